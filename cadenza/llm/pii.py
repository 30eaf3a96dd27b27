"""Personal data by bootstrapped contextual extraction, in DataFrame functions.

Seeds are what fixed expressions find (BASE), as a whole; of cards and phones
their digits count. The words beside a token that could be an identifier (it has
a digit or an @; digit groups with a space between also make one) are its
patterns: two words and one word, before it and after it, other such tokens
and the ends of the text standing as words. Patterns and tokens make a graph, on
which rounds run until one finds nothing:

- a pattern's confidence for a kind is the share of its distinct tokens that
  are known to be of this kind, if enough of them are;
- a token is taken into a kind if its patterns of one sort (by side and number
  of words), on average over those with enough tokens to tell, are confident
  enough and it has the kind's least shape; wherever it occurs it is known then.

What can be discovered is a token with a digit or an @, and of digit groups as
many as have MOST_DIGITS digits together, the most that a card has. The scan is
linear in a text but for sorting, however many spans it has.

Only pairs of (pattern, token) are shuffled, distinct before and counted with
partial aggregation. Texts are read once: what the expressions find goes to a
table in the shared folder, without the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.session import written

#: kind -> expression. Written so that no text makes them slow: a run of
#: characters is tried from its start (or from the end of the match before) and
#: is not given back where giving it back can't help.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of that kind.
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A token that could be an identifier.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: The least that a discovered token of a kind looks like, without punctuation around it.
SHAPE = {"email": r"^[^@]+@[^@]+$", "ip": r"^[0-9a-fA-F]+([.:][0-9a-fA-F]+){3,}$", "card": r"^([^0-9]*[0-9]){12,19}[^0-9]*$", "phone": r"^([^0-9]*[0-9]){7,15}[^0-9]*$"}
#: What a digit group looks like that another can follow after a space, and one
#: that can follow; a token of digit groups as a whole, which its digits stand for.
GROUP = r"^\p{Punct}*+(?<![@/_])[0-9][0-9().-]*+(?<=[0-9)])$"
LATER_GROUP = r"^\(?[0-9][0-9().-]*+\p{Punct}*+$"
NUMBER = r"^[+(]*+[0-9][0-9 ().-]*+$"
#: The most digits that groups have together.
MOST_DIGITS = 19
#: Distinct known tokens that a pattern needs, and its least confidence.
SUPPORT = 3
CONFIDENCE = 0.8
_STEP = 256

PIECE = "array<struct<start:int,end:int,value:string,left:string,right:string,free:boolean,leads:boolean,follows:boolean,digits:int>>"
SPAN = "array<struct<kind:int,start:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it, also
    inside of lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def running(lengths: Column) -> Column:
    """Running sums of an array of ints; linear but for a factor of _STEP."""

    def of(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _STEP).cast("int")), lambda k: F.slice(a, k * _STEP + 1, _STEP))
        return let(F.struct(blocks.alias("blocks"), F.transform(blocks, _total).alias("sums")), lambda v: F.flatten(F.transform(v["blocks"], lambda b, k: let(_total(F.slice(v["sums"], F.lit(1), k)), lambda before: F.transform(b, lambda _, i: before + _total(F.slice(b, F.lit(1), i + 1)))))))

    return let(lengths, lambda a: F.when(F.size(a) > 0, of(a)).otherwise(F.array().cast("array<int>")))


def counted(points: Column, queries: Column, upto: bool) -> Column:
    """For each query the number of points below it, or, with upto, not above
    it; arrays of ints in any order. Both are sorted together and counted."""
    marks = F.concat(
        F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(int(not upto)).alias("side"), F.lit(-1).alias("i"))),
        F.transform(queries, lambda q, i: F.struct(q.alias("at"), F.lit(int(upto)).alias("side"), i.alias("i"))),
    )

    def ranked(ordered: Column) -> Column:
        upto_here = running(F.transform(ordered, lambda m: (m["i"] < 0).cast("int")))
        both = F.zip_with(ordered, upto_here, lambda m, n: F.struct(m["i"].alias("i"), n.alias("n")))
        return F.transform(F.array_sort(F.filter(both, lambda m: m["i"] >= 0)), lambda m: m["n"])

    return let(F.array_sort(marks), ranked)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before>> of the leftmost non-overlapping
    matches: code points, and the text from the match before to this one."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(hits.alias("hit"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("part"))

    def placed(z: Column) -> Column:
        ends = running(F.transform(z, lambda m: F.char_length(m["part"]) + F.char_length(m["hit"])))
        return F.zip_with(z, ends, lambda m, end: F.struct((end - F.char_length(m["hit"])).alias("start"), end.alias("end"), m["hit"].alias("value"), m["part"].alias("before")))

    return let(both, placed)


def _luhn(digits: Column) -> Column:
    def add(back: Column) -> Column:
        def step(total: Column, i: Column) -> Column:
            d = F.ascii(F.substring(back, i + 1, F.lit(1))) - 48
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return total + F.when(i % 2 == 1, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), F.char_length(back) - 1), F.lit(0), step)

    return let(F.reverse(digits), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return let(digits, lambda d: F.when(F.char_length(d).between(13, 19), _luhn(d)).otherwise(False))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, base, tokens) of each row, without the text: base spans with
    kinds numbered as in BASE; and as tokens the base spans, the identifier-like
    tokens outside them, and what digit groups with a space between make
    together. first: no longer token starts there; last: its first group starts
    the groups."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")

    def spans(k: int, kind: str) -> Column:
        hits = F.filter(located(F.col("text"), BASE[kind]), lambda s: _holds(kind, s["value"]))
        numbered = F.transform(hits, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        return F.when(F.col("text").rlike(HINT[kind]), numbered).otherwise(none)

    rows = rows.withColumn("found", F.flatten(F.array(*(spans(k, kind) for k, kind in enumerate(BASE)))))
    parts = F.transform(F.split("text", TOKEN, -1), lambda p: F.struct(_edge(p).alias("head"), F.reverse(_edge(F.reverse(p))).alias("tail"), (p == " ").alias("space")))

    def piece(around: Column, free: Column, s: Column, i: Column) -> Column:
        def words(j: Column, side: str) -> Column:
            return F.nullif(F.get(around, j)[side], F.lit(""))

        left = F.when(i == 0, F.concat_ws(" ", F.lit("^ ^"), words(i, "tail"))).otherwise(F.concat_ws(" ", F.when(i == 1, "^").otherwise("#"), words(i - 1, "tail"), F.lit("#"), words(i, "tail")))
        right = F.when(i == F.size(around) - 2, F.concat_ws(" ", words(i + 1, "head"), F.lit("$ $"))).otherwise(F.concat_ws(" ", words(i + 1, "head"), F.lit("#"), words(i + 2, "head"), F.when(i == F.size(around) - 3, "$").otherwise("#")))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["value"].alias("value"),
            F.substring_index(left, " ", -2).alias("left"),
            F.substring_index(right, " ", 2).alias("right"),
            free.alias("free"),
            (free & s["value"].rlike(GROUP)).alias("leads"),
            (free & F.get(around, i)["space"] & s["value"].rlike(LATER_GROUP)).alias("follows"),
            F.char_length(F.regexp_replace(s["value"], "[^0-9]", "")).alias("digits"),
        )

    # A piece is free of base spans if as many end before it as start before its
    # end; both sides are counted, no piece is held against every span.
    field = lambda a, name: F.transform(a, lambda x: x[name])
    hits = let(
        F.struct(F.col("found").alias("base"), parts.alias("around"), located(F.col("text"), TOKEN).alias("hits")),
        lambda v: let(
            F.struct(counted(field(v["base"], "end"), field(v["hits"], "start"), True).alias("ended"), counted(field(v["base"], "start"), field(v["hits"], "end"), False).alias("begun")),
            lambda n: F.transform(v["hits"], lambda s, i: piece(v["around"], F.get(n["ended"], i) == F.get(n["begun"], i), s, i)),
        ),
    )
    rows = rows.withColumn("pieces", F.when(F.col("text").rlike("[0-9@]"), hits).otherwise(F.array().cast(PIECE)))

    def seed(n: Column, b: Column, i: Column) -> Column:
        first, last = F.get(n["ended"], i), F.get(n["begun"], i) - 1
        value = F.when(b["kind"] >= 2, F.regexp_replace(b["value"], "[^0-9]", "")).otherwise(b["value"])
        left, right = (F.when(first <= last, F.get("pieces", at)[side]).alias(side) for at, side in ((first, "left"), (last, "right")))
        return F.struct(b["start"].alias("start"), b["end"].alias("end"), value.alias("token"), left, right, F.lit(True).alias("first"), F.lit(True).alias("last"), b["kind"].alias("known"))

    def reading(group: Column, n: Column, longest: Column) -> Column:
        a, z = F.get(group, F.lit(0)), F.get(group, n - 1)
        value = F.array_join(F.transform(F.slice(group, F.lit(1), n), lambda s: s["value"]), " ")

        def stripped(value: Column) -> Column:
            lead = F.char_length(F.regexp_extract(value, r"^[\p{Punct}&&[^+(@]]*", 0))
            tail = F.char_length(F.regexp_extract(value, r"[\p{Punct}&&[^)]]*$", 0))
            bare = F.substring(value, lead + 1, F.char_length(value) - lead - tail)
            token = let(bare, lambda t: F.when(t.rlike(NUMBER) & ~t.rlike(r"^[0-9]+(\.[0-9]+){3,}$"), F.regexp_replace(t, "[^0-9]", "")).otherwise(t))
            return F.struct((a["start"] + lead).alias("start"), (z["end"] - tail).alias("end"), token.alias("token"), a["left"].alias("left"), z["right"].alias("right"), (n == longest).alias("first"), (~a["follows"]).alias("last"), F.lit(None).cast("int").alias("known"))

        return let(value, stripped)

    def reach(group: Column) -> Column:
        """How many of the pieces, from the first, can be one token."""
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("digits"), F.lit(True).alias("on"))

        def step(x: Column, s: Column) -> Column:
            on = (x["n"] == 0) | (x["on"] & s["follows"] & (x["digits"] + s["digits"] <= MOST_DIGITS))
            return F.struct((x["n"] + on.cast("int")).alias("n"), (x["digits"] + s["digits"]).alias("digits"), (on & s["leads"]).alias("on"))

        return F.aggregate(group, start, step)["n"]

    def readings(s: Column, i: Column) -> Column:
        group = F.slice("pieces", i + 1, F.when(s["leads"], MOST_DIGITS).otherwise(1))
        many = let(group, lambda g: let(reach(g), lambda n: F.transform(F.sequence(F.lit(1), n), lambda m: reading(g, m, n))))
        return F.when(s["free"], many)

    free = F.flatten(F.filter(F.transform("pieces", readings), lambda r: r.isNotNull()))
    touched = F.struct(counted(field("pieces", "end"), field("found", "start"), True).alias("ended"), counted(field("pieces", "start"), field("found", "end"), False).alias("begun"))
    seeds = let(touched, lambda n: F.transform("found", lambda b, i: seed(n, b, i)))
    tokens = F.concat(seeds, F.filter(free, lambda t: t["end"] > t["start"]))
    base = F.transform("found", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return rows.select("id", "hash", base.alias("base"), tokens.alias("tokens"))


def _edge(text: Column) -> Column:
    """The first two words of a text, or what there is of them."""
    return F.lower(F.regexp_replace(F.regexp_extract(text, r"^\s*+(\S++(?:\s++\S++)?+)", 1), r"\s+", " "))


def _kinds(token: Column, kind: Column | None = None) -> Column:
    """Whether a token has the least shape of this kind, or of any."""
    out = F.lit(False)
    for k, name in enumerate(BASE):
        fits = token.rlike(SHAPE[name])
        out |= fits if kind is None else (kind == k) & fits
    return out


def paired(tokens: DataFrame) -> DataFrame:
    """Distinct (side, pattern, token, known, counts) of (token, known, left,
    right, first, last): one pattern of two words and one of one word on each
    side. counts: the token is the one that the pattern is about there."""
    sides = [("l2", F.col("left"), "first"), ("l1", F.substring_index("left", " ", -1), "first"), ("r2", F.col("right"), "last"), ("r1", F.substring_index("right", " ", 1), "last")]
    each = F.array(*(F.struct(F.lit(side).alias("side"), F.when(F.char_length(p) > 80, F.md5(p)).otherwise(p).alias("pattern"), F.col(main).alias("counts")) for side, p, main in sides))
    flat = tokens.select("token", "known", F.explode(each).alias("e")).select("e.side", "e.pattern", "token", "known", "e.counts")
    return flat.groupBy("side", "pattern", "token", "known").agg(F.max("counts").alias("counts"))


def bootstrapped(pairs: DataFrame, rounds: int | None = None, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(token, kind) of the tokens that are known or discovered; rounds: None
    for as many as find something. pairs: as paired() returns them."""
    known = pairs.filter("known is not null").select("token", F.col("known").alias("kind")).distinct()
    edges = pairs.groupBy("side", "pattern", "token").agg(F.max("counts").alias("counts"))
    # A pattern of fewer tokens is never scored, and says nothing of its tokens.
    sizes = edges.filter("counts").groupBy("side", "pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    edges = written(edges.filter(_kinds(F.col("token"))).join(sizes, ["side", "pattern"]), "pii-edges")
    # Over all patterns of a token on a side: those that know nothing count as 0.
    degree = edges.groupBy("token", "side").agg(F.count("*").alias("degree"))
    discovered, before, r = None, 0, 0
    while rounds is None or r < rounds:
        every = known if discovered is None else known.union(discovered).distinct()
        scored = edges.filter("counts").join(every, "token").groupBy("side", "pattern", "kind").agg(F.count("*").alias("hits"), F.first("n").alias("n")).filter(F.col("hits") >= support)
        scored = scored.select("side", "pattern", "kind", (F.col("hits") / F.col("n")).alias("confidence"))
        instances = edges.join(scored, ["side", "pattern"]).groupBy("token", "side", "kind").agg(F.sum("confidence").alias("sum")).join(degree, ["token", "side"]).filter(F.col("sum") / F.col("degree") >= confidence)
        now = instances.filter(_kinds(F.col("token"), F.col("kind"))).select("token", "kind").distinct().join(known.select("token").distinct(), "token", "left_anti")
        discovered = written(now if discovered is None else discovered.union(now).distinct(), f"pii-round-{r}")
        r, after = r + 1, discovered.count()
        if after == before:
            break
        before = after
    every = known if discovered is None else known.union(discovered)
    return every.groupBy("token").agg(F.min("kind").alias("kind"))


def personal_data(docs: DataFrame, rounds: int | None = None, support: int = SUPPORT, confidence: float = CONFIDENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans) for each row of docs: arrays of (kind, start, end)
    by kind, numbered as in BASE, then start; code points, end exclusive. spans
    holds base and what the patterns discover outside of base spans, of spans of
    a kind that lie in each other the longest. A null text is empty. Rows with
    equal ids and texts have equal results; ids may be null. Other columns are
    not read.
    """
    found = written(scanned(docs, id_col, text_col), "pii-scan")
    each = found.filter(F.size("tokens") > 0).select("id", "hash", F.explode("tokens").alias("t")).select("id", "hash", "t.*")
    pairs = written(paired(each), "pii-pairs")
    new = bootstrapped(pairs, rounds, support, confidence)
    added = each.filter("known is null").join(new, "token").select("id", "hash", F.col("kind").cast("int").alias("kind"), "start", "end").distinct()
    earlier = Window.partitionBy("id", "hash", "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("reached", F.max("end").over(earlier)).filter("reached is null or end > reached")
    added = added.groupBy("id", "hash").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    same = F.col("f.id").eqNullSafe(F.col("a.id")) & F.col("f.hash").eqNullSafe(F.col("a.hash"))
    joined = found.alias("f").join(added.alias("a"), same, "left")
    return joined.select(F.col("f.id").alias(id_col), F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN)))).alias("spans"))


def written_spans(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, BASE))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
