"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and replayed, pass
after pass. A document's virtual finish time in pass e is

    (e * size of the source + words up to and with it) / target of its source

so all sources run at the pace of their targets. The mix is the whole stream,
sorted by finish time, cut where the budget is spent. Copies of a row queue like
other rows, each in a place of its own.

No step gathers a source, the stream, or the list of sources in one task or on
the driver: running sums are taken in two levels, inside narrow slices of the
order (a slice of the shuffle hash; a slice of finish time) and over the slices'
totals, and both kinds of slice hold about as many words each whatever the
sources' sizes. Texts are left at the scan: only (id, source, size, hash) rows
are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.session import partitions, written
from cadenza.operators.ordered import numbered, running, summed

#: Copies of a row that are written out at a time.
_COPIES = 1 << 12
WORD = r"[^\x20\x09-\x0D]+"

#: Gives sources (source, n, big) a column weight, above 0.
Weigh = Callable[[DataFrame], DataFrame]


def cycle_123(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, ... to the sources by code point, null last."""
    placed = numbered(sources.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_number", "mix-sources")
    return placed.withColumn("weight", (1 + (F.col("_number") - 1) % 3).cast("double")).drop("_null", "_number")


def weights(given: Mapping[str | None, float], default: float = 1.0) -> Weigh:
    """Weights by name, for a list that a user writes down."""

    def weigh(sources: DataFrame) -> DataFrame:
        weight = F.lit(default)
        for name, w in given.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        return sources.withColumn("weight", weight)

    return weigh


def fair_targets(weighted: DataFrame, budget: float, most_passes: int) -> DataFrame:
    """(source, n, big, weight) with target: shares of the budget by weight,
    none above most_passes times its source's size; what a full source can't
    take is shared again by weight. Sources fill up in ascending order of room
    per weight, so the first that does not fill gives the level of all after
    it: running sums, no rounds."""
    rows = weighted.withColumns({"_room": most_passes * F.col("n"), "_null": F.col("source").isNull()}).withColumn("_ratio", F.col("_room") / F.col("weight"))
    order = ["_ratio", "_null", "source"]
    rows = written(running(rows, [], order, {"_rooms": "_room", "_weights": "weight"}, what="mix-rooms"), "mix-levels")
    whole = rows.agg(F.sum("weight").alias("w")).first()["w"]
    level = (F.lit(float(budget)) - (F.col("_rooms") - F.col("_room"))) / (F.lit(whole) - (F.col("_weights") - F.col("weight")))
    rows = rows.withColumns({"_level": level, "_place": F.struct(*order)})
    open_ = rows.filter(F.col("_level") * F.col("weight") <= F.col("_room")).agg(F.min(F.struct("_place", "_level")).alias("o")).first()["o"]
    if open_ is None:
        target = F.col("_room").cast("double")
    else:
        first, null, name = open_["_place"]
        # Nulls come first in a struct's order, but there is one null source and
        # the flag before it says so.
        after = F.col("_place") >= F.struct(F.lit(first).alias("_ratio"), F.lit(null).alias("_null"), F.lit(name).cast("string").alias("source"))
        target = F.when(after, F.lit(open_["_level"]) * F.col("weight")).otherwise(F.col("_room").cast("double"))
    return rows.withColumn("target", target).select(*weighted.columns, "target")


def last_moment(targets: DataFrame, budget: float, most_passes: int) -> float | None:
    """A finish time by which the stream has surely spent the budget, or is at
    its end; None if no source has a target. A source is never more than one
    document behind its pace."""
    some = targets.filter("target > 0")
    room = most_passes * F.col("n")
    found = some.agg(F.max(room / F.col("target")).alias("end"), F.sum("big").alias("slack")).first()
    if found["end"] is None:
        return None
    moments = [1.0]
    while moments[-1] < found["end"]:
        moments.append(1 + 2**-20 * 2.0 ** (len(moments) - 1))
    emitted = some.agg(*[F.sum(F.least(F.lit(t) * F.col("target"), room.cast("double"))).alias(f"t{i}") for i, t in enumerate(moments)]).first()
    return next((min(t, found["end"]) for t, words in zip(moments, emitted, strict=True) if words - found["slack"] >= budget), found["end"])


def _each_copy(rows: DataFrame) -> DataFrame:
    """A row for each of its copies, with `copy` from `before` on. Very many copies are
    dealt out before they are written, and no array is long."""
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / _COPIES)))
    many = rows.filter(F.col("copies") > _COPIES).withColumn("_block", block).repartition(partitions(rows.sparkSession), "turn", "_block")
    blocks = rows.filter(F.col("copies") <= _COPIES).withColumn("_block", F.lit(0).cast("bigint")).unionByName(many)
    last = F.least(F.col("copies"), (F.col("_block") + 1) * _COPIES) - 1
    return blocks.withColumn("copy", F.explode(F.sequence(F.col("before") + F.col("_block") * _COPIES, F.col("before") + last))).drop("_block", "copies", "before")


def mix_decisions(docs: DataFrame, weigh: Weigh = cycle_123, most_passes: int = 3, budget_share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", variant: Column | None = None) -> DataFrame:
    """One row for each row of docs: (turn, variant, id, size, source_size,
    target, passes). See `mix_sources`; `turn` is as of `turn_of`. variant is an
    expression over docs that tells rows of one turn apart; the mix is the same
    with and without it."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(
        turn_of(id_col, text_col, source_col).alias("turn"),
        (F.lit("") if variant is None else variant).alias("variant"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    rows = written(rows.groupBy("turn", "variant", "id", "source", "size").agg(F.count("*").alias("copies")), "mix-sizes")
    before = F.lit(0).cast("bigint")
    if variant is not None and (rows.groupBy("turn").count().agg(F.max("count").alias("n")).first()["n"] or 0) > 1:
        rows = running(rows, ["turn"], ["variant"], {"upto": "copies"}, what="mix-variants")
        before = F.col("upto") - F.col("copies")
    rows = rows.withColumn("before", before).drop("upto")
    sources = written(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("size").alias("big")), "mix-source-sizes")
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    budget = min(budget_share, most_passes) * total
    targets = written(fair_targets(weigh(sources), budget, most_passes), "mix-targets")
    sizes = targets.select("source", F.col("n").alias("source_size"), "target")

    # Copies have places of their own in the shuffle. Slices of the hash hold
    # equal shares of each source; a source is joined in as many slices.
    place = F.when(F.col("copy") == 0, F.col("turn")).otherwise(F.md5(F.concat_ws("/", "turn", "copy").cast("binary")))
    queue = _each_copy(rows).withColumn("place", place).withColumn("slice", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint") * n / (1 << 32)).cast("int"))
    sizes = sizes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    planned = queue.alias("r").join(sizes.alias("p"), (F.col("r.slice") == F.col("p.slice")) & F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", "p.source_size", "p.target")
    queued = summed(planned, ["source"], "slice", ["place"], {"upto": "size"})
    end = last_moment(targets, budget, most_passes) if total else None
    if end is None:
        return queued.withColumn("passes", F.lit(0)).select("turn", "variant", "id", "size", "source_size", "target", "passes")
    queued = written(queued, "mix-queue")
    finish = lambda e: (e * F.col("source_size") + F.col("upto")) / F.col("target")

    # Every slice of time takes the same share of each target, thus about the
    # same words; the few words due after time 1 are sliced apart.
    timed = queued.filter((F.col("target") > 0) & (F.col("size") > 0)).select("place", "size", F.explode(F.array(*[F.struct(F.lit(e).alias("pass"), finish(e).alias("finish")) for e in range(most_passes)])).alias("p")).select("place", "size", "p.*").filter(F.col("finish") <= end)
    late = n + F.floor((F.col("finish") - 1) / max(end - 1, 1e-12) * n)
    timed = timed.withColumn("span", F.when(F.col("finish") < 1, F.floor(F.col("finish") * n)).otherwise(late).cast("int"))
    stream = summed(timed, [], "span", ["finish", "place", "pass"], {"spent": "size"})
    cut = stream.filter(F.col("spent") <= budget).agg(F.max(F.struct("finish", "place", "pass")).alias("cut")).first()["cut"]
    if cut is None:
        taken = F.lit(0)
    else:
        last = F.struct(F.lit(cut["finish"]).alias("finish"), F.lit(cut["place"]).alias("place"), F.lit(cut["pass"]).alias("pass"))
        taken = sum((F.when((F.col("target") > 0) & (F.struct(finish(e).alias("finish"), F.col("place"), F.lit(e).alias("pass")) <= last), 1).otherwise(0) for e in range(most_passes)), F.lit(0))
    return queued.withColumn("passes", F.when(F.col("size") > 0, taken).otherwise(0)).select("turn", "variant", "id", "size", "source_size", "target", "passes")


def turn_of(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Column:
    """A row's place in the shuffle: a hash of its id, source and text."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in (id_col, source_col)]
    return F.md5(F.concat_ws("/", *parts, F.coalesce(F.md5(F.col(f"`{text_col}`").cast("binary")), F.lit("\x00"))).cast("binary"))


def mix_sources(docs: DataFrame, weigh: Weigh = cycle_123, most_passes: int = 3, budget_share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, taken) for each row of docs.

    size is the number of words (null text: 0). A null source is a source of
    its own. taken is size times the passes that take the row, 0 to
    most_passes. Rows that are equal in id, source and text queue one by one,
    so of many copies some may be taken once more than others; which of them is
    of no account, as they are equal. A source of no words has target 0, an
    empty table gives no row. Other columns are not read. The order is a
    hash's, so reruns agree.
    """
    decided = mix_decisions(docs, weigh, most_passes, budget_share, id_col, text_col, source_col)
    return decided.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as `mix_sources` takes it,
    with all its columns."""
    names = [options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    variant = F.md5(F.to_json(F.struct(*others)).cast("binary")) if others else F.lit("")
    decided = written(mix_decisions(docs, **options, variant=variant).groupBy("turn", "variant").agg(F.sum("passes").alias("passes"), F.count("*").alias("copies")), "mix-decided")
    # The row as one column, so that its names clash with none here. Rows that
    # are equal in all columns are one row, taken as often as all of them.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), turn_of(*names).alias("turn"), variant.alias("variant"))
    if decided.agg(F.max("copies").alias("c")).first()["c"] not in (None, 1):
        rows = rows.groupBy("turn", "variant").agg(F.first("row").alias("row"))
    rows = rows.join(decided.filter("passes > 0").select("turn", "variant", "passes"), ["turn", "variant"])
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("passes") - 1) / _COPIES)))
    blocks = rows.withColumn("block", block).withColumn("here", F.least(F.col("passes") - F.col("block") * _COPIES, F.lit(_COPIES)))
    return blocks.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "here")).alias("pass")).select("row.*")
