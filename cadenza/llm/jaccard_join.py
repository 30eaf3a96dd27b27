"""N-gram Jaccard join by vertical partitioning.

The distinct 5-word shingles of all documents have a global order: by document
frequency class, then by hash. The hash order is cut into fragments
(`fragments`), which count separately in how many documents each shingle
occurs; a document sums its fragments' answers. Since a linked document shares
at least 80 % of its shingles with another, documents with fewer shared ones
are done. Of the others, only the shared shingles are kept from here on.

1. Documents with equal sets are one class, named by its smallest id; the join
   is between class representatives.
2. A representative's prefix is its first n - ceil(0.8 n) + 1 shingles in the
   global order: linked sets have a prefix shingle in common. Each prefix
   shingle has a leader, the representative with the smallest part of unshared
   shingles: the middle of a group of near copies, if there is one.
3. Representatives are compared with the leaders of their shingles, if their
   sizes allow a link, which links groups of near copies without their pairs.
4. What is then still in another component than its leader is compared with
   all that this leader leads; with that, every pair that shares a prefix
   shingle is linked, in one component already, or has been compared.
5. Components of the links.

A comparison counts the overlap fragment by fragment and sums per pair, giving
up pairs whose remaining shingles can't reach the threshold. Compared groups
are cut into blocks, so no task holds more than BLOCK members of a group.
Shingles are told apart by 64-bit hashes, and sets by 128 bits and their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import components
from cadenza.llm.fragments import batched, classes, doc_values, looked_up
from cadenza.llm.session import partitions, written
from cadenza.llm.wordhash import Words, mix, run_owner, runs

SHINGLE = 5
#: A link: PERCENT of the union is in both.
PERCENT = 80
#: Members of a block that is compared with a leader, and members (and probes)
#: of one that is compared with what is still apart.
LED, BLOCK = 256, 2000
#: Parts of the hash order in which a comparison counts overlaps.
PARTS = 8


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and the text of each; a text of fewer
    words, but not none, has its whole sequence as one."""
    h = words.hashes()
    starts, text = run_owner(words.first, k)
    full = runs(h, k)[starts] if len(starts) else np.empty(0, np.uint64)
    n = np.diff(words.first)
    values, owners = [full], [text]
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            values.append(mix(runs(h, m)[words.first[short]] + np.uint64(m)))
            owners.append(short)
    return np.concatenate(values), np.concatenate(owners)


def _least(n: np.ndarray | int, percent: int):
    """Overlap that a set of n shares at least with a linked one."""
    return -(-percent * n // 100)


def shingle_sets(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, n, s1, s2, unshared, shared, prefix): the text's hash; n
    shingles; s1, s2 a fingerprint of the set. The last three are null unless enough shingles are
    shared: the number of unshared ones, the shared ones ascending (packed
    64-bit), and the shared ones in the prefix."""
    rows = batched(docs, id_col, text_col)
    fragments = partitions(docs.sparkSession)

    def extract(words: Words) -> tuple[np.ndarray, np.ndarray]:
        return shingles(words, k)

    def sets(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        values, first = doc_values(table.column("text").to_pylist(), "lower", extract)
        found = looked_up(values, answers, fragments)
        n = np.diff(first)
        full = np.concatenate([[0], np.cumsum(found > 0)])
        common = full[first[1:]] - full[first[:-1]]
        kept = (n > 0) & (common >= _least(n, percent))
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (values, mix(values ^ np.uint64(0x5851F42D4C957F2D)))]
        prints = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
        shared, prefix = [None] * len(n), [None] * len(n)
        for i in np.flatnonzero(kept).tolist():
            v, c = values[first[i] : first[i + 1]], found[first[i] : first[i + 1]]
            v, c = v[c > 0], c[c > 0]
            shared[i] = v.tobytes()
            length = int(n[i] - _least(n[i], percent) + 1 - (n[i] - common[i]))
            prefix[i] = v[np.lexsort((v, c))[:length]].view(np.int64).tolist()
        unshared = [int(x) if k else None for x, k in zip(n - common, kept, strict=True)]
        columns = [table.column("id"), table.column("hash"), pa.array(n, pa.int64()), pa.array(prints[0]), pa.array(prints[1]), pa.array(unshared, pa.int64()), pa.array(shared, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
        return pa.table(dict(zip(kinds, columns, strict=True)))

    kinds = {"id": pa.int64(), "hash": pa.int64(), "n": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "unshared": pa.int64(), "shared": pa.binary(), "prefix": pa.list_(pa.int64())}
    schema = "id bigint, hash bigint, n bigint, s1 bigint, s2 bigint, unshared bigint, shared binary, prefix array<bigint>"
    answers = classes(rows, "lower", extract)
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(sets, schema)


def compared(members: DataFrame, probes: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) between a group's probes and its members. members, probes:
    distinct (leader, id). Both are cut into blocks of about `block`; each block
    of probes meets each block of members of its group."""
    size = lambda df, name: df.groupBy("leader").agg(F.ceil(F.count("*") / block).alias(name))
    blocks = size(members, "mb").join(size(probes, "pb"), "leader")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    placed = (members.join(blocks, "leader").select("leader", "id", F.lit(False).alias("probe"), place("mb").alias("m"), every("pb").alias("p"))).union(
        probes.join(blocks, "leader").select("leader", "id", F.lit(True).alias("probe"), every("mb").alias("m"), place("pb").alias("p"))
    )
    rows = placed.join(sets.select("id", "n", "unshared", "shared"), "id").select("leader", "m", "p", "id", "probe", "n", "unshared", "shared")

    def links(table: pa.Table) -> pa.Table:
        probe = table.column("probe").to_numpy(zero_copy_only=False)
        ids, n, unshared = (table.column(c).to_numpy() for c in ("id", "n", "unshared"))
        packed = table.column("shared").to_pylist()
        inside = np.flatnonzero(~probe)
        held = [np.frombuffer(packed[i], "<u8") for i in inside]
        owner = np.repeat(np.arange(len(inside)), [len(x) for x in held])
        values = np.concatenate(held) if held else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        mn, mu = n[inside], unshared[inside]
        edges = np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS)
        a, b = [], []
        for i in np.flatnonzero(probe).tolist():
            mine = np.frombuffer(packed[i], "<u8")
            # Overlap is at most the smaller shared part; unions hold both unshared parts.
            most = np.minimum(n[i] - unshared[i], mn - mu)
            open_ = (100 * most >= percent * np.maximum(n[i] + mu, mn + unshared[i])) & (ids[inside] != ids[i])
            overlap = np.zeros(len(inside), np.int64)
            rest = len(mine)
            for part in np.split(mine, np.searchsorted(mine, edges)):
                if not open_.any():
                    break
                low, high = np.searchsorted(values, part, "left"), np.searchsorted(values, part, "right")
                count = high - low
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                overlap += np.bincount(owner[at], minlength=len(inside))
                rest -= len(part)
                open_ &= (100 + percent) * (overlap + rest) >= percent * (n[i] + mn)
            linked = open_ & ((100 + percent) * overlap >= percent * (n[i] + mn))
            b += ids[inside][linked].tolist()
            a += [ids[i]] * int(linked.sum())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("leader", "m", "p").applyInArrow(links, "a bigint, b bigint")


def row_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, n, component) for each row of docs: see `jaccard_classes`."""
    sets = written(shingle_sets(docs, k, percent, id_col, text_col), "shingle-sets")
    key = ["s1", "s2", "n"]
    # A class of null ids alone goes by a hash of its set.
    classes_ = sets.filter("shared is not null").groupBy(*key).agg(F.min("id").alias("real")).withColumn("rep", F.coalesce("real", F.xxhash64(*key)))
    reps = sets.filter("shared is not null").join(classes_, key).filter("real is null or id = real").dropDuplicates(key)
    reps = written(reps.select(F.col("rep").alias("id"), "n", "unshared", "shared", "prefix"), "representatives")

    rank = F.struct((F.col("unshared") / F.col("n")).alias("part"), F.col("id").alias("id"), "n", "unshared")
    prefix = reps.select("id", rank.alias("rank"), F.explode("prefix").alias("shingle"))
    leaders = prefix.groupBy("shingle").agg(F.min("rank").alias("first"), F.count("*").alias("df")).filter("df > 1").select("shingle", F.col("first").alias("l"))
    pairs = prefix.join(leaders, "shingle").filter("l.id <> id").select(F.col("l.id").alias("leader"), "id", "l", "rank")
    # What overlap the sizes allow: a leader gets only the sets it could link with.
    most = F.least(F.col("l.n") - F.col("l.unshared"), F.col("rank.n") - F.col("rank.unshared"))
    union = F.greatest(F.col("l.n") + F.col("rank.unshared"), F.col("rank.n") + F.col("l.unshared"))
    led = written(pairs.select("leader", "id", (100 * most >= percent * union).alias("near")).distinct(), "led")
    near = led.filter("near").select("leader", "id")
    led = led.select("leader", "id")
    heads = near.select("leader").distinct().select("leader", F.col("leader").alias("id"))

    links = written(compared(near, heads, reps, percent, LED), "links")
    part = components(links)
    named = led.join(part.toDF("id", "c"), "id", "left").join(part.toDF("leader", "lc"), "leader", "left")
    apart = named.filter(F.coalesce("c", "id") != F.coalesce("lc", "leader")).select("leader", "id")
    rest = compared(led, written(apart, "apart"), reps, percent, BLOCK)
    part = components(links.union(rest))

    found = classes_.join(part, classes_.rep == part.node, "left").select(*key, "real", F.coalesce("component", "rep").alias("group"))
    # A component is named by its least id, not by a class of null ids.
    names = found.groupBy("group").agg(F.min("real").alias("name"))
    found = found.join(names, "group").select(*key, "name", F.lit(True).alias("known"))
    return sets.select("id", "hash", *key).join(found, key, "left").select("id", "hash", "n", F.when(F.col("known"), F.col("name")).otherwise(F.col("id")).alias("component"))


def jaccard_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of docs.

    Words are runs of bytes other than space and 0x09-0x0D, with A-Z
    lower-cased. A text of fewer than k words, but not none, has its whole
    sequence as one shingle; a null or wordless text has none, links with
    nothing, and is its own component. component_id is the smallest id among
    the rows that links reach. A row with a null id takes part, but names no
    component: reached by itself alone, its component is null. Rows with equal
    ids are separate rows, each with the component of its own set. Other
    columns are not read. Ids are bigint.
    """
    found = row_classes(docs, k, percent, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns, but of each component only the row whose id names
    it. Rows of a component without an id stay; equal rows become one."""
    found = row_classes(docs, k, percent, id_col, text_col)
    named = found.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("r")).select("r.id", "r.hash")
    # An unnamed component has null ids alone.
    kept = named.union(found.filter("component is null").select("id", "hash").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col).cast("string").cast("binary")).alias("hash"))
    same = F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.hash") == F.col("k.hash"))
    return rows.alias("d").join(kept.alias("k"), same, "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
