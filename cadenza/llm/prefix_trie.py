"""The trie of conversations' shared beginnings, by its Patricia tree.

Conversations are sorted, turn by turn. What two neighbours share ends at a
branch; branches, conversations' ends and leaves are the points of the
compressed tree, at most two for each distinct conversation, and all turns
between two points are one edge. In the sorted order the members of a point are
an interval of ranks, and the points below it follow it in preorder; so whatever
is summed over a subtree is the difference of two running sums, without going
down the tree level by level. The turns of an edge have the members of the point
at its end, and their sums differ by what the edge has from there on.

A turn is a digest of its role and text; texts stay at the scan. A beginning is
known by its depth and the exclusive or of its turns' hashes with their places,
128 bits. No step holds a whole conversation, its members or all points:
running sums are taken in slices, and sort keys stand for CHUNK turns at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.session import partitions, written
from cadenza.operators.ordered import numbered, ordered, running

#: Turns whose digests are one part of a sort key; turns, or ranks, that are
#: summed or joined at a time; bits of ids that are listed at a time.
CHUNK, SLICE, LIST_BITS = 256, 4096, 16
_BEGINNING = ["depth", "p1", "p2"]


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, key, bytes): the turns of each conversation, numbered from 1
    by turn, null first; turns of one number by role and then by digest. A null
    role or text is empty. key is the digest of role and text, bytes the length
    of the text in UTF-8. Rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), digest.alias("key"), F.octet_length(text).cast("bigint").alias("bytes"))
    return numbered(rows.filter("conv IS NOT NULL"), ["conv"], ["turn", "role", "key"], "pos", "turns").select("conv", "pos", "key", "bytes")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, n): how many turns each conversation has."""
    return turns.groupBy("conv").agg(F.max("pos").alias("n"))


def slice_of(position: Column) -> Column:
    return F.floor(position / SLICE)


def rooted(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns with a row of position 0 for each conversation."""
    return turns.unionByName(convs.select("conv", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("bigint").alias("bytes")))


def spliced(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """Conversations that begin with others: the first `head` turns of the
    conversation `base` (all if there are fewer, none if there is no such one),
    then their own after the first `head`. Both are expressions of conv. Turns
    as of `ordered_turns`; the result has a row of position 0 for each."""
    own = written(lengths(turns), "lengths")
    each = turns.withColumn("head", head.cast("bigint"))
    tails = each.filter("pos > head").select("conv", F.lit(1).alias("own"), "pos", "key", "bytes")
    takers = own.select(base.alias("base"), F.col("conv").alias("taker"), head.cast("bigint").alias("head")).filter("head > 0")
    takers = takers.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slice_of(F.col("head")))))
    heads = turns.withColumn("slice", slice_of(F.col("pos"))).alias("t").join(takers.alias("k"), (F.col("t.conv") == F.col("k.base")) & (F.col("t.slice") == F.col("k.slice")) & (F.col("t.pos") <= F.col("k.head")))
    heads = heads.select(F.col("taker").alias("conv"), F.lit(0).alias("own"), "pos", "key", "bytes")
    joined = numbered(heads.unionByName(tails), ["conv"], ["own", "pos"], "place", "spliced")
    return rooted(joined.select("conv", F.col("place").alias("pos"), "key", "bytes"), own)


def _digests(where: Column) -> Column:
    """The digests of the turns there, in order, as one text."""
    listed = F.array_sort(F.collect_list(F.when(where, F.struct("pos", F.hex("key").alias("key")))))
    return F.array_join(F.transform(listed, lambda t: t["key"]), "")


def _later_places(turns: DataFrame) -> DataFrame:
    """(conv, later): for conversations of more than CHUNK turns, the places
    that their later parts of CHUNK turns have among all such parts."""
    parts = turns.filter(F.col("pos") > CHUNK).groupBy("conv", F.floor((F.col("pos") - 1) / CHUNK).alias("part")).agg(_digests(F.lit(True)).alias("digests"))
    parts = written(parts.withColumn("same", F.unhex(F.md5(F.col("digests").cast("binary")))), "parts")
    places = ordered(parts.groupBy("same").agg(F.min("digests").alias("digests")), ["digests"], "part-order")
    place = F.concat(F.lpad(F.hex("_part"), 8, "0"), F.lpad(F.hex("_at"), 9, "0"))
    found = parts.drop("digests").join(places.select("same", place.alias("place")), "same")
    listed = F.array_sort(F.collect_list(F.struct("part", "place")))
    return found.groupBy("conv").agg(F.array_join(F.transform(listed, lambda p: p["place"]), "").alias("later"))


def _sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as (conv, n, p1, p2), by what identifies their whole, and
    the distinct ones in sorted order: (conv, n, p1, p2, copies, rank), conv
    being the smallest of the equal ones and rank 0, 1, ... The sort key is the
    digests of the first CHUNK turns, then the places of the later parts."""
    wholes = written(turns.groupBy("conv").agg(F.max("pos").alias("n"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"), _digests(F.col("pos").between(1, CHUNK)).alias("digests")), "wholes")
    kinds = wholes.groupBy("n", "p1", "p2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"), F.first("digests").alias("digests"))
    if (wholes.agg(F.max("n").alias("n")).first()["n"] or 0) > CHUNK:
        kinds = kinds.join(_later_places(turns), "conv", "left").withColumn("later", F.coalesce("later", F.lit("")))
    else:
        kinds = kinds.withColumn("later", F.lit(""))
    ranked = numbered(kinds, [], ["digests", "later"], "rank", "sequences")
    return wholes.drop("digests"), ranked.select("conv", "n", "p1", "p2", "copies", (F.col("rank") - 1).alias("rank"))


def _ends(wholes: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the beginnings at which conversations
    end. Ids are listed for ranges of ids, which bounds a list; the lists of one
    end are hashed as a stream, in order."""
    listed = wholes.groupBy(F.col("n").alias("depth"), "p1", "p2", F.shiftright("conv", LIST_BITS).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = row[:3], hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(row[3].encode())
            if done:
                yield made(done)
        if key is not None:
            yield made([(*key, sha.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*_BEGINNING, "ends_sha256"])

    n = partitions(wholes.sparkSession)
    dealt = listed.repartition(n, *_BEGINNING).sortWithinPartitions(*_BEGINNING, "range").select(*_BEGINNING, "ids")
    return dealt.mapInArrow(digest, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def _points(paths: DataFrame, sequences: DataFrame) -> DataFrame:
    """The compressed tree: (depth, p1, p2, low, high, conv_id, n_convs, upto,
    n_children, up_depth, up_conv, below, n_leaves). Members are the sequences
    of rank low to high; up_* are of the point above; upto is the length of all
    texts to here; below sums what the points under it save."""
    members = paths.groupBy(*_BEGINNING).agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.min("conv").alias("conv_id"), F.sum("copies").alias("n_convs"), F.min("upto").alias("upto"), F.min("x1").alias("x1"), F.min("x2").alias("x2"))
    members = written(members, "members")
    # A sequence leaves the one before it above the first beginning of its own.
    up = F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("p2"))
    shared = members.filter("low > 0").groupBy("low").agg(F.min(up).alias("at"))
    marks = shared.select("at.*", F.lit(1).alias("joins"), F.lit(0).alias("ends"))
    marks = marks.union(sequences.select("n", "p1", "p2", F.lit(0), F.lit(1))).union(members.filter("depth = 0").select(*_BEGINNING, F.lit(0), F.lit(0)))
    # Each time that a neighbour leaves here there is one more way on; the first
    # way leaves a conversation that ends here, or nothing.
    marks = marks.groupBy(*_BEGINNING).agg((F.sum("joins") + 1 - F.max("ends")).alias("n_children"))
    points = written(members.drop("x1", "x2").join(marks, _BEGINNING), "points")

    # Above a point is the one before it on the path of its first member, or,
    # for the first of those, where that member leaves the one before it.
    chain = Window.partitionBy("low").orderBy("depth")
    facts = [*_BEGINNING, "conv_id", "upto"]
    inner = written(points.withColumn("up", F.lag(F.struct(*facts)).over(chain)).join(shared, "low", "left"), "chains")
    # A point from which many lead on is joined in slices of their ranks.
    above = points.withColumn("slice", F.explode(F.sequence(slice_of(F.col("low")), slice_of(F.col("high"))))).select("slice", F.struct(*_BEGINNING).alias("at"), F.struct(*facts).alias("above"))
    tops = inner.filter("up IS NULL").drop("up").withColumn("slice", slice_of(F.col("low"))).join(above, ["slice", "at"], "left")
    linked = inner.filter("up IS NOT NULL").select(*points.columns, "up").unionByName(tops.select(*points.columns, F.col("above").alias("up")))

    edge = F.col("upto") - F.coalesce(F.col("up.upto"), F.lit(0))
    tree = linked.select(*points.columns, F.coalesce(F.col("up.depth"), F.lit(-1)).cast("bigint").alias("up_depth"), F.col("up.conv_id").alias("up_conv"), ((F.col("n_convs") - 1) * edge).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    tree = running(tree, [], ["low", "depth"], {"saved_upto": "saved", "leaves_upto": "leaf"}, what="tree")
    # The last point below one is the end of the last sequence that it has.
    last = tree.groupBy(F.col("low").alias("high")).agg(F.max(F.struct("depth", "saved_upto", "leaves_upto")).alias("last"))
    below = (F.col("last.saved_upto") - F.col("saved_upto")).alias("below")
    return tree.join(last, "high").select(*points.columns, "up_depth", "up_conv", below, (F.col("last.leaves_upto") - F.col("leaves_upto") + F.col("leaf")).alias("n_leaves"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each distinct beginning of conversations: (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    turns: (conv, pos, key, bytes), positions 1, 2, ... without holes and a row
    of position 0 for each conversation, as `rooted` and `spliced` give; other
    columns are not read. conv_id is the smallest conversation that begins so,
    parent_conv_id that of the beginning without its last turn (null at depth
    0), n_convs how many begin so, n_children how many next turns there are,
    n_leaves how many beginnings from here on have none; saved_tokens sums over
    all from here on (n_convs - 1) times the bytes of the last text; ends_sha256
    is the SHA-256 of the ids that end here, ascending, joined by commas. No
    conversation gives no row; a conversation without turns is one of the root.
    """
    place = F.col("pos") > 0
    hashes = {f"x{i}": F.when(place, F.xxhash64(F.lit(i), "pos", "key")).otherwise(F.lit(0).cast("bigint")) for i in (1, 2)}
    turns = turns.select("conv", "pos", "key", "bytes").withColumns(hashes)
    wholes, sequences = _sequences(turns)
    # A long conversation is no hot key: it is joined slice by slice.
    chosen = sequences.select("conv", "copies", "rank", F.explode(F.sequence(F.lit(0).cast("bigint"), slice_of(F.col("n")))).alias("slice"))
    rows = turns.drop("key").withColumn("slice", slice_of(F.col("pos"))).join(chosen, ["conv", "slice"]).withColumnRenamed("pos", "depth")
    paths = running(rows, ["rank"], ["depth"], {"upto": "bytes"}, {"p1": "x1", "p2": "x2"}, "paths")
    points = _points(paths, sequences)

    # Edges back to turns: those of the path of the first member.
    edges = points.withColumn("slice", F.explode(F.sequence(slice_of(F.col("up_depth") + 1), slice_of(F.col("depth")))))
    edges = edges.select(F.col("low").alias("rank"), "slice", F.col("depth").alias("end"), F.col("upto").alias("end_upto"), "up_depth", "up_conv", "conv_id", "n_convs", "n_children", "below", "n_leaves")
    nodes = paths.select("rank", "slice", *_BEGINNING, "bytes", "upto").join(edges, ["rank", "slice"]).filter("depth > up_depth AND depth <= end")
    at_end = F.col("depth") == F.col("end")
    nodes = nodes.select(
        "conv_id",
        *_BEGINNING,
        F.when(F.col("depth") == F.col("up_depth") + 1, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(at_end, F.col("n_children")).otherwise(1).alias("n_children"),
        "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("end_upto") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"),
    )
    nothing = F.lit(hashlib.sha256().hexdigest())
    return nodes.join(_ends(wholes), _BEGINNING, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """`prefix_trie` of a table of turns; see `ordered_turns` for columns."""
    turns = ordered_turns(conversations, **columns)
    return prefix_trie(rooted(turns, lengths(turns)))
