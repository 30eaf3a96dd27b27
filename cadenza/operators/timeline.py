"""Operators over ordered intervals: indexes, groups, runs, periods, cues.

All take the columns that name the track (partition key), the order in it, and
the interval, so they run on any table with such columns. Every order is total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.exprs import let

#: Segments that a fold takes at a time.
STRETCH = 256


def _ordered(track: str, order: str) -> "Window":
    return Window.partitionBy(track).orderBy(order)


def prefix_index(refs: DataFrame, track: str = "track", order: str = "idx", size: str = "size", duration: str = "duration", first_byte: int = 0, first_tick: int = 0) -> DataFrame:
    """refs with start, end, start_byte, end_byte: running sums of duration and
    size in each track. Overflow raises."""
    upto = _ordered(track, order).rowsBetween(Window.unboundedPreceding, 0)
    end, end_byte = F.sum(duration).over(upto) + first_tick, F.sum(size).over(upto) + first_byte
    return refs.withColumns({"start": end - F.col(duration), "end": end, "start_byte": end_byte - F.col(size), "end_byte": end_byte})


def cut_after(segments: DataFrame, boundaries: Sequence[int], track: str = "track", order: str = "idx", start_ms: str = "sm") -> DataFrame:
    """segments with `cut`: whether a boundary snaps to the start of the next
    one, that is, lies after this start and not after the next. Boundaries, in
    ms, are a short list in any order, with repeats."""
    listed = sorted({int(b) for b in boundaries})
    following = F.lead(start_ms).over(_ordered(track, order))
    hit = F.exists(F.array(*[F.lit(b).cast("bigint") for b in listed]), lambda b: (F.col(start_ms) < b) & (b <= F.col("_next"))) if listed else F.lit(False)
    return segments.withColumn("_next", following).withColumn("cut", F.col("_next").isNotNull() & hit).drop("_next")


def snapped(segments: DataFrame, boundaries: Sequence[int], track: str = "track", start_ms: str = "sm") -> DataFrame:
    """(track, boundary, position): for each boundary and track, the number of
    segments that start before it. Boundaries, in ms, are a short list, as in
    `cut_after`. Each track's are merged with its segments and counted: a window,
    no join."""
    listed = F.array(*[F.lit(b).cast("bigint") for b in sorted({int(b) for b in boundaries})]).cast("array<bigint>")
    edges = segments.select(track).distinct().select(track, F.explode(listed).alias("at"), F.lit(0).alias("n"))
    merged = segments.select(track, F.col(start_ms).cast("bigint").alias("at"), F.lit(1).alias("n")).union(edges)
    before = Window.partitionBy(track).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("position", F.sum("n").over(before)).filter("n = 0").select(track, F.col("at").alias("boundary"), F.col("position").cast("bigint").alias("position"))


def served_groups(segments: DataFrame, minimum_ms: int | Column, boundaries: Sequence[int] = (), track: str = "track", order: str = "idx", start: str = "st", end: str = "en", start_ms: str = "sm", end_ms: str = "em", size: str = "sz") -> DataFrame:
    """Greedy groups of consecutive segments: (track, group_id, first_order,
    start, end, start_ms, end_ms, bytes, n_segments).

    A group closes when it lasts minimum_ms, at a boundary's cut, or with the
    track; a short tail stays. minimum_ms 0 gives every segment its own group
    and no heed to boundaries; it can be an expression of track. Groups restart at cuts, so the fold runs per
    (track, cut span); its memory is one span. The fold keeps the places where
    groups start, which are then sliced out. It goes by stretches of STRETCH
    segments, so that appending a place copies a stretch's places at most."""
    if isinstance(minimum_ms, int) and minimum_ms == 0:
        groups = segments.select(track, F.col(order).alias("first_order"), F.col(start).alias("start"), F.col(end).alias("end"), F.col(start_ms).alias("start_ms"), F.col(end_ms).alias("end_ms"), F.col(size).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("n_segments"))
    else:
        cuts = cut_after(segments, boundaries, track, order, start_ms)
        before = _ordered(track, order).rowsBetween(Window.unboundedPreceding, -1)
        spans = cuts.withColumn("_span", F.coalesce(F.sum(F.col("cut").cast("int")).over(before), F.lit(0)))
        rows = F.struct(F.col(order).alias("o"), F.col(start).alias("st"), F.col(end).alias("en"), F.col(start_ms).alias("sm"), F.col(end_ms).alias("em"), F.col(size).cast("bigint").alias("sz"))
        held = spans.groupBy(track, "_span").agg(F.array_sort(F.collect_list(rows)).alias("a"))
        none = F.lit(None).cast("bigint")

        def step(s: Column, x: Column) -> Column:
            opens = s["open"].isNull()
            since = F.coalesce(s["open"], x["sm"].cast("bigint"))
            return F.struct((s["i"] + 1).alias("i"), F.when(x["em"] - since >= minimum_ms, none).otherwise(since).alias("open"), F.when(opens, F.array_append(s["starts"], s["i"])).otherwise(s["starts"]).alias("starts"))

        def stretch(s: Column, part: Column) -> Column:
            seed = F.struct(s["i"].alias("i"), s["open"].alias("open"), F.array().cast("array<int>").alias("starts"))
            return let(F.aggregate(part, seed, step), lambda r: F.struct(r["i"].alias("i"), r["open"].alias("open"), F.array_append(s["parts"], r["starts"]).alias("parts")))

        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("a") - 1) / STRETCH).cast("int")), lambda k: F.slice("a", k * STRETCH + 1, STRETCH))
        seed = F.struct(F.lit(0).alias("i"), none.alias("open"), F.array().cast("array<array<int>>").alias("parts"))
        starts = held.withColumn("starts", F.flatten(F.aggregate(parts, seed, stretch)["parts"]))
        pieces = F.transform("starts", lambda s, k: F.slice("a", s + 1, F.coalesce(F.get("starts", k + 1), F.size("a")) - s))
        g = starts.select(track, F.explode(pieces).alias("g")).select(track, F.element_at("g", 1).alias("f"), F.element_at("g", -1).alias("l"), F.aggregate("g", F.lit(0).cast("bigint"), lambda n, x: n + x["sz"]).alias("bytes"), F.size("g").cast("bigint").alias("n_segments"))
        groups = g.select(track, F.col("f.o").alias("first_order"), F.col("f.st").alias("start"), F.col("l.en").alias("end"), F.col("f.sm").alias("start_ms"), F.col("l.em").alias("end_ms"), "bytes", "n_segments")
    return groups.withColumn("group_id", (F.row_number().over(Window.partitionBy(track).orderBy("first_order")) - 1).cast("bigint"))


def absolute_runs(segments: DataFrame, track: str = "track", order: str = "idx", start: str = "st", end: str = "en") -> DataFrame:
    """(track, run, first, d, n, number, gap): a run is a stretch of n segments
    of one duration d without gaps, from `first` on; number of them come before
    it in the track. gap: whether it does not start where the run before ends,
    as the first one does not."""
    w = _ordered(track, order)
    d = F.col(end) - F.col(start)
    rows = segments.withColumn("_d", d).withColumn("_gap", ~F.coalesce(F.lag(end).over(w) == F.col(start), F.lit(False)))
    rows = rows.withColumns({"_new": (F.col("_gap") | (F.lag("_d").over(w) != F.col("_d"))).cast("int"), "_number": F.row_number().over(w) - 1})
    rows = rows.withColumn("run", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("bigint"))
    # Only a run's first segment can have a gap in front.
    out = rows.groupBy(track, "run").agg(F.min_by(start, order).alias("first"), F.bool_or("_gap").alias("gap"), F.first("_d").alias("d"), F.count("*").alias("n"), F.min("_number").cast("bigint").alias("number"))
    return out.select(track, "run", "first", "d", "n", "number", "gap")


def run_length_encoded(segments: DataFrame, track: str = "track", order: str = "idx", start: str = "st", end: str = "en") -> DataFrame:
    """(track, run, t, d, r): a run is a stretch of segments of one duration
    without gaps. t, its start, is there for the first run and after a gap; r,
    the repeats, is one less than the segments, and null for none."""
    return written_runs(absolute_runs(segments, track, order, start, end), track)


def written_runs(runs: DataFrame, track: str = "track") -> DataFrame:
    """(track, run, t, d, r) of runs (track, run, first, d, n, gap)."""
    return runs.select(track, "run", F.when(F.col("gap"), F.col("first")).alias("t"), "d", F.when(F.col("n") > 1, F.col("n") - 1).alias("r"))


def run_length_expanded(runs: DataFrame, track: str = "track", run: str = "run") -> DataFrame:
    """(track, run, k, start, end): the segments that the runs (t, d, r) stand
    for. A negative repeat, or a first run without a start, raises."""
    w = _ordered(track, run)
    guard = F.when(F.coalesce("r", F.lit(0)) < 0, F.raise_error(F.lit("negative repeat"))).when((F.row_number().over(w) == 1) & F.col("t").isNull(), F.raise_error(F.lit("the first run has no start"))).otherwise(F.coalesce("r", F.lit(0)).cast("bigint"))
    rows = runs.withColumn("_r", guard)
    # A start holds until the next start; in between, runs follow each other.
    rows = rows.withColumn("_block", F.sum(F.col("t").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(track, "_block").orderBy(run).rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("d") * (F.col("_r") + 1)
    rows = rows.withColumn("_first", F.first("t").over(inside) + F.sum(length).over(inside) - length)
    out = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), "_r")))
    start = F.col("_first") + F.col("k") * F.col("d")
    return out.select(track, run, "k", start.alias("start"), (start + F.col("d")).alias("end"))


def period_spans(spark, boundaries: Sequence[int], duration: int) -> DataFrame:
    """(period_id, start_ms, end_ms): [0, duration) cut at the boundaries inside
    it; always one span at least, 0..0 for no duration."""
    edges = sorted({b for b in boundaries if 0 < b < duration})
    return spark.createDataFrame(list(zip(range(len(edges) + 1), [0, *edges], [*edges, duration], strict=True)), "period_id bigint, start_ms bigint, end_ms bigint")


def grid(length: int, end: int) -> list[int]:
    """Multiples of length below end; none for length 0."""
    return list(range(length, end, length)) if length else []


def partitioned(ranges: DataFrame, cuts: DataFrame, track: str = "track", start: str = "a", end: str = "b", cut: str = "c") -> DataFrame:
    """(track, start, end): each track's range, cut at the distinct points
    strictly inside it. An empty range gives nothing."""
    inside = cuts.join(ranges, track).filter((F.col(start) < F.col(cut)) & (F.col(cut) < F.col(end))).select(track, F.col(cut).alias("edge"))
    ends = ranges.filter(F.col(start) < F.col(end)).select(track, F.explode(F.array(start, end)).alias("edge"))
    edges = inside.union(ends).distinct()
    return edges.select(track, F.col("edge").alias("start"), F.lead("edge").over(Window.partitionBy(track).orderBy("edge")).alias("end")).filter("end is not null")


def overlap(segments: DataFrame, periods: DataFrame, bucket_ms: int, start_ms: str = "sm", end_ms: str = "em") -> DataFrame:
    """Every segment with every period (period_id, start_ms, end_ms) that it
    overlaps, half open. Both sides are dealt into buckets of bucket_ms and
    joined by bucket; a pair counts in the first bucket that both are in."""
    bucket = lambda c: F.floor(c / bucket_ms)
    s = segments.withColumn("_b0", bucket(F.col(start_ms))).withColumn("_b", F.explode(F.sequence("_b0", F.greatest("_b0", bucket(F.col(end_ms) - 1)))))
    p = periods.filter("start_ms < end_ms").select("period_id", F.col("start_ms").alias("period_start"), F.col("end_ms").alias("period_end"), bucket(F.col("start_ms")).alias("_p0"), F.explode(F.sequence(bucket(F.col("start_ms")), bucket(F.col("end_ms") - 1))).alias("_b"))
    hit = (F.col(start_ms) < F.col("period_end")) & (F.col("period_start") < F.col(end_ms)) & (F.col("_b") == F.greatest("_b0", "_p0"))
    return s.join(p, "_b").filter(hit).drop("_b", "_b0", "_p0")


def period_relationships(pieces: DataFrame, timescale: int, track: str = "track", start: str = "st", end: str = "en") -> DataFrame:
    """(track, period_id, previous_period, offset, relation) of a track's
    periods that have segments; pieces as `overlap` gives them.

    offset is the period's start in ticks. The previous period is the last one
    that was emitted at all, if the track is in it. The relation is "continuous"
    if one of its segments ends, and one of the period's starts, at the offset;
    else "connected"; null without a previous period."""
    offset = F.floor(F.col("period_start") * timescale / 1000).cast("bigint")
    rows = pieces.withColumn("offset", offset)
    # The periods that were emitted, with their neighbours: few, one array.
    emitted = rows.agg(F.array_sort(F.collect_set(F.struct("period_id", "offset"))).alias("p")).select("p", F.posexplode("p").alias("i", "own"))
    at = lambda i, name: F.when(i >= 0, F.get("p", i))[name]
    order = emitted.select(F.col("own.period_id").alias("period_id"), at(F.col("i") - 1, "period_id").alias("_before"), at(F.col("i") + 1, "offset").alias("_next"))
    each = rows.join(order, "period_id").groupBy(track, "period_id", "offset", "_before").agg(F.bool_or(F.col(end) == F.col("_next")).alias("_reaches"), F.bool_or(F.col(start) == F.col("offset")).alias("_starts"))
    w = Window.partitionBy(track).orderBy("period_id")
    linked = each.withColumns({"_own": F.lag("period_id").over(w), "_reached": F.lag("_reaches").over(w)})
    has = F.col("_own") == F.col("_before")
    joined = F.col("_starts") & F.coalesce("_reached", F.lit(False))
    return linked.select(track, "period_id", F.when(has, F.col("_own")).alias("previous_period"), "offset", F.when(has, F.when(joined, "continuous").otherwise("connected")).alias("relation"))


def numbered(segments: DataFrame, track: str = "track", order: str = "idx") -> DataFrame:
    """segments with `number`, from 0, in each track: for `number_shift`."""
    return segments.withColumn("number", (F.row_number().over(_ordered(track, order)) - 1).cast("bigint"))


def number_shift(pieces: DataFrame, first_number: int = 1, track: str = "track") -> DataFrame:
    """(track, period_id, start_number): the first number plus the segments
    that come before the period's first one. pieces: `numbered` segments by
    period, as `overlap` gives them."""
    return pieces.groupBy(track, "period_id").agg((F.min("number") + first_number).cast("bigint").alias("start_number"))


def cue_samples(parts: DataFrame, cues: DataFrame, bucket_ms: int, track: str = "track") -> DataFrame:
    """(track, start, end, active): parts of a track's time with the texts of
    the cues (start_ms, end_ms, pos, text) that hold at their start, in cue
    order. Parts are those between neighbouring edges, so a cue that holds at
    the start holds throughout."""
    c = cues.filter("start_ms < end_ms").select(track, "pos", "text", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms))).alias("_b"))
    held = parts.withColumn("_b", F.floor(F.col("start") / bucket_ms)).join(c, [track, "_b"]).filter((F.col("start_ms") <= F.col("start")) & (F.col("start") < F.col("end_ms")))
    active = held.groupBy(track, "start").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "pos", "text"))).alias("a"))
    return parts.join(active, [track, "start"], "left").select(track, "start", "end", F.coalesce(F.transform("a", lambda x: x["text"]), F.array().cast("array<string>")).alias("active"))


def clipped(cues: DataFrame, a: int, b: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """The cues that overlap [a, b), cut to it; none if it is empty."""
    if a >= b:
        return cues.limit(0)
    inside = cues.filter((F.col(start) < b) & (F.col(end) > a))
    return inside.withColumns({start: F.greatest(start, F.lit(a).cast("bigint")), end: F.least(end, F.lit(b).cast("bigint"))})


def dominant(segments: DataFrame, value: Column, track: str = "track") -> DataFrame:
    """(track, cadence): the most frequent value, of several the greatest; null
    where that is 0."""
    counts = segments.groupBy(track, value.alias("v")).count()
    return counts.groupBy(track).agg(F.max_by("v", F.struct("count", "v")).alias("c")).select(track, F.when(F.col("c") != 0, F.col("c")).alias("cadence"))


def cadence_aligned(segments: DataFrame, value: Column, track: str = "track", order: str = "idx", start: str = "st") -> DataFrame:
    """The segments whose offset from the track's first is within ceil(cadence
    / 100) of a multiple of the cadence. None of a track without a cadence."""
    offset = F.col(start) - F.first(start).over(_ordered(track, order))
    rows = segments.withColumn("offset", offset).join(dominant(segments, value, track).filter("cadence is not null"), track)
    rest = F.col("offset") % F.col("cadence")
    slack = F.ceil(F.col("cadence") / 100)
    return rows.filter((rest <= slack) | (F.col("cadence") - rest <= slack))


def paged(rows: DataFrame, number: int, size: int, track: str = "track", order: str = "idx") -> DataFrame:
    """Page `number` (from 0) of `size` rows of each track, with its place `k`."""
    k = F.row_number().over(_ordered(track, order)) - 1 - number * size
    return rows.withColumn("k", k.cast("bigint")).filter((F.col("k") >= 0) & (F.col("k") < size))
