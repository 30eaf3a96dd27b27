"""Text tracks on demand: what packaging a track's cues would give, by sums.

A packaged segment's size follows from how many samples it has and how many
bytes of cues hold in each, so an index of a track needs no payload: edges of
cues and divisions of segments are sorted once, and running sums over them say
what holds between any two. No cue is paired with a sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.ordered import followed, numbered, ordered, summed
from cadenza.sources.stored import written
from cadenza.sources.wvtt import ENTRY, FTYP, MOOF, NO_CUE, STYP, movie

#: Bytes of a box's header; of ftyp and moov; of a sidx without references; of
#: each reference. Fixed values of the format.
BOX, INITIALIZATION, SIDX, REFERENCE = 8, 579, 40, 12
TIMESCALE = 1000


def divisions(tracks: DataFrame, length_ms: int | Column, boundaries: Sequence[int], duration: str = "duration") -> Column:
    """The points at which a text track is cut into segments: multiples of the
    length (0: none) and boundaries, strictly inside its duration. The length
    can be an expression of the track."""
    listed = F.array(*[F.lit(int(b)).cast("bigint") for b in boundaries]).cast("array<bigint>")
    length = (F.lit(length_ms) if isinstance(length_ms, int) else length_ms).cast("bigint")
    grid = F.when(length > 0, F.sequence(length, F.greatest(F.col(duration), length), F.greatest(length, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.filter(F.concat(listed, grid), lambda b: (b > 0) & (b < F.col(duration)))


def durations(cues: DataFrame, track: str = "track") -> DataFrame:
    """(track, duration): the latest end of a track's cues. Tracks that cover
    no time have none."""
    return cues.groupBy(track).agg(F.max("end_ms").alias("duration")).filter("duration > 0")


def text_samples(cues: DataFrame, length_ms: int | Column, boundaries: Sequence[int] = (), track: str = "track") -> DataFrame:
    """(track, segment, start, n_active, bytes): one row for each sample that a
    packaged track has, from 0 to its duration, with the bytes of the sample.
    A sample begins at 0, at a division and at an edge of a cue. cues: (track,
    start_ms, end_ms, text); a cue that ends where it starts cuts, but is in no
    sample. One track may have any number of cues."""
    whole = durations(cues, track)
    size = 2 * BOX + F.octet_length("text").cast("bigint")
    zero = F.lit(0).cast("bigint")
    ends = F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).cast("bigint").alias("n"), size.alias("b")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).cast("bigint").alias("n"), (-size).alias("b")))
    edges = cues.select(track, F.explode(ends).alias("e")).select(track, "e.*", zero.alias("new"))
    cuts = whole.select(track, F.explode(F.concat(F.array(zero), divisions(whole, length_ms, boundaries))).alias("at"))
    edges = edges.unionByName(cuts.select(track, "at", zero.alias("n"), zero.alias("b"), F.lit(1).cast("bigint").alias("new")))
    points = edges.groupBy(track, "at").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("new").alias("new"))
    rows = summed(ordered(points, [track, "at"], "text-edges"), [track], "_part", ["_at"], {"active": "n", "held": "b", "segments": "new"})
    rows = rows.join(whole, track).filter(F.col("at") < F.col("duration"))
    return rows.select(track, (F.col("segments") - 1).alias("segment"), F.col("at").alias("start"), F.col("active").alias("n_active"), F.when(F.col("active") > 0, F.col("held")).otherwise(len(NO_CUE)).alias("bytes"))


def text_index(cues: DataFrame, length_ms: int | Column, boundaries: Sequence[int] = (), track: str = "track") -> DataFrame:
    """(track, idx, st, en, sm, em, sz, start_byte, end_byte, n_samples): the
    segments of each track's cues, packaged, in ms and bytes of the file that
    packaging would write. Nothing is packaged. A track without time has none."""
    samples = text_samples(cues, length_ms, boundaries, track)
    each = samples.groupBy(track, F.col("segment").alias("idx")).agg(F.min("start").alias("st"), F.count("*").alias("n_samples"), F.sum("bytes").alias("payload"))
    sized = each.withColumn("sz", F.col("payload") + len(STYP) + MOOF + ENTRY * F.col("n_samples") + BOX)
    counts = each.groupBy(track).agg(F.count("*").alias("n_segments"))
    rows = summed(ordered(sized, [track, "idx"], "text-segments"), [track], "_part", ["_at"], {"upto": "sz"})
    rows = followed(rows, [track], "_part", ["_at"], {"next": "st"})
    rows = rows.join(durations(cues, track), track).join(counts, track)
    end, first = F.coalesce("next", "duration"), INITIALIZATION + SIDX + REFERENCE * F.col("n_segments")
    return rows.select(track, "idx", "st", end.alias("en"), F.col("st").alias("sm"), end.alias("em"), "sz", (first + F.col("upto") - F.col("sz")).alias("start_byte"), (first + F.col("upto")).alias("end_byte"), "n_samples")


def initialization(cues: DataFrame, track: str = "track", track_id: int = 1) -> DataFrame:
    """(track, content): the initialization of each track's cues, packaged."""
    return durations(cues, track).select(track, F.concat(F.lit(FTYP), movie(F.col("duration"), TIMESCALE, track_id)).alias("content"))
