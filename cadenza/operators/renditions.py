"""Operators over catalogues of tracks: grouping, selection, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.sources.languages import with_language_names


def ordered_groups(tracks: DataFrame, key: Column, by: list[str], pos: str = "pos", member: str = "id") -> DataFrame:
    """(by, group_id, key, first_pos, members): the groups of each asset in the
    order in which they first appear, members in input order."""
    groups = tracks.groupBy(*by, key.alias("key")).agg(F.min(pos).alias("first_pos"), F.array_sort(F.collect_list(F.struct(pos, member))).alias("m"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("first_pos")) - 1
    return groups.select(*by, number.cast("bigint").alias("group_id"), "key", "first_pos", F.transform("m", lambda x: x[member]).alias("members"))


def nearest_source(tracks: DataFrame, target: int, by: list[str], width: str = "width", pos: str = "pos", id_col: str = "id") -> DataFrame:
    """Of each group the id of the narrowest track at least `target` wide, else
    of the widest; the first of equals."""
    wide = F.min_by(id_col, F.when(F.col(width) >= target, F.struct(width, pos)))
    return tracks.filter(F.col(width).isNotNull()).groupBy(*by).agg(F.coalesce(wide, F.min_by(id_col, F.struct((-F.col(width)).alias("w"), pos))).alias("source_id"))


def resolved_thumbnails(thumbnails: DataFrame, sources: DataFrame, cadences: DataFrame) -> DataFrame:
    """thumbnails (asset, pos, id, tile_size, width) with source_id, height,
    tile_width, tile_height, frame_ms, sprite_ms, bandwidth and
    source_duration_ms. sources: all videos of the assets, before any filter
    (asset, pos, id, width, height, timescale, duration_ms). cadences: (id,
    cadence) in ticks. A thumbnail without a source raises."""
    target = X.floor_div(F.col("width"), F.greatest("tile_size", F.lit(1)))
    # The first of each width will do: a few rows for each asset meet its thumbnails.
    videos = sources.groupBy("asset", F.col("width").alias("w")).agg(F.min_by(F.struct(F.col("width").alias("w"), "pos", "id", "height", "timescale", "duration_ms"), F.struct("pos")).alias("v")).drop("w")
    wide = F.min_by("v", F.when(F.col("v.w") >= F.col("target"), F.struct("v.w", "v.pos")))
    widest = F.min_by("v", F.when(F.col("v.w").isNotNull(), F.struct((-F.col("v.w")).alias("w"), "v.pos")))
    own = ["asset", "pos", "id", "tile_size", "width"]
    picked = thumbnails.withColumn("target", target).join(videos, "asset", "left").groupBy(*own).agg(F.coalesce(wide, widest).alias("v"))
    found = F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("no source for thumbnail "), "id"))).otherwise(F.col("v"))
    rows = picked.withColumn("v", found).withColumn("source_id", F.col("v.id")).join(cadences.select(F.col("id").alias("source_id"), "cadence").hint("merge"), "source_id", "left")
    rows = rows.withColumn("height", X.sprite_height(F.col("width"), F.col("tile_size"), F.col("v.w"), F.col("v.height"))).withColumn("frame_ms", F.coalesce(X.ticks_to_ms(F.col("cadence"), F.col("v.timescale")), F.lit(0).cast("bigint")))
    rows = rows.withColumn("sprite_ms", (F.col("tile_size") * F.col("tile_size") * F.col("frame_ms")).cast("bigint"))
    tile = lambda name: X.floor_div(F.col(name), F.greatest("tile_size", F.lit(1)))
    return rows.select(*own, "source_id", "height", tile("width").alias("tile_width"), tile("height").alias("tile_height"), "frame_ms", "sprite_ms", X.sprite_bandwidth(F.col("width"), F.col("height"), F.col("sprite_ms")).alias("bandwidth"), F.col("v.duration_ms").alias("source_duration_ms"))


def default_audio(tracks: DataFrame, by: list[str], pos: str = "pos", id_col: str = "id") -> DataFrame:
    """Of each group the first audio track with role main, else the first
    without a role, else null."""
    audio = F.col("type") == "audio"
    pick = lambda cond: F.min_by(id_col, F.when(cond, F.col(pos)))
    return tracks.groupBy(*by).agg(F.coalesce(pick(audio & (F.col("role") == "main")), pick(audio & F.col("role").isNull())).alias("default_id"))


def media_entries(tracks: DataFrame, by: list[str], pos: str = "pos", id_col: str = "id") -> DataFrame:
    """One row per audio and text track: its group, name and flags. A track is
    selected by itself if it is the default, or alone in its group with its
    (type, language, forced, characteristics)."""
    rows = tracks.filter(F.col("type").isin("audio", "text")).join(default_audio(tracks, by, pos, id_col), by)
    rows = with_language_names(rows, "language", "_named")
    forced, traits = X.is_forced(F.col("role")), X.characteristics(F.col("role"))
    alone = F.count("*").over(Window.partitionBy(*by, "type", "language", forced, F.coalesce(traits, F.lit("")))) == 1
    default = F.coalesce(F.col(id_col) == F.col("default_id"), F.lit(False))
    return rows.select(
        *by, pos, id_col,
        F.when(F.col("type") == "audio", "AUDIO").otherwise("SUBTITLES").alias("media_type"),
        F.when(F.col("type") == "audio", "audio").otherwise("subtitles").alias("group_name"),
        "language", X.rendition_name(F.col("language"), F.col("role"), F.col("_named")).alias("name"),
        default.alias("is_default"), (default | alone).alias("autoselect"), forced.alias("forced"), traits.alias("characteristics"),
        F.when(F.col("type") == "audio", F.col("channels").cast("string")).alias("channels"),
    )


def rendition_summary(tracks: DataFrame, rates: DataFrame, by: list[str], wvtt: bool, pos: str = "pos", id_col: str = "id") -> DataFrame:
    """Per group: has_audio, has_subtitles, the peak of tracks' maximum and
    average rates of each type, added over the types, and the distinct codecs
    in order. rates: (id, max_bitrate, avg_bitrate). Text codecs count only
    where packaging as wvtt was asked for, also for tracks packaged already."""
    rows = tracks.filter(F.col("type").isin("audio", "text")).join(rates, id_col, "left")
    per = rows.groupBy(*by, "type").agg(
        F.coalesce(F.max("max_bitrate"), F.lit(0)).alias("max"), F.coalesce(F.max("avg_bitrate"), F.lit(0)).alias("avg"), F.collect_list(F.struct(pos, "codec")).alias("c")
    )
    kept = F.array_sort(F.flatten(F.collect_list(F.when(F.lit(wvtt) | (F.col("type") != "text"), F.col("c")))))
    out = per.groupBy(*by).agg(F.bool_or(F.col("type") == "audio").alias("has_audio"), F.bool_or(F.col("type") == "text").alias("has_subtitles"), F.sum("max").alias("maximum_bitrate"), F.sum("avg").alias("average_bitrate"), kept.alias("k"))
    return out.withColumn("codecs", F.array_distinct(F.transform("k", lambda x: x["codec"]))).drop("k")


def ordered_union(first: Column, rest: Column) -> Column:
    """Distinct elements of both arrays, in order of first appearance."""
    return F.array_distinct(F.concat(first, rest))


def presentation(tracks: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the longest video track's duration_ms, else the longest audio
    track's, else 0; and the longest segment_ms of audio and video."""
    most = lambda kind, c: F.max(F.when(F.col("type") == kind, F.col(c)))
    return tracks.groupBy(*by).agg(
        F.coalesce(most("video", "duration_ms"), most("audio", "duration_ms"), F.lit(0)).cast("bigint").alias("presentation_ms"),
        F.coalesce(F.max(F.when(F.col("type").isin("video", "audio"), F.col("segment_ms"))), F.lit(0)).cast("bigint").alias("max_segment_ms"),
    )


def hoisted(rows: DataFrame, by: list[str], fields: list[str], least: int = 2) -> DataFrame:
    """Per group and field: the value that all members share, if there are at
    least `least` members and each has it; else null. As columns `shared_*`."""
    shared = [F.when((F.count("*") >= least) & (F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(f"shared_{c}") for c in fields]
    return rows.groupBy(*by).agg(F.count("*").alias("members"), *shared)


def upserted(stored: DataFrame, given: DataFrame, by: list[str], key: str, fields: list[str], pos: str = "pos") -> DataFrame:
    """(by, pos, key, fields): the stored rows of each asset with the rows of
    given: a known key keeps its place and what is stored but for fields that
    are given; new keys are appended in input order. pos counts from 0."""
    s = stored.select(*by, key, F.col(pos).alias("_s"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    g = given.select(*by, key, F.col(pos).alias("_g"), *[F.col(f).alias(f"_g_{f}") for f in fields])
    both = s.join(g, [*by, key], "full_outer")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_s").isNull(), F.coalesce("_s", "_g"))) - 1
    return both.select(*by, place.cast("bigint").alias(pos), key, *[F.coalesce(f"_g_{f}", f"_s_{f}").alias(f) for f in fields])
