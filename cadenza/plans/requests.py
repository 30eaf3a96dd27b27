"""What a request for a manifest, playlist or segment asks for, as a plan.

Thumbnails are bound to their sources first, and only then tracks and thumbnails
are filtered. Everything stays a DataFrame, for one asset or for many.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import renditions as R
from cadenza.operators import sprites
from cadenza.operators import text as demand
from cadenza.operators import timeline as L
from cadenza.plans import filters, mpd, playlists
from cadenza.plans.filters import Options
from cadenza.sources import webvtt


class NotFound(LookupError):
    pass


def served(segments: DataFrame, options: Options, boundaries: Sequence[int] = ()) -> DataFrame:
    """Served groups of segments (id, idx, st, en, sm, em, sz) by id."""
    return L.served_groups(segments, options.min_length, boundaries, track="id")


def with_text(segments: DataFrame, cues: DataFrame | None, options: Options, boundaries: Sequence[int] = ()) -> DataFrame:
    """segments with those that each text track of cues (id, start_ms, end_ms,
    text) has at the request's own text length. Nothing is packaged."""
    if cues is None:
        return segments
    index = demand.text_index(cues, options.text_length, boundaries, "id")
    return segments.select("id", "idx", "st", "en", "sm", "em", "sz").unionByName(index.select("id", "idx", "st", "en", "sm", "em", "sz"))


def track_rates(tracks: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, max_bitrate, avg_bitrate)"""
    g = groups.join(tracks.select("id", "timescale"), "id")
    d = F.col("end") - F.col("start")
    return g.groupBy("id", "timescale").agg(F.max(X.bitrate(F.col("bytes"), d, F.col("timescale"))).alias("max_bitrate"), F.sum("bytes").alias("b"), F.sum(d).alias("d")).select("id", "max_bitrate", X.bitrate(F.col("b"), F.col("d"), F.col("timescale")).alias("avg_bitrate"))


def thumbnails_of(tracks: DataFrame, segments: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """thumbnails (asset, pos, id, tile_size, width) with their sources: see
    `resolved_thumbnails`. tracks are all of the assets', unfiltered."""
    lasting = segments.groupBy("id").agg((F.max("em") - F.min("sm")).alias("duration_ms"))
    videos = tracks.filter("type = 'video'").join(lasting, "id", "left").select("asset", "pos", "id", "width", "height", "timescale", "duration_ms")
    return R.resolved_thumbnails(thumbnails, videos, L.dominant(segments, F.col("en") - F.col("st"), "id"))


def master(tracks: DataFrame, groups: DataFrame, wvtt: bool, thumbnails: DataFrame | None = None) -> DataFrame:
    """(asset, document): the master playlist of each asset."""
    rates = track_rates(tracks, groups)
    summary = R.rendition_summary(tracks, rates, ["asset"], wvtt)
    video = tracks.filter("type = 'video'").join(rates, "id", "left").join(summary.withColumnRenamed("codecs", "others"), "asset", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    variants = video.select(
        "asset", "pos", "id", (n("max_bitrate") + n("maximum_bitrate")).alias("bandwidth"), (n("avg_bitrate") + n("average_bitrate")).alias("average_bandwidth"),
        R.ordered_union(F.array("codec"), F.coalesce("others", F.array().cast("array<string>"))).alias("codecs"), "width", "height", "frame_rate",
        F.coalesce("has_audio", F.lit(False)).alias("has_audio"), F.coalesce("has_subtitles", F.lit(False)).alias("has_subtitles"),
    )
    return playlists.master_playlist(R.media_entries(tracks, ["asset"]), variants, ["asset"], thumbnails)


def manifest(tracks: DataFrame, segments: DataFrame, resource: str, options: Options, filter_text: str | None = None, boundaries: Sequence[int] = (), thumbnails: DataFrame | None = None, cues: DataFrame | None = None) -> DataFrame:
    """(asset or id, document) of `index.mpd`, `master.m3u8` or `<id>.m3u8`.
    thumbnails: (asset, pos, id, tile_size, width). cues: of the text tracks
    that segments doesn't have; they are cut as the request's text length asks.
    NotFound for another name, or where the filter leaves no track."""
    segments = with_text(segments, cues, options, boundaries)
    images = None if thumbnails is None else thumbnails_of(tracks, segments, thumbnails)
    if filter_text is not None:
        tracks, images = _kept(tracks, images, filter_text)
    stem, _, extension = resource.rpartition(".")
    if resource == "index.mpd":
        return mpd.documents(tracks, served(segments, options, boundaries), boundaries if options.multi_period else None, options.compact, images)
    if resource == "master.m3u8":
        return master(tracks, served(segments, options, boundaries), options.wvtt, images)
    if extension != "m3u8":
        raise NotFound(resource)
    track = tracks.filter(F.col("id") == stem).limit(1)
    found = track.select("timescale", "format").first()
    if found is None:
        sheet = None if images is None else images.filter(F.col("id") == stem)
        if sheet is None or sheet.isEmpty():
            raise NotFound(resource)
        return playlists.image_playlist(sheet, ["id"])
    groups = served(segments.filter(F.col("id") == stem), options, boundaries)
    plain = found["format"] == "webvtt" and not options.wvtt
    return playlists.media_playlist(groups, F.lit(found["timescale"]), plain, "id")


def _kept(tracks: DataFrame, images: DataFrame | None, text: str) -> tuple[DataFrame, DataFrame | None]:
    """The tracks and thumbnails that a filter keeps; NotFound if none."""
    named = tracks if "tile_size" in tracks.columns else tracks.withColumn("tile_size", F.lit(None).cast("bigint"))
    kept = filters.filtered(named, text)
    if images is None:
        shown = kept.select("id")
    else:
        like = images.withColumn("type", F.lit("thumbnail"))
        missing = {c: F.lit(None).cast("string") for c in filters.TEXT if c not in like.columns} | {c: F.lit(None).cast("bigint") for c in filters.NUMERIC if c not in like.columns}
        images = filters.filtered(like.withColumns(missing), text).select(*images.columns)
        shown = kept.select("id").union(images.select("id"))
    if shown.isEmpty():
        raise NotFound(f"no track matches {text!r}")
    return kept, images


def dispatch(track_id: str, file: str) -> tuple[str, int | None]:
    """What a file of a track is: ("init", None) for init.mp4, ("media", start)
    for <start>.m4s, ("text", start) for <start>.vtt, ("sprite", number from 1)
    for <number>.jpg. NotFound for anything else."""
    stem, dot, extension = file.rpartition(".")
    if file == "init.mp4":
        return "init", None
    kind = {"m4s": "media", "vtt": "text", "jpg": "sprite"}.get(extension)
    number = re.fullmatch(r"\+?([0-9]+)", stem)
    if not dot or kind is None or number is None or int(number[1]) >= 1 << 64 or (kind == "sprite" and int(number[1]) == 0):
        raise NotFound(f"{track_id}/{file}")
    return kind, int(number[1])


def sprite(thumbnails: DataFrame, thumbnail_id: str, number: str) -> DataFrame:
    """(id, number, start_ms, end_ms, ...): the sprite with that number of a
    resolved thumbnail, at most one row. NotFound if it is no number from 1."""
    _, n = dispatch(thumbnail_id, f"{number}.jpg")
    rows = playlists.image_rows(thumbnails.filter(F.col("id") == thumbnail_id), "source_duration_ms", "sprite_ms").filter(F.col("number") == n)
    start = (F.col("number") - 1) * F.col("sprite_ms")
    return rows.withColumns({"start_ms": start, "end_ms": start + F.col("image_ms")})


def sprite_sources(thumbnails: DataFrame, segments: DataFrame, thumbnail_id: str, number: str, gap: int = 0) -> DataFrame:
    """(id, number, source_id, start_byte, end_byte, places): what of its source
    the sprite with that number is made of, beside the initialization. segments:
    (id, idx, st, en, start_byte, end_byte). No row past the last sprite;
    NotFound if it is no number from 1."""
    _, n = dispatch(thumbnail_id, f"{number}.jpg")
    tiles = sprites.sprite_tiles(thumbnails.filter(F.col("id") == thumbnail_id), segments)
    return sprites.sprite_reads(tiles.filter(F.col("number") == n), gap)


def text_segment(cues: DataFrame, track_id: str, start: str, options: Options, boundaries: Sequence[int] = ()) -> DataFrame:
    """(id, content): the cues of the served segment that starts there, clipped
    to it, as a document; without a such segment, no row. cues: (id, pos,
    start_ms, end_ms, text). Segments are those of the request's text length,
    then grouped as those of any track are."""
    own = cues.filter(F.col("id") == track_id)
    group = segment(demand.text_index(own, options.text_length, boundaries, "id"), track_id, start, options, boundaries).select("id", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    inside = (F.col("g.id") == F.col("c.id")) & (F.col("c.start_ms") < F.col("g.b")) & (F.col("c.end_ms") > F.col("g.a"))
    held = group.alias("g").join(own.alias("c"), inside, "left").select("g.id", "c.pos", F.greatest("c.start_ms", "g.a").alias("start_ms"), F.least("c.end_ms", "g.b").alias("end_ms"), "c.text")
    return webvtt.formatted(held, "id")


def initialization(tracks: DataFrame, cues: DataFrame, track_id: str) -> DataFrame:
    """(id, mime_type, path, start_byte, end_byte, content): what `init.mp4` of
    a track is, at most one row. Of a stored track the range of its file (path,
    init_end, as headers give them); of a text track on demand, which has no
    file, the bytes."""
    one = tracks.filter(F.col("id") == track_id)
    made = demand.initialization(cues.filter(F.col("id") == track_id), "id")
    stored = {c: F.col(c) if c in tracks.columns else F.lit(None) for c in ("path", "init_end")}
    rows = one.join(made, "id", "left").withColumns({"path": stored["path"].cast("string"), "init_end": stored["init_end"].cast("bigint")})
    end = F.coalesce(F.length("content").cast("bigint"), "init_end")
    return rows.select("id", X.mime_type(F.col("type")).alias("mime_type"), "path", F.lit(0).cast("bigint").alias("start_byte"), end.alias("end_byte"), "content")


def segment(segments: DataFrame, track_id: str, start: str, options: Options, boundaries: Sequence[int] = ()) -> DataFrame:
    """The served group of a track that starts exactly there, at most one row;
    a start inside a group, or that is no number, gives none."""
    groups = served(segments.filter(F.col("id") == track_id), options, boundaries)
    return groups.filter(F.col("start") == F.lit(start).try_cast("bigint"))
