"""Requests as a table: what each asks for, and the segments they get.

Requests are parsed in the tasks that read them, and looked up by joins; what is
wrong with one is told in its row. Any number of requests, with lengths of their
own, is one plan, and nothing is asked of the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import text as demand
from cadenza.operators import timeline as L
from cadenza.plans import filters, requests

ROUTE = "asset string, min_length bigint, text_length bigint, compact boolean, multi_period boolean, wvtt boolean, kind string, number bigint, status int, message string"
OK, MALFORMED, MISSING = 200, 400, 404


def _route(options: str, resource: str, track_id: str | None, filter_text: str | None) -> tuple:
    try:
        o = filters.parse_options(options)
        if filter_text is not None:
            filters.to_sql(filter_text)
    except ValueError as e:
        return (None,) * 8 + (MALFORMED, str(e))
    found = (o.asset, o.min_length, o.text_length, o.compact, o.multi_period, o.wvtt)
    if track_id is None:
        stem, _, extension = resource.rpartition(".")
        kind = {"index.mpd": "dash", "master.m3u8": "hls"}.get(resource) or ("playlist" if extension == "m3u8" and stem else None)
        return (*found, kind, None, OK, None) if kind else (*found, None, None, MISSING, resource)
    try:
        kind, number = requests.dispatch(track_id, resource)
    except requests.NotFound as e:
        return (*found, None, None, MISSING, str(e))
    if number is not None and number >= 1 << 63:
        return (*found, kind, None, MISSING, f"{track_id}/{resource}")
    return (*found, kind, number, OK, None)


def request_routes(asked: DataFrame, tracks: DataFrame) -> DataFrame:
    """asked (request_id, options, resource, track_id, filter) with what each
    asks for (ROUTE). track_id is null for manifests; of a playlist it is the
    one that the resource names. status is OK, MALFORMED (options or filter) or
    MISSING: no such resource, or none of this kind of that track in tracks
    (asset, id, type, format; thumbnails have the type thumbnail). Null options
    are empty ones, a null resource is none."""
    kind = asked.schema["request_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_route(o or "", r or "", t, f) for o, r, t, f in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * 10
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["request_id", "track_id", "resource", *(c.split(" ")[0] for c in ROUTE.split(", "))])

    rows = asked.select("request_id", "options", "resource", "track_id", "filter").mapInArrow(parse, f"request_id {kind}, track_id string, resource string, {ROUTE}")
    rows = rows.withColumn("track_id", F.when(F.col("kind") == "playlist", F.expr("substring(resource, 1, length(resource) - 5)")).otherwise(F.col("track_id")))
    known = tracks.groupBy(F.col("asset").alias("_asset"), F.col("id").alias("_id")).agg(F.first("type").alias("_type"), F.first("format").alias("_format"))
    joined = rows.join(known, (F.col("asset") == F.col("_asset")) & (F.col("track_id") == F.col("_id")), "left")
    image, text = F.col("_type") == "thumbnail", F.col("_format") == "webvtt"
    fits = F.when(F.col("kind").isin("dash", "hls"), True).when(F.col("kind") == "sprite", image).when(F.col("kind") == "text", text).when(F.col("kind") == "playlist", F.col("_id").isNotNull()).otherwise(~image)
    lost = (F.col("status") == OK) & ~F.coalesce(fits, F.lit(False))
    status, message = F.when(lost, MISSING).otherwise(F.col("status")), F.when(lost, F.concat_ws("/", "track_id", "resource")).otherwise(F.col("message"))
    return joined.withColumns({"status": status, "message": message}).select(*rows.columns)


def segments_asked(routes: DataFrame, segments: DataFrame, cues: DataFrame | None = None, boundaries: Sequence[int] = ()) -> DataFrame:
    """(request_id, id, start, end, start_ms, end_ms, bytes): the served segment
    that each request of the kinds media and text asks for, where one starts
    exactly there. Each pair of a track and lengths that is asked for is grouped
    once: stored tracks of segments (id, idx, st, en, sm, em, sz), text tracks
    of cues (id, start_ms, end_ms, text) at the text length."""
    wanted = routes.filter((F.col("status") == OK) & F.col("kind").isin("media", "text"))
    pairs = wanted.select(F.col("track_id").alias("id"), "min_length", "text_length").distinct()
    columns = ["idx", "st", "en", "sm", "em", "sz"]
    piece = F.struct("id", "min_length", "text_length").alias("piece")
    rows = pairs.join(segments, "id").select(piece, *columns)
    if cues is not None:
        lengths = pairs.select("id", F.struct("id", "text_length").alias("track")).distinct().join(cues.select("id", "start_ms", "end_ms", "text"), "id")
        index = demand.text_index(lengths.drop("id"), F.col("track.text_length"), boundaries)
        rows = rows.unionByName(pairs.join(index.select("track.*", *columns), ["id", "text_length"]).select(piece, *columns))
    groups = L.served_groups(rows, F.col("piece.min_length"), boundaries, track="piece")
    asked = wanted.select("request_id", F.struct(F.col("track_id").alias("id"), "min_length", "text_length").alias("piece"), F.col("number").alias("start"))
    return asked.join(groups, ["piece", "start"]).select("request_id", "piece.id", "start", "end", "start_ms", "end_ms", "bytes")
