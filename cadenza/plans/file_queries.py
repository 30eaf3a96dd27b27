"""Registered queries over documents and files, which they build from the
tables and read again, with their SQL."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators import text as demand
from cadenza.operators import timeline as L
from cadenza.plans import playlists, requests
from cadenza.plans.filters import Options
from cadenza.plans.queries import _SQL as PLAN_SQL
from cadenza.plans.tables import CUES, DAY, SEGMENTS, TRACKS, cues, segments, tracks
from cadenza.sources import assets, boxes, descriptors, media, webvtt, wvtt
from cadenza.sources.stored import fresh_path

HOUR6 = 6 * 3_600_000
_QUERIES, _SQL = {}, {}


def query(sql: str):
    def register(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query(PLAN_SQL["vtt_parse"])
def vtt_blocks(spark, sf_dir):
    """Documents with notes, styles, identifiers, settings and CRLF line ends."""
    c = cues(spark, sf_dir)
    stamp = lambda ms: F.format_string("%d:%02d:%02d.%03d", *(F.expr(f"{ms} {e}") for e in ("div 3600000", "div 60000 % 60", "div 1000 % 60", "% 1000")))
    block = F.concat(F.lit("NOTE before "), "pos", F.lit("\r\nof two lines\r\n\r\n"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("cue "), F.col("pos").cast("string"), F.lit("\r\n"))).otherwise(""), stamp("start_ms"), F.lit(" --> "), stamp("end_ms"), F.when(F.col("pos") % 3 == 0, " align:start line:0").otherwise(""), F.lit("\r\n"), "text", F.lit("\r\n"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))), lambda x: x["block"])
    head = F.lit("﻿WEBVTT a title\r\nmore of it\r\n\r\nSTYLE\r\n::cue {}\r\n\r\n \t\r\n")
    documents = c.groupBy("track").agg(F.concat(head, F.array_join(rows, "\r\n")).alias("content"))
    return webvtt.parsed(documents)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds between any two edges of cues, in segments of six hours."""
    c = cues(spark, sf_dir)
    last = c.groupBy("track").agg(F.lit(0).cast("bigint").alias("a"), F.max("end_ms").alias("b"))
    grid = last.select("track", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b"), F.lit(HOUR6).cast("bigint"))).alias("c"))
    edges = c.select("track", F.explode(F.array("start_ms", "end_ms")).alias("c")).union(grid)
    parts = L.cue_samples(L.partitioned(last, edges), c, HOUR6)
    return parts.withColumn("segment", F.expr(f"start div {HOUR6}"))


FRAGMENTS = f"""{CUES}, mx AS (SELECT track, max(end_ms) AS b FROM cue GROUP BY track),
eg AS (SELECT DISTINCT track, e FROM (SELECT track, start_ms AS e FROM cue UNION ALL SELECT track, end_ms FROM cue UNION ALL SELECT track, i * {HOUR6} FROM mx, range(0, b // {HOUR6} + 1) r(i)) JOIN mx USING (track) WHERE e <= b),
pt AS (SELECT track, e AS a, lead(e) OVER (PARTITION BY track ORDER BY e) AS b FROM eg),
sm AS (SELECT pt.track, pt.a, pt.b, coalesce(sum(16 + strlen(text)), 8) AS bytes FROM pt LEFT JOIN cue c ON c.track = pt.track AND c.start_ms <= a AND a < c.end_ms WHERE b IS NOT NULL GROUP BY ALL),
fr AS (SELECT track, a // {HOUR6} AS segment, min(a) AS "start", max(b) - min(a) AS duration, CAST(28 + 88 + 8 * count(*) + 8 + sum(bytes) AS BIGINT) AS size FROM sm GROUP BY ALL)"""


@query(f'WITH {FRAGMENTS} SELECT track, segment, "start", CAST(duration AS BIGINT) AS duration, size FROM fr')
def text_fragments(spark, sf_dir):
    return wvtt.fragments(_samples(spark, sf_dir)).select("track", "segment", "start", "duration", F.length("fragment").cast("bigint").alias("size"))


#: ftyp and moov of a text track have 579 bytes together; a sidx of n references has 40 + 12 n.
PACKAGED = f'WITH {FRAGMENTS}, n AS (SELECT track, count(*) AS n FROM fr GROUP BY track) SELECT CAST(track AS VARCHAR) AS path, row_number() OVER w - 1 AS idx, "start", CAST("start" + duration AS BIGINT) AS "end", CAST(619 + 12 * n + sum(size) OVER w - size AS BIGINT) AS start_byte, CAST(619 + 12 * n + sum(size) OVER w AS BIGINT) AS end_byte FROM fr JOIN n USING (track) WINDOW w AS (PARTITION BY track ORDER BY segment)'


@query(PACKAGED)
def packaged_segments(spark, sf_dir):
    """Text is packaged as files; their headers are read again."""
    files = wvtt.packaged(_samples(spark, sf_dir)).select(F.col("track").cast("string").alias("path"), "content")
    return boxes.segments(boxes.headers(files)).drop("timescale")


@query(PACKAGED)
def packaged_files(spark, sf_dir):
    """Text is written as files, piece by piece; they are read again by range."""
    root = fresh_path(spark, "text-files")
    media.write_pieces(wvtt.pieces(_samples(spark, sf_dir)).withColumn("path", F.format_string("%d.mp4", "track")), root)
    found = boxes.segments(boxes.read(spark, root)).drop("timescale")
    return found.withColumn("path", F.regexp_extract("path", r"([0-9]+)\.mp4$", 1))


def _descriptors(rows: DataFrame, by: str) -> DataFrame:
    """(path, content): a descriptor per group of tracks, in the order of pos."""
    names = [f.name for f in descriptors.TRACK.fields]
    have = [F.col(n).cast(descriptors.TRACK[n].dataType) if n in rows.columns else F.lit(None).cast(descriptors.TRACK[n].dataType) for n in names]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*[c.alias(n) for c, n in zip(have, names)]).alias("t")))), lambda x: x["t"])
    asset = F.struct(F.lit(None).cast("string").alias("$schema"), F.array(F.lit(0), F.lit(90_000)).cast(T.ArrayType(T.LongType())).alias("boundaries"), listed.alias("tracks"))
    return descriptors.written_json(rows.groupBy(F.col(by).alias("path")).agg(asset.alias("asset")))


@query(f"WITH {TRACKS} SELECT asset AS descriptor, row_number() OVER (PARTITION BY asset ORDER BY pos) - 1 AS pos, id, type, codec, width, height, frame_rate, sample_rate, channels, language, role, CASE WHEN format = 'webvtt' THEN 'webvtt' ELSE 'cmaf' END AS kind FROM trk")
def descriptor_tracks(spark, sf_dir):
    """The catalogue, written as descriptors and read again."""
    found = descriptors.tracks_of(descriptors.parsed(_descriptors(tracks(spark, sf_dir), "asset")).select("path", "asset"))
    return found.select("descriptor", "pos", "id", "type", "codec", "width", "height", "frame_rate", "sample_rate", F.col("channels").cast("bigint").alias("channels"), "language", "role", "kind")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): the cues of each user, packaged and as a document."""
    packaged = wvtt.packaged(_samples(spark, sf_dir)).select(F.format_string("a/text/%d.mp4", "track").alias("path"), "content")
    plain = webvtt.formatted(cues(spark, sf_dir)).select(F.format_string("b/%d.vtt", "track").alias("path"), F.encode("content", "UTF-8").alias("content"))
    return packaged.union(plain)


@query("""WITH u AS (SELECT DISTINCT user_id AS t FROM events) SELECT 'a/' || t || '.json' AS descriptor, i AS pos, CASE i WHEN 0 THEN 'cmaf' ELSE 'webvtt' END AS kind, CASE i WHEN 0 THEN 'a/text/' || t || '.mp4' ELSE 'b/' || t || '.vtt' END AS file, 'text' AS type, CASE WHEN i = 0 THEN 'nl' ELSE 'und' END AS language, CASE WHEN i = 0 THEN 'caption' END AS role, 'wvtt' AS codec, CAST(1000 AS BIGINT) AS timescale FROM u, range(2) r(i)""")
def resolved_tracks(spark, sf_dir):
    """Each descriptor names a packaged track, for which it has metadata of its
    own, and a document, for which it has none."""
    users = cues(spark, sf_dir).select("track").distinct()
    first = users.select(F.format_string("a/%d.json", "track").alias("descriptor"), F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit("text").alias("type"), F.lit("cmaf").alias("kind"), F.format_string("text/%d.mp4", "track").alias("path"), F.lit("nl").alias("language"), F.lit("caption").alias("role"))
    second = users.select(F.format_string("a/%d.json", "track").alias("descriptor"), F.lit(1).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("type"), F.lit("webvtt").alias("kind"), F.format_string("../b/%d.vtt", "track").alias("path"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("role"))
    rows = first.union(second).withColumns({c: F.lit(None).cast(k) for c, k in (("width", "bigint"), ("height", "bigint"), ("frame_rate", "string"), ("sample_rate", "bigint"), ("channels", "bigint"))})
    return assets.resolved(rows, assets.discovered(_files(spark, sf_dir))).select("descriptor", "pos", "kind", "file", "type", "language", "role", "codec", "timescale")


@query(f"""WITH {TRACKS}, p AS (SELECT asset || '/list.json' AS descriptor, row_number() OVER (PARTITION BY asset ORDER BY pos) - 1 AS pos, 'x/' || id AS path FROM trk), n AS (SELECT descriptor, max(pos) AS m FROM p GROUP BY descriptor) SELECT descriptor, pos, path FROM p UNION ALL SELECT descriptor, m + 1 + i, CASE i WHEN 0 THEN '../media/0.mp4' ELSE 'media/1.mp4' END FROM n, range(2) r(i)""")
def appended_tracks(spark, sf_dir):
    """Two more sources for each descriptor, one outside of its folder."""
    t = tracks(spark, sf_dir).select(F.concat("asset", F.lit("/list.json")).alias("descriptor"), "pos", F.concat(F.lit("x/"), "id").alias("path"))
    more = t.select("descriptor").distinct().select("descriptor", F.explode(F.array(F.lit("media/0.mp4"), F.concat(F.substring_index("descriptor", "/", 1), F.lit("/media/1.mp4")))).alias("path"))
    return assets.appended(t, more.withColumn("id", F.lit(None).cast("string")))


#: Cuts of text on demand, in ms: unsorted, one twice, two outside.
TEXT_CUTS = [3 * DAY + 1000, 7 * 3_600_000, 3 * DAY + 1000, 0, 99 * DAY]
INDEX = f"""{CUES}, dn AS (SELECT track, max(end_ms) AS d FROM cue GROUP BY track HAVING max(end_ms) > 0),
ct AS (SELECT DISTINCT track, p FROM (SELECT track, i * {HOUR6} AS p FROM dn, range(0, d // {HOUR6} + 1) r(i) UNION ALL SELECT track, v FROM dn, (VALUES {", ".join(f"({b})" for b in TEXT_CUTS)}) b(v)) JOIN dn USING (track) WHERE p < d),
ed AS (SELECT DISTINCT track, e FROM (SELECT track, start_ms AS e FROM cue UNION ALL SELECT track, end_ms FROM cue UNION ALL SELECT track, p FROM ct) JOIN dn USING (track) WHERE e < d),
sa AS (SELECT ed.track, e AS a, coalesce(sum(16 + strlen(text)), 8) AS bytes FROM ed LEFT JOIN cue c ON c.track = ed.track AND c.start_ms <= e AND e < c.end_ms GROUP BY ALL),
nu AS (SELECT sa.*, count(p) OVER (PARTITION BY sa.track ORDER BY a) - 1 AS idx FROM sa LEFT JOIN ct ON ct.track = sa.track AND p = a),
fg AS (SELECT track, idx, min(a) AS st, count(*) AS n_samples, CAST(28 + 88 + 8 * count(*) + 8 + sum(bytes) AS BIGINT) AS sz FROM nu GROUP BY ALL),
ix AS (SELECT track, idx, st, lead(st, 1, d) OVER w AS en, sz, CAST(619 + 12 * count(*) OVER (PARTITION BY track) + sum(sz) OVER w AS BIGINT) AS end_byte, n_samples FROM fg JOIN dn USING (track) WINDOW w AS (PARTITION BY track ORDER BY idx))"""


@query(f"WITH {INDEX} SELECT track, idx, st, en, sz, end_byte - sz AS start_byte, end_byte, n_samples FROM ix")
def text_index(spark, sf_dir):
    """Cues cut every six hours and at some points: sizes without the bytes."""
    return demand.text_index(cues(spark, sf_dir), HOUR6, TEXT_CUTS).drop("sm", "em")


def _whole_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).select(F.format_string("u%d", "track").alias("id"), "pos", F.expr("start_ms div 1000 * 1000").alias("start_ms"), F.expr("end_ms div 1000 * 1000").alias("end_ms"), "text")


#: Six hours divide half a day, and the cuts lie on days: groups of half a day start at its multiples.
@query(f"""WITH {CUES}, dn AS (SELECT 'u' || track AS id, max(end_ms) // 1000 AS d FROM cue GROUP BY track HAVING max(end_ms) >= 1000),
g AS (SELECT id, i, i * 43200 AS a, least((i + 1) * 43200, d) AS b FROM dn, range(0, (d + 43199) // 43200) r(i))
SELECT id, '#EXTM3U\n#EXT-X-TARGETDURATION:' || max(b - a) || '\n#EXT-X-PLAYLIST-TYPE:VOD\n' || string_agg('#EXTINF:' || (b - a) || ',\n' || id || '/' || (a * 1000) || '.vtt\n', '' ORDER BY i) || '#EXT-X-ENDLIST\n' AS document FROM g GROUP BY id""")
def text_manifest(spark, sf_dir):
    """Playlists of all text tracks, at the request's text and minimum lengths."""
    options, cuts = Options("a", min_length=2 * HOUR6, text_length=HOUR6), [10 * DAY, 5 * DAY, 10 * DAY, 99 * DAY]
    none = spark.createDataFrame([], "id string, idx long, st long, en long, sm long, em long, sz long")
    index = requests.with_text(none, _whole_seconds(spark, sf_dir), options, cuts)
    return playlists.media_playlist(requests.served(index, options, cuts), F.lit(demand.TIMESCALE), True, "id")


def _moov(kind: str) -> bytes:
    """The movie box of a small track of that kind, at 1000 ticks a second."""
    box, full = wvtt._plain, wvtt._full
    entry = {
        "vide": box("avc1", bytes(24), struct.pack(">HH", 640, 360), bytes(50), box("avcC", bytes([1, 0x42, 0xC0, 0x1E, 0xFF]))),
        "soun": box("mp4a", bytes(16), struct.pack(">HHI", 2, 16, 0), struct.pack(">I", 48000 << 16), box("esds", bytes(4), bytes([3, 25, 0, 0, 0, 4, 17]), bytes(13), bytes([5, 2, 0x11, 0x90]))),
        "text": box("wvtt", bytes(8)),
    }[kind]
    language = sum((ord(c) - 0x60) << at for c, at in zip("nld", (10, 5, 0), strict=True))
    mdia = box("mdia", full("mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, 1000, 0, language, 0)), full("hdlr", 0, 0, bytes(4), kind.encode(), bytes(13)), box("minf", box("stbl", full("stsd", 0, 0, struct.pack(">I", 1), entry))))
    return box("moov", box("mvhd", bytes(100)), box("trak", mdia), box("mvex", box("trex", struct.pack(">IIIIII", 0, 1, 1, 40, 0, 0))))


KINDS = ["vide", "soun", "text"]


def _media(spark: SparkSession, sf_dir: str) -> str:
    """Writes a file for each user, of a kind by the user's number: a head, then
    a fragment for each segment. Returns their folder."""
    fragment = wvtt._plain("moof", wvtt._plain("traf", wvtt._full("tfhd", 0, 0, struct.pack(">I", 1)), wvtt._full("trun", 0, 0, struct.pack(">I", 1))))
    rows = segments(spark, sf_dir).select("track", "idx", F.greatest(F.col("em") - F.col("sm"), F.lit(1)).alias("d"), F.concat(F.lit(fragment), F.expr("CAST(repeat(chr(97 + idx % 26), CAST(sz % 5000 AS int)) AS binary)")).alias("data"))
    path = F.format_string("m/%d.mp4", "track")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.length("data").alias("size"), "d"))), lambda r: F.concat(wvtt.number(r["size"], 4), wvtt.number(r["d"], 4), F.lit(struct.pack(">I", 0x90000000))))
    moov = F.element_at(F.array(*[F.lit(wvtt.FTYP + _moov(k)) for k in KINDS]), (F.col("track") % 3 + 1).cast("int"))
    sidx = wvtt.box("sidx", 24 + 12 * F.size("r"), struct.pack(">IIIIIH", 0, 1, 1000, 0, 0, 0), wvtt.number(F.size("r"), 2), wvtt.joined(F.col("r")))
    heads = rows.groupBy("track").agg(refs.alias("r")).select(path.alias("path"), F.lit(-1).cast("bigint").alias("place"), F.concat(moov, sidx).alias("data"))
    root = fresh_path(spark, "media")
    media.write_pieces(heads.unionByName(rows.select(path.alias("path"), F.col("idx").alias("place"), "data")), root)
    return root


MEDIA = f"""{SEGMENTS}, md AS (SELECT track, idx, greatest(em - sm, 1) AS d, 48 + sz % 5000 AS size, repeat(chr(CAST(97 + idx % 26 AS INTEGER)), CAST(sz % 5000 AS INTEGER)) AS fill FROM seg),
mx AS (SELECT track, idx, CAST(sum(d) OVER w - d AS BIGINT) AS a, CAST(sum(d) OVER w AS BIGINT) AS b, size, md5(fill) AS fill FROM md WINDOW w AS (PARTITION BY track ORDER BY idx))"""


@query(f"WITH {MEDIA} SELECT 'm/' || track || '.mp4' AS file, idx, a AS \"start\", b AS \"end\", size, fill FROM mx WHERE a < {20 * DAY} AND b >= {2 * DAY}")
def media_ranges(spark, sf_dir):
    """Files are written by the sink; segments of some days are read of them."""
    got = media.read_ranges(spark, _media(spark, sf_dir), stretch=200_000).filter(f"start < {20 * DAY} AND end >= {2 * DAY}")
    fill = F.md5(F.expr("substring(data, 49)"))
    return got.select(F.concat(F.lit("m/"), F.substring_index("path", "/", -1)).alias("file"), "idx", "start", "end", F.length("data").cast("bigint").alias("size"), fill.alias("fill"))


@query("""WITH u AS (SELECT DISTINCT user_id AS t FROM events) SELECT 'm/' || t || '.mp4' AS file, (['video', 'audio', 'text'])[t % 3 + 1] AS type, (['avc1.42c01e', 'mp4a.40.2', 'wvtt'])[t % 3 + 1] AS codec, CASE t % 3 WHEN 0 THEN CAST(640 AS BIGINT) END AS width, CASE t % 3 WHEN 0 THEN CAST(360 AS BIGINT) END AS height, CASE t % 3 WHEN 0 THEN '25/1' END AS frame_rate, CASE t % 3 WHEN 1 THEN CAST(48000 AS BIGINT) END AS sample_rate, CASE t % 3 WHEN 1 THEN CAST(2 AS BIGINT) END AS channels, CASE WHEN t % 3 > 0 THEN 'nld' END AS language, CAST(1000 AS BIGINT) AS timescale FROM u""")
def media_headers(spark, sf_dir):
    """Video, audio and text headers, read by range."""
    found = boxes.tracks(boxes.read(spark, _media(spark, sf_dir) + "/m"))
    return found.select(F.concat(F.lit("m/"), F.substring_index("path", "/", -1)).alias("file"), "type", "codec", "width", "height", "frame_rate", "sample_rate", F.col("channels").cast("bigint").alias("channels"), "language", "timescale")
