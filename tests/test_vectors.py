"""Acceptance vectors and seeded random comparisons of single operators."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import renditions as R
from cadenza.operators import timeline as L
from cadenza.plans import filters, playlists
from cadenza.sources import descriptors, webvtt


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*values):
    return [F.lit(v) for v in values]


def test_time_and_rates(spark):
    for ticks, scale, want in ((1, 90000, 0), (90000, 90000, 1000), (X.MAX_LONG, 1, X.MAX_LONG)):
        assert value(spark, X.ticks_to_ms(*lits(ticks, scale))) == want
    assert value(spark, X.bitrate(*lits(500, 3000, 1000))) == 1334
    assert value(spark, X.bitrate(*lits(500, 0, 1000))) == 0
    assert value(spark, X.bitrate(*lits(100, 1000, 1000))) == 800
    assert value(spark, X.rounded_seconds(*lits(1500, 1000))) == 2
    assert value(spark, X.seconds_text(F.lit(1500))) == "1.500"
    assert value(spark, X.saturating_sub(*lits(3, 5))) == 0


def test_codec_strings_and_ids(spark):
    assert value(spark, X.avc_codec(*lits(0x42, 0xC0, 0x0A))) == "avc1.42c00a"
    assert value(spark, X.avc_codec(*lits(0x64, 0, 0x1F))) == "avc1.64001f"
    constraints = F.array(*lits(0xB0, 0, 0, 0, 0, 0))
    assert value(spark, X.hevc_codec("hvc1", F.lit(0), F.lit(1), F.lit(0x60000000), F.lit(False), F.lit(120), constraints)) == "hvc1.1.6.L120.b0"
    assert value(spark, X.av1_codec(F.lit(0), F.lit(8), F.lit(False), F.lit(10))) == "av01.0.08M.10"
    assert value(spark, X.av1_codec(F.lit(2), F.lit(12), F.lit(True), F.lit(12))) == "av01.2.12H.12"
    assert value(spark, X.uuid5_url(F.lit("video.mp4"))) == "76666358-6bba-5805-9a37-a18e055e9ea8"
    assert value(spark, X.frame_rate(*lits(90000, 3003))) == "30000/1001"
    assert value(spark, X.frame_rate_value(F.lit("30000/1001"))) == 29.97
    assert value(spark, X.frame_rate(*lits(0, 1))) is None and value(spark, X.frame_rate_value(F.lit("5/0"))) is None
    assert value(spark, X.rendition_name(*lits("en", None))) == "English"
    assert value(spark, X.rendition_name(*lits("deu", "caption"))) == "German (Captions)"
    assert value(spark, X.normalised_path(F.lit("a/./b/../../c//d"))) == "c/d"
    assert value(spark, X.sprite_bandwidth(*lits(16, 16, 0))) is None


def timeline(spark, edges, scale=1):
    rows = [("t", i, a * scale, b * scale, a, b, 40) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return spark.createDataFrame(rows, "track string, idx long, st long, en long, sm long, em long, sz long")


def sizes(df):
    return [r.n_segments for r in df.orderBy("group_id").collect()]


@pytest.mark.parametrize(
    "edges, minimum, boundaries, want",
    [([0, 400, 800, 1200], 800, [], [2, 1]), ([0, 500, 1000, 1500], 1500, [1000], [2, 1]), ([0, 500, 1000, 1500], 1500, [1000, 1000, 500], [1, 1, 1]), ([0, 500, 1000], 0, [500], [1, 1]), ([0], 100, [], [])],
)
def test_grouping(spark, edges, minimum, boundaries, want):
    assert sizes(L.served_groups(timeline(spark, edges), minimum, boundaries)) == want


def test_lookup_of_a_hidden_start(spark):
    g = L.served_groups(timeline(spark, [0, 400, 800, 1200]), 800)
    assert [(r.start, r.bytes) for r in g.filter("start = 800").collect()] == [(800, 40)]
    assert g.filter("start = 400").isEmpty()


def test_grouping_at_random(spark):
    rng = random.Random(5)
    rows, want = [], []
    boundaries = sorted(rng.sample(range(0, 4000), 12))
    for t in range(60):
        edges = [rng.randrange(50)]
        for _ in range(rng.randint(1, 40)):
            edges.append(edges[-1] + rng.choice([0, 20, 90, 150]))
        segs = list(zip(edges, edges[1:]))
        starts = [a for a, _ in segs]
        cuts = {sum(s < b for s in starts) for b in boundaries}
        opened, k = None, 0
        for i, (a, b) in enumerate(segs):
            opened = a if opened is None else opened
            k += 1
            rows.append((t, i, a, b, a, b, 1))
            if b - opened >= 200 or i + 1 in cuts or i + 1 == len(segs):
                want.append((t, opened, b, k))
                opened, k = None, 0
    df = spark.createDataFrame(rows, "track long, idx long, st long, en long, sm long, em long, sz long")
    got = sorted((r.track, r.start, r.end, r.n_segments) for r in L.served_groups(df, 200, boundaries).collect())
    assert got == sorted(want)


def test_runs_round_trip(spark):
    rng = random.Random(6)
    rows = []
    for t in range(40):
        at = rng.randrange(9)
        for i in range(rng.randint(1, 30)):
            at += rng.choice([0, 0, 0, 3])
            d = rng.choice([4, 4, 5])
            rows.append((t, i, at, at + d))
            at += d
    df = spark.createDataFrame(rows, "track long, idx long, st long, en long")
    runs = L.run_length_encoded(df)
    back = L.run_length_expanded(runs)
    assert sorted((r.track, r.start, r.end) for r in back.collect()) == sorted((t, a, b) for t, _, a, b in rows)
    one = spark.createDataFrame([("v", 0, 0, 1000), ("v", 1, 1000, 2000)], "track string, idx long, st long, en long")
    assert [tuple(r) for r in L.run_length_encoded(one).collect()] == [("v", 0, 0, 1000, 1)]
    for bad in ([(1, 0, 0, 4, -1)], [(1, 0, None, 4, 0)]):
        with pytest.raises(PySparkException):
            L.run_length_expanded(spark.createDataFrame(bad, "track long, run long, t long, d long, r long")).collect()


def test_periods(spark):
    assert [tuple(r) for r in L.period_spans(spark, [9, 1000, 9, 0, 5000], 2000).collect()] == [(0, 0, 9), (1, 9, 1000), (2, 1000, 2000)]
    assert [tuple(r) for r in L.period_spans(spark, [], 0).collect()] == [(0, 0, 0)]
    segs = timeline(spark, [0, 1000, 2000])
    for boundary, relation in ((1000, "continuous"), (750, "connected")):
        pieces = L.overlap(segs, L.period_spans(spark, [boundary], 2000), 500)
        got = {r.period_id: (r.previous_period, r.offset, r.relation) for r in L.period_relationships(pieces, 1000).collect()}
        assert got == {0: (None, 0, None), 1: (0, boundary, relation)}
    assert sorted((r.period_id, r.idx) for r in pieces.collect()) == [(0, 0), (1, 0), (1, 1)]


def test_start_number_after_a_boundary(spark):
    rows = [("t", i, i * 4000, i * 4000 + 4000) for i in range(100)]
    segs = spark.createDataFrame(rows, "track string, idx long, sm long, em long")
    pieces = L.overlap(L.numbered(segs), L.period_spans(spark, [90000], 400000), 60000)
    got = {r.period_id: r.start_number for r in L.number_shift(pieces).collect()}
    assert got == {0: 1, 1: 23}


def cue_table(spark, rows):
    return webvtt.with_positions(spark.createDataFrame([("t", *r) for r in rows], "track string, start_ms long, end_ms long, text string"), "track", "text")


def test_samples(spark):
    cues = cue_table(spark, [(500, 1500, "a"), (1000, 2500, "b")])
    ranges = spark.createDataFrame([("t", 0, 2000)], "track string, a long, b long")
    edges = cues.select("track", F.explode(F.array("start_ms", "end_ms")).alias("c"))
    got = L.cue_samples(L.partitioned(ranges, edges), cues, 700).orderBy("start").collect()
    assert [(r.start, r.end, list(r.active)) for r in got] == [(0, 500, []), (500, 1000, ["a"]), (1000, 1500, ["a", "b"]), (1500, 2000, ["b"])]
    cuts = spark.createDataFrame([("t", c) for c in (750, 750, 3000, *L.grid(2000, 2500))], "track string, c long")
    whole = spark.createDataFrame([("t", 0, 2500), ("u", 5, 5)], "track string, a long, b long")
    assert [r.start for r in L.partitioned(whole, cuts).orderBy("start").collect()] == [0, 750, 2000]
    assert L.grid(0, 10) == [] and L.clipped(cues, 5, 5).isEmpty()
    assert [(r.start_ms, r.end_ms) for r in L.clipped(cues, 500, 750).collect()] == [(500, 750)]


def test_webvtt(spark):
    parse = lambda text: [(r.start_ms, r.end_ms, r.text) for r in webvtt.parsed(spark.createDataFrame([("t", text)], "track string, content string")).orderBy("pos").collect()]
    doc = "﻿WEBVTT title\r\n\r\nNOTE no\nno\n\nSTYLE\nx\n\nid\n00:02.000 --> 00:03.500 align:start\ntwo\nlines\n \t\n1:00:01.000 --> 1:00:01.000\n\n00:01.000 --> 00:02.000\none"
    assert parse(doc) == [(1000, 2000, "one"), (2000, 3500, "two\nlines"), (3601000, 3601000, "")]
    for bad in ("WEBVTTx\n\n", "WEBVTT\n\n00:60.000 --> 01:00.000\nx", "WEBVTT\n\n00:02.000 --> 00:01.000\nx", "WEBVTT\n\n0:0:0:1.000 --> 00:01.000\nx", "WEBVTT\n\n00:01.00 --> 00:01.000\nx"):
        with pytest.raises(PySparkException):
            parse(bad)
    out = webvtt.formatted(cue_table(spark, [(3600000, 3601001, "x")])).first()["content"]
    assert out == "WEBVTT\n\n01:00:00.000 --> 01:00:01.001\nx\n"
    assert parse("WEBVTT") == []


TRACKS = [("video", "cmaf", "video", "avc1", 1920, 1080, None, None, None), ("audio", "cmaf", "audio", "mp4a", None, None, 48000, 2, "eng"), ("text", "cmaf", "cmaf-text", "wvtt", None, None, None, None, "eng"), ("text", "webvtt", "webvtt", None, None, None, None, None, "eng"), ("thumbnail", "thumbnail", "thumbnail", None, 640, None, None, None, None)]


def test_filters(spark):
    t = spark.createDataFrame(TRACKS, "type string, format string, id string, codec string, width long, height long, sample_rate long, channels long, language string")
    t = t.withColumns({"frame_rate": F.lit(None).cast("string"), "role": F.lit(None).cast("string"), "tile_size": F.lit(None).cast("long")})
    ids = lambda text: [r.id for r in filters.filtered(t, text).collect()]
    assert ids("type == thumbnail && width >= 640") == ["thumbnail"]
    assert ids("codec == mp4a && type==audio") == ["audio"]
    assert ids("type == text") == ["cmaf-text", "webvtt"]
    assert "cmaf-text" not in ids("type != text") and ids("codec != avc1 && type == text") == ["cmaf-text"]
    assert ids("format == webvtt") == ["webvtt"]
    assert ids("type == video || type == audio && channels > 5") == ["video"]
    assert ids("(type == video || type == audio) && channels > 1") == ["audio"]
    with pytest.raises(LookupError):
        filters.filtered_or_error(t, "width > 5000")
    for bad in ("bitrate == 5", "type > text", "width == x", "", "type == video &&", "type == video) || (type == audio", "type == video type == audio", "(type == video", "width == 18446744073709551616", "type == 'a'; drop"):
        with pytest.raises(filters.FilterError):
            filters.filtered(t, bad)


def test_options():
    assert filters.parse_options("asset:demo,min_length:1000,text_length:2000") == filters.Options("demo", 1000, 2000)
    assert filters.parse_options("(a:x/y.json,sml:1,stl:2,c:true,mp:!t,wvtt:false)") == filters.Options("x/y.json", 1, 2, True, True)
    for bad in ("", "min_length:5", "asset:x,boundaries:1", "asset:x,a:y", "asset:x,min_length:-1"):
        with pytest.raises(ValueError):
            filters.parse_options(bad)


def test_filter_errors_name_their_offset():
    for text, offset in (("type == video language == en", 14), ("", 0), ("  ", 2), ("bitrate == 5", 0), ("type > text", 5), ("width == x", 9), ("type == video &&", 16), ("type == video) || (", 13), ("(type == video", 14), ("(type == video width == 1)", 15), ("type = video", 5), ("width == 12abc", 11), ("width == 18446744073709551616", 9), ("type ==", 7), ("() || type == text", 1), ("type == video | width == 1", 14)):
        with pytest.raises(filters.FilterError) as e:
            filters.to_sql(text)
        assert e.value.offset == offset, text
        assert f"at offset {offset}" in str(e.value)


def test_option_notation():
    parse = filters.parse_options
    assert parse("(a:'my file')") == filters.Options("my file") == parse("a:'my file'")
    assert parse("('a':'it!'s (1,2):!!',c:!f,'sml':7)") == filters.Options("it's (1,2):!", 7)
    assert parse("a:'!''") == filters.Options("'") and parse("a:'7'") == filters.Options("7")
    for bad, offset in (("a:!n", 2), ("a:!t", 2), ("a:7", 2), ("a:-x", 2), ("a:'x", 2), ("a:x,", 4), ("a:x,,c:!t", 4), ("a:x c:!t", 3), ("(a:x", 4), ("a", 1), ("a:x,c:1", 6), ("a:x,sml:!n", 8), ("a:x,sml:'5'", 8), ("a:x,sml:4294967296", 8), ("a:x,sml:!(1)", 8), ("a:x)", 3), ("x:1", 0)):
        with pytest.raises(ValueError, match=f"offset {offset}:"):
            parse(bad)


def test_selection(spark):
    t = spark.createDataFrame([(0, "a", 1280), (1, "b", 1920), (2, "c", 1920)], "pos long, id string, width long").withColumn("g", F.lit(1))
    assert [R.nearest_source(t, w, ["g"]).first()["source_id"] for w in (540, 1281, 2000)] == ["a", "b", "b"]
    h = spark.createDataFrame([(1, "x", 5, None), (1, "x", 6, 1), (2, "y", 7, 2)], "g long, a string, b long, c long")
    got = {r.g: (r.shared_a, r.shared_b, r.shared_c) for r in R.hoisted(h, ["g"], ["a", "b", "c"]).collect()}
    assert got == {1: ("x", None, None), 2: (None, None, None)}


def test_playlists(spark):
    groups = L.served_groups(timeline(spark, [0, 1000, 2000]), 0).withColumn("track", F.lit("video-main"))
    doc = playlists.media_playlist(groups, F.lit(1000)).first()["document"]
    assert doc == '#EXTM3U\n#EXT-X-VERSION:6\n#EXT-X-TARGETDURATION:1\n#EXT-X-PLAYLIST-TYPE:VOD\n#EXT-X-MAP:URI="video-main/init.mp4"\n#EXTINF:1,\nvideo-main/0.m4s\n#EXTINF:1,\nvideo-main/1000.m4s\n#EXT-X-ENDLIST\n'
    plain = playlists.media_playlist(groups, F.lit(1000), plain_vtt=True).first()["document"]
    assert plain == "#EXTM3U\n#EXT-X-TARGETDURATION:1\n#EXT-X-PLAYLIST-TYPE:VOD\n#EXTINF:1,\nvideo-main/0.vtt\n#EXTINF:1,\nvideo-main/1000.vtt\n#EXT-X-ENDLIST\n"
    tracks = spark.createDataFrame([("x", 1, "audio-en", "audio", "mp4a.40.2", "en", None, 2), ("x", 2, "text-en", "text", "wvtt", "en", None, None)], "asset string, pos long, id string, type string, codec string, language string, role string, channels long")
    media = R.media_entries(tracks, ["asset"])
    variants = spark.createDataFrame([("x", 0, "video-main", 2424, 2424, ["avc1.42001e", "mp4a.40.2"], 16, 16, "4/1", True, True)], "asset string, pos long, id string, bandwidth long, average_bandwidth long, codecs array<string>, width long, height long, frame_rate string, has_audio boolean, has_subtitles boolean")
    want = '#EXTM3U\n#EXT-X-INDEPENDENT-SEGMENTS\n#EXT-X-MEDIA:TYPE=AUDIO,URI="audio-en.m3u8",GROUP-ID="audio",LANGUAGE="en",NAME="English",DEFAULT=YES,AUTOSELECT=YES,CHANNELS="2"\n#EXT-X-MEDIA:TYPE=SUBTITLES,URI="text-en.m3u8",GROUP-ID="subtitles",LANGUAGE="en",NAME="English",AUTOSELECT=YES\n#EXT-X-STREAM-INF:BANDWIDTH=2424,AVERAGE-BANDWIDTH=2424,CODECS="avc1.42001e,mp4a.40.2",RESOLUTION=16x16,FRAME-RATE=4,AUDIO="audio",SUBTITLES="subtitles",CLOSED-CAPTIONS=NONE\nvideo-main.m3u8\n'
    assert playlists.master_playlist(media, variants, ["asset"]).first()["document"] == want
    image = spark.createDataFrame([("a", 2000, 4000), ("b", 5000, 4000), ("c", 0, 4000)], "id string, duration_ms long, sprite_ms long")
    assert sorted((r.id, r.number, r.image_ms, r.is_first) for r in playlists.image_rows(image).collect()) == [("a", 1, 2000, True), ("b", 1, 4000, True), ("b", 2, 1000, False)]


def test_descriptors(spark, tmp_path):
    good = '{"boundaries": [5, 1], "tracks": [{"id": "v", "type": "video", "path": "v.mp4", "width": 16, "other": 1}, {"id": "a", "type": "audio", "path": "a.mp4"}, {"id": "s", "type": "text", "format": "webvtt", "role": "caption", "language": "nl"}]}'
    (tmp_path / "a.json").write_text(good)
    assets = descriptors.read(spark, str(tmp_path))
    assert assets.first()["asset"]["boundaries"] == [5, 1]
    got = [(r.pos, r.id, r.kind, r.language, r.role) for r in descriptors.tracks_of(assets).orderBy("pos").collect()]
    assert got == [(0, "v", "cmaf", None, None), (1, "a", "cmaf", "und", None), (2, "s", "webvtt", "nl", "caption")]
    again = descriptors.parsed(descriptors.written_json(assets).drop("asset")).first()["asset"]
    assert again == assets.first()["asset"]
    for bad in ('{"thumbnails": []}', '{"tracks": [{"id": "x", "type": "image"}]}', "{", '{"tracks": [{"id": "x", "type": "text", "role": "no"}]}'):
        with pytest.raises(PySparkException):
            descriptors.parsed(spark.createDataFrame([(bad,)], "content string")).collect()
    assert descriptors.parse_input("b.vtt,language=nl,role=caption,language=de") == {"path": "b.vtt", "language": "de", "role": "caption"}
    for bad in ("a,role=", "a,x=1", ",language=nl"):
        with pytest.raises(ValueError):
            descriptors.parse_input(bad)
