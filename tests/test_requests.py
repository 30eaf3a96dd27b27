import pytest
from pyspark.sql import functions as F

from cadenza.plans import requests
from cadenza.plans.filters import FilterError, Options
from tests.test_mpd import CROWD, NOTES, SCHEMA, SLIM, WIDE

#: Ends in ticks, and bytes, of each track's segments.
SEGMENTS = {
    "wide": [(1200, 9000), (2400, 6000), (3600, 12_000)],
    "slim": [(1200, 900), (2400, 900), (3600, 900)],
    "crowd": [(1800, 450), (3600, 300)],
    "notes": [(600, 30), (3600, 300)],
}
SHEETS = [("gig", 0, "sheet", 2, 300), ("gig", 1, "small", 4, 100)]


def tables(spark):
    kinds = {"notes": "webvtt"}
    t = spark.createDataFrame([(*row, kinds.get(row[2], "cmaf")) for row in (WIDE, CROWD, NOTES, SLIM)], SCHEMA + ", format string")
    rows = []
    for name, ends in SEGMENTS.items():
        start = 0
        for k, (end, size) in enumerate(ends):
            rows.append((name, k, start, end, start * 1000 // 600, end * 1000 // 600, size))
            start = end
    return t, spark.createDataFrame(rows, "id string, idx long, st long, en long, sm long, em long, sz long")


@pytest.fixture(scope="module")
def asset(spark):
    t, s = tables(spark)
    return t, s, spark.createDataFrame(SHEETS, "asset string, pos long, id string, tile_size long, width long")


def document(asset, resource, text=None, **options):
    t, s, sheets = asset
    return requests.manifest(t, s, resource, Options("gig", **options), text, thumbnails=sheets).first()["document"]


def test_master_playlist(asset):
    # Peaks: wide 12,000 bytes in 2 s, slim 900, crowd 450 in 3 s, notes 300 in 5 s;
    # averages over 6 s. Audio and text each add their peaks.
    plain, packed = document(asset, "master.m3u8"), document(asset, "master.m3u8", wvtt=True)
    assert 'BANDWIDTH=49680,AVERAGE-BANDWIDTH=37440,CODECS="hvc1.1.6.L93,mp4a.40.5",RESOLUTION=960x400,FRAME-RATE=25,' in plain
    assert 'BANDWIDTH=5280,AVERAGE-BANDWIDTH=5040,CODECS="hvc1.1.6.L60,mp4a.40.5",RESOLUTION=480x200' in plain
    assert 'CODECS="hvc1.1.6.L93,mp4a.40.5,wvtt",' in packed and packed.count("#EXT-X-MEDIA:") == 2
    assert plain.index("#EXT-X-MEDIA") < plain.index("wide.m3u8") < plain.index("slim.m3u8") < plain.index("#EXT-X-IMAGE-STREAM-INF")
    # Sprites of 2 x 2 at 2 s a frame: 300 wide, 125 high cut to 124; 300 * 124 / 8 s.
    assert '#EXT-X-IMAGE-STREAM-INF:BANDWIDTH=4650,CODECS="jpeg",RESOLUTION=150x62,URI="sheet.m3u8"\n' in plain


def test_playlists_of_tracks(asset):
    assert "notes/600.vtt" in document(asset, "notes.m3u8") and "notes/600.m4s" in document(asset, "notes.m3u8", wvtt=True)
    assert document(asset, "wide.m3u8", min_length=4000).count("#EXTINF:") == 2
    assert document(asset, "sheet.m3u8") == (
        "#EXTM3U\n#EXT-X-VERSION:6\n#EXT-X-TARGETDURATION:6\n#EXT-X-PLAYLIST-TYPE:VOD\n#EXT-X-IMAGES-ONLY\n"
        "#EXT-X-TILES:RESOLUTION=150x62,LAYOUT=2x2,DURATION=2.000\n#EXTINF:6,\nsheet/1.jpg\n#EXT-X-ENDLIST\n"
    )


def test_filters_come_after_thumbnails_have_sources(asset):
    alone = document(asset, "master.m3u8", "type == audio")
    assert "wide" not in alone and "sheet" not in alone
    images = document(asset, "index.mpd", "type == thumbnail || type == audio")
    assert images.count("<AdaptationSet") == 3 and "sheet/$Number$.jpg" in images
    assert document(asset, "index.mpd", "tile_size == 4").count("<AdaptationSet") == 1
    assert "small" in document(asset, "index.mpd", "width < 300 && height > 0")
    t, s, sheets = asset
    with pytest.raises(Exception, match="no source for thumbnail"):
        requests.manifest(t.filter("type <> 'video'"), s, "index.mpd", Options("gig"), thumbnails=sheets).collect()


def test_errors(asset):
    for resource, text, error in (("index.mpd", "width > 5000", requests.NotFound), ("index.mpd", "x == 1", FilterError), ("a.txt", None, requests.NotFound), ("none.m3u8", None, requests.NotFound), ("wide.m3u8", "type == audio", requests.NotFound)):
        with pytest.raises(error):
            document(asset, resource, text)


def test_files_of_tracks(asset):
    t, s, sheets = asset
    at = lambda name, start, **o: [(r.start, r.end) for r in requests.segment(s, name, start, Options("gig", **o)).collect()]
    assert at("crowd", "1800") == [(1800, 3600)] and at("crowd", "1800", min_length=4000) == [] and at("wide", "2400", min_length=4000) == [(2400, 3600)]
    assert at("crowd", "abc") == [] and at("crowd", "") == [] and at("crowd", "18446744073709551616") == []
    thumbs = requests.thumbnails_of(t, s, sheets)
    assert [(r.number, r.start_ms, r.end_ms) for r in requests.sprite(thumbs, "sheet", "1").collect()] == [(1, 0, 6000)]
    for name in ("0", "x", "-1", ""):
        with pytest.raises(requests.NotFound):
            requests.sprite(thumbs, "sheet", name)
    assert requests.dispatch("wide", "init.mp4") == ("init", None) and requests.dispatch("wide", "1200.m4s") == ("media", 1200)
    assert requests.dispatch("notes", "0.vtt") == ("text", 0) and requests.dispatch("sheet", "7.jpg") == ("sprite", 7)
    for bad in ("init", "a.m4s", "0.jpg", "1.png", "x.mp4", ".vtt"):
        with pytest.raises(requests.NotFound):
            requests.dispatch("wide", bad)


CUES = [("notes", 0, 500, 2500, "one"), ("notes", 1, 3900, 4100, "two"), ("notes", 2, 6000, 6000, "")]


def test_text_of_a_served_segment(spark):
    cues = spark.createDataFrame(CUES, "id string, pos long, start_ms long, end_ms long, text string")
    text = lambda start, cuts=(), **o: [r.content for r in requests.text_segment(cues, "notes", start, Options("gig", **o), cuts).collect()]
    second = "WEBVTT\n\n00:00:02.000 --> 00:00:02.500\none\n\n00:00:03.900 --> 00:00:04.000\ntwo\n"
    assert text("2000", text_length=2000) == [second] and text("2000", text_length=2000, min_length=3000) == []
    assert text("2000", text_length=2000, min_length=3000, cuts=[2000]) == [second.replace("04.000", "04.100")]
    assert text("0") == ["WEBVTT\n\n00:00:00.500 --> 00:00:02.500\none\n\n00:00:03.900 --> 00:00:04.100\ntwo\n"]
    assert text("2000") == [] and text("x", text_length=2000) == []


def test_text_is_cut_as_the_request_asks(asset, spark):
    t, s, sheets = asset
    cues = spark.createDataFrame(CUES, "id string, pos long, start_ms long, end_ms long, text string")
    stored = s.filter("id <> 'notes'")
    t = t.withColumn("timescale", F.when(F.col("id") == "notes", 1000).otherwise(F.col("timescale")))
    playlist = lambda cuts=(), **o: requests.manifest(t, stored, "notes.m3u8", Options("gig", **o), None, cuts, cues=cues).first()["document"]
    assert [x for x in playlist(text_length=2000).split("\n") if x.startswith("notes/")] == ["notes/0.vtt", "notes/2000.vtt", "notes/4000.vtt"]
    assert "notes/4000.m4s" in playlist(text_length=2000, wvtt=True) and playlist().count("#EXTINF:6,") == 1
    assert playlist([700], text_length=5000).count("#EXTINF") == 3
    assert 'timescale="1000"' in requests.manifest(t, stored, "index.mpd", Options("gig", text_length=2000), None, cues=cues).first()["document"]
    made = requests.initialization(t, cues, "notes").first()
    assert made.mime_type and made.start_byte == 0 and made.end_byte == 579 == len(made.content) and bytes(made.content[4:8]) == b"ftyp"
    stored = requests.initialization(t.withColumns({"path": F.lit("a.mp4"), "init_end": F.lit(700)}), cues, "wide").first()
    assert (stored.path, stored.start_byte, stored.end_byte, stored.content) == ("a.mp4", 0, 700, None)


def test_sources_of_a_sprite(asset, spark):
    t, s, sheets = asset
    thumbs = requests.thumbnails_of(t, s, sheets)
    wide = spark.createDataFrame([("slim", k, 1200 * k + (3 if k == 4 else 0), 1200 * k + 1200, 100 + 10 * k + (500 if k > 2 else 0), 110 + 10 * k + (500 if k > 2 else 0)) for k in range(6)], "id string, idx long, st long, en long, start_byte long, end_byte long")
    reads = lambda n, gap=0: sorted((r.start_byte, r.end_byte, r.places) for r in requests.sprite_sources(thumbs, wide, "sheet", n, gap).collect())
    assert reads("1") == [(100, 130, [0, 1, 2]), (630, 640, [3])] and reads("1", 500) == [(100, 640, [0, 1, 2, 3])]
    assert reads("2") == [(640, 660, [0, 1])] and reads("3") == []
    with pytest.raises(requests.NotFound):
        requests.sprite_sources(thumbs, wide, "sheet", "0")
