import pytest
from pyspark.sql import functions as F

from cadenza.plans import requests, routes
from cadenza.plans.filters import Options
from tests.test_requests import CUES, SHEETS, tables

ASKED = [
    (1, "(a:gig)", "index.mpd", None, None, 200, "dash"), (2, "a:gig,c:!t", "master.m3u8", None, "type == video", 200, "hls"), (3, "a:gig", "wide.m3u8", None, None, 200, "playlist"),
    (4, "a:gig", "none.m3u8", None, None, 404, "playlist"), (5, "a:gig", "x.txt", None, None, 404, None), (6, "a:7", "index.mpd", None, None, 400, None), (7, "a:gig", "index.mpd", None, "type == video x", 400, None),
    (8, "a:gig", "init.mp4", "wide", None, 200, "init"), (9, "a:gig", "1200.m4s", "wide", None, 200, "media"), (10, "a:gig,sml:4000", "1200.m4s", "wide", None, 200, "media"), (11, "a:gig,sml:4000", "2400.m4s", "wide", None, 200, "media"),
    (12, "a:gig,stl:2000", "2000.vtt", "notes", None, 200, "text"), (13, "a:gig,stl:3000", "2000.vtt", "notes", None, 200, "text"), (14, "a:gig", "5.vtt", "wide", None, 404, "text"), (15, "a:gig", "1.jpg", "sheet", None, 200, "sprite"),
    (16, "a:gig", "0.jpg", "sheet", None, 404, None), (17, "a:gig", "1.m4s", "sheet", None, 404, "media"), (18, "a:other", "1.m4s", "wide", None, 404, "media"), (19, "a:gig", "18446744073709551615.m4s", "wide", None, 404, "media"), (20, None, None, None, None, 400, None),
    (21, "a:gig,sml:3000,stl:2000", "4000.m4s", "notes", None, 200, "media"), (None, "a:gig", "0.m4s", "crowd", None, 200, "media"),
]


@pytest.fixture(scope="module")
def table(spark):
    t, s = tables(spark)
    sheets = spark.createDataFrame(SHEETS, "asset string, pos long, id string, tile_size long, width long").withColumns({"type": F.lit("thumbnail"), "format": F.lit("thumbnail")})
    known = t.select("asset", "id", "type", "format").unionByName(sheets.select("asset", "id", "type", "format"))
    asked = spark.createDataFrame([a[:5] for a in ASKED], "request_id long, options string, resource string, track_id string, filter string")
    return routes.request_routes(asked, known), s.filter("id <> 'notes'")


def test_what_is_asked_for(table):
    got = {r.request_id: r for r in table[0].collect()}
    assert {k: (r.status, r.kind) for k, r in got.items()} == {a[0]: a[5:] for a in ASKED}
    assert all((r.message is None) == (r.status == 200) for r in got.values()) and "offset 2" in got[6].message
    assert got[3].track_id == "wide" and (got[10].min_length, got[12].text_length, got[15].number) == (4000, 2000, 1)


def test_segments_equal_those_of_single_requests(table, spark):
    found, s = table
    cues = spark.createDataFrame(CUES, "id string, pos long, start_ms long, end_ms long, text string")
    for cuts in ([], [2100]):
        got = {(r.request_id, r.id, r.start, r.end, r.bytes) for r in routes.segments_asked(found, s, cues, cuts).collect()}
        want = set()
        for i, options, resource, track, *_ in ASKED:
            if i in (9, 10, 11, 12, 13, 21, None):
                o = requests.filters.parse_options(options)
                one = requests.with_text(s, cues, o, cuts)
                want |= {(i, track, r.start, r.end, r.bytes) for r in requests.segment(one, track, resource.split(".")[0], Options("gig", o.min_length, o.text_length), cuts).collect()}
        assert got == want and len(want) >= 4
