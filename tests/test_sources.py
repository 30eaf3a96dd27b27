"""Stored files: ranges that are read, descriptors joined to them, sinks."""

import json

import pytest
from pyspark.errors import PySparkException

from cadenza.sources import assets, boxes, descriptors, files
from cadenza.sources.languages import with_language_names
from tests.test_boxes import good


def test_headers_and_ranges_of_stored_files(spark, tmp_path):
    content = good()
    root = tmp_path.as_uri()
    assert files.write_files(spark.createDataFrame([("m/a.mp4", bytearray(content)), ("m/big.mp4", bytearray(content))], "path string, content binary"), root) == 2
    # A hole of 3 GiB behind the media: only headers are read.
    with open(tmp_path / "m" / "big.mp4", "r+b") as f:
        f.truncate(3 << 30)
    rows = boxes.read(spark, f"{root}/m").drop("path").distinct().collect()
    assert len(rows) == 1
    read = []
    boxes.header(None, lambda at, n: read.append(n) or content[at : at + n] + bytes(max(0, at + n - len(content))), 3 << 30)
    assert sum(read) < 2000
    path = f"{root}/m/big.mp4"
    ranges = spark.createDataFrame([(path, 0, 0, 16), (path, 1, (3 << 30) - 4, 3 << 30)], "path string, idx long, start_byte long, end_byte long")
    assert [(r.idx, bytes(r.data)) for r in boxes.stored_ranges(ranges).orderBy("idx").collect()] == [(0, content[:16]), (1, bytes(4))]
    with pytest.raises(PySparkException, match="past the file"):
        boxes.stored_ranges(ranges.filter("idx = 1").selectExpr("path", "idx", "start_byte", "end_byte + 1 as end_byte")).collect()
    with pytest.raises(PySparkException):
        files.write_files(spark.createDataFrame([("x", b"1")], "path string, content binary"), "nofs://x")


def test_read_or_create(spark, tmp_path):
    missing = assets.read_or_create(spark, (tmp_path / "none.json").as_uri()).first()
    assert missing.asset.tracks == [] and missing.asset.boundaries == []
    (tmp_path / "a.json").write_text(json.dumps({"boundaries": [5], "tracks": [{"type": "video", "path": "v.mp4"}]}))
    assert assets.read_or_create(spark, (tmp_path / "a.json").as_uri()).first().asset.boundaries == [5]
    (tmp_path / "b.json").write_text("{")
    with pytest.raises(PySparkException):
        assets.read_or_create(spark, (tmp_path / "b.json").as_uri()).collect()


def found(spark, *rows):
    return assets.discovered(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary"))


def test_discovery_by_suffix(spark):
    got = {r.path: r for r in found(spark, ("d/a.mp4", good()), ("d/b.vtt", b"WEBVTT\n")).collect()}
    assert (got["d/a.mp4"].kind, got["d/a.mp4"].codec, got["d/a.mp4"].width) == ("cmaf", "avc1.42c00a", 16)
    assert (got["d/b.vtt"].kind, got["d/b.vtt"].language, got["d/b.vtt"].type) == ("webvtt", "und", "text")
    for bad in (("d/b.vtt", b"no"), ("d/b.txt", b"WEBVTT\n")):
        with pytest.raises(PySparkException):
            found(spark, bad).collect()


def test_tracks_with_their_files(spark):
    text = json.dumps({"tracks": [{"type": "video", "path": "../d/a.mp4", "width": 99}, {"type": "thumbnail", "id": "t", "tile_size": 2, "width": 5}]})
    tracks = descriptors.tracks_of(descriptors.parsed(spark.createDataFrame([("x/list.json", text)], "path string, content string")).select("path", "asset"))
    (row,) = assets.resolved(tracks, found(spark, ("d/a.mp4", good()))).collect()
    # The descriptor's metadata count as a whole: the file's height does not come in.
    assert (row.file, row.width, row.height, row.codec, row.timescale) == ("d/a.mp4", 99, None, "avc1.42c00a", 1000)
    with pytest.raises(PySparkException, match="no such file: d/a.mp4"):
        assets.resolved(tracks, found(spark, ("d/other.mp4", good()))).collect()


def test_appended_sources(spark):
    tracks = spark.createDataFrame([("x/y/l.json", 0, "p.mp4")], "descriptor string, pos long, path string")
    new = spark.createDataFrame([("x/y/l.json", "x/z/b.mp4"), ("x/y/l.json", "x/y/a.mp4")], "descriptor string, path string")
    got = sorted((r.pos, r.path) for r in assets.appended(tracks, new).collect())
    assert got == [(0, "p.mp4"), (1, "../z/b.mp4"), (2, "a.mp4")] or got == [(0, "p.mp4"), (1, "a.mp4"), (2, "../z/b.mp4")]
    with pytest.raises(PySparkException, match="in memory"):
        assets.appended(tracks, spark.createDataFrame([("x/y/l.json", None)], "descriptor string, path string")).collect()


def test_schema_of_descriptors():
    schema = json.loads(descriptors.json_schema())
    assert schema["additionalProperties"] is False and set(schema["properties"]) == {"$schema", "boundaries", "tracks"}
    track = schema["properties"]["tracks"]["items"]["properties"]
    assert track["type"]["enum"] == ["video", "audio", "text", "thumbnail"] and track["width"] == {"type": "integer", "minimum": 0}


def test_language_names(spark):
    rows = spark.createDataFrame([(t,) for t in ("sw", "swa", "el-GR", "NL", "qqq", "x-private", None)], "tag string")
    got = {r.tag: r.name for r in with_language_names(rows, "tag").collect()}
    assert got == {"sw": "Swahili", "swa": "Swahili", "el-GR": "Modern Greek (1453-)", "NL": "Dutch", "qqq": "qqq", "x-private": "x-private", None: None}
