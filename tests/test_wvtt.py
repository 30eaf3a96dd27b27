"""Packaged text: layout, a round trip through the header reader, guards."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import timeline as L
from cadenza.sources import boxes, webvtt, wvtt

SEGMENTS = [(0, [(500, []), (500, ["a"])]), (1000, [(1000, ["a", "bé"])])]


def read_samples(content, start, end):
    data = memoryview(content)
    moof = next((s, b, e) for k, s, b, e in boxes.walk(data, start, end) if k == "moof")
    run = boxes.child(data, moof[1], moof[2], "traf", "trun")
    count, offset = int.from_bytes(data[run[0] + 4 : run[0] + 8]), int.from_bytes(data[run[0] + 8 : run[0] + 12])
    at, out = moof[0] + offset, []
    for i in range(count):
        entry = run[0] + 12 + 8 * i
        duration, size = int.from_bytes(data[entry : entry + 4]), int.from_bytes(data[entry + 4 : entry + 8])
        cues = []
        for kind, _, b, e in boxes.walk(data, at, at + size):
            if kind == "vttc":
                p = boxes.child(data, b, e, "payl")
                cues.append(bytes(data[p[0] : p[1]]).decode())
        out.append((duration, cues))
        at += size
    assert at == end
    return out


def samples(spark, segments):
    rows = []
    for k, (start, parts) in enumerate(segments):
        for duration, cues in parts:
            rows.append(("t", 5 * k, start, start + duration, cues))
            start += duration
    return spark.createDataFrame(rows, "track string, segment long, start long, end long, active array<string>")


def test_round_trip(spark):
    content = bytes(wvtt.packaged(samples(spark, SEGMENTS)).first()["content"])
    head = boxes.header(content)
    assert (head["handler"], head["entry"], head["timescale"], head["language"]) == ("text", "wvtt", 1000, "und")
    at = head["first_byte"]
    for ref, (_, parts) in zip(head["refs"], SEGMENTS, strict=True):
        assert ref["duration"] == sum(d for d, _ in parts) and ref["sap"]
        assert read_samples(content, at, at + ref["size"]) == parts
        at += ref["size"]
    assert at == len(content)
    assert len(wvtt.fragments(samples(spark, [(0, [(1000, ["12345"])])])).first()["fragment"]) == 153


def test_guards(spark):
    for bad in ({"track_id": 0}, {"timescale": 0}):
        with pytest.raises(ValueError):
            wvtt.packaged(samples(spark, SEGMENTS), **bad)
    with pytest.raises(Exception, match="no time is covered"):
        wvtt.packaged(samples(spark, [(0, [(0, [])])])).collect()
    assert wvtt.packaged(samples(spark, SEGMENTS).limit(0)).collect() == []


def test_from_document_to_segments(spark):
    doc = "WEBVTT\n\n00:00.500 --> 00:01.500\na\n\n00:01.000 --> 00:02.500\nb\n"
    cues = webvtt.parsed(spark.createDataFrame([("t", doc)], "track string, content string"))
    edges = [0, *sorted({750, *L.grid(1000, 2500)}), 2500]
    ranges = spark.createDataFrame([("t", 0, 2500)], "track string, a long, b long")
    cuts = cues.select("track", F.explode(F.array("start_ms", "end_ms")).alias("c")).union(spark.createDataFrame([("t", e) for e in edges], "track string, c long"))
    parts = L.cue_samples(L.partitioned(ranges, cuts), cues, 1000)
    inner = F.array(*[F.lit(e).cast("bigint") for e in edges])
    numbered = parts.withColumn("segment", F.size(F.filter(inner, lambda e: e <= F.col("start"))))
    files = wvtt.packaged(numbered).select(F.col("track").alias("path"), "content")
    segs = boxes.segments(boxes.headers(files)).withColumns({"sm": F.col("start"), "em": F.col("end"), "sz": F.col("end_byte") - F.col("start_byte")})
    assert [(r.start, r.end) for r in segs.orderBy("idx").collect()] == [(0, 750), (750, 1000), (1000, 2000), (2000, 2500)]
    assert segs.agg(F.max(X.bitrate(F.col("sz"), F.col("end") - F.col("start"), F.col("timescale"))).alias("r")).first()["r"] > 0
    first = L.clipped(cues, 0, 750)
    assert webvtt.formatted(first).first()["content"] == "WEBVTT\n\n00:00:00.500 --> 00:00:00.750\na\n"


def test_pieces_are_the_file(spark):
    rows = [("a", 0, 0, 100, ["x"]), ("a", 0, 100, 250, []), ("a", 1, 250, 300, ["y", "z"]), ("b", -3, 0, 10, [])]
    samples = spark.createDataFrame(rows, "track string, segment long, start long, end long, active array<string>")
    whole = {r.track: bytes(r.content) for r in wvtt.packaged(samples).collect()}
    parts = {}
    for r in sorted(wvtt.pieces(samples).collect(), key=lambda r: (r.track, r.place)):
        parts[r.track] = parts.get(r.track, b"") + bytes(r.data)
    assert parts == whole
