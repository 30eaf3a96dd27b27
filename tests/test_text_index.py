import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import text, timeline
from cadenza.sources import boxes, wvtt

SCHEMA = "track string, pos long, start_ms long, end_ms long, text string"


def cue_table(spark, seed):
    rng, rows = random.Random(seed), []
    for track in ("a", "b", "c"):
        for k in range(rng.choice([0, 1, 5, 30])):
            start = rng.randint(0, 300)
            rows.append((track, k, start, start + rng.choice([0, 0, 1, 7, 80]), rng.choice(["", "x", "é ü", "two\nlines"])))
    return spark.createDataFrame(rows, SCHEMA)


def packaged(cues, length, boundaries):
    """The files themselves, sample by sample."""
    whole = text.durations(cues)
    cuts = whole.select("track", F.explode(F.concat(F.array(F.lit(0).cast("long"), "duration"), text.divisions(whole, length, boundaries))).alias("c"))
    ranges = whole.select("track", F.lit(0).cast("long").alias("a"), F.col("duration").alias("b"))
    edges = cues.select("track", F.explode(F.array("start_ms", "end_ms")).alias("c")).union(cuts)
    parts = timeline.cue_samples(timeline.partitioned(ranges, edges), cues, 50)
    starts = cuts.groupBy("track").agg(F.array_sort(F.collect_set("c")).alias("starts"))
    return wvtt.packaged(parts.join(starts, "track").withColumn("segment", F.size(F.filter("starts", lambda s: s <= F.col("start")))))


@pytest.mark.parametrize("seed,length,boundaries", [(1, 0, []), (2, 40, []), (3, 0, [10, 10, 200, 9999, 0]), (4, 64, [5, 64, 90]), (5, 1, [])])
def test_the_index_is_that_of_the_bytes(spark, seed, length, boundaries):
    cues = cue_table(spark, seed)
    names = ["track", "idx", "st", "en", "start_byte", "end_byte"]
    got = [tuple(r) for r in text.text_index(cues, length, boundaries).select(*names).collect()]
    files = packaged(cues, length, boundaries).select(F.col("track").alias("path"), "content")
    want = boxes.segments(boxes.headers(files)).select("path", "idx", "start", "end", "start_byte", "end_byte").collect()
    assert sorted(got) == sorted(map(tuple, want))
    sizes = {r.path: r.n for r in files.select("path", F.length("content").alias("n")).collect()}
    assert {t: max(e for x, *_, e in got if x == t) for t, *_ in got} == sizes
    inits = {r.track: bytes(r.content) for r in text.initialization(cues).collect()}
    assert inits == {r.path: bytes(r.content[: text.INITIALIZATION]) for r in files.collect()}
    samples = text.text_samples(cues, length, boundaries).groupBy("track", "segment").count().collect()
    index = text.text_index(cues, length, boundaries).collect()
    assert {(r.track, r.idx): r.n_samples for r in index} == {(r.track, r.segment): r["count"] for r in samples}


def test_no_cues(spark):
    cues = spark.createDataFrame([("a", 0, 0, 0, "x")], SCHEMA)
    assert text.text_index(cues, 10).collect() == [] == text.text_index(cues.limit(0), 10).collect()
