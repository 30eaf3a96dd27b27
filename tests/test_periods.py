import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import periods, timeline
from cadenza.plans import queries


@pytest.mark.parametrize("seed,timescale", [(1, 1000), (2, 600), (3, 90_000), (4, 7), (5, 48_000)])
def test_runs_by_period_equal_segments_by_period(spark, seed, timescale):
    rng = random.Random(seed)
    segments, cuts = [], [rng.randint(-50, 4000) for _ in range(6)] + [1000, 1000]
    for track in ("a", "b"):
        at = rng.choice([0, timescale // 2])
        for k in range(60):
            at += rng.choice([0, 0, 0, 0, timescale // 3])
            d = rng.choice([0, timescale // 10, timescale // 10, timescale // 10, timescale // 3 + 1, 1])
            segments.append((track, k, at, at + d))
            at += d
    duration = 3500
    edges = [0, *sorted({c for c in cuts if 0 < c < duration}), duration]
    want = {}
    for track, k, st, en in segments:
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            if st * 1000 // timescale < b and a < en * 1000 // timescale:
                want.setdefault((track, p, a, b), []).append((k, st, en))
    t = spark.createDataFrame(segments, "track string, idx long, st long, en long")
    runs = timeline.absolute_runs(t).withColumns({"timescale": F.lit(timescale).cast("bigint"), "spans": periods.spans_of(F.lit(duration).cast("bigint"), cuts)})
    pieces = periods.clipped_runs(runs)
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: r.run):
        got.setdefault((r.track, r.period_id, r.period_start, r.period_end), []).extend((r.number + i, r["first"] + i * r.d, r["first"] + (i + 1) * r.d) for i in range(r.n))
    assert got == want
    ticks = spark.createDataFrame([(x,) for x in {x for *_, a, b in segments for x in (a, b, a + 1)}], "tick long")
    edge = pieces.crossJoin(ticks).groupBy("track", "period_id", "tick").agg(F.bool_or(periods.has_edge(F.col("tick"), False)).alias("starts"), F.bool_or(periods.has_edge(F.col("tick"), True)).alias("ends"))
    held = {(track, p): rows for (track, p, *_), rows in want.items()}
    for r in edge.collect():
        rows = held[r.track, r.period_id]
        assert r.starts == any(r.tick == a for _, a, _ in rows) and r.ends == any(r.tick == b for _, _, b in rows)


def test_runs_are_cut_without_wide_divisions(spark):
    runs = spark.createDataFrame([("a", 0, 0, 10, 7, 0, True), ("b", 0, 5, 0, 2, 0, True)], "track string, run long, first long, d long, n long, number long, gap boolean")
    spans = periods.spans_of(F.lit(50).cast("bigint"), [20, 33])
    at = spark.createDataFrame([("a", 1000), ("b", 1000)], "track string, timescale long")
    pieces = periods.clipped_runs(runs.join(at.withColumn("spans", periods.ticked(spans, F.col("timescale"))), "track"))
    # Once for each track, below the join, and not for its runs.
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan[: plan.index("Join")]
    assert sorted((r.track, r.period_id, r["first"], r.n) for r in pieces.collect()) == [("a", 0, 0, 2), ("a", 1, 20, 2), ("a", 2, 30, 2), ("b", 0, 5, 2)]


def test_customers_are_dealt_out_before_their_steps(spark):
    """A small file is one task, whose groups would all be in its memory."""
    for name in ("period_relationship", "template_shift"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [track" in plan and plan.index("Generate explode(") < plan.index("RepartitionByExpression [track")
    steps = queries._steps(spark, "/root/testdata/sf0.001")
    assert steps.rdd.getNumPartitions() == 4 and steps.count() == steps.select("track").distinct().count() * 32
