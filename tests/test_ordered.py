import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from cadenza.operators.ordered import followed, numbered, ordered, running


def table(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None, "c"]), rng.choice([None, *range(20)]), rng.randint(0, 9), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, o bigint, v bigint, i bigint")


@pytest.mark.parametrize("n", [0, 1, 7, 900])
def test_numbers_and_sums_equal_a_loop(spark, n):
    rows, t = table(spark, n, n)
    want, seen = {}, defaultdict(lambda: [0, 0, 0])
    for g, o, v, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
        s = seen[g]
        s[0] += 1
        s[1] += v
        s[2] ^= i
        want[i] = tuple(s)
    got = numbered(t, ["g"], ["o", "i"]).collect()
    assert {r.i: r.number for r in got} == {i: w[0] for i, w in want.items()} and len(got) == n
    got = running(t.repartition(3), ["g"], ["o", "i"], {"upto": "v"}, {"parity": "i"}).collect()
    assert {r.i: r.upto for r in got} == {i: w[1] for i, w in want.items()}
    assert {r.i: r.parity for r in got} == {i: w[2] for i, w in want.items()}


def test_one_group_lies_in_many_partitions(spark):
    t = spark.range(4000).selectExpr("1 AS g", "7 AS o")
    placed = ordered(t, ["g", "o"])
    assert placed.select("_part").distinct().count() > 1
    assert sorted(r.number for r in numbered(t, ["g"], ["o"]).collect()) == list(range(1, 4001))


def test_no_groups(spark):
    got = numbered(spark.range(100).selectExpr("-id AS x"), [], ["x"]).collect()
    assert sorted((r.x, r.number) for r in got) == [(i - 99, i + 1) for i in range(100)]


def test_small_batches_doubles_and_overflow(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows, t = table(spark, 300, 5)
        got = running(t.withColumn("x", F.col("v") / 2), ["g"], ["o", "i"], {"half": "x", "n": F.lit(1).cast("bigint")}).collect()
        for r in got:
            upto = [v for g, o, v, i in rows if g == r.g and (o is not None, o or 0, i) <= (r.o is not None, r.o or 0, r.i)]
            assert (r.half, r.n) == (sum(upto) / 2, len(upto))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(Exception, match="64 bits|overflow"):
        running(spark.range(4).selectExpr("id", "1L << 61 AS v"), [], ["id"], {"s": F.col("v") * 2}).collect()


def test_following_rows(spark):
    rows, t = table(spark, 200, 8)
    placed = ordered(t, ["g", "o", "i"])
    got = followed(placed, ["g"], "_part", ["_at"], {"next": "i"}).collect()
    for name in {r[0] for r in rows}:
        own = [i for g, o, v, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3])) if g == name]
        assert {r.i: r.next for r in got if r.g == name} == dict(zip(own, [*own[1:], None]))
