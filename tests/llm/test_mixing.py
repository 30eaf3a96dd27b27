import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.llm.mixing import cycle_123, fair_targets, mix_sources, mixed_documents, weights
from tests.llm.common import prose, table


def reshare(sizes, weights, budget, most):
    """Targets by the rule itself: share, stop at the limit, share the excess."""
    full, out = set(), {}
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        out = {s: most * sizes[s] if s in full else left * weights[s] / weight for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def by_code_point(sources):
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [s for s in sources if s is None]
    return {s: float(1 + i % 3) for i, s in enumerate(ordered)}


def test_targets(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {f"s{i}": rng.choice([0, 5, 100, 10_000]) for i in range(rng.randint(1, 9))}
        sizes[None] = rng.randint(1, 1000)
        total = sum(sizes.values())
        got = {r.source: r for r in fair_targets(cycle_123(spark.createDataFrame(list(sizes.items()), "source string, n bigint")), total, 3).collect()}
        assert {s: r.weight for s, r in got.items()} == by_code_point(sizes)
        want = reshare(sizes, by_code_point(sizes), total, 3)
        assert got.keys() == want.keys() and all(abs(got[s].target - want[s]) < 1e-6 * total for s in sizes)


def queue(rows, weight):
    """The mix row by row: every row of a source, copies too, in a queue that
    is shuffled anyhow, its finish times, the stream and the cut. Words taken
    of each source."""
    rng, sizes, stream = random.Random(0), defaultdict(int), []
    of = defaultdict(list)
    for _, text, _, source in rows:
        of[source].append(len((text or "").split()))
        sizes[source] += of[source][-1]
    targets = reshare(sizes, weight(list(sizes)), sum(sizes.values()), 3)
    for s, words in of.items():
        rng.shuffle(words)
        upto = 0
        for e in range(3):
            for w in words:
                upto += w
                if w:
                    stream.append((upto / targets[s], rng.random(), s, w))
    taken, left = defaultdict(int), sum(sizes.values())
    for _, _, s, w in sorted(stream):
        if w > left:
            break
        left -= w
        taken[s] += w
    return targets, taken


def docs():
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(600)]
    return rows + [(5, None, "en", "a"), (None, "x y", None, "b"), (None, "x y", None, "b"), (7, "", "en", "d")]


def test_mix(spark):
    rows = docs()
    got = mix_sources(table(spark, rows)).collect()
    again = mix_sources(table(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size, source = defaultdict(int), defaultdict(set)
    for i, t, _, s in rows:
        size[s] += len((t or "").split())
        source[i].add(s)
    want = reshare(size, by_code_point(size), sum(size.values()), 3)
    taken, by_target = defaultdict(int), {}
    for r in got:
        s = [s for s in source[r.doc_id] if size[s] == r.source_size][0]
        assert abs(r.target - want[s]) < 1e-6 and r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        by_target[s] = r.target
    assert all(abs(taken[s] - by_target[s]) <= 70 for s in by_target)
    assert 0 <= sum(size.values()) - sum(taken.values()) <= 60
    assert mix_sources(table(spark, [])).collect() == []
    assert [r.taken for r in mix_sources(table(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_mixed_documents(spark):
    rows = docs()
    t = table(spark, rows)
    want = sum(r.taken for r in mix_sources(t).collect())
    mixed = mixed_documents(t)
    assert mixed.columns == t.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == want


def test_names_that_the_operator_uses_itself(spark):
    names = ["_key", "_turn", "_passes", "_pass", "turn", "passes", "row", "pass"]
    t = table(spark, docs())
    for n in names:
        t = t.withColumn(n, F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    mixed = mixed_documents(t)
    assert mixed.columns == t.columns
    for r in mixed.collect():
        assert all(r[n] == f"{n} of {'-' if r.doc_id is None else r.doc_id}" for n in names)


@pytest.mark.parametrize("given", [None, {"a": 3, "b": 2}, {"a": 1, "b": 5}])
def test_a_repeated_row_gets_its_share(spark, given):
    rows = [(7, "w w w", "en", "a")] * 1000 + [(i, f"x{i} y z", "en", "b") for i in range(1000)]
    t = table(spark, rows)
    options = {"weigh": weights(given)} if given else {}
    targets, taken = queue(rows, (lambda _: given) if given else by_code_point)
    got = mix_sources(t, **options).collect()
    of = {s: sum(r.taken for r in got if (r.doc_id == 7 and r.target == targets["a"]) == (s == "a")) for s in "ab"}
    assert all(abs(of[s] - targets[s]) <= 3 and abs(of[s] - taken[s]) <= 3 for s in "ab")
    assert all(0 <= r.taken <= 9 for r in got)
    mixed = mixed_documents(t, **options).groupBy("source").count().collect()
    assert {r["source"]: 3 * r["count"] for r in mixed} == of


def test_many_copies_of_a_row(spark):
    t = table(spark, [(1, "a b c", "en", "s")]).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).drop("i")
    got = mix_sources(t).collect()
    assert len(got) == 10_000 and sum(r.taken for r in got) == 30_000 and mixed_documents(t).count() == 10_000


def test_copies_that_differ_in_another_column(spark):
    t = table(spark, [(1, "a b c", "en", "s"), (1, "a b c", "de", "s"), (1, "a b c", "de", "s"), (2, "d e f", None, "s")])
    assert sorted(str(r.lang) for r in mixed_documents(t).collect()) == ["None", "de", "de", "en"]
