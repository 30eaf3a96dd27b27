import math
import random
from collections import Counter

import numpy as np

from cadenza.llm import bm25
from cadenza.llm.bm25 import top_k
from tests.llm.common import prose, table
from tests.llm.test_decontamination import words


def brute(docs, queries, k):
    counts = [Counter(words(t)) for _, t in docs]
    mean = sum(sum(c.values()) for c in counts) / len(docs)
    df = Counter(w for c in counts for w in c)
    out = []
    for q, text in {(q, t) for q, t in queries if t is not None}:
        scored = []
        for (d, _), c in zip(docs, counts):
            s = sum(math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(words(text)) if c[w])
            if s:
                scored.append((-round(s, 4), -(1 << 63) if d is None else d))
        out += [(q, r, None if d < 0 else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and abs(a[3] - b[3]) < 2e-4


def docs():
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(0, 120), 400) + (" Straße über" if i % 5 == 0 else "")) for i in range(400)]
    rows += [(500 + i, rows[100][1]) for i in range(30)] + [(600, None), (700, ""), (800, "zzz"), (None, rows[5][1]), (100, "extra text w1"), (100, "extra text w1")]
    return rows


def result(spark, rows, k):
    t = table(spark, rows)
    return sorted(map(tuple, top_k(t, t.filter("doc_id % 100 = 0"), k).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    rows = docs()
    queries = [r for r in rows if r[0] is not None and r[0] % 100 == 0]
    want = brute(rows, queries, 10)
    got = result(spark, rows, 10)
    close(got, want)
    assert sum(a[2] == b[2] for a, b in zip(got, want)) >= 0.98 * len(want)
    monkeypatch.setattr(bm25, "QUERY_BYTES", 500)
    close(result(spark, rows, 10), want)


def test_small_tables(spark):
    assert result(spark, [], 3) == []
    assert result(spark, [(100, None), (200, " ")], 3) == []
    assert [r[:3] for r in result(spark, [(100, "a b"), (200, "c"), (3, "b")], 3)] == [(100, 1, 100), (100, 2, 3), (200, 1, 200)]


def test_scores_that_round_alike_are_ties(spark):
    rows = [(100 - i, "zz " + "w " * (9000 + i)) for i in range(30)] + [(1000 + i, "w " * 9000) for i in range(60)]
    for k in (1, 2, 5):
        want = brute(rows, [(7, "zz")], k)
        got = sorted(map(tuple, top_k(table(spark, rows), table(spark, [(7, "zz")]), k).collect()), key=str)
        assert [r[:3] for r in got] == [r[:3] for r in want]
    rows = docs()
    assert [r[:3] for r in result(spark, rows, 10)] == [r[:3] for r in brute(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], 10)]


def test_a_floor_spares_the_postings_of_frequent_words(spark, monkeypatch):
    """Whatever the floor, a shard finds the same; with one, no posting of a
    frequent word is read, and a block's words are looked up once."""
    rng = random.Random(3)
    rows = [(i, "the of and to " + prose(rng, 40, 400) + (" rare odd" if i % 40 == 0 else "")) for i in range(1, 401)]
    row = max(bm25.build_index(table(spark, rows), "doc_id", "text").collect(), key=lambda r: r["n_docs"]).asDict()
    shard = bm25.Shard(row, 45.0)
    terms = bm25.term_counts([b"the of and to rare odd unseen"])[1]
    met = shard.meet(terms, np.where(np.isin(terms, bm25.term_counts([b"the of and to"])[1]), 0.01, 5.0))
    read, scores = [], shard._scores
    monkeypatch.setattr(shard, "_scores", lambda m, w: read.append(int(m.n[w].sum())) or scores(m, w), raising=False)
    words = np.arange(len(terms), dtype=np.int32)
    ids, found = shard.search(met, words, 1)
    again = shard.search(met, words, 1, float(found[-1]), int(ids[-1]) + 1)
    assert ids.tolist() == again[0].tolist() and found.tolist() == again[1].tolist()
    assert read[0] >= 4 * row["n_docs"] and read[1] == read[0] - 4 * row["n_docs"] > 0
