import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cadenza.llm.filter_audit import filter_audit
from tests.llm.common import prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        out.append({f for f, bad in fails.items() if bad})
    return out


def brute(rows, labels):
    """Applies the filters to every document, order by order."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    out, shapley = {}, Counter()
    docs = [(r[0], r[2] or "", f) for r, f in zip(rows, failing(rows), strict=True)]
    for part in {p for _, p, _ in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in docs if p == part]
            gone = []
            for step, name in enumerate(order, 1):
                lost = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                out[part, order, step] = [len(left), len(lost), sum(name in f for _, f in gone), sum(f == {name} for _, p, f in docs if p == part), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
                shapley[part, name] += len(lost)
                gone += lost
    return {(p, o, s): tuple(v) + (shapley[p, o[s - 1]],) for (p, o, s), v in out.items()}


def case(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = prose(rng, rng.choice([0, 5, 199, 200, 260]), rng.choice([20, 5000]))
        t = rng.choice([t, t.upper(), t + " #", "\t" + t + "\n\x0b", t + "\x1c x", t])
        if rows and rng.random() < 0.4:
            t = rng.choice(rows)[1]
        rows.append((rng.choice([i, i, i, rng.randrange(n), None]), rng.choice([t, t, t, None, ""]), rng.choice(["en", "de", "", None]), "s"))
    labels = [(rng.choice([*range(n), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)]
    return rows, labels


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 1), (3, 150), (4, 0)])
def test_equals_applying_the_filters(spark, seed, n):
    rows, labels = case(seed, n)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("lang", F.lit("clash"))
    docs = table(spark, rows).withColumn("quality", F.lit(1)).withColumn("part", F.lit("clash")).withColumn("mask", F.lit(7))
    got = filter_audit(docs, marks).collect()
    want = brute(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in NAMES) for r in got} == want
    assert len(got) == len(want)


def test_copies_of_one_text(spark):
    rows = [(i, "same text", "en", "s") for i in range(500)] + [(0, "same text", "en", "s")]
    got = {(r.filter_order, r.step): r for r in filter_audit(table(spark, rows), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()}
    assert got["EABCD", 1].removed == 499 and got["EABCD", 1].kept == 2
    assert got["AEBCD", 2].redundant == 499 and got["AEBCD", 2].removed == 0 and len(got) == 600


def test_other_filters(spark):
    docs = table(spark, [(1, "a"), (2, "bb"), (3, "bb")])
    got = filter_audit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), lambda t: {"L": F.length(t) > 1}, "K").collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in got} == {("LK", 1): (1, 2, 0, 3), ("LK", 2): (1, 0, 1, 1), ("KL", 1): (2, 1, 0, 1), ("KL", 2): (1, 1, 1, 3)}
    with pytest.raises(ValueError):
        filter_audit(docs, docs, lambda t: {"E": F.lit(True)})
