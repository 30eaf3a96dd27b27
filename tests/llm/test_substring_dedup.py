import random

from cadenza.llm.substring_dedup import SuffixAutomaton, deduplicated
from tests.llm.common import prose, table

LAST = 1 << 63


def brute(rows, run=13):
    least = {}
    split = [(t or "").encode().split() for _, t in rows]
    order = [LAST if i is None else i for i, _ in rows]
    for d, w in zip(order, split):
        for i in range(len(w) - run + 1):
            g = tuple(w[i : i + run])
            least[g] = min(least.get(g, d), d)
    out = []
    for (doc_id, _), d, w in zip(rows, order, split):
        gone = set()
        for i in range(len(w) - run + 1):
            if least[tuple(w[i : i + run])] < d:
                gone |= set(range(i, i + run))
        out.append((doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(6)
    passages = [prose(rng, rng.randint(10, 60)) for _ in range(12)]
    rows = []
    for i in range(300):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                parts.append(prose(rng, rng.randint(0, 40), 5000))
            else:
                w = rng.choice(passages).split()
                a = rng.randint(0, max(0, len(w) - 14))
                parts.append(" ".join(w[a : a + rng.randint(11, 60)]))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(i + 300, rows[i][1]) for i in range(0, 60)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "x " * 500), (404, "x " * 30_000), (None, rows[3][1]), (None, rows[3][1] + " more " + "q " * 20), (5, rows[5][1]), (406, "é " * 14), (407, "z é " + "é " * 14)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = cases()
    got = sorted((tuple(r) for r in deduplicated(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 2000


def test_other_lengths_and_empty(spark):
    rows = cases()[:120]
    got = sorted((tuple(r) for r in deduplicated(table(spark, rows), run=6, gram=3).collect()), key=str)
    assert got == brute(rows, 6)
    assert deduplicated(table(spark, [])).collect() == []


def test_automaton():
    rng = random.Random(9)
    for _ in range(300):
        added = ["".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(rng.randint(1, 5))]
        sam = SuffixAutomaton()
        for s in added:
            sam.add(list(s))
        q = "".join(rng.choices("abc", k=12))
        want = [max(n for n in range(i + 2) if any(q[i + 1 - n : i + 1] in s for s in added)) for i in range(len(q))]
        assert sam.matching(list(q)) == want
