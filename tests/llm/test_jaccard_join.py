import random

from cadenza.llm import jaccard_join
from cadenza.llm.components import components
from cadenza.llm.jaccard_join import jaccard_classes, one_of_each
from tests.llm.common import prose, table


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    w = lower(text).encode().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i : i + rng.choice([0, 1, 1])] = [f"e{rng.randrange(10**6)}"]
    return words


def cases():
    rng = random.Random(11)
    rows = []
    passages = [prose(rng, 25) for _ in range(4)]
    for g in range(12):
        base = prose(rng, rng.randint(5, 150)).split()
        for _ in range(rng.randint(1, 25)):
            words = edited(rng, base, rng.choice([0, 0, 1, 2, 3, 5, 8]) if len(base) > 20 else rng.choice([0, 1]))
            text = " ".join(words).title() if rng.random() < 0.2 else "\t".join(words)
            rows.append(text)
    for _ in range(60):
        rows.append(prose(rng, rng.randint(0, 40)) + " " + " ".join(rng.sample(passages, 2)))
    rows += [None, None, "", "  ", "one", "One", "a b c", "a b c d", "a b  c d", "x " * 3000, "x " * 4000, "É é", "é é"]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def result(spark, rows):
    return sorted((tuple(r) for r in jaccard_classes(table(spark, rows)).collect()), key=str)


def test_against_brute_force(spark):
    rows = cases()
    assert result(spark, rows) == brute(rows)


def test_small_blocks_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "LED", 5)
    rows = cases()
    rows += rows[:5]
    assert result(spark, rows) == brute(rows)


def test_null_ids_and_empty(spark):
    assert result(spark, []) == []
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (None, "q r s"), (9, None), (None, None)]
    assert result(spark, rows) == brute(rows)


def test_a_row_without_an_id_links_others(spark):
    words = [f"v{i}" for i in range(200)]
    first, last = ["e"] * 20 + words[20:], words[:180] + ["f"] * 20
    rows = [(8, " ".join(first)), (3, " ".join(last)), (None, " ".join(words)), (None, "u " + " ".join(words))]
    want = brute(rows)
    assert result(spark, rows) == want and {w[2] for w in want} == {3}
    assert [r.doc_id for r in one_of_each(table(spark, rows)).collect()] == [3]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for a in near:
        seen, todo = {a}, [a]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[a] == min(seen)
    assert set(got) == set(near)
