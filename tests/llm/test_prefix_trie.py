import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.llm import prefix_trie as P
from cadenza.llm import queries as Q

SCHEMA = "conv_id bigint, turn bigint, role string, text string, rank string, depth int"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def own(rows):
    """Turns of each conversation, as (role, text)."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    return {c: [(t[2], t[4]) for t in sorted(ts, key=lambda t: t[:4])] for c, ts in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    """The trie turn by turn."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below[node] = (sum(below[k][0] for k in kids) or 1, saved + sum(below[k][1] for k in kids))
        ends = ",".join(map(str, sorted(c for c in members[node] if len(convs[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[c] for c in FIELDS) for r in got), key=key) == sorted(want, key=key)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)


def case(seed, n):
    """Conversations that copy, continue and leave each other."""
    rng = random.Random(seed)
    convs = []
    for _ in range(n):
        turns = list(rng.choice(convs)) if convs and rng.random() < 0.7 else []
        turns = turns[: rng.randint(0, len(turns))] if rng.random() < 0.6 else turns
        turns = turns + [(rng.choice(["u", "a", None, ""]), rng.choice(["x", "é", "long text", "", None, rng.random().hex()])) for _ in range(rng.choice([0, 0, 1, 2, 7]))]
        convs.append(turns or [("u", "x")])
    rows = [(c, t, role, text) for c, turns in zip(rng.sample(range(3 * n + 1), n), convs, strict=True) for t, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,chunk,slice_", [(1, 60, 256, 4096), (2, 60, 2, 3), (3, 90, 3, 2), (4, 1, 256, 4096), (5, 0, 256, 4096)])
def test_equals_the_trie_turn_by_turn(spark, monkeypatch, seed, n, chunk, slice_):
    monkeypatch.setattr(P, "CHUNK", chunk)
    monkeypatch.setattr(P, "SLICE", slice_)
    monkeypatch.setattr(P, "LIST_BITS", 3)
    rows = case(seed, n)
    same(P.conversation_trie(table(spark, rows)).collect(), brute(own(rows)))


@pytest.mark.parametrize("seed,slice_", [(6, 4096), (7, 2)])
def test_spliced(spark, monkeypatch, seed, slice_):
    monkeypatch.setattr(P, "SLICE", slice_)
    rows = case(seed, 70)
    turns = P.ordered_turns(table(spark, rows))
    got = P.prefix_trie(P.spliced(turns, F.expr("conv - conv % 5"), F.crc32(F.col("conv").cast("string").cast("binary")) % 9)).collect()
    same(got, brute(rebuilt(own(rows))))


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(1, None, "u", "b"), (1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, None, None), (None, 0, "u", "a"), (None, None, None, None), (2, None, "u", "b"), (2, -5, "", ""), (3, 7, "u", "b")]
    rows += [(4, 1, "ab", "c"), (5, 1, "a", "bc")]
    same(P.conversation_trie(table(spark, rows)).collect(), brute(own(rows)))


def test_copies_and_a_long_conversation(spark):
    rows = [(c, t, "u", "same") for c in range(300) for t in range(3)] + [(1000, t, "u", "same") for t in range(700)] + [(1001, t, "u", "same" if t < 600 else "x") for t in range(650)]
    same(P.conversation_trie(table(spark, rows)).collect(), brute(own(rows)))


def test_query(spark, tmp_path):
    rows = case(9, 60)
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    same(Q.op11_conversation_trie(spark, str(tmp_path)).collect(), brute(rebuilt(own(rows))))
