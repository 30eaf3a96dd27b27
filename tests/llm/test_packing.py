import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import queries as Q
from cadenza.llm.packing import SCORES, Limits, RankEncoder, best_fit, byte_of, pack_documents, packed_sequences, scored
from tests.llm.common import prose, table
from tests.test_oracles import SF_DIR

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "Foo", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'", "s'll", "12", "½", "é", "ß", "ï", "中文", "🙂", "́", ".", "...", "#", "<|endoftext|>", "<|end", "\xad", "¡", "˿", "̀", "﻿", " x", "\r\n"]


def library(texts):
    t = Tokenizer.from_file(FILE)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_are_the_librarys():
    rng = random.Random(4)
    latin = ["a", "Zz", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "'ll", "12", "½", "é", "ß", "ɏ", "ª", "²", "¡", "\xad", "…", ".", "#", " x", " '", "_"]
    texts = ["".join(rng.choice(latin) for _ in range(rng.randint(0, 20))) for _ in range(20_000)]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + ["x" * 5000 + " y" * 5000, " " * 300 + "a", "w" * 300 + " " + "w" * 300]
    with open(FILE, encoding="utf-8") as f:
        encoder = RankEncoder(f.read())
    for text, ids in zip(texts, library(texts), strict=True):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, repr(text)
    assert encoder.fast is not None and byte_of()["\u0120"] == 0x20 and len(byte_of()) == 256 == len(set(byte_of().values()))


def one_by_one(counts, limits, score):
    """Best-fit of single pieces into single sequences, in the same order."""
    caps, bins = limits.vector(), []
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length])
        for _ in range(counts[length]):
            fits = [b for b in bins if (b >= need).all()]
            if fits:
                best = min(fits, key=lambda b: scored((b - need)[None], need, caps, score)[0])
                best -= need
            else:
                bins.append(caps - need)
    return len(bins)


@pytest.mark.parametrize("score", SCORES)
@pytest.mark.parametrize("limits", [Limits(32), Limits(32, documents=3), Limits(32, attention=1100), Limits(32, 5, 1024)])
def test_best_fit_of_classes(limits, score):
    rng = random.Random(7)
    for _ in range(12):
        counts = Counter(rng.randint(1, 32) for _ in range(rng.choice([1, 5, 60, 250])))
        opened, runs = best_fit(counts, limits, score)
        used, documents, cost = Counter(), Counter(), Counter()
        for length in sorted(counts, reverse=True):
            at = 0
            for n, k, many, first, offset in (r.tolist() for r in runs if r[0] == length):
                assert k == at
                at += many
                for b in range(first, first + many):
                    assert used[b] == offset
                    used[b] += n
                    documents[b] += 1
                    cost[b] += n * n
            assert at == counts[length]
        caps = limits.vector()
        assert len(used) == opened and max(used.values()) <= caps[0] and max(documents.values()) <= caps[1] and max(cost.values()) <= caps[2]
        # Equal scores may go another way, so the numbers may differ a little.
        assert abs(opened - one_by_one(counts, limits, score)) <= 1


def test_pieces_that_fit_nowhere():
    with pytest.raises(ValueError):
        best_fit({9: 1}, Limits(16, attention=80), SCORES[0])
    assert best_fit({}, Limits(16), SCORES[0])[0] == 0


def check(rows, texts, capacity, end=2):
    """rows: of pack_documents; texts: by id."""
    found, place = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
        place[r.sequence_id].append((r.offset, r.length))
    assert found.keys() == texts.keys()
    for (i, t), ids in zip(texts.items(), library([t or "" for t in texts.values()]), strict=True):
        ids = [*ids, end]
        at = 0
        for p, r in enumerate(sorted(found[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (p, at) and (p == 0 or r.length == capacity) and 1 <= r.length <= capacity
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in place.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(place)


def test_documents(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([0, 1, 10, 60, 200]))) for i in range(150)] + [(500, None), (501, ""), (502, "a " * 1000), (503, "b" * 3000)]
    docs = table(spark, rows).withColumn("length", F.lit("clash")).withColumn("id", F.lit(1))
    got = pack_documents(docs, FILE, Limits(64)).collect()
    n = check(got, dict(rows), 64)
    assert n <= 1.03 * sum(r.length for r in got) / 64 + 1
    again = pack_documents(docs.repartition(7), FILE, Limits(64)).collect()
    assert sorted(got) == sorted(again)
    bound = pack_documents(docs, FILE, Limits(64, documents=2, attention=64 * 64)).collect()
    check(bound, dict(rows), 64)
    assert max(Counter(r.sequence_id for r in bound).values()) == 2


def test_awkward_tables(spark):
    assert pack_documents(table(spark, []), FILE).collect() == []
    same = [(7, "one two"), (7, "one two"), (None, "x"), (None, None), (7, "other")]
    got = pack_documents(table(spark, same), FILE).collect()
    assert len(got) == 5 and {r.sequence_id for r in got} == {0} and sum(r.length for r in got) == sum(len(i) + 1 for i in library([t or "" for _, t in same]))


def test_the_sequences_themselves(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([1, 30, 90]))) for i in range(40)]
    docs = table(spark, rows)
    ids = {i: [*x, 2] for (i, _), x in zip(rows, library([t for _, t in rows]), strict=True)}
    seen = defaultdict(dict)
    for r in packed_sequences(docs, FILE, Limits(64)).collect():
        tokens, at = np.frombuffer(r.ids, "<u4").tolist(), 0
        assert len(tokens) <= 64
        for d in r.documents:
            assert tokens[at : at + d.length] == ids[d.id][d.start : d.start + d.length]
            seen[d.id][d.start] = d.length
            at += d.length
        assert at == len(tokens)
    assert {i: sum(p.values()) for i, p in seen.items()} == {i: len(x) for i, x in ids.items()}


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = Q.op13_best_fit_packing(spark, SF_DIR).collect()
    n = check(got, texts, 1024)
    assert n <= 1.01 * sum(r.length for r in got) / 1024 + 1
