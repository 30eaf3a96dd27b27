import random
import re
import tracemalloc

from cadenza.llm import decontamination
from cadenza.llm.decontamination import contaminated_spans
from cadenza.llm.wordhash import block
from tests.llm.common import prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item_text in items:
            v = words(item_text)
            n = min(window, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(10, 40), 60)) for i in range(20)]
    items += [(30, "one"), (31, "zwei Wörter"), (32, None), (33, ""), (34, "a b c d e f g h i"), (3, prose(rng, 15, 60)), (None, "null id " * 6), (40, "aa " * 30)]
    docs = []
    for i in range(120):
        text = prose(rng, rng.randint(0, 80), 60).split()
        for _ in range(rng.randint(0, 3)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(v) - 8))
            at = rng.randint(0, len(text))
            text[at:at] = v[a : a + rng.randint(7, 25)]
        docs.append((i, rng.choice([" ", ", ", "--"]).join(text).title() if i % 3 else " ".join(text)))
    docs += [(200, None), (201, ""), (202, "..."), (203, "x aa aa aa aa aa aa aa aa aa aa aa y"), (None, items[0][1]), (5, items[1][1]), (5, items[1][1]), (204, "w1 " * 30_000 + items[2][1])]
    return docs, items


def result(spark, docs, items):
    bench = spark.createDataFrame([(i, t, "hit") for i, t in items], "item_id bigint, text string, hit string")
    got = contaminated_spans(table(spark, docs), bench).collect()
    return sorted(((r.doc_id, r.n_words, tuple(k for s in r.hit for k in range(s.start, s.end)), tuple(r["items"])) for r in got), key=str)


def test_against_brute_force(spark):
    docs, items = cases()
    assert result(spark, docs, items) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 800)
    assert result(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    assert result(spark, [], items) == []
    assert result(spark, docs, []) == brute(docs, [])


def test_many_blocks_and_pieces_of_items(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 400)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 12)
    items = [(i, t) for i, t in items if i != 34] + [(50, "q " * 11), (50, "q " * 25 + "r")]
    docs = docs + [(300, "q " * 40), (301, "q " * 9 + "r")]
    assert result(spark, docs, items) == brute(docs, items)


def test_repeated_words_take_little_memory():
    index = decontamination.ItemIndex(["x", "y", "z"], [b"a " * 1000, b"a " * 1000, b"a a"], 10, 5)
    tracemalloc.start()
    hit, items = index.hits(block([b"a " * 32_768], "alnum"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hit.all() and len(hit) == 32_768 and items == [(0, "x"), (0, "y"), (0, "z")]
    assert peak < 20 << 20


def test_patterns_of_two_letters_do_not_collide():
    a = "ab"
    for _ in range(11):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    for kind in ("alnum", "nonspace"):
        assert len(set(block([a.encode(), b.encode(), a.encode() * 20, b.encode() * 20], kind).hashes().tolist())) == 4
