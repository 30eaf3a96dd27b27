import itertools
import random
import sys
import zlib

import numpy as np

from cadenza.llm.language_id import BUCKETS, OTHER, SWITCH, Model, held_out, identify, language_id, train
from tests.llm.common import table

language_id_module = sys.modules["cadenza.llm.language_id"]
SYLLABLES = {"aa": "the ing er on an re".split(), "bb": "der ein sch gen ung ver".split(), "cc": "привет мир да нет как".split(), "dd": "και το ναι οχι εν".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize()


def rows():
    rng = random.Random(4)
    out = [(i, text(rng, lang, rng.randint(3, 60)), lang, "s") for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    out += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 -- !", "bb", "s"), (1003, "the ering", None, "s"), (None, "der gen", "bb", "s"), (5, "the " * 50_000, "aa", "s")]
    return out


def test_accuracy_and_contract(spark):
    docs = rows()
    got = language_id(table(spark, docs)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for i, t, lang, _ in docs:
        r = by[i]
        assert r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif lang:
            assert i == 5 or r.lang_pred == lang
    assert language_id(table(spark, [])).collect() == []
    assert [r.lang_pred for r in language_id(table(spark, [(1, "abc", None, "s")])).collect()] == ["und"]


def test_mixed_text_is_cut_at_the_switch(spark):
    rng = random.Random(8)
    model = train(table(spark, rows()))
    a, b, c = text(rng, "aa", 30), text(rng, "bb", 30), text(rng, "cc", 5)
    r = identify(table(spark, [(1, f"{a}. {b}. {c}!")]), model).collect()[0]
    got = [(s.lang, s.start, s.end) for s in r["_spans"]]
    assert [g[0] for g in got] == ["aa", "bb", "cc"]
    assert abs(got[1][1] - len(a) - 2) <= 12 and got[2][1:] == (len(a) + len(b) + 4, len(a) + len(b) + len(c) + 4)
    assert r.extra == "x"


def test_held_out_rows_teach_nothing(spark):
    t = table(spark, rows())
    assert train(t.filter(~held_out())).langs == train(t).langs
    assert train(t.filter("lang = 'aa'")).langs == ["aa"]


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(5)
    model = Model(["a", "b", "c"], np.ones((BUCKETS, 3)), np.ones((3, OTHER + 1)))
    lengths = [0, 1, 2, 5, 7, 0, 3]
    begin = np.concatenate([[0], np.cumsum(lengths)])
    for spread in (1, 8, 30):
        scores = (rng.normal(size=(begin[-1], 3)) * spread).astype(np.float32)
        got = model.label(scores, begin)
        for a, b in zip(begin[:-1], begin[1:]):
            total = lambda path: sum(scores[a + i, k] for i, k in enumerate(path)) - SWITCH * sum(x != y for x, y in zip(path, path[1:]))
            best = max((total(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
            assert abs(total(got[a:b].tolist()) - best) < 1e-3


def test_long_texts_are_scored_in_parts(spark):
    rng = random.Random(2)
    docs = [(1, text(rng, "aa", 300) + " " + text(rng, "cc", 300)), (2, "x" * 900), (3, text(rng, "bb", 40))]
    model = train(table(spark, rows()))
    whole = identify(table(spark, docs), model).collect()
    assert [s.lang for s in whole[0]["_spans"]] == ["aa", "cc"] and whole[0]["_spans"][1].end == len(docs[0][1])
    parts = list(language_id_module._stretches("ab " * 400_000))
    assert len(parts) > 2 and "".join(p for _, p in parts) == "ab " * 400_000 and all(("ab " * 400_000)[o : o + len(p)] == p for o, p in parts)


def test_rare_languages_are_learned(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, text(rng, "aa", 20), "aa", "s") for i in range(400)] + [(1000 + i, text(rng, "bb", 20), "bb", "s") for i in range(3)]
    assert train(table(spark, docs), rows=40).langs == ["aa", "bb"]
    monkeypatch.setattr(language_id_module, "MOST_LANGUAGES", 1)
    assert train(table(spark, docs)).langs == ["aa"]
