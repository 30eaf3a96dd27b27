import random
from collections import Counter

import corpus_pipeline
from tests.llm.common import prose, table
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_language_id import text


def docs():
    rng = random.Random(12)
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, text(rng, lang, rng.randint(20, 60)), lang, rng.choice("pqqq")))
    rows += [(200 + i, rows[i][1] + (" tail" if i % 2 else ""), rows[i][2], "q") for i in range(25)]
    rows += [(300, None, "aa", "p"), (301, "12 34", "aa", "p"), (None, text(rng, "aa", 30), "aa", None), (302, "", None, "q")]
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = docs()
    items = [(i, " ".join(rows[i * 7][1].split()[3:18])) for i in range(6)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    t = table(spark, rows)
    t.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, want, got = [n for n, _ in corpus_pipeline.STAGES], {r[0] for r in rows} - {300, 301, 302}, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == t.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = Counter(r.doc_id for r in now.collect())
    pairs = [(r[0], r[1]) for r in rows if r[0] in want]
    assert set(got[names[0]]) == want
    want = {d for d, _, c in components(pairs) if d == c}
    assert set(got[names[1]]) == want and max(got[names[1]].values()) == 1
    pairs = [p for p in pairs if p[0] in want]
    want = {d for d, _, hit, _ in contaminated(pairs, items) if not hit}
    assert set(got[names[2]]) == want
    assert set(got[names[3]]) <= want and max(got[names[3]].values()) <= 3
    out = corpus_pipeline.STAGES[4][1](spark, now, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == got[names[3]]
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
