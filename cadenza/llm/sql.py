"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, id_col: str, text: str, pattern: str) -> str:
    return f"SELECT {id_col}, coalesce(regexp_extract_all({text}, '{pattern}'), []) AS ws FROM {table}"


DECONTAMINATION = rf"""
WITH d AS ({_words("documents", "doc_id", _LOWER, _ALNUM)}), b AS ({_words("benchmark", "item_id", _LOWER, _ALNUM)}),
bg AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) t(i) WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM d, ns, unnest(range(1, len(ws) - n + 2)) t(i) WHERE len(ws) >= n),
h AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(n)) t(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS ({_words("documents", "doc_id", _LOWER, _SPACED)}),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS o, doc_id AS reached FROM documents UNION SELECT r.o, e.b FROM r JOIN e ON e.a = r.reached)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r JOIN documents ON doc_id = o LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

SUBSTRING_DEDUP = rf"""
WITH d AS ({_words("documents", "doc_id", "text", _SPACED)}),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(ws) - 11)) t(i) WHERE len(ws) >= 13),
m AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN m USING (g), unnest(range(13)) t(k) WHERE m < doc_id),
w AS (SELECT doc_id, p, ws[p] AS w FROM d, unnest(range(1, len(ws) + 1)) t(p)),
k AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS s FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

TOP_K = rf"""
WITH d AS ({_words("documents", "doc_id", _LOWER, _ALNUM)}),
tf AS (SELECT doc_id, w, count(*) AS f FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), t AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM d),
sc AS (SELECT q.doc_id AS query_id, x.doc_id, round(sum(ln(1 + (t.n - df.df + 0.5) / (df.df + 0.5)) * x.f * 2.2 / (x.f + 1.2 * (0.25 + 0.75 * len(d.ws) / t.mean))), 4) AS score
 FROM tf q JOIN tf x ON x.w = q.w JOIN df ON df.w = q.w JOIN d ON d.doc_id = x.doc_id, t WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10"""

MIX_SOURCES = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_SPACED}')), 0) AS BIGINT) AS size, md5(concat_ws('/', coalesce(CAST(doc_id AS VARCHAR), chr(0)), coalesce(source, chr(0)), coalesce(md5(text), chr(0)))) AS turn FROM documents),
u AS (SELECT *, row_number() OVER (PARTITION BY turn) - 1 AS copy FROM d),
v AS (SELECT doc_id, source, size, CASE WHEN copy = 0 THEN turn ELSE md5(concat(turn, '/', copy)) END AS place FROM u),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM v GROUP BY source),
w AS (SELECT source, n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS wt FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * n / CAST(wt AS DOUBLE), source NULLS LAST) AS k FROM w),
lv AS (SELECT *, (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(wt) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
f AS (SELECT min(k) AS k0, arg_min(level, k) AS level0 FROM lv WHERE level * wt <= 3 * n),
tg AS (SELECT source, n, CASE WHEN k0 IS NOT NULL AND k >= k0 THEN level0 * wt ELSE CAST(3 * n AS DOUBLE) END AS target FROM lv, f),
q AS (SELECT v.*, tg.n AS source_size, target, sum(size) OVER (PARTITION BY v.source ORDER BY place) AS upto FROM v JOIN tg ON v.source IS NOT DISTINCT FROM tg.source),
st AS (SELECT place, size, e, (e * source_size + upto) / target AS finish FROM q, range(3) r(e) WHERE size > 0 AND target > 0),
sp AS (SELECT place, sum(size) OVER (ORDER BY finish, place, e ROWS UNBOUNDED PRECEDING) AS spent FROM st),
ps AS (SELECT place, count(*) AS passes FROM sp WHERE spent <= (SELECT sum(n) FROM s) GROUP BY place)
SELECT doc_id, size, source_size, target, size * coalesce(passes, 0) AS taken FROM q LEFT JOIN ps USING (place)"""

FILTER_AUDIT = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
lb AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, coalesce(regexp_extract_all(t, '{_SPACED}'), []) AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
x AS (SELECT k, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS f FROM w LEFT JOIN lb USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
p AS (SELECT a.c || b.c || e.c || g.c || h.c AS filter_order FROM l a, l b, l e, l g, l h WHERE length(replace(replace(replace(replace(replace('ABCDE', a.c, ''), b.c, ''), e.c, ''), g.c, ''), h.c, '')) = 0),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, [strpos('ABCDE', filter_order[j]) for j in range(1, step)] AS earlier, strpos('ABCDE', filter_order[step]) AS nxt FROM p, range(1, 6) r(step)),
c AS (SELECT part, filter_order, step, nxt, len([j for j in earlier if f[j]]) = 0 AS alive, f[nxt] AS fails, len([b for b in f if b]) AS n_fails, good, toxic FROM x, s),
o AS (SELECT part, filter_order, step, nxt, count(*) FILTER (alive AND NOT fails) AS kept, count(*) FILTER (alive AND fails) AS removed, count(*) FILTER (NOT alive AND fails) AS redundant, count(*) FILTER (fails AND n_fails = 1) AS unique_fails, count(*) FILTER (alive AND fails AND good) AS good_lost, count(*) FILTER (alive AND fails AND toxic) AS toxic_lost FROM c GROUP BY ALL)
SELECT * EXCLUDE (nxt), CAST(sum(removed) OVER (PARTITION BY part, nxt) AS BIGINT) AS shapley FROM o"""

# The crc32 of the decimal digits, bit by bit.
_CRC32 = "xor(list_reduce([4294967295] || [CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END for i in range(8 * length(s))], lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"

CONVERSATION_TRIE = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, md5(concat(length(r), ':', r, x))) AS p FROM t),
k AS (SELECT c, c - c % 5 AS base, {_CRC32} % 9 AS h FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)),
hd AS (SELECT k.c, p, r, x FROM k JOIN o ON o.c = base AND p <= h),
hn AS (SELECT c, count(*) AS m FROM hd GROUP BY c),
rb AS (SELECT * FROM hd UNION ALL SELECT o.c, p - h + coalesce(m, 0), r, x FROM o JOIN k USING (c) LEFT JOIN hn USING (c) WHERE p > h),
e AS (SELECT c, p AS d, strlen(x) AS b, string_agg(concat(length(r), ':', r, length(x), ':', x), '') OVER (PARTITION BY c ORDER BY p) AS beginning FROM rb UNION ALL SELECT c, 0, 0, '' FROM k),
n AS (SELECT beginning, d, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b FROM e GROUP BY beginning, d),
up AS (SELECT n.conv_id AS below, n.d, e.beginning FROM n JOIN e ON e.c = n.conv_id AND e.d = n.d - 1),
kids AS (SELECT beginning, d - 1 AS d, count(*) AS n_children FROM up GROUP BY ALL),
sub AS (SELECT e.beginning, e.d, sum((n_convs - 1) * n.b) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves FROM n LEFT JOIN kids USING (beginning, d) JOIN e ON e.c = n.conv_id AND e.d <= n.d GROUP BY e.beginning, e.d),
en AS (SELECT beginning, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, d, beginning, max(d) OVER (PARTITION BY c) AS last FROM e) WHERE d = last GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sub USING (beginning, d) LEFT JOIN kids USING (beginning, d) LEFT JOIN en USING (beginning, d) LEFT JOIN up ON up.below = n.conv_id AND up.d = n.d LEFT JOIN n p ON p.beginning = up.beginning AND p.d = n.d - 1"""

ORACLES = {
    "op3_decontamination": DECONTAMINATION,
    "op5_ngram_jaccard_join": JACCARD_JOIN,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op7_exact_top_k": TOP_K,
    "op10_mix_sources": MIX_SOURCES,
    "op11_conversation_trie": CONVERSATION_TRIE,
    "op12_filter_audit": FILTER_AUDIT,
}
