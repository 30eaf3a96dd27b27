"""One registered query per operator of the inventory, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.operators import long_tracks
from cadenza.operators import renditions as R
from cadenza.operators import sprites as sprite_ops
from cadenza.operators import timeline as L
from cadenza.plans import filters, playlists
from cadenza.plans.tables import BOUNDARIES, CUES, DAY, HALF_DAY, SEGMENTS, START, TIMESCALE, TRACKS, cues, segments, table, tracks
from cadenza.sources import webvtt
from cadenza.sources.languages import with_language_names

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

BITS = "CASE WHEN {d} = 0 THEN 0 ELSE CAST((CAST({b} AS HUGEINT) * 8 * 1000000 + {d} - 1) // {d} AS BIGINT) END"
EDGES = ", ".join(f"({b})" for b in sorted(set(BOUNDARIES)))
#: Greedy groups, row by row: gs is where the open group starts, gid its number.
GREEDY = f"""{SEGMENTS}, b(v) AS (VALUES {EDGES}),
cutrow AS (SELECT s.*, count(*) OVER (PARTITION BY track) AS n, EXISTS (SELECT 1 FROM b WHERE s.sm < v AND v <= (SELECT x.sm FROM seg x WHERE x.track = s.track AND x.idx = s.idx + 1)) AS cut FROM seg s),
fold AS (SELECT track, idx, sm AS gs, CAST(0 AS BIGINT) AS gid, (em - sm >= {HALF_DAY} OR cut) AS closed FROM cutrow WHERE idx = 0
 UNION ALL SELECT c.track, c.idx, CASE WHEN f.closed THEN c.sm ELSE f.gs END, CASE WHEN f.closed THEN f.gid + 1 ELSE f.gid END, (c.em - CASE WHEN f.closed THEN c.sm ELSE f.gs END >= {HALF_DAY} OR c.cut) FROM fold f JOIN cutrow c ON c.track = f.track AND c.idx = f.idx + 1),
served AS (SELECT f.track, f.gid AS group_id, min(s.st) AS "start", max(s.en) AS "end", min(s.sm) AS start_ms, max(s.em) AS end_ms, CAST(sum(s.sz) AS BIGINT) AS bytes, count(*) AS n_segments FROM fold f JOIN seg s ON s.track = f.track AND s.idx = f.idx GROUP BY ALL)"""
GREEDY = "RECURSIVE " + GREEDY
PERIODS = f"per AS (SELECT CAST(i AS BIGINT) AS period_id, {START} + i * {DAY} AS period_start, {START} + (i + 1) * {DAY} AS period_end FROM range(30) t(i))"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.served_groups(segments(spark, sf_dir), HALF_DAY, BOUNDARIES)


def _days(spark: SparkSession) -> DataFrame:
    return spark.range(30).select(F.col("id").alias("period_id"), (F.col("id") * DAY + START).alias("start_ms"), ((F.col("id") + 1) * DAY + START).alias("end_ms"))


def _rate(size: str = "bytes"):
    return X.bitrate(F.col(size), F.col("end") - F.col("start"), F.lit(TIMESCALE))


@query(f"WITH {GREEDY} SELECT track, group_id, \"start\", \"end\", bytes, n_segments, {BITS.format(b='bytes', d='(\"end\" - \"start\")')} AS bitrate FROM served")
def served_groups(spark, sf_dir):
    return _served(spark, sf_dir).select("track", "group_id", "start", "end", "bytes", "n_segments", _rate().alias("bitrate"))


@query(f"WITH {SEGMENTS} SELECT track, idx AS group_id, st AS \"start\", en AS \"end\", sz AS bytes, CAST(1 AS BIGINT) AS n_segments FROM seg")
def served_groups_min0(spark, sf_dir):
    return L.served_groups(segments(spark, sf_dir), 0, BOUNDARIES).select("track", "group_id", "start", "end", "bytes", "n_segments")


@query(f"WITH {SEGMENTS} SELECT track, idx, CAST(sum(en - st) OVER w AS BIGINT) - (en - st) AS \"start\", CAST(sum(en - st) OVER w AS BIGINT) AS \"end\", 40 + CAST(sum(sz) OVER w AS BIGINT) - sz AS start_byte, 40 + CAST(sum(sz) OVER w AS BIGINT) AS end_byte FROM seg WINDOW w AS (PARTITION BY track ORDER BY idx)")
def segment_index(spark, sf_dir):
    refs = segments(spark, sf_dir).select("track", "idx", F.col("sz").alias("size"), (F.col("en") - F.col("st")).alias("duration"))
    return L.prefix_index(refs, first_byte=40).select("track", "idx", "start", "end", "start_byte", "end_byte")


@query(f"WITH {SEGMENTS}, b(boundary) AS (VALUES {EDGES}) SELECT track, boundary, count(*) FILTER (sm < boundary) AS position FROM seg CROSS JOIN b GROUP BY ALL")
def boundary_snap(spark, sf_dir):
    return L.snapped(segments(spark, sf_dir), BOUNDARIES)


@query(f"WITH {GREEDY}, r AS (SELECT *, {BITS.format(b='bytes', d='(\"end\" - \"start\")')} AS br FROM served) SELECT track, max(br) AS max_bitrate, {BITS.format(b='sum(bytes)', d='CAST(sum(\"end\" - \"start\") AS BIGINT)')} AS avg_bitrate FROM r GROUP BY track")
def track_bitrates(spark, sf_dir):
    g = _served(spark, sf_dir)
    return g.groupBy("track").agg(F.coalesce(F.max(_rate()), F.lit(0)).alias("max_bitrate"), X.bitrate(F.sum("bytes"), F.sum(F.col("end") - F.col("start")), F.lit(TIMESCALE)).alias("avg_bitrate"))


HOURS = "(en - st) // 3600000000"


@query(f"WITH {SEGMENTS}, c AS (SELECT track, {HOURS} AS v, count(*) AS n FROM seg GROUP BY ALL), m AS (SELECT track, arg_max(v, (n, v)) AS v FROM c GROUP BY track) SELECT track, CASE WHEN v <> 0 THEN v END AS cadence FROM m")
def dominant_cadence(spark, sf_dir):
    return L.dominant(segments(spark, sf_dir), F.expr("(en - st) div 3600000000"))


@query(f"WITH {SEGMENTS}, h AS (SELECT *, (em - first_value(sm) OVER (PARTITION BY track ORDER BY idx)) AS unused, sm // 3600000 AS hh FROM seg), c AS (SELECT track, {HOURS} AS v, count(*) AS n FROM seg GROUP BY ALL), m AS (SELECT track, arg_max(v, (n, v)) AS v FROM c GROUP BY track), o AS (SELECT h.track, idx, hh - first_value(hh) OVER (PARTITION BY h.track ORDER BY idx) AS \"offset\", v AS cadence FROM h JOIN m ON m.track = h.track WHERE v <> 0) SELECT track, idx, \"offset\", cadence FROM o WHERE \"offset\" % cadence <= CAST(ceil(cadence / 100) AS BIGINT) OR cadence - \"offset\" % cadence <= CAST(ceil(cadence / 100) AS BIGINT)")
def cadence_aligned(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("hh", F.expr("sm div 3600000"))
    return L.cadence_aligned(s, F.expr("(en - st) div 3600000000"), start="hh").select("track", "idx", "offset", "cadence")


@query("""WITH e AS (SELECT user_id AS track, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY track ORDER BY i) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS nw FROM e), g AS (SELECT *, sum(nw) OVER (PARTITION BY track ORDER BY i) AS run FROM f) SELECT track, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM g GROUP BY track, run""")
def timeline_rle(spark, sf_dir):
    w = Window.partitionBy("track").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), "ts", "event_id", "event_type")
    new = (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).cast("int")
    runs = e.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return runs.groupBy("track", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


#: Times are cut to quarter days and slip after every seventh row, so that there are gaps and repeats.
COARSE = f"{SEGMENTS}, q AS (SELECT track, idx, idx * 6 + idx // 7 AS st, idx * 6 + idx // 7 + CASE WHEN sz % 4 = 0 THEN 5 ELSE 6 END AS en FROM seg)"
RUNS = f"""{COARSE}, f AS (SELECT *, en - st AS d, (lag(en) OVER w IS DISTINCT FROM st) AS gap, lag(en - st) OVER w AS pd FROM q WINDOW w AS (PARTITION BY track ORDER BY idx)), g AS (SELECT *, sum(CASE WHEN gap OR pd <> d THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY idx) - 1 AS run FROM f)"""


def _coarse(spark, sf_dir):
    st = F.col("idx") * 6 + F.expr("idx div 7")
    return segments(spark, sf_dir).select("track", "idx", st.alias("st"), (st + F.when(F.col("sz") % 4 == 0, 5).otherwise(6)).cast("bigint").alias("en"))


@query(f"WITH {RUNS} SELECT track, CAST(run AS BIGINT) AS run, CASE WHEN arg_min(gap, idx) THEN min(st) END AS t, any_value(d) AS d, CASE WHEN count(*) > 1 THEN count(*) - 1 END AS r FROM g GROUP BY track, run")
def timeline_rle_gaps(spark, sf_dir):
    return L.run_length_encoded(_coarse(spark, sf_dir))


@query(f"WITH {COARSE} SELECT track, st AS \"start\", en AS \"end\" FROM q")
def timeline_expand(spark, sf_dir):
    return L.run_length_expanded(L.run_length_encoded(_coarse(spark, sf_dir))).select("track", "start", "end")


@query(f"SELECT CAST(row_number() OVER (ORDER BY a) - 1 AS BIGINT) AS period_id, a AS start_ms, lead(a, 1, {30 * DAY}) OVER (ORDER BY a) AS end_ms FROM (SELECT CAST(0 AS BIGINT) AS a UNION SELECT v - {START} FROM (VALUES {EDGES}) b(v) WHERE v - {START} > 0 AND v - {START} < {30 * DAY})")
def period_spans(spark, sf_dir):
    return L.period_spans(spark, [b - START for b in BOUNDARIES], 30 * DAY)


@query(f"WITH {SEGMENTS}, {PERIODS} SELECT period_id, count(*) AS n, count(DISTINCT track) AS n_tracks, CAST(sum(sz) AS BIGINT) AS bytes FROM seg JOIN per ON sm < period_end AND period_start < em GROUP BY period_id")
def period_overlap(spark, sf_dir):
    pieces = L.overlap(segments(spark, sf_dir), _days(spark), DAY)
    return pieces.groupBy("period_id").agg(F.count("*").alias("n"), F.countDistinct("track").alias("n_tracks"), F.sum("sz").alias("bytes"))


#: A timeline that touches midnights: hours, six-hour steps, every fifth day left out.
STEPS = f"st6 AS (SELECT c_custkey AS track, CAST(i AS BIGINT) AS idx, {START} + i * 21600000 AS sm, {START} + i * 21600000 + CASE WHEN (i + c_custkey) % 3 = 0 THEN 18000000 ELSE 21600000 END AS em FROM customer CROSS JOIN range(40) t(i) WHERE (i // 4) % 5 <> 2)"
LINKS = f"""{STEPS}, {PERIODS}, x AS (SELECT track, idx, sm, em, period_id, period_start FROM st6 JOIN per ON sm < period_end AND period_start < em),
em0 AS (SELECT period_id, lag(period_id) OVER (ORDER BY period_id) AS b FROM (SELECT DISTINCT period_id FROM x)),
g AS (SELECT x.track, x.period_id, any_value(em0.b) AS b, any_value(period_start) AS ps, bool_or(sm = period_start) AS starts, list(em) AS ends FROM x JOIN em0 USING (period_id) GROUP BY x.track, x.period_id)"""


def _steps(spark, sf_dir):
    """40 steps for each customer, less what is left out. Customers are dealt
    out first: a file of many is one task, and what steps give is grouped there."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track")).repartition(n, "track")
    c = dealt.select("track", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(39).cast("bigint"))).alias("idx")).filter("(idx div 4) % 5 <> 2")
    sm = F.col("idx") * 21_600_000 + START
    em = sm + F.when((F.col("idx") + F.col("track")) % 3 == 0, 18_000_000).otherwise(21_600_000)
    return c.select("track", "idx", sm.alias("sm"), em.alias("em"))


@query(f"WITH {LINKS} SELECT g.track, g.period_id, p.period_id AS previous_period, g.ps * 1000 AS \"offset\", CASE WHEN p.period_id IS NOT NULL THEN CASE WHEN g.starts AND list_contains(p.ends, g.ps) THEN 'continuous' ELSE 'connected' END END AS relation FROM g LEFT JOIN g p ON p.track = g.track AND p.period_id = g.b")
def period_relationship(spark, sf_dir):
    s = _steps(spark, sf_dir).withColumns({"st": F.col("sm") * 1000, "en": F.col("em") * 1000})
    return L.period_relationships(L.overlap(s, _days(spark), DAY), TIMESCALE)


@query(f"WITH {STEPS}, {PERIODS}, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY idx) - 1 AS k FROM st6) SELECT track, period_id, min(k) + 1 AS start_number, any_value(period_start - {START}) * 90 AS slid FROM n JOIN per ON sm < period_end AND period_start < em GROUP BY track, period_id")
def template_shift(spark, sf_dir):
    numbers = L.number_shift(L.overlap(L.numbered(_steps(spark, sf_dir)), _days(spark), DAY))
    slid = X.floor_div((F.col("start_ms") - START) * 90_000, F.lit(1000))
    return numbers.join(_days(spark), "period_id").select("track", "period_id", "start_number", slid.alias("slid"))


PARTS = f"""{CUES}, edge AS (SELECT DISTINCT track, e FROM (SELECT track, start_ms AS e FROM cue UNION ALL SELECT track, end_ms FROM cue UNION ALL SELECT track, 0 FROM cue)), parts AS (SELECT track, e AS "start", lead(e) OVER (PARTITION BY track ORDER BY e) AS "end" FROM edge), part2 AS (SELECT * FROM parts WHERE "end" IS NOT NULL)"""


def _parts(spark, sf_dir):
    c = cues(spark, sf_dir)
    ranges = c.groupBy("track").agg(F.lit(0).cast("bigint").alias("a"), F.max("end_ms").alias("b"))
    edges = c.select("track", F.explode(F.array("start_ms", "end_ms")).alias("c"))
    return L.partitioned(ranges, edges)


@query(f'WITH {PARTS} SELECT track, "start", "end" FROM part2')
def cue_partition(spark, sf_dir):
    return _parts(spark, sf_dir)


@query(f"""WITH {PARTS} SELECT p.track, p."start", p."end", count(c.pos) AS n_active, coalesce(string_agg(c.text, '|' ORDER BY c.start_ms, c.end_ms, c.pos), '') AS active FROM part2 p LEFT JOIN cue c ON c.track = p.track AND c.start_ms <= p."start" AND p."start" < c.end_ms GROUP BY ALL""")
def cue_samples(spark, sf_dir):
    out = L.cue_samples(_parts(spark, sf_dir), cues(spark, sf_dir), 6 * 3_600_000)
    return out.select("track", "start", "end", F.size("active").cast("bigint").alias("n_active"), F.array_join("active", "|").alias("active"))


@query(f"WITH {CUES} SELECT track, pos, greatest(start_ms, {5 * DAY}) AS start_ms, least(end_ms, {6 * DAY}) AS end_ms, text FROM cue WHERE start_ms < {6 * DAY} AND end_ms > {5 * DAY}")
def cue_slice(spark, sf_dir):
    return L.clipped(cues(spark, sf_dir), 5 * DAY, 6 * DAY)


@query(f"SELECT CAST(i AS BIGINT) AS at FROM range({7 * 3_600_000}, {3 * DAY}, {7 * 3_600_000}) t(i)")
def text_grid(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in L.grid(7 * 3_600_000, 3 * DAY)], "at bigint")


KEY = "CASE type WHEN 'video' THEN concat_ws(':', type, split_part(codec, '.', 1), timescale) WHEN 'audio' THEN concat_ws(':', type, split_part(codec, '.', 1), timescale, language, coalesce(role, ''), sample_rate, channels) ELSE concat_ws(':', type, split_part(codec, '.', 1), timescale, language, coalesce(role, '')) END"


@query(f"WITH {TRACKS}, k AS (SELECT *, {KEY} AS key FROM trk) SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY min(pos)) - 1 AS group_id, key, min(pos) AS first_pos, string_agg(id, ',' ORDER BY pos) AS members FROM k GROUP BY asset, key")
def adaptation_groups(spark, sf_dir):
    c = F.col
    key = X.adaptation_key(c("type"), c("codec"), c("timescale"), c("language"), c("role"), c("sample_rate"), c("channels"))
    return R.ordered_groups(tracks(spark, sf_dir), key, ["asset"]).withColumn("members", F.array_join("members", ","))


@query(f"WITH {TRACKS} SELECT asset, coalesce(arg_min(id, (width, pos)) FILTER (width >= 1000), arg_min(id, (-width, pos))) AS source_id FROM trk WHERE width IS NOT NULL GROUP BY asset")
def thumbnail_source(spark, sf_dir):
    return R.nearest_source(tracks(spark, sf_dir), 1000, ["asset"])


DEFAULT = "coalesce(arg_min(id, pos) FILTER (type = 'audio' AND role = 'main'), arg_min(id, pos) FILTER (type = 'audio' AND role IS NULL))"


@query(f"WITH {TRACKS} SELECT asset, {DEFAULT} AS default_id FROM trk GROUP BY asset")
def default_rendition(spark, sf_dir):
    return R.default_audio(tracks(spark, sf_dir), ["asset"])


NAME = "CASE language WHEN 'en' THEN 'English' WHEN 'deu' THEN 'German' WHEN 'fr-CA' THEN 'French' ELSE language END"
TRAITS = "CASE role WHEN 'description' THEN 'public.accessibility.describes-video' WHEN 'caption' THEN 'public.accessibility.transcribes-spoken-dialog,public.accessibility.describes-music-and-sound' END"
LABEL = "CASE role WHEN 'main' THEN 'Main' WHEN 'caption' THEN 'Captions' WHEN 'description' THEN 'Audio Description' END"


@query(f"WITH {TRACKS}, d AS (SELECT asset, {DEFAULT} AS did FROM trk GROUP BY asset), m AS (SELECT t.*, {TRAITS} AS traits, coalesce(role = 'forced-subtitle', false) AS forced, coalesce(id = did, false) AS is_default FROM trk t JOIN d USING (asset) WHERE type IN ('audio', 'text')) SELECT asset, pos, id, CASE type WHEN 'audio' THEN 'AUDIO' ELSE 'SUBTITLES' END AS media_type, CASE type WHEN 'audio' THEN 'audio' ELSE 'subtitles' END AS group_name, language, {NAME} || CASE WHEN role IS NULL THEN '' ELSE ' (' || {LABEL} || ')' END AS name, is_default, is_default OR count(*) OVER (PARTITION BY asset, type, language, forced, traits) = 1 AS autoselect, forced, traits AS characteristics, CASE type WHEN 'audio' THEN CAST(channels AS VARCHAR) END AS channels FROM m")
def autoselect(spark, sf_dir):
    return R.media_entries(tracks(spark, sf_dir), ["asset"])


RATES = f"{GREEDY}, r AS (SELECT *, {BITS.format(b='bytes', d='(\"end\" - \"start\")')} AS br FROM served), rate AS (SELECT track, max(br) AS mx, {BITS.format(b='sum(bytes)', d='CAST(sum(\"end\" - \"start\") AS BIGINT)')} AS av FROM r GROUP BY track)"


def _summary_sql(wvtt: bool) -> str:
    keep = "" if wvtt else " AND type <> 'text'"
    return f"""WITH {RATES}, {TRACKS}, t AS (SELECT t.*, mx, av FROM trk t LEFT JOIN rate ON rate.track = t."user" WHERE type IN ('audio', 'text')),
p AS (SELECT asset, type, coalesce(max(mx), 0) AS mx, coalesce(max(av), 0) AS av FROM t GROUP BY ALL), c AS (SELECT asset, codec, min(pos) AS pos FROM t WHERE true{keep} GROUP BY ALL), cs AS (SELECT asset, string_agg(codec, ',' ORDER BY pos) AS codecs FROM c GROUP BY asset)
SELECT asset, bool_or(type = 'audio') AS has_audio, bool_or(type = 'text') AS has_subtitles, CAST(sum(mx) AS BIGINT) AS maximum_bitrate, CAST(sum(av) AS BIGINT) AS average_bitrate, coalesce(any_value(codecs), '') AS codecs FROM p LEFT JOIN cs USING (asset) GROUP BY asset"""


def _summary(spark, sf_dir, wvtt: bool) -> DataFrame:
    t = tracks(spark, sf_dir)
    rates = t.select("id", F.col("user").alias("track")).join(track_bitrates(spark, sf_dir), "track").drop("track")
    return R.rendition_summary(t, rates, ["asset"], wvtt).withColumn("codecs", F.array_join("codecs", ","))


@query(_summary_sql(False))
def rendition_summary(spark, sf_dir):
    return _summary(spark, sf_dir, False)


@query(_summary_sql(True))
def rendition_summary_wvtt(spark, sf_dir):
    return _summary(spark, sf_dir, True)


@query(f"WITH {SEGMENTS}, {TRACKS}, s AS (SELECT track, max(em) - min(sm) AS dur, max((en - st + 999) // 1000) AS seg_ms, min(st) AS ept FROM seg GROUP BY track), j AS (SELECT t.asset, t.type, dur, seg_ms, ept FROM trk t LEFT JOIN s ON s.track = t.\"user\") SELECT asset, CAST(coalesce(max(dur) FILTER (type = 'video'), max(dur) FILTER (type = 'audio'), 0) AS BIGINT) AS presentation_ms, CAST(coalesce(max(seg_ms) FILTER (type IN ('video', 'audio')), 0) AS BIGINT) AS max_segment_ms FROM j GROUP BY asset")
def presentation_duration(spark, sf_dir):
    s = segments(spark, sf_dir).groupBy("track").agg((F.max_by("em", "idx") - F.min_by("sm", "idx")).alias("duration_ms"), F.max(X.ceil_div((F.col("en") - F.col("st")) * 1000, F.lit(TIMESCALE))).alias("segment_ms"), F.min_by("st", "idx").alias("earliest"))
    t = tracks(spark, sf_dir)
    return R.presentation(t.join(s, t.user == s.track, "left"), ["asset"])


@query(f"WITH {SEGMENTS} SELECT track, max(((en - st) + 500000) // 1000000) AS target, CAST(sum(((en - st) * 1000 + 500000) // 1000000) AS BIGINT) AS rounded_ms, max(em) - min(sm) AS total_ms FROM seg GROUP BY track")
def target_duration(spark, sf_dir):
    d = F.col("en") - F.col("st")
    return segments(spark, sf_dir).groupBy("track").agg(F.max(X.rounded_seconds(d, F.lit(TIMESCALE))).alias("target"), F.sum(X.rounded_ms(d, F.lit(TIMESCALE))).alias("rounded_ms"), F.sum(X.duration_ms(F.col("st"), F.col("en"), F.lit(TIMESCALE))).alias("total_ms"))


FIELDS = ["codec", "width", "height", "frame_rate", "sample_rate", "channels", "language", "role", "timescale"]


@query(f"WITH {TRACKS} SELECT asset, type, \"user\" % 20 AS bin, count(*) AS members, " + ", ".join(f"CASE WHEN count(*) >= 2 AND count({c}) = count(*) AND min({c}) = max({c}) THEN min({c}) END AS shared_{c}" for c in FIELDS) + ' FROM trk GROUP BY asset, type, "user" % 20')
def hoist_shared(spark, sf_dir):
    return R.hoisted(tracks(spark, sf_dir).withColumn("bin", F.col("user") % 20), ["asset", "type", "bin"], FIELDS)


def _filter_query(name: str, text: str, where: str) -> None:
    def run(spark, sf_dir):
        return filters.filtered(tracks(spark, sf_dir), text).select("pos", "id", "type", "codec", "width", "language", "role")

    run.__name__ = name
    query(f"WITH {TRACKS} SELECT pos, id, type, codec, width, language, role FROM trk WHERE {where}")(run)


_filter_query("filter_and", "type == video && width >= 1000", "type = 'video' AND width >= 1000")
_filter_query("filter_precedence", "type == text || type == audio && channels > 2", "type = 'text' OR (type = 'audio' AND channels > 2)")
_filter_query("filter_parentheses", "(type == text || type == audio) && language != en", "(type = 'text' OR type = 'audio') AND language <> 'en'")
_filter_query("filter_missing", "role != main && sample_rate <= 44100", "role <> 'main' AND sample_rate <= 44100")
_filter_query("filter_codec", "codec==avc1.2||codec==mp4a.40.1&&format!=webvtt", "codec = 'avc1.2' OR (codec = 'mp4a.40.1' AND format <> 'webvtt')")


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'fr' OR source = 'src3'")
def filter_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return filters.filtered(docs, "language == fr || id == src3", {"language": "lang", "id": "source"}).select("doc_id", "source", "lang")


@query(f"WITH {SEGMENTS}, n AS (SELECT track, idx, st, row_number() OVER (PARTITION BY track ORDER BY idx) - 1 - 18 AS k FROM seg) SELECT track, idx, k, k % 3 AS \"column\", k // 3 AS \"row\" FROM n WHERE k BETWEEN 0 AND 8")
def sprite_plan(spark, sf_dir):
    page = L.paged(segments(spark, sf_dir), 2, 9)
    return page.select("track", "idx", "k", (F.col("k") % 3).alias("column"), F.expr("k div 3").alias("row"))


@query(f"WITH {SEGMENTS}, t AS (SELECT track, max(em) - min(sm) AS dur, 9 * {HALF_DAY} AS sp FROM seg GROUP BY track) SELECT track, i AS number, least(dur - (i - 1) * sp, sp) AS image_ms, i = 1 AS is_first FROM t, range(1, (dur + sp - 1) // sp + 1) r(i)")
def image_rows(spark, sf_dir):
    t = segments(spark, sf_dir).groupBy("track").agg((F.max("em") - F.min("sm")).alias("duration_ms"), F.lit(9 * HALF_DAY).cast("bigint").alias("sprite_ms"))
    return playlists.image_rows(t).select("track", "number", "image_ms", "is_first")


@query(f"WITH {GREEDY} SELECT track, group_id, track || '/' || \"start\" || '.m4s' AS uri, CASE WHEN group_id = 0 THEN track || '/init.mp4' END AS map, ((\"end\" - \"start\") * 1000 + 500000) // 1000000 AS duration_ms FROM served")
def media_rows(spark, sf_dir):
    g = _served(spark, sf_dir)
    return g.select("track", "group_id", F.concat("track", F.lit("/"), "start", F.lit(".m4s")).alias("uri"), F.when(F.col("group_id") == 0, F.concat("track", F.lit("/init.mp4"))).alias("map"), X.rounded_ms(F.col("end") - F.col("start"), F.lit(TIMESCALE)).alias("duration_ms"))


@query("""WITH p AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) * 1000 AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem) SELECT q, n, (q // gcd(q, n)) || '/' || (n // gcd(q, n)) AS ratio, CAST(round(round(q / n, 3) * 1000) AS BIGINT) AS milli FROM p""")
def frame_rate(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("bigint") * 1000).alias("q"), F.col("l_linenumber").cast("bigint").alias("n")).distinct()
    ratio = X.frame_rate(F.col("q"), F.col("n"))
    return p.select("q", "n", ratio.alias("ratio"), F.round(X.frame_rate_value(ratio) * 1000).cast("bigint").alias("milli"))


@query(f"WITH {CUES} SELECT track, pos, start_ms, end_ms, text FROM cue")
def vtt_parse(spark, sf_dir):
    return webvtt.parsed(webvtt.formatted(cues(spark, sf_dir)))


STAMP = "printf('%02d:%02d:%02d.%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"WITH {CUES} SELECT track, 'WEBVTT\n\n' || string_agg({STAMP.format('start_ms')} || ' --> ' || {STAMP.format('end_ms')} || '\n' || text || '\n', '\n' ORDER BY pos) AS content FROM cue GROUP BY track")
def vtt_format(spark, sf_dir):
    return webvtt.formatted(cues(spark, sf_dir))


@query("""SELECT p_partkey AS id, printf('avc1.%02x%02x%02x', p_partkey % 256, p_size, p_size % 52) AS avc, printf('av01.%d.%02d%s.%02d', p_size % 3, p_partkey % 24, CASE WHEN p_size % 2 = 0 THEN 'H' ELSE 'M' END, 8 + p_size % 3 * 2) AS av1, 'mp4a.40.' || p_size AS aac,
'hvc1.' || (['', 'A', 'B', 'C'])[p_size % 4 + 1] || p_size % 32 || '.' || coalesce(nullif(lower(ltrim(to_hex(CAST(list_sum([CASE WHEN (p_partkey * 2654435 >> i) & 1 = 1 THEN CAST(1 AS BIGINT) << (31 - i) ELSE 0 END for i in range(32)]) AS BIGINT)), '0')), ''), '0') || CASE WHEN p_size % 2 = 0 THEN '.H' ELSE '.L' END || p_size * 3 || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE printf('.%02x', 176) END AS hevc FROM part""")
def codec_strings(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    high = s % 2 == 0
    constraints = F.when(k % 3 == 0, F.array(*[F.lit(0)] * 6)).otherwise(F.array(F.lit(0xB0), *[F.lit(0)] * 5))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), X.avc_codec(k % 256, s, s % 52).alias("avc"), X.av1_codec(s % 3, k % 24, high, s % 3 * 2 + 8).alias("av1"), X.aac_codec(s).alias("aac"),
        X.hevc_codec("hvc1", s % 4, s % 32, (k * 2654435).bitwiseAND(X.MAX_U32), high, s * 3, constraints).alias("hevc"),
    )


@query(f"""WITH h AS (SELECT page_id, sha1(unhex('{X.URL_NAMESPACE}') || encode(url)) AS h FROM pages) SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(to_hex((CAST('0x' || h[17:18] AS INTEGER) & 63) | 128)) || h[19:20] || '-' || h[21:32] AS id FROM h""")
def track_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.uuid5_url(F.col("url")).alias("id"))


@query(f"WITH {TRACKS} SELECT id, CASE WHEN type = 'text' AND (role IS NULL OR role = 'caption') THEN 'subtitle' WHEN type = 'audio' AND role IN ('description', 'enhanced-audio-intelligibility') THEN NULL ELSE role END AS dash_role, CASE WHEN type = 'audio' AND role IN ('description', 'enhanced-audio-intelligibility') OR type = 'text' AND role = 'caption' THEN role END AS accessibility, CASE type WHEN 'video' THEN 'video/mp4' WHEN 'audio' THEN 'audio/mp4' ELSE 'application/mp4' END AS mime FROM trk")
def dash_roles(spark, sf_dir):
    return tracks(spark, sf_dir).select("id", X.dash_role(F.col("type"), F.col("role")).alias("dash_role"), X.dash_accessibility(F.col("type"), F.col("role")).alias("accessibility"), X.mime_type(F.col("type")).alias("mime"))


#: A nation's customers are the tracks of its descriptor; a third is not in it yet, and half are given anew.
@query("""WITH s AS (SELECT c_nationkey AS asset, c_name AS path, c_custkey AS p, c_mktsegment AS language, CAST(c_nationkey AS VARCHAR) AS role FROM customer WHERE c_custkey % 3 <> 0), g AS (SELECT c_nationkey AS asset, CASE WHEN c_custkey % 5 = 0 THEN c_name || '-new' ELSE c_name END AS path, c_custkey AS p, CASE WHEN c_custkey % 4 = 0 THEN 'nl' END AS language, CASE WHEN c_custkey % 7 = 0 THEN 'main' END AS role FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0), f AS (SELECT coalesce(s.asset, g.asset) AS asset, coalesce(s.path, g.path) AS path, coalesce(g.language, s.language) AS language, coalesce(g.role, s.role) AS role, s.p IS NULL AS nw, coalesce(s.p, g.p) AS place FROM s FULL JOIN g ON s.asset = g.asset AND s.path = g.path) SELECT asset, path, language, role, row_number() OVER (PARTITION BY asset ORDER BY nw, place) - 1 AS pos FROM f""")
def descriptor_upsert(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer").withColumn("asset", F.col("c_nationkey")), F.col("c_custkey")
    stored = c.filter(k % 3 != 0).select("asset", F.col("c_name").alias("path"), k.alias("pos"), F.col("c_mktsegment").alias("language"), F.col("c_nationkey").cast("string").alias("role"))
    given = c.filter((k % 2 == 0) | (k % 3 == 0)).select("asset", F.when(k % 5 == 0, F.concat("c_name", F.lit("-new"))).otherwise(F.col("c_name")).alias("path"), k.alias("pos"), F.when(k % 4 == 0, "nl").alias("language"), F.when(k % 7 == 0, "main").alias("role"))
    return R.upserted(stored, given, ["asset"], "path", ["language", "role"])


@query("SELECT CAST(r_regionkey AS BIGINT) AS pos, r_name AS name FROM region UNION ALL SELECT CAST(n_nationkey + 5 AS BIGINT), n_name FROM nation")
def ordered_union(spark, sf_dir):
    first = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("pos"), F.col("r_name").alias("name"))
    return first.unionByName(table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 5).cast("bigint").alias("pos"), F.col("n_name").alias("name")))


@query("SELECT asset, string_agg(codec, ',' ORDER BY k, p) AS codecs FROM (SELECT asset, codec, min(k) AS k, arg_min(pos, (k, pos)) AS p FROM (" + f"WITH {TRACKS} SELECT asset, codec, pos, CASE WHEN type = 'audio' THEN 0 ELSE 1 END AS k FROM trk) GROUP BY asset, codec) GROUP BY asset")
def codec_union(spark, sf_dir):
    of = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "codec")))), lambda x: x["codec"])
    audio = F.col("type") == "audio"
    return tracks(spark, sf_dir).groupBy("asset").agg(F.array_join(R.ordered_union(of(audio), of(~audio)), ",").alias("codecs"))


@query("SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE lang END AS name FROM documents")
def language_lookup(spark, sf_dir):
    return with_language_names(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


@query(f"WITH {GREEDY}, l AS (SELECT *, CAST(((\"end\" - \"start\") * 1000 + 500000) // 1000000 AS BIGINT) AS ms FROM served) SELECT track, '#EXTM3U\n#EXT-X-VERSION:6\n#EXT-X-TARGETDURATION:' || max(((\"end\" - \"start\") + 500000) // 1000000) || '\n#EXT-X-PLAYLIST-TYPE:VOD\n' || count(*) || ' entries' AS head FROM l GROUP BY track")
def media_playlists(spark, sf_dir):
    whole = playlists.media_playlist(_served(spark, sf_dir), F.lit(TIMESCALE))
    lines = F.split("document", "\n")
    entries = F.size(F.filter(lines, lambda x: x.startswith("#EXTINF")))
    return whole.select("track", F.concat(F.array_join(F.slice(lines, 1, 4), "\n"), F.lit("\n"), entries.cast("string"), F.lit(" entries")).alias("head"))


@query(f"WITH {RUNS}, r AS (SELECT track, run, CASE WHEN arg_min(gap, idx) THEN min(st) END AS t, any_value(d) AS d, CASE WHEN count(*) > 1 THEN count(*) - 1 END AS r FROM g GROUP BY track, run) SELECT track, string_agg('<S' || coalesce(' t=\"' || t || '\"', '') || ' d=\"' || d || '\"' || coalesce(' r=\"' || r || '\"', '') || '/>', '' ORDER BY run) AS timeline FROM r GROUP BY track")
def timeline_xml(spark, sf_dir):
    return playlists.timeline_xml(L.run_length_encoded(_coarse(spark, sf_dir)))


@query(f"WITH {GREEDY} SELECT served.track, group_id, \"start\", bytes FROM served JOIN seg ON seg.track = served.track AND seg.st = served.\"start\"")
def segment_lookup(spark, sf_dir):
    """Every segment's start is asked for; those inside a group find none."""
    wanted = segments(spark, sf_dir).select("track", F.col("st").alias("start"))
    return _served(spark, sf_dir).join(wanted, ["track", "start"]).select("track", "group_id", "start", "bytes")


@query(f"WITH {TRACKS} SELECT pos, id, 40 * (1 + pos % 9) AS sprite_width, CASE WHEN width > 0 THEN (40 * (1 + pos % 9) * height // width) - (40 * (1 + pos % 9) * height // width) % 3 ELSE 0 END AS sprite_height, greatest(1, (40 * (1 + pos % 9) * height * 1000 + pos * 7 - 1) // (pos * 7)) AS bandwidth FROM trk WHERE type = 'video'")
def sprite_sizes(spark, sf_dir):
    w = (F.lit(40) * (F.col("pos") % 9 + 1)).cast("bigint")
    t = tracks(spark, sf_dir).filter("type = 'video'")
    return t.select("pos", "id", w.alias("sprite_width"), X.sprite_height(w, F.lit(3), F.col("width"), F.col("height")).alias("sprite_height"), X.sprite_bandwidth(w, F.col("height"), F.col("pos") * 7).alias("bandwidth"))


_ALIGNED = f"""h AS (SELECT track, idx, sm // 3600000 AS hh, 40 + CAST(sum(sz) OVER w AS BIGINT) - sz AS a, 40 + CAST(sum(sz) OVER w AS BIGINT) AS b FROM seg WINDOW w AS (PARTITION BY track ORDER BY idx)), c AS (SELECT track, {HOURS} AS v, count(*) AS n FROM seg GROUP BY ALL), m AS (SELECT track, arg_max(v, (n, v)) AS v FROM c GROUP BY track),
o AS (SELECT h.*, hh - first_value(hh) OVER (PARTITION BY h.track ORDER BY idx) AS o, v FROM h JOIN m ON m.track = h.track WHERE v <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY idx) - 1 AS k FROM o WHERE o % v <= CAST(ceil(v / 100) AS BIGINT) OR v - o % v <= CAST(ceil(v / 100) AS BIGINT)),
tiles AS (SELECT 's' || track || '-' || size AS id, k // (size * size) + 1 AS number, k % (size * size) AS place, k % (size * size) % size AS "column", k % (size * size) // size AS "row", track AS source_id, idx, hh AS target, a AS start_byte, b AS end_byte FROM f, (VALUES (CAST(2 AS BIGINT)), (3)) t(size))"""


def _tiles(spark, sf_dir):
    """Two sheets of each user's segments, 2 and 3 tiles wide."""
    s = L.prefix_index(segments(spark, sf_dir).drop("start", "end").withColumn("d", F.col("en") - F.col("st")), duration="d", size="sz", first_byte=40).withColumn("hh", F.expr("sm div 3600000")).withColumn("id", F.col("track"))
    sheets = s.select("track").distinct().select(F.col("track").alias("source_id"), F.explode(F.array(F.lit(2), F.lit(3))).alias("tile_size")).withColumn("id", F.format_string("s%d-%d", "source_id", "tile_size"))
    return sprite_ops.sprite_tiles(sheets, s, F.expr("(en - st) div 3600000000"), "hh")


@query(f"WITH {SEGMENTS}, {_ALIGNED} SELECT * FROM tiles")
def sprite_tiles(spark, sf_dir):
    return _tiles(spark, sf_dir)


@query(f"""WITH {SEGMENTS}, {_ALIGNED}, n AS (SELECT *, CASE WHEN start_byte - lag(end_byte) OVER w > 500 OR lag(end_byte) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM tiles WINDOW w AS (PARTITION BY id, number ORDER BY start_byte, place)), r AS (SELECT *, sum(nw) OVER (PARTITION BY id, number ORDER BY start_byte, place) AS read FROM n)
SELECT id, number, source_id, min(start_byte) AS start_byte, max(end_byte) AS end_byte, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS places FROM r GROUP BY id, number, source_id, read""")
def sprite_reads(spark, sf_dir):
    return sprite_ops.sprite_reads(_tiles(spark, sf_dir), 500).withColumn("places", F.array_join(F.transform("places", lambda p: p.cast("string")), ","))


# All lines of all orders as one track, each as long as its quantities.
_LINES = """l0 AS (SELECT l_orderkey * 10 + l_linenumber AS idx, CAST(sum(CAST(l_quantity AS BIGINT)) * 100 AS BIGINT) AS d, CAST(sum(l_partkey % 997) AS BIGINT) AS sz FROM lineitem GROUP BY 1),
ln AS (SELECT row_number() OVER w - 1 AS i, idx, d, sz, CAST(sum(d) OVER w AS BIGINT) - d AS st, CAST(sum(d) OVER w AS BIGINT) AS en, CAST(sum(sz) OVER w AS BIGINT) AS upto FROM l0 WINDOW w AS (ORDER BY idx))"""
_LINE_CUTS = [5_000_000, 777_700, 777_700, -1, 10**12]


def _lines(spark, sf_dir):
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint")
    rows = table(spark, sf_dir, "lineitem").groupBy(place.alias("idx")).agg((F.sum(F.col("l_quantity").cast("bigint")) * 100).alias("duration"), F.sum(F.col("l_partkey") % 997).cast("bigint").alias("size"))
    return long_tracks.long_prefix_index(rows.withColumn("track", F.lit(0).cast("bigint")), first_byte=40)


@query(f"WITH {_LINES} SELECT idx, st AS \"start\", en AS \"end\", 40 + upto - sz AS start_byte, 40 + upto AS end_byte FROM ln")
def long_track_index(spark, sf_dir):
    return _lines(spark, sf_dir).select("idx", "start", "end", "start_byte", "end_byte")


@query(f"WITH {_LINES}, f AS (SELECT *, CASE WHEN lag(d) OVER (ORDER BY i) IS DISTINCT FROM d THEN 1 ELSE 0 END AS nw FROM ln), g AS (SELECT *, sum(nw) OVER (ORDER BY i) - 1 AS run FROM f) SELECT CAST(run AS BIGINT) AS run, min(st) AS first, any_value(d) AS d, count(*) AS n, min(i) AS number, run = 0 AS gap FROM g GROUP BY run")
def long_track_runs(spark, sf_dir):
    return long_tracks.long_runs(_lines(spark, sf_dir), start="start", end="end").drop("track")


@query(f"""WITH RECURSIVE {_LINES}, n AS (SELECT count(*) AS n FROM ln), cu AS (SELECT ln.*, (SELECT min(b) FROM (VALUES {", ".join(f"({b})" for b in _LINE_CUTS)}) v(b) WHERE b > st) AS cut FROM ln),
e AS (SELECT a.i, b.i + 1 AS after FROM ln a ASOF LEFT JOIN ln b ON a.st + 600000 <= b.en), c AS (SELECT a.i, b.i AS cut FROM cu a ASOF LEFT JOIN ln b ON a.cut <= b.st),
nx AS (SELECT e.i, least(coalesce(after, n), coalesce(cut, n), n) AS nxt FROM e JOIN c USING (i), n),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS group_id UNION ALL SELECT nxt, group_id + 1 FROM g JOIN nx USING (i), n WHERE nxt < n.n)
SELECT group_id, a.idx AS first_order, a.st AS "start", b.en AS "end", b.upto - a.upto + a.sz AS bytes, nxt - g.i AS n_segments FROM g JOIN nx USING (i) JOIN ln a ON a.i = g.i JOIN ln b ON b.i = nxt - 1""")
def long_track_groups(spark, sf_dir):
    s = _lines(spark, sf_dir).select("track", "idx", F.col("start").alias("st"), F.col("end").alias("en"), F.col("start").alias("sm"), F.col("end").alias("em"), F.col("size").alias("sz"))
    return long_tracks.long_served_groups(s, 600_000, _LINE_CUTS).select("group_id", "first_order", "start", "end", "bytes", "n_segments")
