"""The star-schema tables as timelines, cues and catalogues of tracks.

Each adapter has its twin as a SQL common table expression, so that queries and
their SQL start from the same relations, stated twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400_000
#: Midnight of 1 January 2024 in ms.
START = 1_704_067_200_000
#: Unsorted, one twice, one past the end.
BOUNDARIES = [START + d * DAY for d in (10, 5, 10, 20, 99)]
HALF_DAY = DAY // 2
TIMESCALE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a timeline per user: an event lasts until the user's next."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("track").orderBy("ts", "event_id")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = e.select(F.col("user_id").alias("track"), "ts", "event_id", us.alias("st"), F.round(F.col("value") * 100).cast("bigint").alias("sz"), F.col("event_type").alias("kind"))
    rows = rows.select("track", (F.row_number().over(w) - 1).cast("bigint").alias("idx"), "st", F.lead("st").over(w).alias("en"), "sz", "kind").filter("en is not null")
    return rows.withColumns({"sm": F.expr("st div 1000"), "em": F.expr("en div 1000")})


SEGMENTS = """seg0 AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) AS st, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS en, CAST(round(value * 100) AS BIGINT) AS sz, event_type AS kind FROM events),
seg AS (SELECT *, st // 1000 AS sm, en // 1000 AS em FROM seg0 WHERE en IS NOT NULL)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as cues of a user: shown for as many seconds as 100 times the value."""
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    start = F.floor((us - F.lit(START * 1000)) / 1000).cast("bigint")
    rows = e.select(F.col("user_id").alias("track"), "event_id", start.alias("start_ms"), F.col("event_type").alias("text"), F.round(F.col("value") * 100).cast("bigint").alias("s"))
    rows = rows.withColumn("end_ms", F.col("start_ms") + F.col("s") * 1000)
    pos = F.row_number().over(Window.partitionBy("track").orderBy("start_ms", "end_ms", "event_id")) - 1
    return rows.select("track", pos.cast("bigint").alias("pos"), "start_ms", "end_ms", "text")


CUES = f"""cue0 AS (SELECT user_id AS track, event_id, (epoch_us(ts) - {START * 1000}) // 1000 AS start_ms, (epoch_us(ts) - {START * 1000}) // 1000 + CAST(round(value * 100) AS BIGINT) * 1000 AS end_ms, event_type AS text FROM events),
cue AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY start_ms, end_ms, event_id) - 1 AS pos, start_ms, end_ms, text FROM cue0)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a catalogue: a brand is an asset, a part one of its tracks."""
    p = table(spark, sf_dir, "part")
    word = F.substring_index("p_type", " ", 1)
    kind = F.when(word.isin("STANDARD", "LARGE", "MEDIUM"), "video").when(word.isin("ECONOMY", "SMALL"), "audio").otherwise("text")
    rows = p.select("*", kind.alias("type"))
    video, audio = F.col("type") == "video", F.col("type") == "audio"
    k = F.col("p_partkey")
    return rows.select(
        F.col("p_brand").alias("asset"), k.alias("pos"), F.concat(F.lit("t"), k).alias("id"), "type",
        F.when(k % 7 == 0, "webvtt").otherwise("cmaf").alias("format"),
        F.when(video, F.concat(F.lit("avc1."), F.col("p_size") % 4)).when(audio, F.concat(F.lit("mp4a.40."), F.col("p_size") % 3)).otherwise("wvtt").alias("codec"),
        F.when(video, F.col("p_size") * 40).cast("bigint").alias("width"), F.when(video, F.col("p_size") * 22).cast("bigint").alias("height"),
        F.when(video, F.concat(F.col("p_size"), F.lit("/1"))).alias("frame_rate"),
        F.when(audio, F.lit(44100) + F.col("p_size") % 2 * 3900).cast("bigint").alias("sample_rate"), F.when(audio, F.col("p_size") % 3 * 2 + 2).cast("bigint").alias("channels"),
        F.when(~video, F.element_at(F.array(*map(F.lit, ("en", "deu", "fr-CA", "xx"))), (k % 4 + 1).cast("int"))).alias("language"),
        F.when(k % 5 == 0, "main").when(k % 5 == 2, "caption").when(k % 5 == 3, "description").alias("role"),
        F.lit(None).cast("bigint").alias("tile_size"), (k % 2 * 500 + 1000).cast("bigint").alias("timescale"), (k % 100).cast("bigint").alias("user"),
    )


TRACKS = """trk0 AS (SELECT *, CASE WHEN split_part(p_type, ' ', 1) IN ('STANDARD', 'LARGE', 'MEDIUM') THEN 'video' WHEN split_part(p_type, ' ', 1) IN ('ECONOMY', 'SMALL') THEN 'audio' ELSE 'text' END AS type FROM part),
trk AS (SELECT p_brand AS asset, p_partkey AS pos, 't' || p_partkey AS id, type, CASE WHEN p_partkey % 7 = 0 THEN 'webvtt' ELSE 'cmaf' END AS format,
 CASE type WHEN 'video' THEN 'avc1.' || p_size % 4 WHEN 'audio' THEN 'mp4a.40.' || p_size % 3 ELSE 'wvtt' END AS codec,
 CASE WHEN type = 'video' THEN CAST(p_size * 40 AS BIGINT) END AS width, CASE WHEN type = 'video' THEN CAST(p_size * 22 AS BIGINT) END AS height,
 CASE WHEN type = 'video' THEN p_size || '/1' END AS frame_rate, CASE WHEN type = 'audio' THEN CAST(44100 + p_size % 2 * 3900 AS BIGINT) END AS sample_rate, CASE WHEN type = 'audio' THEN CAST(p_size % 3 * 2 + 2 AS BIGINT) END AS channels,
 CASE WHEN type <> 'video' THEN (['en', 'deu', 'fr-CA', 'xx'])[p_partkey % 4 + 1] END AS language,
 CASE p_partkey % 5 WHEN 0 THEN 'main' WHEN 2 THEN 'caption' WHEN 3 THEN 'description' END AS role, CAST(NULL AS BIGINT) AS tile_size,
 CAST(p_partkey % 2 * 500 + 1000 AS BIGINT) AS timescale, CAST(p_partkey % 100 AS BIGINT) AS "user" FROM trk0)"""
