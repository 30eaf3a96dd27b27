"""WebVTT documents to cues and back, on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.exprs import let, timestamp_ms, timestamp_text


def read_documents(spark, path: str) -> DataFrame:
    """(path, content) of each file under path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def checked(documents: DataFrame, content: str = "content") -> DataFrame:
    """documents with normalised line breaks and without a byte order mark. One
    without a signature raises; a null one stays."""
    body = F.regexp_replace(F.regexp_replace(F.col(content), "^\ufeff", ""), "\r\n?", "\n")
    good = F.substring_index(body, "\n", 1).rlike(r"^WEBVTT($|[ \t])")
    return documents.withColumn(content, F.when(body.isNull() | good, body).otherwise(F.raise_error(F.lit("no WEBVTT signature"))))


def parsed(documents: DataFrame, track: str = "track", content: str = "content") -> DataFrame:
    """(track, pos, start_ms, end_ms, text) of the cues, pos by (start, end,
    place in the document).

    Blocks are separated by blank lines; NOTE, STYLE and REGION blocks, and
    those without a timing line first or second, are skipped; cue settings are
    dropped; text keeps its line breaks. A missing signature, a bad timestamp,
    or an end before its start raises. A null document has no cues.
    """
    blocks = F.split(content, r"\n(?:[^\S\n]*\n)+")
    rows = checked(documents.filter(F.col(content).isNotNull()), content).select(track, F.posexplode(blocks).alias("block", "lines"))
    rows = rows.filter(F.col("block") > 0).select(track, "block", F.split(F.regexp_replace("lines", r"^\n+|\n+$", ""), "\n").alias("l"))
    first = F.element_at("l", 1)
    rows = rows.filter(~first.rlike(r"^(NOTE|STYLE|REGION)($|[ \t])"))
    at = F.when(first.contains("-->"), 1).when(F.coalesce(F.get("l", F.lit(1)).contains("-->"), F.lit(False)), 2)
    rows = rows.withColumn("at", at).filter("at is not null").withColumn("timing", F.element_at("l", F.col("at")))
    # Bound by let, as projections that name a column twice compute it twice.
    late = F.raise_error(F.lit("a cue ends before it starts"))
    times = let(F.array(F.trim(F.substring_index("timing", "-->", 1)), F.regexp_extract("timing", r"-->\s*(\S*)", 1)), lambda both: let(F.transform(both, _time), lambda t: F.when(F.get(t, F.lit(1)) < F.get(t, F.lit(0)), late).otherwise(t)))
    rows = rows.select(track, "block", times.alias("times"), F.array_join(F.slice("l", F.col("at") + 1, F.size("l")), "\n").alias("text"))
    # The cues are sorted by these columns, behind which times are not computed again.
    rows = rows.select(track, "block", "text", F.inline(F.array(F.struct(F.get("times", F.lit(0)).alias("start_ms"), F.get("times", F.lit(1)).alias("end_ms")))))
    return with_positions(rows, track, "block").select(track, "pos", "start_ms", "end_ms", "text")


def _time(text: Column) -> Column:
    return let(F.struct(timestamp_ms(text).alias("ms"), text.alias("text")), lambda v: F.when(v["ms"].isNull(), F.raise_error(F.concat(F.lit("bad timestamp: "), v["text"]))).otherwise(v["ms"]))


def with_positions(cues: DataFrame, track: str, tie: str) -> DataFrame:
    """cues with pos, from 0, by (start, end, tie)."""
    return cues.withColumn("pos", (F.row_number().over(Window.partitionBy(track).orderBy("start_ms", "end_ms", tie)) - 1).cast("bigint"))


def formatted(cues: DataFrame, track: str = "track") -> DataFrame:
    """(track, content): the cues of each track as a document, in cue order. A
    row without pos stands for a track without cues."""
    block = F.concat(F.lit("\n"), timestamp_text(F.col("start_ms")), F.lit(" --> "), timestamp_text(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", block.alias("b"))))
    return cues.groupBy(track).agg(F.concat(F.lit("WEBVTT\n"), F.array_join(F.transform(F.array_sort(rows), lambda x: x["b"]), "")).alias("content"))
