"""Descriptors joined to the files that their tracks name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import exprs as X
from cadenza.sources import boxes, descriptors, webvtt

#: What a descriptor may say of a track in place of what its file says.
CONFIGURED = ("width", "height", "frame_rate", "sample_rate", "channels", "language", "role")
FOUND = "path string, id string, kind string, type string, codec string, timescale bigint, width bigint, height bigint, frame_rate string, sample_rate bigint, channels bigint, language string, role string"


def read_or_create(spark: SparkSession, path: str) -> DataFrame:
    """(path, asset) of the descriptor at path, or an empty one if there is no
    such file. Any other failure stays one."""
    try:
        return descriptors.read(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return descriptors.parsed(spark.createDataFrame([(path, "{}")], "path string, content string")).select("path", "asset")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)?[^/]*$", 1)


def relative_to(folder: Column, path: Column) -> Column:
    """The path as seen from a folder, with `..` for each step up."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda p: ~p.isin("", "."))

    def of(v: Column) -> Column:
        step = lambda s, i: F.when(F.get(v["a"], i) == F.get(v["b"], i), s + (s == i).cast("int")).otherwise(s)
        same = F.aggregate(F.sequence(F.lit(0), F.size(v["a"])), F.lit(0), step)
        return X.let(same, lambda n: F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(v["a"]) - n), F.slice(v["b"], n + 1, F.size(v["b"]))), "/"))

    return X.let(F.struct(parts(folder).alias("a"), parts(path).alias("b")), of)


def discovered(files: DataFrame) -> DataFrame:
    """A FOUND row for each file (path, content): what ends in .vtt is read as
    WebVTT, anything else as fragmented MP4. A file that is neither raises."""
    is_text = F.col("path").endswith(".vtt")
    heads = boxes.tracks(boxes.headers(files.filter(~is_text))).withColumns({"kind": F.lit("cmaf"), "role": F.lit(None).cast("string")})
    text = webvtt.checked(files.filter(is_text).select("path", F.decode("content", "UTF-8").alias("content")))
    null = lambda kind: F.lit(None).cast(kind)
    # kind names the content, so that it is checked though nothing of it is kept.
    tracks = text.select(
        "path", X.uuid5_url(F.col("path")).alias("id"), F.concat(F.lit("webvtt"), F.substring("content", 1, 0)).alias("kind"), F.lit("text").alias("type"), F.lit("wvtt").alias("codec"), F.lit(1000).cast("bigint").alias("timescale"),
        null("bigint").alias("width"), null("bigint").alias("height"), null("string").alias("frame_rate"), null("bigint").alias("sample_rate"), null("bigint").alias("channels"), F.lit("und").alias("language"), null("string").alias("role"),
    )
    names = [c.split(" ")[0] for c in FOUND.split(", ")]
    return heads.select(*names).unionByName(tracks.select(*names))


def resolved(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """The source tracks of descriptors (`descriptors.tracks_of`: path is the
    track's, `descriptor` its descriptor's) with what their files hold (FOUND).
    One without a file raises. A descriptor's own metadata stand in place of the
    file's as a whole, if it has any; codec and timescale are the file's."""
    file = X.normalised_path(F.concat(parent(F.col("descriptor")), F.col("path")))
    asked = tracks.filter("kind <> 'thumbnail'").withColumn("file", file)
    own = F.struct(*[F.col(f"t.{c}").cast(k).alias(c) for c, k in (("type", "string"), *((c, _kind(c)) for c in CONFIGURED))])
    theirs = F.struct(*[F.col(f"f.{c}").alias(c) for c in ("type", *CONFIGURED)])
    there = F.when(F.col("f.path").isNull(), F.raise_error(F.concat(F.lit("no such file: "), "t.file"))).otherwise(F.when(F.col("t.type").isNotNull(), own).otherwise(theirs))
    joined = asked.alias("t").join(found.alias("f"), F.col("t.file") == F.col("f.path"), "left")
    return joined.select("t.descriptor", "t.pos", F.coalesce("t.id", "f.id").alias("id"), "t.kind", "t.file", there.alias("m"), F.col("f.codec").alias("codec"), F.col("f.timescale").alias("timescale")).select("descriptor", "pos", "id", "kind", "file", "m.*", "codec", "timescale")


def _kind(name: str) -> str:
    return dict(c.split(" ") for c in FOUND.split(", "))[name]


def appended(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """tracks (descriptor, pos, id, path, ...) with the found sources (descriptor
    and FOUND) after them, in the order of their paths. Their paths are stored
    relative to the descriptor; a source without a path raises."""
    path = F.when(F.col("path").isNull(), F.raise_error(F.lit("a source in memory has no path"))).otherwise(relative_to(parent(F.col("descriptor")), F.col("path")))
    names = [c for c in tracks.columns if c in found.columns and c != "path"]
    new = found.select(*names, path.alias("path")).withColumn("_new", F.lit(1))
    both = tracks.withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("descriptor").orderBy("_new", "pos", "path")) - 1
    return both.withColumn("pos", place.cast("bigint")).drop("_new")
