"""Which segments' frames make a sprite, and what to read for them.

A sprite is a square of tiles. Frames come from the segments of the source whose
starts lie at multiples of its cadence; sprite number n has the n-th lot of them,
row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.ordered import numbered
from cadenza.operators.timeline import cadence_aligned


def sprite_tiles(thumbnails: DataFrame, segments: DataFrame, value: Column | None = None, start: str = "st") -> DataFrame:
    """(id, number, place, column, row, source_id, idx, target, start_byte,
    end_byte): a row for each tile of each sprite, numbers from 1, places from
    0. thumbnails: (id, source_id, tile_size), resolved. segments: (id, idx, st,
    en, start_byte, end_byte) of the sources, of which any may be long. target
    is the time of the frame, in the source's ticks. The last sprite may have
    fewer tiles; a source without a cadence gives none, nor does a thumbnail
    without tiles. value: what the cadence is the most frequent of; by default
    segments' durations."""
    of = thumbnails.filter("tile_size > 0").select("id", "source_id", F.col("tile_size").cast("bigint").alias("tile_size"))
    used = segments.join(of.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
    aligned = cadence_aligned(used, F.col("en") - F.col("st") if value is None else value, "id", "idx", start)
    placed = numbered(aligned.select(F.col("id").alias("source_id"), "idx", F.col(start).alias("target"), "start_byte", "end_byte"), ["source_id"], ["idx"], "_k", "sprite-frames")
    tiles = placed.join(of, "source_id").withColumns({"_k": F.col("_k") - 1, "_n": F.col("tile_size") * F.col("tile_size")})
    place = F.col("_k") % F.col("_n")
    rows = tiles.withColumns({"number": F.expr("_k div _n + 1"), "place": place}).withColumns({"column": F.col("place") % F.col("tile_size"), "row": F.expr("place div tile_size")})
    return rows.select("id", "number", "place", "column", "row", "source_id", "idx", "target", "start_byte", "end_byte")


def sprite_reads(tiles: DataFrame, gap: int = 0) -> DataFrame:
    """(id, number, source_id, start_byte, end_byte, places): what to read for
    each sprite, in file order. Segments that lie within `gap` bytes of each
    other are one read, with the places of their tiles. A window holds a sprite."""
    own = Window.partitionBy("id", "number").orderBy("start_byte", "place")
    far = F.col("start_byte") - F.max("end_byte").over(own.rowsBetween(Window.unboundedPreceding, -1)) > gap
    rows = tiles.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int"))
    rows = rows.withColumn("_read", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("id", "number", "source_id", "_read").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.array_sort(F.collect_list("place")).alias("places"))
    return out.drop("_read")
