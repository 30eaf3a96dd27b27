"""Settings that the operators read from the Spark session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cadenza.sources.stored import fresh_path, shared_dir, written

__all__ = ["fresh_path", "partitions", "shared_dir", "written"]


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: the one knob with which a
    user sizes these operators to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
