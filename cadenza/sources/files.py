"""Sink of small named files: documents, descriptors, packaged media."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(rows: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Writes each row's content (text or bytes) to root/path and returns the
    number of files. root is a URI of a folder that all executors share. A file
    appears whole, under its name, so a task can run again; paths are unique."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = f"{base}/{name}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                temporary = f"{target}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(temporary) as f:
                    f.write(data)
                fs.move(temporary, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = rows.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(write, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
