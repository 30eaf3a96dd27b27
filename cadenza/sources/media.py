"""Media files as Spark sources and sinks.

    spark.read.format("media_ranges").load(uri)      segments with their bytes
    rows.write.format("media_files").save(uri)       files from pieces in order

Reading deals files out in stretches of bytes, as file scans do; where there are
many, a task takes several one after the other. It reads the header of a file,
takes the segments that start in its stretch and pass what was pushed down
(path, idx, start, end), and fetches neighbouring ones in one read; it opens the
file once and holds one such read. Writing appends pieces as they come to staged
files, which get their names when all tasks are done.

Paths are URIs that pyarrow's file systems know (local files, HDFS, S3, GCS).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from cadenza.sources.boxes import header

SEGMENT = "path string, idx bigint, start bigint, end bigint, start_byte bigint, end_byte bigint, timescale bigint, data binary"
PIECE = "path string, place bigint, data binary"
#: Bytes of a file that are one task's, and of one read; bytes between segments
#: that are read along rather than asked for anew.
STRETCH, READ, GAP = 64 << 20, 8 << 20, 64 << 10
#: So many stretches are a task each. Of more, a task takes TASK bytes, or what
#: deals them to so many tasks; opening a file counts as OPEN bytes.
TASKS, TASK, OPEN = 256, 64 << 20, 256 << 10
#: Files that a commit names at a time.
NAMING = 16
_TESTS = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}


@dataclass
class Stretch(InputPartition):
    path: str
    length: int
    first: int
    stop: int
    others: tuple["Stretch", ...] = ()


def dealt(stretches: list[Stretch], tasks: int = TASKS, task: int = TASK) -> list[Stretch]:
    """Stretches, in order, as partitions: each with the others of its task.
    Neighbours in a file become one."""
    if len(stretches) <= tasks:
        return stretches
    weights = [min(s.stop, s.length) - s.first + OPEN for s in stretches]
    most = min(task, -(-sum(weights) // tasks))
    groups: list[list[Stretch]] = []
    held = most
    for s, weight in zip(stretches, weights, strict=True):
        if held + weight > most:
            groups.append([])
            held = 0
        last = groups[-1][-1] if groups[-1] else None
        if last and last.path == s.path and last.stop == s.first:
            groups[-1][-1] = Stretch(s.path, s.length, last.first, s.stop)
        else:
            groups[-1].append(s)
        held += weight
    return [Stretch(g[0].path, g[0].length, g[0].first, g[0].stop, tuple(g[1:])) for g in groups]


class RangeReader(DataSourceReader):
    def __init__(self, root: str, stretch: int, gap: int, names: list[str]):
        self.root, self.stretch, self.gap, self.names = root, stretch, gap, names
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what can be told from a path or a header; Spark does the rest."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if name in ("path", "idx", "start", "end") and type(f) in _TESTS:
                self.tests.append((name, _TESTS[type(f)], f.value))
            elif name == "path" and isinstance(f, In):
                self.tests.append((name, "in", f.value))
            else:
                yield f

    def passes(self, **values) -> bool:
        return all((values[n] in v if op == "in" else getattr(values[n], op)(v)) for n, op, v in self.tests if n in values)

    def partitions(self) -> list[Stretch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.root)
        prefix = self.root[: len(self.root) - len(base)] if self.root.endswith(base) else ""
        found = fs.get_file_info(base)
        files = [found] if found.is_file else fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
        listed = [(prefix + f.path, f.size) for f in files if f.is_file and not f.base_name.startswith((".", "_"))]
        return dealt([Stretch(path, size, at, at + self.stretch) for path, size in sorted(listed) if self.passes(path=path) for at in range(0, size, self.stretch)]) or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for part in (partition, *partition.others):
            if part.path:
                yield from self.stretch_of(part)

    def stretch_of(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        fs, at = pyarrow.fs.FileSystem.from_uri(partition.path)
        with fs.open_input_file(at) as f:
            try:
                found = header(None, lambda at, n: f.read_at(n, at), partition.length)
            except (ValueError, IndexError) as e:
                raise ValueError(f"{partition.path}: {e}") from e
            for group in self.together(self.segments(found, partition)):
                low, high = group[0][3], group[-1][4]
                if high > partition.length:
                    raise ValueError(f"{partition.path}: a segment ends past the file")
                data = f.read_at(high - low, low) if "data" in self.names else None
                rows = [(partition.path, *s, found["timescale"], data and data[s[3] - low : s[4] - low]) for s in group]
                columns = dict(zip(("path", "idx", "start", "end", "start_byte", "end_byte", "timescale", "data"), zip(*rows, strict=True), strict=True))
                kinds = {"path": pa.string(), "data": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.int64())) for n in self.names], names=self.names)

    def segments(self, found: dict, partition: Stretch) -> Iterator[tuple[int, int, int, int, int]]:
        """(idx, start, end, start_byte, end_byte) of those to read."""
        start, byte = found["earliest"], found["first_byte"]
        for r in found["refs"]:
            end, stop = start + r["duration"], byte + r["size"]
            if partition.first <= byte < partition.stop and self.passes(idx=r["idx"], start=start, end=end):
                yield r["idx"], start, end, byte, stop
            start, byte = end, stop

    def together(self, segments: Iterator[tuple]) -> Iterator[list[tuple]]:
        """Segments that one read fetches: near each other, READ bytes at most
        unless a single one is larger."""
        group: list[tuple] = []
        for s in segments:
            if group and (s[3] - group[-1][4] > self.gap or s[4] - group[0][3] > READ):
                yield group
                group = []
            group.append(s)
        if group:
            yield group


class MediaRanges(DataSource):
    """The segments of fragmented files under `path`, with their bytes. Options:
    stretch, bytes of a file for a task, which may take several such stretches;
    gap, bytes read along between segments."""

    @classmethod
    def name(cls) -> str:
        return "media_ranges"

    def schema(self) -> str:
        return SEGMENT

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(self.options["path"], int(self.options.get("stretch", STRETCH)), int(self.options.get("gap", GAP)), schema.names)


@dataclass
class Staged(WriterCommitMessage):
    moves: list[tuple[str, str]]


class PieceWriter(DataSourceArrowWriter):
    """Appends pieces to staged files. A task that fails takes its own away; a
    commit names all files, an abort takes all away."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.root)
        moves, stream, current, place = [], None, None, None
        try:
            for batch in iterator:
                for path, at, data in zip(*(batch.column(n) for n in ("path", "place", "data")), strict=True):
                    path, at = path.as_py(), at.as_py()
                    if path != current:
                        if stream:
                            stream.close()
                        if any(path == p for _, p in moves[-1:]):
                            raise ValueError(f"{path} comes twice")
                        staged = f"{base}/.staged-{uuid.uuid4().hex}"
                        fs.create_dir(base, recursive=True)
                        moves.append((staged, path))
                        stream, current, place = fs.open_output_stream(staged), path, None
                    if place is not None and at <= place:
                        raise ValueError(f"{path}: piece {at} comes after {place}")
                    place = at
                    stream.write(data.as_buffer())
            if stream:
                stream.close()
        except BaseException:
            self.drop(fs, moves)
            raise
        return Staged(moves)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.root)
        moves = [(staged, f"{base}/{path}") for message in messages if message for staged, path in message.moves]
        for folder in sorted({target.rpartition("/")[0] for _, target in moves}):
            fs.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(NAMING) as pool:
            for _ in pool.map(lambda m: fs.move(*m), moves):
                pass

    def abort(self, messages: list[Staged | None]) -> None:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.root)
        for message in messages:
            if message:
                self.drop(fs, message.moves)

    @staticmethod
    def drop(fs: pyarrow.fs.FileSystem, moves: list[tuple[str, str]]) -> None:
        for staged, _ in moves:
            if fs.get_file_info(staged).is_file:
                fs.delete_file(staged)


class MediaFiles(DataSource):
    """Files under `path`, each from the pieces (path, place, data) that come
    one behind the other in a task; see `write_pieces`."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return PIECE

    def writer(self, schema: StructType, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MediaRanges)
    spark.dataSource.register(MediaFiles)
    return spark


def read_ranges(spark: SparkSession, root: str, **options) -> DataFrame:
    """The segments (SEGMENT) of the files under root, with their bytes."""
    return registered(spark).read.format("media_ranges").options(**options).load(root)


def write_pieces(pieces: DataFrame, root: str) -> None:
    """Writes files under root from pieces (path, place, data): each file's
    data end to end, by place. A file is one task's stream, of which it holds a
    batch; a file appears whole, under its name, when all are done. Null data
    are empty; places are unique in a file."""
    spark = registered(pieces.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.selectExpr("path", "CAST(place AS bigint) AS place", "coalesce(data, X'') AS data").repartition(n, "path").sortWithinPartitions("path", "place")
    dealt.write.format("media_files").mode("append").option("path", root).save()
