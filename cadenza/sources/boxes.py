"""Headers of fragmented MP4 files: a row per file, then segments in Spark.

Of a file only the headers of its top-level boxes are read, and the bodies of
moov, sidx and moof; the walk ends when all three are there. So what is read
does not grow with the media in a file, and a file may be of any size. What the
boxes hold becomes columns; offsets, times, codec strings and checks are column
expressions from there on.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import exprs as X

HEADER = (
    "path string, timescale bigint, handler string, entry string, language string, width bigint, height bigint, channels bigint, sample_rate bigint, config array<int>, "
    "sample_duration bigint, init_end bigint, sidx_timescale bigint, earliest bigint, first_byte bigint, refs array<struct<idx:bigint,size:bigint,duration:bigint,media:boolean,sap:boolean>>"
)


def walk(data: memoryview, at: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """(type, start, body, end) of each box in a range; ValueError if one is cut short."""
    while at < end:
        if end - at < 8:
            raise ValueError(f"box header cut short at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else at + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {at} is cut short")
        yield kind.decode("latin-1"), at, body, stop
        at = stop


def child(data: memoryview, at: int, end: int, *path: str) -> tuple[int, int] | None:
    """Body and end of the first box down this path."""
    for kind in path:
        found = next(((b, e) for k, _, b, e in walk(data, at, end) if k == kind), None)
        if found is None:
            return None
        at, end = found
    return at, end


#: Boxes that a header needs.
NEEDED = ("moov", "sidx", "moof")
#: (offset, size) -> bytes, as many as there are.
Reader = Callable[[int, int], bytes]


def top_level(read: Reader, length: int) -> dict[str, tuple[int, bytes]]:
    """The end in the file and the body of each box of NEEDED; the last of
    those that come before all three are there. ValueError if one is missing or
    cut short."""
    found: dict[str, tuple[int, bytes]] = {}
    at = 0
    while at < length and len(found) < len(NEEDED):
        head = read(at, 16)
        if len(head) < 8:
            raise ValueError(f"box header cut short at {at}")
        size, kind = struct.unpack_from(">I4s", head)
        body = at + 8
        if size == 1:
            if len(head) < 16:
                raise ValueError(f"box header cut short at {at}")
            (size,) = struct.unpack_from(">Q", head, 8)
            body += 8
        stop = length if size == 0 else at + size
        if stop > length or stop < body:
            raise ValueError(f"box {kind!r} at {at} is cut short")
        if (name := kind.decode("latin-1")) in NEEDED:
            found[name] = stop, read(body, stop - body)
        at = stop
    if missing := set(NEEDED) - found.keys():
        raise ValueError(f"no {', '.join(sorted(missing))}")
    return found


def header(content: bytes | None, read: Reader | None = None, length: int = 0) -> dict:
    """The columns of HEADER, but for path, of one file's bytes or reader."""
    if read is None:
        length, read = len(content), lambda at, n: content[at : at + n]
    found = top_level(read, length)
    moov, sidx, moof = (memoryview(found[k][1]) for k in NEEDED)
    return {"init_end": found["moov"][0], **_movie(moov, 0, len(moov)), **_index(sidx, found["sidx"][0]), **_duration(moov, moof)}


def _movie(data: memoryview, at: int, end: int) -> dict:
    media = child(data, at, end, "trak", "mdia")
    if not media:
        raise ValueError("no track")
    mdhd, hdlr, stsd = child(data, *media, "mdhd"), child(data, *media, "hdlr"), child(data, *media, "minf", "stbl", "stsd")
    if not (mdhd and hdlr and stsd):
        raise ValueError("no media header, handler or sample description")
    skip = 20 if data[mdhd[0]] else 12
    timescale, = struct.unpack_from(">I", data, mdhd[0] + skip)
    packed, = struct.unpack_from(">H", data, mdhd[0] + skip + (12 if data[mdhd[0]] else 8))
    letters = [(packed >> s & 31) + 0x60 for s in (10, 5, 0)]
    entry = next(walk(data, stsd[0] + 8, stsd[1]), None)
    if entry is None:
        raise ValueError("no sample entry")
    kind, _, body, stop = entry
    out = {"timescale": timescale, "handler": bytes(data[hdlr[0] + 8 : hdlr[0] + 12]).decode("latin-1"), "entry": kind, "language": bytes(letters).decode() if all(0x61 <= c <= 0x7A for c in letters) else "und", "config": []}
    if out["handler"] == "vide":
        out["width"], out["height"] = struct.unpack_from(">HH", data, body + 24)
        boxes = body + 78
    elif out["handler"] == "soun":
        out["channels"], = struct.unpack_from(">H", data, body + 16)
        out["sample_rate"], = struct.unpack_from(">H", data, body + 24)
        boxes = body + 28
    else:
        boxes = body + 8
    for name in {"avc1": ["avcC"], "avc3": ["avcC"], "hvc1": ["hvcC"], "hev1": ["hvcC"], "av01": ["av1C"], "mp4a": ["esds"]}.get(kind, []):
        config = child(data, boxes, stop, name)
        if config is None:
            raise ValueError(f"no {name}")
        raw = bytes(data[config[0] : config[1]])
        out["config"] = [raw[_specific(raw)] >> 3] if name == "esds" else list(raw[:13])
    return out


def _specific(raw: bytes) -> int:
    """Where the decoder's own settings start in an elementary stream descriptor."""
    at = 4
    while at < len(raw):
        tag, at = raw[at], at + 1
        while raw[at] & 0x80:
            at += 1
        at += 1
        if tag == 5:
            return at
        at += {3: 3, 4: 13}.get(tag, len(raw))
    raise ValueError("no decoder settings")


def _index(data: memoryview, end: int) -> dict:
    at, wide = 0, data[0] > 0
    timescale, = struct.unpack_from(">I", data, at + 8)
    earliest, first = struct.unpack_from(">QQ" if wide else ">II", data, at + 12)
    at += 28 if wide else 20
    count, = struct.unpack_from(">H", data, at + 2)
    refs = []
    for i in range(count):
        a, duration, sap = struct.unpack_from(">III", data, at + 4 + 12 * i)
        refs.append({"idx": i, "size": a & 0x7FFFFFFF, "duration": duration, "media": not a >> 31, "sap": bool(sap >> 31) and sap >> 28 & 7 == 1})
    return {"sidx_timescale": timescale, "earliest": earliest, "first_byte": end + first, "refs": refs}


def _duration(moov: memoryview, moof: memoryview) -> dict:
    """The first sample's duration: its own, the fragment's, or the movie's."""
    traf = child(moof, 0, len(moof), "traf")
    if traf and (run := child(moof, *traf, "trun")):
        flags = int.from_bytes(moof[run[0] + 1 : run[0] + 4])
        if flags & 0x100:
            return {"sample_duration": struct.unpack_from(">I", moof, run[0] + 8 + 4 * bool(flags & 1) + 4 * bool(flags & 4))[0]}
    if traf and (head := child(moof, *traf, "tfhd")):
        flags = int.from_bytes(moof[head[0] + 1 : head[0] + 4])
        if flags & 8:
            return {"sample_duration": struct.unpack_from(">I", moof, head[0] + 8 + 8 * bool(flags & 1) + 4 * bool(flags & 2))[0]}
    trex = child(moov, 0, len(moov), "mvex", "trex")
    return {"sample_duration": struct.unpack_from(">I", moov, trex[0] + 12)[0] if trex else None}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in ("path", "timescale", "handler", "entry", "language", "width", "height", "channels", "sample_rate", "config", "sample_duration", "init_end", "sidx_timescale", "earliest", "first_byte", "refs")]
    reference = pa.struct([("idx", pa.int64()), ("size", pa.int64()), ("duration", pa.int64()), ("media", pa.bool_()), ("sap", pa.bool_())])
    kinds = {"path": pa.string(), "handler": pa.string(), "entry": pa.string(), "language": pa.string(), "config": pa.list_(pa.int32()), "refs": pa.list_(reference)}
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.int64())) for n in names], names=names)


def _of(path: str, *source) -> dict:
    try:
        return {"path": path, **header(*source)}
    except (ValueError, struct.error, IndexError) as e:
        raise ValueError(f"{path}: {e}") from e


#: Files whose headers are given at a time.
AT_ONCE = 200


def headers(files: DataFrame) -> DataFrame:
    """A HEADER row for each row (path, content) of files that are in memory, of
    which a task copies one at a time. A malformed file raises."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                yield _batch([_of(path.as_py(), content.as_py()) for path, content in zip(*part.columns, strict=True)])

    return validated(files.select("path", "content").mapInArrow(scan, HEADER))


def stored_headers(files: DataFrame) -> DataFrame:
    """A HEADER row for each row (path, length) of stored files, of which tasks
    read the ranges that a header needs. Paths are what pyarrow's file systems
    know (local files, HDFS, S3, GCS). A malformed file raises."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as f:
                    rows.append(_of(path, None, lambda at, n, f=f: f.read_at(n, at), length))
            yield _batch(rows)

    return validated(files.select("path", "length").mapInArrow(scan, HEADER))


def validated(rows: DataFrame) -> DataFrame:
    """rows, whose use raises where a header can't be served from."""
    fail = lambda text: F.raise_error(F.concat("path", F.lit(f": {text}")))
    checks = (
        F.when((F.col("timescale") == 0) | (F.col("sidx_timescale") == 0), fail("a timescale is 0"))
        .when(F.exists("refs", lambda r: r["duration"] == 0), fail("a segment has no duration"))
        .when(~F.forall("refs", lambda r: r["media"] & r["sap"]), fail("a segment does not start at a random access point"))
        .when(~F.col("handler").isin("vide", "soun", "text", "subt"), fail("unknown handler"))
        .when((F.col("handler") == "vide") & (F.coalesce("sample_duration", F.lit(0)) == 0), fail("no sample duration"))
    )
    return rows.withColumn("refs", checks.otherwise(F.col("refs")))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under path; none of their bytes are read."""
    local = F.regexp_replace("path", "^file:/(?!/)", "file:///")
    return spark.read.format("binaryFile").load(path).select(local.alias("path"), "length")


def read(spark: SparkSession, path: str) -> DataFrame:
    return stored_headers(listed(spark, path))


def codec(entry=None, config=None):
    """The codec string of a header row; an unknown sample entry raises."""
    e, c = F.col("entry") if entry is None else entry, F.col("config") if config is None else config
    at = lambda i: F.get(c, F.lit(i))
    word = at(2).cast("bigint") * (1 << 24) + at(3) * (1 << 16) + at(4) * (1 << 8) + at(5)
    hevc = lambda name: X.hevc_codec(name, F.shiftright(at(1), 6), at(1).bitwiseAND(31), word, at(1).bitwiseAND(32) > 0, at(12), F.slice(c, 7, 6))
    depth = F.when(at(2).bitwiseAND(0x20) > 0, 12).when(at(2).bitwiseAND(0x40) > 0, 10).otherwise(8)
    return (
        F.when(e.isin("avc1", "avc3"), F.concat(e, F.substring(X.avc_codec(at(1), at(2), at(3)), 5, 7)))
        .when(e == "hvc1", hevc("hvc1"))
        .when(e == "hev1", hevc("hev1"))
        .when(e == "av01", X.av1_codec(F.shiftright(at(1), 5), at(1).bitwiseAND(31), at(2).bitwiseAND(0x80) > 0, depth))
        .when(e == "mp4a", X.aac_codec(at(0)))
        .when(e.isin("ac-3", "ec-3", "wvtt"), e)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported sample entry "), e)))
    )


def tracks(rows: DataFrame) -> DataFrame:
    """(id, path, type, codec, frame_rate, ...) of header rows."""
    kind = F.when(F.col("handler") == "vide", "video").when(F.col("handler") == "soun", "audio").otherwise("text")
    rate = F.when(F.col("handler") == "vide", X.frame_rate(F.col("timescale"), F.col("sample_duration")))
    return rows.select(X.uuid5_url(F.col("path")).alias("id"), "path", kind.alias("type"), codec().alias("codec"), "timescale", "width", "height", rate.alias("frame_rate"), "sample_rate", "channels", F.when(kind != "video", F.col("language")).alias("language"), "init_end")


def segments(rows: DataFrame) -> DataFrame:
    """(path, idx, start, end, start_byte, end_byte, timescale): running sums
    of the references. Overflow raises."""
    each = rows.select("path", "timescale", "earliest", "first_byte", F.explode("refs").alias("r")).select("path", "timescale", "earliest", "first_byte", "r.*")
    upto = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end, end_byte = F.col("earliest") + F.sum("duration").over(upto), F.col("first_byte") + F.sum("size").over(upto)
    return each.select("path", "idx", (end - F.col("duration")).alias("start"), end.alias("end"), (end_byte - F.col("size")).alias("start_byte"), end_byte.alias("end_byte"), "timescale")


def ranged(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, idx, data): the bytes of each range (path, idx, start_byte,
    end_byte) of files in memory (path, content); a range past the end raises."""
    rows = ranges.join(files.select("path", "content"), "path")
    data = F.substring("content", (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    inside = F.col("end_byte") <= F.length("content")
    return rows.select("path", "idx", F.when(inside, data).otherwise(F.raise_error(F.lit("the range ends past the file"))).alias("data"))


#: Bytes of a file whose ranges are one task's, and of one read.
STRETCH, READ = 64 << 20, 8 << 20


def stored_ranges(ranges: DataFrame) -> DataFrame:
    """(path, idx, data) as `ranged`, of stored files; tasks read the ranges,
    which may lie anywhere in a file of any size. Ranges of one stretch of a
    file go to one task, which opens the file once and reads ranges that touch
    each other together."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, f = None, None
        for batch in batches:
            for group in _touching(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                path, low, high = group[0][0], group[0][2], max(r[3] for r in group)
                if path != current:
                    if f:
                        f.close()
                    fs, at = pyarrow.fs.FileSystem.from_uri(path)
                    current, f = path, fs.open_input_file(at)
                data = f.read_at(high - low, low)
                if len(data) < high - low:
                    raise ValueError(f"{path}: the range ends past the file")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(group)), pa.array([r[1] for r in group], pa.int64()), pa.array([data[r[2] - low : r[3] - low] for r in group], pa.binary())], names=["path", "idx", "data"])
        if f:
            f.close()

    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ranges.select("path", F.col("idx").cast("bigint").alias("idx"), "start_byte", "end_byte")
    dealt = rows.repartition(n, "path", F.floor(F.col("start_byte") / STRETCH)).sortWithinPartitions("path", "start_byte", "end_byte")
    return dealt.mapInArrow(fetch, "path string, idx bigint, data binary")


def _touching(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (path, idx, start, end), in that order, by what one read fetches."""
    group: list[tuple] = []
    end = 0
    for r in rows:
        if group and (r[0] != group[0][0] or r[2] > end or r[3] - group[0][2] > READ):
            yield group
            group = []
        end = max(end, r[3]) if group else r[3]
        group.append(r)
    if group:
        yield group
