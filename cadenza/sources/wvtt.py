"""Timed text as fragmented MP4: cue samples to bytes, in column expressions.

Which samples there are, and what holds in each, is worked out by the timeline
operators. Here each segment's samples become one binary column: styp, moof and
mdat. What precedes them in a file, ftyp, moov and a sidx with a reference per
segment, needs only their sizes and durations. The sizes of boxes follow from
the numbers of their entries, so no box is built to be measured.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cadenza.sources.stored import written

# The parts of the format that no sample changes.
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FTYP = bytes.fromhex("0000001c") + b"ftypiso6" + bytes(4) + b"iso6cmfccmft"
STYP = bytes.fromhex("0000001c") + b"stypmsdh" + bytes(4) + b"msdhmsixcmfs"
NO_CUE = bytes.fromhex("00000008") + b"vtte"
#: Bytes of a moof with no samples, and of each sample's entry.
MOOF, ENTRY = 88, 8


def number(value: Column | int, size: int) -> Column:
    """A big-endian unsigned integer of that many bytes."""
    if isinstance(value, int):
        return F.lit(value.to_bytes(size, "big"))
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def joined(parts: Column) -> Column:
    """An array of binaries, end to end."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def box(kind: str, size: Column | int, *parts: Column | bytes) -> Column:
    """A box whose parts have `size` bytes together."""
    return F.concat(number(size + 8, 4), F.lit(kind.encode()), *[F.lit(p) if isinstance(p, bytes) else p for p in parts])


def payload(cues: Column) -> Column:
    """A sample: one box per active cue, or one that says there is none."""
    one = lambda text: F.length(F.encode(text, "UTF-8"))
    boxes = F.transform(cues, lambda c: box("vttc", one(c) + 8, box("payl", one(c), F.encode(c, "UTF-8"))))
    return F.when(F.size(cues) > 0, joined(boxes)).otherwise(F.lit(NO_CUE))


def fragments(samples: DataFrame, track: str = "track", track_id: int = 1) -> DataFrame:
    """(track, segment, start, duration, fragment) from samples (track, segment,
    start, end, active) in ms; segments are numbered in time order, from any
    number. One row, and what a task holds, is one segment. A run's data offset
    points behind the moof and the mdat's header."""
    if track_id == 0:
        raise ValueError("the track id must not be 0")
    sample = F.struct("start", (F.col("end") - F.col("start")).alias("duration"), payload(F.col("active")).alias("data"))
    rows = samples.groupBy(track, "segment").agg(F.array_sort(F.collect_list(sample)).alias("s")).withColumn("sequence", F.row_number().over(_in_order(track)))
    n = F.size("s")
    entries = joined(F.transform("s", lambda s: F.concat(number(s["duration"], 4), number(F.length(s["data"]), 4))))
    size = F.aggregate("s", F.lit(0), lambda total, s: total + F.length(s["data"]))
    start, length = F.get("s", F.lit(0))["start"], F.aggregate("s", F.lit(0).cast("bigint"), lambda total, s: total + s["duration"])
    run = box("trun", 12 + ENTRY * n, struct.pack(">I", 0x301), number(n, 4), number(MOOF + ENTRY * n + 8, 4), entries)
    header = box("tfhd", 8, struct.pack(">II", 0x20000, track_id))
    traf = box("traf", 56 + ENTRY * n, header, box("tfdt", 12, struct.pack(">I", 1 << 24), number(start, 8)), run)
    moof = box("moof", MOOF - 8 + ENTRY * n, box("mfhd", 8, bytes(4), number(F.col("sequence"), 4)), traf)
    return rows.select(track, "segment", start.alias("start"), length.alias("duration"), F.concat(F.lit(STYP), moof, box("mdat", size, joined(F.transform("s", lambda s: s["data"])))).alias("fragment"))


def _in_order(track: str) -> WindowSpec:
    return Window.partitionBy(track).orderBy("segment")


def _full(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return _plain(kind, struct.pack(">I", version << 24 | flags), *parts)


def _plain(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode()) + body


def movie(duration: Column, timescale: int, track_id: int) -> Column:
    """The moov of a text track: fixed but for the duration, in three places."""
    d, mark = number(duration, 8), b"\xff" * 8
    mvhd = _full("mvhd", 1, 0, struct.pack(">QQI", 0, 0, timescale), mark, struct.pack(">IH10x", 0x10000, 0x100), UNITY, bytes(24), struct.pack(">I", track_id + 1))
    tkhd = _full("tkhd", 1, 3, struct.pack(">QQII", 0, 0, track_id, 0), mark, bytes(16), UNITY, bytes(8))
    mdhd = _full("mdhd", 1, 0, struct.pack(">QQI", 0, 0, timescale), mark, struct.pack(">HH", 0x55C4, 0))
    entry = _plain("wvtt", bytes(6), struct.pack(">H", 1), _plain("vttC", b"WEBVTT\n"))
    tables = _full("stts", 0, 0, bytes(4)) + _full("stsc", 0, 0, bytes(4)) + _full("stsz", 0, 0, bytes(8)) + _full("stco", 0, 0, bytes(4))
    stbl = _plain("stbl", _full("stsd", 0, 0, struct.pack(">I", 1), entry), tables)
    minf = _plain("minf", _full("nmhd", 0, 0), _plain("dinf", _full("dref", 0, 0, struct.pack(">I", 1), _full("url ", 0, 1))), stbl)
    mdia = _plain("mdia", mdhd, _full("hdlr", 0, 0, bytes(4), b"text", bytes(12), b"cadenza\0"), minf)
    trex = _full("trex", 0, 0, struct.pack(">IIIII", track_id, 1, 0, 0, 0))
    parts = _plain("moov", mvhd, _plain("mvex", trex), _plain("trak", tkhd, mdia)).split(mark)
    return F.concat(*[c for p in parts[:-1] for c in (F.lit(p), d)], F.lit(parts[-1]))


def heads(pieces: DataFrame, track: str = "track", timescale: int = 1000, track_id: int = 1) -> DataFrame:
    """(track, head): what stands before the fragments in a file; of `pieces`
    (track, segment, start, duration, size) no bytes are needed. A track that
    covers no time raises."""
    if timescale == 0 or track_id == 0:
        raise ValueError("the track id and the timescale must not be 0")
    rows = pieces.groupBy(track).agg(F.array_sort(F.collect_list(F.struct("segment", "start", "duration", "size"))).alias("p"))
    n = F.size("p")
    last = F.element_at("p", -1)
    end = last["start"] + last["duration"]
    end = F.when(end > 0, end).otherwise(F.raise_error(F.lit("no time is covered")))
    refs = joined(F.transform("p", lambda p: F.concat(number(p["size"], 4), number(p["duration"], 4), F.lit(struct.pack(">I", 0x90000000)))))
    first = F.concat(F.lit(struct.pack(">III", 1 << 24, track_id, timescale)), number(F.get("p", F.lit(0))["start"], 8), F.lit(bytes(10)), number(n, 2))
    return rows.select(track, F.concat(F.lit(FTYP), movie(end, timescale, track_id), box("sidx", 32 + 12 * n, first, refs)).alias("head"))


def packaged(samples: DataFrame, track: str = "track", timescale: int = 1000, track_id: int = 1) -> DataFrame:
    """(track, content): a whole file per track, for a sink of files. Fragments
    are built segment by segment; only their joining holds a track."""
    pieces = fragments(samples, track, track_id)
    head = heads(pieces.withColumn("size", F.length("fragment")), track, timescale, track_id)
    bodies = pieces.groupBy(track).agg(F.array_sort(F.collect_list(F.struct("segment", "fragment"))).alias("f"))
    return bodies.join(head, track).select(track, F.concat("head", joined(F.transform("f", lambda f: f["fragment"]))).alias("content"))


def pieces(samples: DataFrame, track: str = "track", timescale: int = 1000, track_id: int = 1) -> DataFrame:
    """(track, place, data): each track's file in pieces, the head and then the
    fragments, for a sink that appends them (`media.write_pieces`). No row is
    more than one of them."""
    made = written(fragments(samples, track, track_id), "fragments")
    head = heads(made.withColumn("size", F.length("fragment")), track, timescale, track_id)
    first = head.select(track, F.lit(None).cast("bigint").alias("place"), F.col("head").alias("data"))
    rest = made.select(track, F.col("segment").cast("bigint").alias("place"), F.col("fragment").alias("data"))
    # A segment's number may be any; the head stands before them all.
    return first.unionByName(rest).withColumn("place", F.coalesce("place", F.lit(-(1 << 63))))
