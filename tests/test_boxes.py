"""Headers of small files that are put together here."""

import struct

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from cadenza.sources import boxes


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode()) + body


def movie(entry, handler=b"vide", timescale=1000, language="und", trex=0):
    code = sum((ord(c) - 0x60) << s for c, s in zip(language, (10, 5, 0)))
    mdhd = box("mdhd", struct.pack(">IIIIIHH", 0, 0, 0, timescale, 0, code, 0))
    hdlr = box("hdlr", struct.pack(">II4s", 0, 0, handler), bytes(13))
    stsd = box("stsd", struct.pack(">II", 0, 1), entry)
    trak = box("trak", box("mdia", mdhd, hdlr, box("minf", box("stbl", stsd))))
    return box("moov", box("mvhd", bytes(100)), trak, box("mvex", box("trex", struct.pack(">IIIIII", 0, 1, 1, trex, 0, 0))))


def visual(kind, width, height, config):
    return box(kind, bytes(24), struct.pack(">HH", width, height), bytes(50), config)


def sidx(refs, timescale=1000, earliest=0, first=0, version=0):
    head = struct.pack(">B3xII", version, 1, timescale) + struct.pack(">QQ" if version else ">II", earliest, first)
    return box("sidx", head, struct.pack(">HH", 0, len(refs)), *(struct.pack(">III", size, duration, sap) for size, duration, sap in refs))


def moof(duration=None):
    flags = 0x100 if duration is not None else 0
    run = struct.pack(">II", flags, 1) + (struct.pack(">I", duration) if flags else b"")
    return box("moof", box("traf", box("tfhd", struct.pack(">II", 0, 1)), box("trun", run)))


AVC = visual("avc1", 16, 8, box("avcC", bytes([1, 0x42, 0xC0, 0x0A, 0xFF])))
SAP = 0x90000000
REFS = [(40, 1000, SAP), (60, 500, SAP)]


def good(**changes):
    parts = {"moov": movie(AVC), "free": box("free", bytes(30)), "sidx": sidx(REFS, earliest=90, first=4), "moof": moof(250)} | changes
    return box("ftyp", b"cmfc", bytes(4)) + b"".join(parts.values()) + bytes(200)


def frame(spark, *contents):
    return spark.createDataFrame([(f"f{i}.mp4", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_tracks_and_segments(spark):
    audio = box("mp4a", bytes(16), struct.pack(">HHI", 2, 16, 0), struct.pack(">I", 48000 << 16), box("esds", bytes(4), bytes([3, 25, 0, 0, 0, 4, 17]), bytes(13), bytes([5, 2, 0x11, 0x90])))
    hevc = visual("hvc1", 64, 32, box("hvcC", bytes([1, 1, 0x60, 0, 0, 0, 0xB0, 0, 0, 0, 0, 0, 120])))
    contents = [good(), good(moov=movie(audio, b"soun", 48000, "nld")), good(moov=movie(hevc)), good(moov=movie(visual("av01", 2, 2, box("av1C", bytes([0x81, 0x08, 0x4C, 0])))), moof=moof()), good(moov=movie(box("wvtt", bytes(8)), b"text", language="eng"))]
    contents[3] = good(moov=movie(visual("av01", 2, 2, box("av1C", bytes([0x81, 0x08, 0x4C, 0]))), trex=40), moof=moof())
    files = frame(spark, *contents)
    rows = boxes.headers(files)
    got = {r.path: r for r in boxes.tracks(rows).collect()}
    a = [(r.type, r.codec, r.width, r.height, r.frame_rate, r.sample_rate, r.channels, r.language) for r in (got[f"f{i}.mp4"] for i in range(5))]
    assert a == [
        ("video", "avc1.42c00a", 16, 8, "4/1", None, None, None),
        ("audio", "mp4a.40.2", None, None, None, 48000, 2, "nld"),
        ("video", "hvc1.1.6.L120.b0", 64, 32, "4/1", None, None, None),
        ("video", "av01.0.08M.10", 2, 2, "25/1", None, None, None),
        ("text", "wvtt", None, None, None, None, None, "eng"),
    ]
    ends = contents[0].index(moof(250))
    segs = boxes.segments(rows.filter("path = 'f0.mp4'")).orderBy("idx")
    want = [(0, 90, 1090, ends + 4, ends + 44), (1, 1090, 1590, ends + 44, ends + 104)]
    assert [tuple(r)[1:6] for r in segs.collect()] == want
    assert [bytes(r.data) for r in boxes.ranged(files, segs).orderBy("idx").collect()] == [contents[0][w[3] : w[4]] for w in want]
    assert got["f0.mp4"].id == "%s" % boxes.tracks(rows).filter("path = 'f0.mp4'").first()["id"]


def test_bad_files(spark):
    bad = [good(moov=b""), good(sidx=b""), good(moov=movie(AVC, timescale=0)), good(sidx=sidx([(40, 0, SAP)])), good(sidx=sidx([(40, 5, 0)])), good(sidx=sidx([(1 << 31 | 40, 5, SAP)])), good(moov=movie(AVC, b"meta")), good(moof=moof()), good()[:60], good(moov=movie(visual("xxxx", 1, 1, b"")))]
    for content in bad:
        with pytest.raises(PySparkException):
            boxes.tracks(boxes.headers(frame(spark, content))).join(boxes.segments(boxes.headers(frame(spark, content))), "path").collect()


def test_wide_index_and_late_repeat():
    content = good(sidx=sidx(REFS, earliest=1 << 33, version=1))
    assert boxes.header(content)["earliest"] == 1 << 33
    twice = good(moov=movie(AVC, timescale=5) + movie(AVC, timescale=7))
    assert boxes.header(twice)["timescale"] == 7


def test_headers_come_in_small_batches(spark, monkeypatch):
    """However many files a batch brings, few headers are held at once."""
    held, batch = [], boxes._batch
    monkeypatch.setattr(boxes, "AT_ONCE", 3)
    monkeypatch.setattr(boxes, "_batch", lambda rows: (held.append(len(rows)), batch(rows))[1])

    class Files:
        def select(self, *names):
            return self

        def mapInArrow(self, scan, schema):
            paths = pa.array([str(k) for k in range(8)])
            self.out = list(scan(iter([pa.RecordBatch.from_arrays([paths, pa.array([good()] * 8, pa.binary())], names=["path", "content"])])))
            return self

    monkeypatch.setattr(boxes, "validated", lambda rows: rows)
    assert sum(b.num_rows for b in boxes.headers(Files()).out) == 8 and held == [3, 3, 2]
