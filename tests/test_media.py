import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

from cadenza.sources import boxes, media
from tests.test_boxes import SAP, good, moof, sidx


def file(n, size=50):
    """A file of n segments of growing length, the first of which is the moof."""
    first = moof(250)
    bodies = [first, *(bytes([65 + k % 26]) * (size + k) for k in range(1, n))]
    refs = [(len(b), 100 + k, SAP) for k, b in enumerate(bodies)]
    head = good(sidx=sidx(refs))
    return head[: head.index(first)] + b"".join(bodies)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, n in (("a.mp4", 40), ("sub/b.mp4", 7), ("c.mp4", 1)):
        (tmp_path / name).write_bytes(file(n))
    (tmp_path / "_hidden").write_bytes(b"x")
    return f"file://{tmp_path}"


@pytest.mark.parametrize("options", [{}, {"stretch": 100}, {"stretch": 333, "gap": 0}])
def test_segments_equal_those_of_headers(spark, folder, options):
    got = media.read_ranges(spark, folder, **options).collect()
    headers = boxes.stored_headers(spark.createDataFrame([(f"{folder}/{p}", os.path.getsize(f"{folder[7:]}/{p}")) for p in ("a.mp4", "sub/b.mp4", "c.mp4")], "path string, length long"))
    want = boxes.segments(headers).collect()
    key = lambda r: (r.path, r.idx, r.start, r.end, r.start_byte, r.end_byte, r.timescale)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 48
    for r in got:
        with open(r.path[7:], "rb") as f:
            assert bytes(r.data) == f.read()[r.start_byte : r.end_byte]


def test_filters_reach_the_reader(spark, folder):
    rows = media.read_ranges(spark, folder).filter((F.col("start") >= 500) & (F.col("end") < 1500) & F.col("path").endswith("a.mp4"))
    assert "PythonScan" in rows._jdf.queryExecution().toString() or rows.count()
    ends = [r.end for r in rows.collect()]
    assert ends and all(e < 1500 for e in ends) and len(ends) == len(set(ends))
    assert media.read_ranges(spark, folder).filter(f"path = '{folder}/c.mp4'").select("idx").collect()[0].idx == 0
    reader = media.RangeReader(folder, 1 << 20, 0, ["idx", "data"])
    left = list(reader.pushFilters([GreaterThan(("start",), 500), LessThan(("end",), 1500), In(("path",), (f"{folder}/a.mp4",)), EqualTo(("timescale",), 1)]))
    assert [type(f) for f in left] == [EqualTo] and len(reader.partitions()) == 1
    batches = list(reader.read(reader.partitions()[0]))
    assert len(batches) == 1 and 0 < batches[0].num_rows < 15 and batches[0].schema.names == ["idx", "data"]
    plain = media.RangeReader(folder, 1 << 20, 0, ["idx"])
    assert sum(b.num_rows for p in plain.partitions() for b in plain.read(p)) == 48


def test_reads_are_coalesced(folder):
    reader = media.RangeReader(folder, 1 << 20, 0, ["data"])
    part = next(p for p in reader.partitions() if p.path.endswith("a.mp4"))
    assert len(list(reader.read(part))) == 1
    reader.tests = [("idx", "__ge__", 5)]
    reader.passes = lambda idx=None, **_: idx is None or idx in (3, 4, 20)
    assert [b.num_rows for b in reader.read(part)] == [2, 1]


def test_a_broken_file_raises(spark, tmp_path):
    (tmp_path / "x.mp4").write_bytes(file(9)[:-40])
    with pytest.raises(Exception, match="ends past the file"):
        media.read_ranges(spark, f"file://{tmp_path}").collect()
    (tmp_path / "x.mp4").write_bytes(b"\0\0\0\4")
    with pytest.raises(Exception, match="cut short"):
        media.read_ranges(spark, f"file://{tmp_path}").collect()


def test_no_files(spark, tmp_path):
    assert media.read_ranges(spark, f"file://{tmp_path}").collect() == []


def test_pieces_are_written_in_order(spark, tmp_path):
    root, whole = f"file://{tmp_path}/out", {f"d/{n}.mp4": file(n + 1) for n in range(12)}
    pieces = [(p, k, bytearray(data[10 * k : 10 * k + 10])) for p, data in whole.items() for k in range(-(-len(data) // 10))]
    media.write_pieces(spark.createDataFrame([*pieces, ("d/0.mp4", 10_000, None)], "path string, place long, data binary").repartition(5, "data"), root)
    assert {p: (tmp_path / "out" / p).read_bytes() for p in whole} == whole
    assert [f for f in os.listdir(tmp_path / "out") if f.startswith(".staged")] == []
    assert media.read_ranges(spark, root).groupBy("path").count().count() == 12
    media.write_pieces(spark.createDataFrame([], "path string, place long, data binary"), root)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k % 9}", k, bytearray(b"abc")) for k in range(90)] + [("3", 3, bytearray(b"x"))], "path string, place long, data binary")
    with pytest.raises(Exception, match="comes after"):
        media.write_pieces(rows, f"file://{tmp_path}/out")
    left = os.listdir(tmp_path / "out") if (tmp_path / "out").exists() else []
    assert left == []


def test_many_files_share_tasks(spark, tmp_path):
    for n in range(600):
        (tmp_path / f"{n:03d}.mp4").write_bytes(file(2 + n % 9))
    reader = media.RangeReader(f"file://{tmp_path}", 100, 0, ["path", "idx"])
    parts = reader.partitions()
    assert len(parts) <= media.TASKS + 1 and max(len(p.others) for p in parts) < 20
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == sum(2 + n % 9 for n in range(600))
    got = media.read_ranges(spark, f"file://{tmp_path}", stretch=100)
    assert got.rdd.getNumPartitions() <= media.TASKS + 1
    assert got.select("path", "idx").distinct().count() == got.count() == sum(2 + n % 9 for n in range(600))


def test_large_tasks_are_cut_by_bytes():
    many = [media.Stretch(f"f{k // 10}", 10 * media.STRETCH, k % 10 * media.STRETCH, (k % 10 + 1) * media.STRETCH) for k in range(400)]
    assert len(media.dealt(many)) == 400
    assert [(p.first, p.stop) for p in media.dealt([media.Stretch("f", 100, k, k + 10) for k in range(0, 100, 10)], 2)] == [(0, 50), (50, 100)]
