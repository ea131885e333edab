"""Binary clouds and captures in ranges of any size, against what was written."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.sources import captures, clouds, packets


def cloud_rows(df):
    return sorted((r.frame_id, r.id, r.x, r.y, r.z, r.intensity) for r in df.collect())


@pytest.fixture(scope="module")
def points(spark):
    n = F.col("id")
    frame = F.when(n < 3000, F.lit("hot")).when(n < 3001, F.lit("one")).otherwise(F.concat(F.lit("f"), (n % 7).cast("string")))
    return spark.range(4000).select(frame.alias("frame_id"), (n * 3).alias("id"), (n * 0.1).alias("x"), (-n).cast("double").alias("y"), F.lit(1 / 3).alias("z"), (n % 5).cast("double").alias("intensity")).repartition(6)


def wanted(points):
    out, n = [], {}
    for r in sorted(points.collect(), key=lambda r: (r.frame_id, r.id)):
        out.append((r.frame_id, n.setdefault(r.frame_id, 0), r.x, r.y, r.z, r.intensity))
        n[r.frame_id] += 1
    return out


@pytest.mark.parametrize("split", [100, 777, 1 << 20])
def test_clouds_go_out_and_in(spark, points, tmp_path, split):
    path = str(tmp_path / "clouds")
    clouds.write_binary_clouds(points, path, file_points=500)
    names = sorted(p.name for p in (tmp_path / "clouds").iterdir())
    assert "one.pcd" in names and "hot.part-000000000000.pcd" in names and len([n for n in names if n.startswith("hot.")]) >= 6
    assert not any(n.startswith("_") for n in names)
    assert cloud_rows(clouds.read_binary_clouds(spark, f"file://{path}", split_bytes=split)) == wanted(points)
    # overwriting leaves nothing of before
    clouds.write_binary_clouds(points.where("frame_id = 'one'"), path)
    assert [p.name for p in (tmp_path / "clouds").iterdir()] == ["one.pcd"]
    clouds.write_binary_clouds(points.limit(0), path)
    assert clouds.read_binary_clouds(spark, path).count() == 0


def test_other_layouts(spark, tmp_path):
    """Floats, fields in another order, counts, an ascii file, and a folder and files that are not to be read."""
    kind = np.dtype([("intensity", "<f4"), ("normal", "<f4", (3,)), ("z", "<f8"), ("x", "<i2"), ("y", "u1")])
    raw = np.zeros(1000, kind)
    raw["x"], raw["y"], raw["z"], raw["intensity"] = np.arange(1000) - 500, np.arange(1000) % 256, np.arange(1000) / 8, 0.5
    head = b"# .PCD\nVERSION 0.7\nFIELDS intensity normal z x y\nSIZE 4 4 8 2 1\nTYPE F F F I U\nCOUNT 1 3 1 1 1\nWIDTH 1000\nHEIGHT 1\nPOINTS 1000\nDATA binary\n"
    (tmp_path / "a.pcd").write_bytes(head + raw.tobytes() + b"trailing")
    (tmp_path / "b.pcd").write_text("VERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 3\nHEIGHT 1\nPOINTS 3\nDATA ascii\n1 2 3\n4 5 6\n7 8 nan\n")
    (tmp_path / "_staging-x").mkdir()
    (tmp_path / "_staging-x" / "c.pcd").write_bytes(b"half")
    (tmp_path / "d.txt").write_text("no cloud")
    for split in (50, 333, None):
        rows = cloud_rows(clouds.read_binary_clouds(spark, str(tmp_path), split_bytes=split))
        a = [r for r in rows if r[0] == "a"]
        assert [r[1:] for r in a] == [(i, i - 500, i % 256, i / 8, 0.5) for i in range(1000)]
        assert [r[1:4] for r in rows if r[0] == "b"] == [(0, 1, 2), (1, 4, 5), (2, 7, 8)]
    (tmp_path / "a.pcd").write_bytes(head + raw.tobytes()[:-5])
    with pytest.raises(Exception, match="ends before"):
        clouds.read_binary_clouds(spark, str(tmp_path)).count()


def capture(order, magic, rows, unit):
    out = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65_535, 1)
    for us, data in rows:
        out += struct.pack(f"{order}IIII", us // 1_000_000, us % 1_000_000 * unit, len(data), len(data) + 3) + data
    return out


@pytest.mark.parametrize("split", [7, 1000, 1 << 20])
def test_captures_in_ranges(spark, tmp_path, split):
    """Ranges down to one byte, both byte orders and units, empty packets, and packets that hold a capture themselves."""
    rng = np.random.default_rng(1)
    inner = capture("<", 0xA1B2C3D4, [(1_699_999_000_000_000 + k, b"x" * 9) for k in range(5)], 1)
    n = 6 if split < 10 else 400
    rows = [(1_700_000_000_000_000 + 1000 * k, inner if k % 50 == 7 and split > 10 else rng.bytes(int(rng.integers(0, 90)))) for k in range(n)]
    (tmp_path / "a.pcap").write_bytes(capture("<", 0xA1B2C3D4, rows, 1))
    (tmp_path / "b.pcap").write_bytes(capture(">", 0xA1B23C4D, rows[: n // 2], 1000))
    (tmp_path / "c.pcap").write_bytes(capture("<", 0xA1B2C3D4, [], 1))
    found = captures.read_capture_ranges(spark, str(tmp_path), split_bytes=split)
    numbered = sorted((r.file, r.number, r.ts_us, r.length, bytes(r.payload)) for r in captures.with_numbers(found).collect())
    want = [(f, k, us, len(data) + 3, data) for f, own in (("a.pcap", rows), ("b.pcap", rows[: n // 2])) for k, (us, data) in enumerate(own)]
    assert numbered == want
    if split > 1000:
        whole = sorted((r.file, r.number, r.ts_us, r.length, bytes(r.payload)) for r in packets.read_captures(spark, str(tmp_path)).collect())
        assert whole == want


def test_very_many_short_ranges_are_few_tasks(spark, points, tmp_path):
    """More ranges than a driver has room for tasks: those that follow each other go together, of one file and of many."""
    clouds.write_binary_clouds(points, str(tmp_path / "clouds"), file_points=1000)
    found = clouds.read_binary_clouds(spark, str(tmp_path / "clouds"), split_bytes=64)
    assert found.rdd.getNumPartitions() <= 2
    assert cloud_rows(found) == wanted(points)
    rows = spark.range(3000).select((1_700_000_000_000_000 + F.col("id") * 7919 % 3000).alias("ts_us"), F.concat(F.lit("p"), F.col("id").cast("string")).cast("binary").alias("payload")).repartition(3)
    captures.write_captures(rows, str(tmp_path / "captures"))
    packets_found = captures.read_capture_ranges(spark, str(tmp_path / "captures"), split_bytes=50)
    assert packets_found.rdd.getNumPartitions() <= 2
    got = sorted((r.number, r.ts_us, bytes(r.payload)) for r in captures.with_numbers(packets_found, whole=True).collect())
    assert got == [(k, r.ts_us, bytes(r.payload)) for k, r in enumerate(sorted(rows.collect(), key=lambda r: (r.ts_us, bytes(r.payload))))]


def test_captures_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(5000).select((1_700_000_000_000_000 + F.col("id") * 7919 % 5000).alias("ts_us"), F.concat(F.lit("p"), F.col("id").cast("string")).cast("binary").alias("payload")).repartition(5)
    captures.write_captures(rows, str(tmp_path / "out"))
    found = captures.read_capture_ranges(spark, str(tmp_path / "out"), split_bytes=1000)
    got = found.orderBy("file", "at").collect()
    assert [r.ts_us for r in got] == sorted(r.ts_us for r in got)
    assert sorted((r.ts_us, bytes(r.payload)) for r in got) == sorted((r.ts_us, bytes(r.payload)) for r in rows.collect())


def test_scanner_packets_there_and_back(spark):
    rows = spark.range(1000).select(F.floor(F.col("id") / 384).alias("packet"), (F.col("id") % 384).cast("int").alias("place"), (F.col("id") * 50).cast("int").alias("raw"), (F.col("id") % 200).cast("int").alias("intensity"), F.lit(4500).alias("azimuth"))
    sent = packets.encode(rows).select(F.lit("f").alias("file"), F.col("ts_us").alias("number"), "ts_us", F.lit(0).cast("long").alias("length"), "payload")
    got = {r.gps * 384 + r.block * 32 + r.laser: r for r in packets.decode(sent).collect()}
    assert len(got) == 3 * 384
    for i in range(1000):
        assert np.isclose(got[i].distance, i * 50 * 0.002) and got[i].intensity == i % 200 and got[i].azimuth == 45
    assert got[1100].distance == 0
