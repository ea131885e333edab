"""Readers against files written by hand, and round trips of the writers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.sources import packets, text


def put(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return str(tmp_path / name)


def test_points(spark, tmp_path):
    path = put(tmp_path, "p.txt", "1 2 3 4\n  5\t6 7 8  \n\nbad 1 2 3\n1 2\n")
    rows = text.read_text(spark, path, "points")
    assert [tuple(r)[:4] for r in rows.collect()] == [(1, 2, 3, 4), (5, 6, 7, 8), (None, 1, 2, 3), (1, 2, None, None)]
    assert text.read_text(spark, path, "points", bad="drop").count() == 2


def test_poses(spark, tmp_path):
    path = put(tmp_path, "a.txt", "0.5 2 3 1 20 30 10\n")
    assert text.read_text(spark, path, "poses_rpy").select("t", "x", "y", "z", "roll", "pitch", "yaw").first() == (0.5, 1, 2, 3, 10, 20, 30)
    path = put(tmp_path, "b.txt", "7 8 1 2 3 0 0 0 1\n")
    assert text.read_text(spark, path, "poses_stamped").drop("file").first() == (7, 8, 1, 2, 3, 0, 0, 0, 1)
    path = put(tmp_path, "c.txt", "1 2 3 10 20 30\n")
    assert text.read_text(spark, path, "points_rgb").drop("file").first() == (1, 2, 3, 10, 20, 30)


def test_scans_in_a_folder(spark, tmp_path):
    put(tmp_path, "a.xyz", "1 2 3 A\n4 5 6 7\n")
    put(tmp_path, "b.xyz", "1 1 1 B\n")
    put(tmp_path, "c.txt", "9 9 9 9\n")
    rows = sorted(map(tuple, text.read_xyz(spark, str(tmp_path)).collect()))
    assert rows == [(1, 1, 1, 66, "b.xyz"), (1, 2, 3, 65, "a.xyz"), (4, 5, 6, 55, "a.xyz")]
    assert text.read_xyz(spark, str(tmp_path), compat=False).where("x = 4").first().intensity == 7


def test_curves(spark, tmp_path):
    path = put(tmp_path, "c.csv", "0.5, 1, 2\n1.5,3,4\n")
    assert [(r.t, r["values"]) for r in text.read_curve(spark, path).collect()] == [(0.5, [1, 2]), (1.5, [3, 4])]
    assert [(r.t0, r.t1, r["values"]) for r in text.read_curve(spark, path, 2).collect()] == [(0.5, 1, [2]), (1.5, 3, [4])]
    assert [r.t for r in text.read_curve(spark, path, compat=True).collect()] == [1, 3]
    assert text.read_matrix(spark, path).first().fields == ["0.5", " 1", " 2"]
    rows = spark.createDataFrame([(2.0, [1.0, 2.0]), (1.0, [3.0, 4.5])], "t double, values array<double>")
    text.write_curve(rows, str(tmp_path / "out"))
    back = text.read_curve(spark, str(tmp_path / "out"))
    assert sorted((r.t, r["values"]) for r in back.collect()) == [(1, [3, 4.5]), (2, [1, 2])]
    with pytest.raises(ValueError):
        text.write_curve(rows.union(spark.createDataFrame([(3.0, [1.0])], rows.schema)), str(tmp_path / "bad"))


def test_text_writer(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 1.25), (2, 1.5, -2.0)], "k int, t double, x double")
    text.write_text(rows, str(tmp_path / "o"), ["t", "x"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == ["0.500000 1.250000", "1.500000 -2.000000"]
    text.write_text(rows, str(tmp_path / "by"), ["t", "x"], by="k")
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["k=1", "k=2"]
    assert spark.range(1).select(text.file_key(F.lit(1.5)).alias("f")).first().f == "1.500000"


def capture(n):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i in range(n):
        record = b"".join(struct.pack("<HH", 0xEEFF, (i * 12 + b) * 2000 % 36000) + b"".join(struct.pack("<HB", 500 + k, k) for k in range(32)) for b in range(12)) + struct.pack("<IBB", 1000 + i, 0, 0)
        body = b"\0" * packets.PAYLOAD_AT + record
        out += struct.pack("<IIII", 10 + i, 5, len(body), len(body)) + body
    return out


def test_captures(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(4))
    found = packets.read_captures(spark, str(tmp_path))
    assert [(r.number, r.ts_us, r.length) for r in found.orderBy("number").collect()] == [(i, (10 + i) * 1_000_000 + 5, 1248) for i in range(4)]
    returns = packets.decode(found)
    assert returns.count() == 4 * 12 * 32
    one = returns.where("number = 1 and block = 2 and laser = 3").first()
    assert (one.azimuth, round(one.distance, 6), one.intensity, one.gps) == (280.0, 1.006, 3, 1001)
    assert {r.frame for r in packets.with_frames(returns).select("frame").distinct().collect()} == {0, 1, 2}
    points = packets.to_points(returns, [0.0] * 32).where("number = 0 and block = 0 and laser = 0").first()
    assert (round(points.x, 9), round(points.y, 9), points.z) == (0, 1.0, 0)


def test_broken_capture(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(2)[:-10])
    with pytest.raises(Exception, match="inside a packet"):
        packets.read_captures(spark, str(tmp_path)).count()


def test_clouds(spark, tmp_path):
    points = spark.createDataFrame([("1.000000", 0, 1.0, 2.0, 3.0, 4.0), ("1.000000", 1, 5.0, 6.0, 7.0, 8.0), ("2.000000", 0, 0.5, 0.0, 0.0, 1.0)], "frame_id string, id long, x double, y double, z double, intensity double")
    packets.write_clouds(points, str(tmp_path / "o"))
    back = packets.read_clouds(spark, str(tmp_path / "o"), pattern="*.txt")
    assert sorted(tuple(r)[1:] for r in back.collect()) == sorted(tuple(r)[1:] for r in points.collect())
    head = "VERSION 0.7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary\n"
    (tmp_path / "3.250000.pcd").write_bytes(head.encode() + np.arange(8, dtype="<f4").tobytes())
    assert [tuple(r) for r in packets.read_clouds(spark, str(tmp_path)).collect()] == [("3.250000", 0, 0, 1, 2, 3), ("3.250000", 1, 4, 5, 6, 7)]


def test_times_asked_twice_are_two_rows_of_a_curve_evaluation(spark):
    from cloudframe.operators import rotations

    poses = spark.createDataFrame([(1, float(k), float(k * k), 1.0, 0.0, 0.0, 0.0, 0.1 * k) for k in range(5)], "traj_id long, t double, x double, y double, z double, roll double, pitch double, yaw double")
    times = spark.createDataFrame([(1, 1.5), (1, 1.5), (1, 4.0)], "traj_id long, t double")
    assert sorted(r.t for r in rotations.curve_evaluation(poses, times).collect()) == [1.5, 1.5, 4.0]


def test_curve_evaluation_files(spark, tmp_path):
    """Headers and lines in the order of time, over several files of one curve, which read back as they were."""
    from cloudframe.operators import rotations, trajectory

    poses = spark.range(40).select((F.col("id") % 2).alias("traj_id"), F.col("id").cast("double").alias("t"), F.sin("id").alias("x"), F.cos("id").alias("y"), F.lit(0.5).alias("z"), F.lit(0.1).alias("roll"), F.lit(0.0).alias("pitch"), (F.col("id") / 10).alias("yaw"))
    rows = rotations.curve_evaluation(poses, trajectory.sample_times(poses, 200))
    path = str(tmp_path / "curve")
    text.write_evaluation(rows.repartition(3), path)
    for folder in ("traj_id=0", "traj_id=1"):
        times = []
        for file in sorted((tmp_path / "curve" / folder).glob("part-*")):
            lines = file.read_text().splitlines()
            assert lines[0] == "t px py pz rw rx ry rz vx vy vz wx wy wz" and len(lines[1].split(" ")) == 14
            times += [float(line.split(" ")[0]) for line in lines[1:]]
        assert times == sorted(times) and len(times) == 199
    back = {(r.traj_id, round(r.t, 3)): r for r in text.read_evaluation(spark, path).collect()}
    for r in rows.collect():
        assert np.allclose(tuple(back[r.traj_id, round(r.t, 3)])[:14], tuple(r)[1:], atol=1e-6)


def test_composition_is_extended_folded_and_saved(spark, tmp_path):
    from cloudframe.operators import rigid, rotations

    at = lambda t: rigid.exponential((1.0, 0.2, 0.0), (0.0, 0.1, 0.3), t)
    kind = "traj_id long, t double, x double, y double, z double, qw double, qx double, qy double, qz double"
    row = lambda k, t, m: (k, float(t), *map(float, m[1]), *map(float, m[0]))
    turn = rigid.exponential((0.5, 0.0, 1.0), (0.2, 0.0, 0.0))
    base = spark.createDataFrame([row(1, t, at(t)) for t in (1, 2, 3)], kind)
    correction = spark.createDataFrame([row(1, t, turn) for t in (1, 3)], kind)
    new = spark.createDataFrame([row(1, 5, at(7)), row(1, 0, at(9)), row(2, 4, at(1)), row(2, 6, at(2))], kind)
    longer, carried_on = rotations.extend_composition(base, correction, new)
    assert sorted((r.traj_id, r.t) for r in carried_on.collect()) == [(1, 0), (1, 1), (1, 3), (1, 5), (2, 4), (2, 6)]
    folded, still = rotations.fold_corrections(longer, carried_on)
    want = {(1, t): rigid.compose(turn, at(t)) for t in (1, 2, 3)} | {(1, 5): at(7), (1, 0): at(9), (2, 4): at(1), (2, 6): at(2)}
    got = {(r.traj_id, r.t): r for r in folded.collect()}
    assert set(got) == set(want)
    for key, motion in want.items():
        r = got[key]
        assert np.allclose((r.x, r.y, r.z), motion[1]) and np.isclose(abs(np.dot((r.qw, r.qx, r.qy, r.qz), motion[0])), 1)
    assert {tuple(r)[2:] for r in still.collect()} == {(0, 0, 0, 1, 0, 0, 0)}
    text.write_composition(longer, carried_on, folded, str(tmp_path / "c"))
    assert {p.name for p in (tmp_path / "c").iterdir()} == {"base", "correction", "composition"}
    assert spark.read.csv(str(tmp_path / "c" / "composition")).count() == 7


def test_control_points(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, float(i), *map(float, rng.normal(size=2))) for k, n in ((1, 700), (2, 4), (3, 1)) for i in range(n)]
    points = spark.createDataFrame(rows, "traj_id long, t double, x double, y double").repartition(3)
    controls = points.select("traj_id", F.col("t").cast("long").alias("i"), (F.col("x") + 10).alias("px"), (F.col("y") - 10).alias("py"))
    path = str(tmp_path / "controls")
    text.write_control_points(controls, points, path)
    first = sorted((tmp_path / "controls" / "traj_id=2").glob("part-*"))[0].read_text().splitlines()
    assert first[0] == "4" and len(first[1].split(",")) == 2
    want = {(k, kind, int(i), x + s, y - s) for k, i, x, y in rows for kind, s in (("control", 10.0), ("point", 0.0))}
    for size in ("128m", "1000"):  # lines are numbered right where files are cut
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = text.read_control_points(spark, path).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {(r.traj_id, r.kind, r.i, r.x, r.y) for r in found} == want and len(found) == 2 * len(rows)
        assert {(r.traj_id, r.n) for r in found} == {(1, 700), (2, 4), (3, 1)}


def test_control_points_that_do_not_fit_their_count(spark, tmp_path):
    for name, body in (("short", "2\n1,1\n2,2\n3,3\n"), ("other", "x\n1,1\n2,2\n")):
        folder = tmp_path / name / "traj_id=1"
        folder.mkdir(parents=True)
        (folder / "a.txt").write_text(body)
        with pytest.raises(Exception, match="do not fit"):
            text.read_control_points(spark, str(tmp_path / name)).collect()
