"""Whole programs on scenes whose answer is known."""

import math

from pyspark.sql import functions as F

from cloudframe.operators import ring
from cloudframe.plans import programs

FRAMES = 24


def at(distance, azimuth, elevation):
    flat = distance * math.cos(math.radians(elevation))
    return flat * math.sin(math.radians(azimuth)), flat * math.cos(math.radians(azimuth)), distance * math.sin(math.radians(elevation))


def scene():
    """Ground all around, one thing that stands and one that moves by two degrees a frame."""
    rows, n = [], 0
    for f in range(FRAMES):
        shots = [("ground", *at(1 / math.sin(math.radians(-e)), a + 0.02, e)) for a in range(0, 360, 2) for e in (-14.1, -12.1, -10.1)]
        shots += [("stands", *at(3.0, a + 0.02, e)) for a in range(200, 206) for e in (-0.1, 1.9)]
        shots += [("moves", *at(3.0, a + 2 * f + 0.02, e)) for a in range(30, 36) for e in (-0.1, 1.9)]
        for kind, x, y, z in shots:
            rows.append((1, f, n, x, y, z, kind))
            n += 1
    return rows


def test_moving_things_leave_the_map(spark):
    points = spark.createDataFrame(scene(), "seq_id long, frame_id long, id long, x double, y double, z double, kind string")
    poses = points.select("frame_id").distinct().select("frame_id", *[F.lit(0.0).alias(c) for c in ("tx", "ty", "tz", "roll", "pitch", "yaw")])
    kept = programs.remove_dynamic_objects(points.drop("kind"), poses, programs.Scan(columns=360, radius=0.2, least=5))
    left = {(r.kind, r.frame_id): r["count"] for r in points.join(kept.select("id"), "id").groupBy("kind", "frame_id").count().collect()}
    everything = {(r.kind, r.frame_id): r["count"] for r in points.groupBy("kind", "frame_id").count().collect()}
    assert all(left[k] == everything[k] for k in everything if k[0] == "stands")
    gone = [f for f in range(FRAMES) if ("moves", f) not in left]
    assert gone and gone[-1] == FRAMES - 1 and gone == list(range(gone[0], FRAMES)) and gone[0] >= 4


def test_frames_are_apart(spark):
    points = spark.createDataFrame([(f, 1000 * f + i, *at(4.0, 3.0 * i, e)) for f in (0, 1) for i in range(60) for e in (0.1,) if f == 0 or i < 30], "frame_id long, id long, x double, y double, z double")
    image = ring.project(points, columns=120, frame="frame_id")
    assert {r.frame_id: r["count"] for r in image.groupBy("frame_id").count().collect()} == {0: 60, 1: 30}
    alone = {f: ring.segments(ring.project(points.where(F.col("frame_id") == f).drop("frame_id"), columns=120), columns=120, angle=0.2, least=4) for f in (0, 1)}
    both = ring.segments(image, columns=120, angle=0.2, least=4, frame="frame_id")
    for f, one in alone.items():
        assert sorted(map(tuple, both.where(F.col("frame_id") == f).drop("frame_id").collect())) == sorted(map(tuple, one.collect()))


def test_features_lie_in_their_frames(spark):
    points = spark.createDataFrame([(f, 10_000 * f + i, *at(5.0 + (i % 17 == 0) + 0.01 * (i % 7), i, 0.1)) for f in (0, 1, 2) for i in range(360)], "frame_id long, id long, x double, y double, z double")
    rows = programs.scan_features(points, programs.Scan(columns=360), block=60).collect()
    assert {r.type for r in rows} == {1, 2} and all(r.id // 10_000 == r.frame_id for r in rows)
