"""Queries of the readers and writers: rows of the tables written in each layout, read back, and compared with the tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.functions.geometry import euler_to_quaternion
from cloudframe.operators import rotations, trajectory
from cloudframe.plans.oracles import COMPOSED, EVALUATED, ZERO, r, rs
from cloudframe.sources import captures, clouds, packets, text
from cloudframe.sources import tables as t
from cloudframe.sources.shared import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_query(sql: str):
    def put(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return put


def rounded(*columns: str, digits: int = 6) -> list:
    return [(F.round(c, digits) + 0.0).alias(c) for c in columns]


def _there_and_back(spark: SparkSession, rows: DataFrame, layout: str, digits: int | None = None, **options) -> DataFrame:
    path = _place(spark, layout)
    text.write_text(rows, path, text.LAYOUTS[layout], digits=digits)
    return text.read_text(spark, path, layout, **options)


@file_query(f"WITH p AS ({t.SQL['points_small']}) SELECT {rs('x', 'y', 'z', 'intensity')} FROM p")
def read_points(spark, sf_dir):
    return _there_and_back(spark, t.points_small(spark, sf_dir), "points").select(*rounded("x", "y", "z", "intensity"))


@file_query("SELECT round(value, 6) + CAST(0 AS DOUBLE) AS x, CAST(event_id % 50 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z, CAST(ascii(event_type) AS DOUBLE) AS intensity FROM events")
def read_xyz_scans(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"), F.lit(0.0).alias("z"), F.col("event_type").alias("token"))
    path = _place(spark, "xyz")
    text.write_text(rows, path, ("x", "y", "z", "token"), digits=None)
    return text.read_xyz(spark, path, pattern="*.txt").select(*rounded("x", "y", "z", "intensity"))


@file_query(f"WITH p AS ({t.SQL['points_small']}) SELECT {rs('x', 'y', 'z')}, CAST(id % 256 AS SMALLINT) AS r, CAST(id * 7 % 256 AS SMALLINT) AS g, CAST(id * 31 % 256 AS SMALLINT) AS b FROM p")
def read_points_rgb(spark, sf_dir):
    rows = t.points_small(spark, sf_dir).withColumns({"r": F.col("id") % 256, "g": F.col("id") * 7 % 256, "b": F.col("id") * 31 % 256})
    return _there_and_back(spark, rows, "points_rgb").select(*rounded("x", "y", "z"), "r", "g", "b")


@file_query(f"WITH p AS ({t.SQL['poses']}) SELECT {rs('t', 'x', 'y', 'z', 'roll', 'pitch', 'yaw')} FROM p")
def read_poses_rpy(spark, sf_dir):
    return _there_and_back(spark, t.poses(spark, sf_dir), "poses_rpy", 6).select(*rounded("t", "x", "y", "z", "roll", "pitch", "yaw"))


@file_query(f"WITH p AS ({t.SQL['poses']}) SELECT {rs('t', 'x', 'y', 'z')}, {ZERO} AS qx, {ZERO} AS qy, {r('sin(yaw / 2)', 'qz')}, {r('cos(yaw / 2)', 'qw')} FROM p")
def read_poses_quaternion(spark, sf_dir):
    turn = dict(zip(("qw", "qx", "qy", "qz"), euler_to_quaternion(F.col("roll"), F.col("pitch"), F.col("yaw")), strict=True))
    return _there_and_back(spark, t.poses(spark, sf_dir).withColumns(turn), "poses_quaternion").select(*rounded("t", "x", "y", "z", "qx", "qy", "qz", "qw"))


@file_query(f"WITH p AS ({t.SQL['poses']}) SELECT CAST(floor(t) AS BIGINT) AS sec, CAST(round((t - floor(t)) * 1000000) AS BIGINT) AS usec, {r('x', 'tx')}, {r('y', 'ty')}, {ZERO} AS tz, {ZERO} AS qx, {ZERO} AS qy, {r('sin(yaw / 2)', 'qz')}, {r('cos(yaw / 2)', 'qw')} FROM p")
def read_poses_stamped(spark, sf_dir):
    second = F.floor("t").cast("long")
    more = {"sec": second, "usec": F.round((F.col("t") - second) * 1_000_000).cast("long"), "tx": F.col("x"), "ty": F.col("y"), "tz": F.col("z")} | dict(zip(("qw", "qx", "qy", "qz"), euler_to_quaternion(F.col("roll"), F.col("pitch"), F.col("yaw")), strict=True))
    return _there_and_back(spark, t.poses(spark, sf_dir).withColumns(more), "poses_stamped").select("sec", "usec", *rounded("tx", "ty", "tz", "qx", "qy", "qz", "qw"))


@file_query(f"WITH p AS ({t.SQL['scan_times']}) SELECT {rs('t')} FROM p")
def read_scan_times(spark, sf_dir):
    return _there_and_back(spark, t.scan_times(spark, sf_dir), "times").select(*rounded("t"))


@file_query("SELECT CAST(event_id AS VARCHAR) AS first, event_type AS second, 3 AS n FROM events")
def read_matrix(spark, sf_dir):
    path = _place(spark, "matrix")
    text.write_text(spark.read.parquet(f"{sf_dir}/events.parquet"), path, ("event_id", "event_type", "user_id"), digits=None, separator=",")
    return text.read_matrix(spark, path).select(F.get("fields", F.lit(0)).alias("first"), F.get("fields", F.lit(1)).alias("second"), F.size("fields").alias("n"))


@file_query(f"WITH p AS ({t.SQL['poses']}) SELECT {rs('t')}, {r('x', 'v0')}, {r('y', 'v1')}, {r('yaw', 'v2')} FROM p")
def curve_file(spark, sf_dir):
    path = _place(spark, "curve")
    text.write_curve(t.poses(spark, sf_dir).select("t", F.array("x", "y", "yaw").alias("values")), path)
    return text.read_curve(spark, path).select(*rounded("t"), *[(F.round(F.get("values", F.lit(i)), 6) + 0.0).alias(f"v{i}") for i in range(3)])


@file_query(f"WITH p AS ({t.SQL['poses']}) SELECT {r('t', 't0')}, {r('t + 1', 't1')}, {r('x', 'v0')}, {r('y', 'v1')} FROM p")
def two_time_curve_file(spark, sf_dir):
    path = _place(spark, "curve")
    text.write_text(t.poses(spark, sf_dir).withColumn("t1", F.col("t") + 1), path, ("t", "t1", "x", "y"), digits=None, separator=",")
    return text.read_curve(spark, path, times=2).select(*rounded("t0", "t1"), *[(F.round(F.get("values", F.lit(i)), 6) + 0.0).alias(f"v{i}") for i in range(2)])


@file_query(f"WITH f AS ({t.SQL['frames']}) SELECT row_number() OVER (PARTITION BY frame_id ORDER BY id) - 1 AS id, {rs('x', 'y', 'z')}, CAST(frame_id AS DOUBLE) AS intensity FROM f")
def cloud_files(spark, sf_dir):
    path = _place(spark, "clouds")
    packets.write_clouds(t.frames(spark, sf_dir).withColumn("intensity", F.col("frame_id").cast("double")), path)
    found = packets.read_clouds(spark, path, pattern="*.txt")
    return found.select("id", *rounded("x", "y", "z", "intensity"))


@file_query(f"WITH f AS ({t.SQL['frames']}) SELECT CAST(frame_id AS VARCHAR) AS frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY id) - 1 AS id, {rs('x', 'y', 'z')}, {r('id / 4.0', 'intensity')} FROM f")
def binary_cloud_files(spark, sf_dir):
    path = _place(spark, "binary-clouds")
    clouds.write_binary_clouds(t.frames(spark, sf_dir).withColumn("intensity", F.col("id") / 4), path)
    return clouds.read_binary_clouds(spark, path, split_bytes=4096).select("frame_id", "id", *rounded("x", "y", "z", "intensity"))


def _event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), said.alias("payload"))


@file_query("SELECT event_id, epoch_us(ts) AS ts_us, strlen(concat_ws('|', CAST(event_id AS VARCHAR), event_type, props)) AS length, concat_ws('|', CAST(event_id AS VARCHAR), event_type, props) AS said FROM events")
def capture_packets(spark, sf_dir):
    path = _place(spark, "captures")
    captures.write_captures(_event_packets(spark, sf_dir), path)
    said = F.col("payload").cast("string")
    return captures.read_capture_ranges(spark, path, split_bytes=10_000).select(F.split_part(said, F.lit("|"), F.lit(1)).cast("long").alias("event_id"), "ts_us", "length", said.alias("said"))


@file_query("SELECT row_number() OVER (ORDER BY ts, concat_ws('|', CAST(event_id AS VARCHAR), event_type, props)) - 1 AS number, event_id FROM events")
def capture_numbers(spark, sf_dir):
    """The packets' numbers over all files, each going on where the one before ends."""
    path = _place(spark, "captures")
    captures.write_captures(_event_packets(spark, sf_dir), path)
    numbered = captures.with_numbers(captures.read_capture_ranges(spark, path, split_bytes=10_000), whole=True)
    return numbered.select("number", F.split_part(F.col("payload").cast("string"), F.lit("|"), F.lit(1)).cast("long").alias("event_id"))


@file_query(f"SELECT event_id // 384 AS packet, CAST(event_id % 384 // 32 AS INTEGER) AS block, CAST(event_id % 32 AS INTEGER) AS laser, {r('event_id // 384 % 360 * 1.0', 'azimuth')}, {r('CAST(floor(value) AS INTEGER) % 60000 * 0.002', 'distance', 4)}, CAST(event_id % 256 AS INTEGER) AS intensity, event_id // 384 AS gps FROM events")
def scanner_returns(spark, sf_dir):
    """Values of events as a scanner's returns, 384 a packet, put into captures and decoded again."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    returns = events.select(F.floor(F.col("event_id") / 384).alias("packet"), (F.col("event_id") % 384).cast("int").alias("place"), (F.floor("value") % 60_000).cast("int").alias("raw"), (F.col("event_id") % 256).cast("int").alias("intensity"))
    path = _place(spark, "captures")
    captures.write_captures(packets.encode(returns.withColumn("azimuth", (F.col("packet") % 360 * 100).cast("int"))), path)
    found = packets.decode(captures.with_numbers(captures.read_capture_ranges(spark, path, split_bytes=20_000)))
    return found.join(events.select(F.col("event_id")), F.col("event_id") == F.col("gps") * 384 + F.col("block") * 32 + F.col("laser"), "left_semi").select(F.col("gps").alias("packet"), "block", "laser", *rounded("azimuth"), *rounded("distance", digits=4), "intensity", "gps")


@file_query(EVALUATED)
def curve_evaluation_file(spark, sf_dir):
    knots = t.poses(spark, sf_dir)
    path = _place(spark, "evaluation")
    text.write_evaluation(rotations.curve_evaluation(knots, trajectory.sample_times(knots, 6)), path)
    # six digits are written; rounded a little aside of what they leave in the middle
    digits = {"px": 3, "py": 3, "rw": 4, "rz": 4, "vx": 3, "vy": 3, "wz": 4}
    return text.read_evaluation(spark, path).select("traj_id", *rounded("t", digits=3), *[(F.round(F.col(c) + 1e-7, d) + 0.0).alias(c) for c, d in digits.items()])


@file_query(COMPOSED)
def composition_folded(spark, sf_dir):
    """A composed curve that is extended, folded, saved and read back: its base then holds the corrected places itself."""
    knots = rotations.with_turns(t.poses(spark, sf_dir)).select("traj_id", "t", *rotations.STAND)
    even = F.floor("t") % 2 == 0
    correction = knots.groupBy("traj_id").agg(F.array(F.struct(F.min("t").alias("t"), F.lit(0.5).alias("x")), F.struct((F.max("t") + 1).alias("t"), F.lit(0.5).alias("x"))).alias("k"))
    correction = correction.select("traj_id", F.explode("k").alias("k")).select("traj_id", "k.t", "k.x", F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(math.cos(0.05)).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(math.sin(0.05)).alias("qz"))
    base, correction = rotations.extend_composition(knots.where(even), correction, knots.where(~even))
    folded, still = rotations.fold_corrections(base, correction)
    path = _place(spark, "composition")
    text.write_composition(folded, still, folded, path)
    fields = ["traj_id", "t", *rotations.STAND]
    found = spark.read.schema(", ".join(f"{c} double" for c in fields)).csv(f"{path}/composition")
    return found.select(F.col("traj_id").cast("long").alias("traj_id"), *rounded(*fields[1:], digits=5))


@file_query(f"WITH p AS ({t.SQL['poses']}) SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY t, x, y) - 1 AS i, count(*) OVER (PARTITION BY traj_id) AS n, {rs('x', 'y')}, {r('x', 'at_x')}, {r('y', 'at_y')} FROM p")
def control_point_files(spark, sf_dir):
    """Control points of closed splines and the points they are from, out and in again; the curve of the controls read meets the points read."""
    points = t.poses(spark, sf_dir).select("traj_id", "t", "x", "y")
    path = _place(spark, "controls")
    text.write_control_points(trajectory.closed_bspline(points), points, path)
    found = text.read_control_points(spark, path).withColumn("traj_id", F.col("traj_id").cast("long"))
    # a control point counts 4/6 at its own knot and 1/6 at those beside it
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6))]))
    moved = found.where("kind = 'control'").withColumn("s", steps).withColumn("i", F.pmod(F.col("i") + F.col("s.k"), F.col("n")))
    curve = moved.select("traj_id", "i", "n", *[F.lit(None).cast("double").alias(c) for c in "xy"], *[(F.col("s.w") * F.col(c)).alias(f"at_{c}") for c in "xy"])
    given = found.where("kind = 'point'").select("traj_id", "i", "n", "x", "y", *[F.lit(None).cast("double").alias(f"at_{c}") for c in "xy"])
    return curve.unionByName(given).groupBy("traj_id", "i", "n").agg(*[F.sum(c).alias(c) for c in ("x", "y", "at_x", "at_y")]).select("traj_id", "i", "n", *rounded("x", "y", "at_x", "at_y"))
