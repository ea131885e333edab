"""Point, pose and detection tables taken from the driver's Parquet tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def points_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [(10 * F.col("embedding")[i].cast("double")).alias(c) for i, c in enumerate("xyz")]
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *e, F.col("label").cast("double").alias("intensity"))


def points_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), _k().alias("y"), F.lit(0.0).alias("z"))


def points_keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    # adding 0.0 turns -0.0 into 0.0
    return _read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (100 * F.col("l_discount") + 0.0).alias("y"), (100 * F.col("l_tax") + 0.0).alias("z"), F.col("l_extendedprice").alias("intensity"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("frame_id"), F.col("event_id").alias("id"), F.col("value").alias("x"), _k().alias("y"), F.lit(0.0).alias("z"))


def _seconds() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event but views: a pose of its user at its time."""
    e = _read(spark, sf_dir, "events").where("event_type <> 'view'")
    zero = F.lit(0.0)
    return e.select(F.col("user_id").alias("traj_id"), _seconds().alias("t"), F.col("value").alias("x"), _k().alias("y"), zero.alias("z"), zero.alias("roll"), zero.alias("pitch"), F.radians(_k() - 50).alias("yaw"))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three angles of each event, between the ends of their ranges."""
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ((_k() - 50) / 20).alias("roll"), ((_k() - 40) / 50).alias("pitch"), ((60 - _k()) / 25).alias("yaw"))


def scan_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("traj_id"), _seconds().alias("t"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection a frame and user, in the order of time."""
    from pyspark.sql import Window

    e = _read(spark, sf_dir, "events")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("seq_id"), frame.alias("frame"), F.col("event_id").alias("det_id"), F.col("value").alias("x"), _k().alias("y"))


_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
#: The same tables as common table expressions for DuckDB.
SQL = {
    "points_small": "SELECT vec_id AS id, 10 * CAST(embedding[1] AS DOUBLE) AS x, 10 * CAST(embedding[2] AS DOUBLE) AS y, 10 * CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS DOUBLE) AS intensity FROM embeddings",
    "points_large": f"SELECT event_id AS id, value AS x, {_K} AS y, CAST(0 AS DOUBLE) AS z FROM events",
    "points_keyless": "SELECT l_quantity AS x, 100 * l_discount + CAST(0 AS DOUBLE) AS y, 100 * l_tax + CAST(0 AS DOUBLE) AS z, l_extendedprice AS intensity FROM lineitem",
    "frames": f"SELECT user_id AS frame_id, event_id AS id, value AS x, {_K} AS y, CAST(0 AS DOUBLE) AS z FROM events",
    "poses": f"SELECT user_id AS traj_id, epoch_us(ts) / CAST(1e6 AS DOUBLE) AS t, value AS x, {_K} AS y, CAST(0 AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS roll, CAST(0 AS DOUBLE) AS pitch, radians({_K} - 50) AS yaw FROM events WHERE event_type <> 'view'",
    "angles": f"SELECT event_id AS id, ({_K} - 50) / 20 AS roll, ({_K} - 40) / 50 AS pitch, (60 - {_K}) / 25 AS yaw FROM events",
    "scan_times": "SELECT user_id AS traj_id, epoch_us(ts) / CAST(1e6 AS DOUBLE) AS t FROM events WHERE event_type = 'view'",
    "detections": f"SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, event_id AS det_id, value AS x, {_K} AS y FROM events",
}
