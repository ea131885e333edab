"""Voxel grids, boxes and moments: aggregations that combine before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.operators.joins import join_one
from cloudframe.operators.neighbors import XYZ, meet, square


def cell(column: str, leaf: float) -> Column:
    return F.floor(F.col(column) / leaf).cast("long")


def voxel_downsample(points: DataFrame, leaf: float = 0.2, fields: Sequence[str] = XYZ) -> DataFrame:
    """One row per occupied voxel: its cell, the number of points and the mean of all fields."""
    return points.groupBy(*[cell(c, leaf).alias(f"v{c}") for c in XYZ]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in fields])


def voxel_blocks(points: DataFrame, leaf: float = 3.0, least: int = 20) -> DataFrame:
    """Voxels with at least ``least`` points: cell, count, centre, and a colour that depends on the cell only."""
    blocks = points.groupBy(*[cell(c, leaf).alias(f"v{c}") for c in XYZ]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    centres = {f"c{c}": (F.col(f"v{c}") + 0.5) * leaf for c in XYZ}
    return blocks.withColumns({**centres, "colour": F.pmod(F.xxhash64("vx", "vy", "vz"), F.lit(1 << 24)).cast("int")})


def voxel_points(points: DataFrame, leaf: float = 3.0, least: int = 20) -> DataFrame:
    """``points`` of the voxels with at least ``least`` of them, with their cell: the members of ``voxel_blocks`` as rows, so a full voxel is no long list. Points of heavy voxels stay where they are."""
    placed = points.where(" and ".join(f"{c} is not null" for c in XYZ)).withColumn("__v", F.struct(*[cell(c, leaf).alias(f"v{c}") for c in XYZ]))
    counts = placed.groupBy("__v").agg(F.count(F.lit(1)).alias("n"))
    return join_one(placed, counts.where(F.col("n") >= least).select("__v"), "__v", placed.count(), counts).select(*points.columns, "__v.*")


def boxes(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, centre and bounding box of each group."""
    sides = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sides)


def covariance_about(points: DataFrame, r: float) -> DataFrame:
    """Of each point's neighbours nearer than r (itself included): their number and the second moments about the point."""
    near = meet(points, points, r).where(square(XYZ) < r * r)
    offset = {c: F.col(f"n{c}") - F.col(c) for c in XYZ}
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(offset[a] * offset[b]).alias(f"c{a}{b}") for a, b in pairs])
