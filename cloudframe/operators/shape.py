"""Local shape from second moments: normals, principal axes, oriented boxes. Moments are aggregations; only 3x3 eigenproblems run in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudframe.operators.cluster import euclidean_clusters
from cloudframe.operators.nearest import knn
from cloudframe.operators.neighbors import XYZ
from cloudframe.operators.voxels import cell, covariance_about

PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


#: a type instead of a string: the module is imported without a session
_AXES = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("vectors", T.ArrayType(T.ArrayType(T.DoubleType())))])


@F.pandas_udf(_AXES)
def eigen(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Eigenvalues of a symmetric matrix, greatest first, with unit vectors whose largest part is positive."""
    m = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]], float).transpose(2, 0, 1)
    value, vector = np.linalg.eigh(m)
    value, vector = value[:, ::-1], vector[:, :, ::-1].transpose(0, 2, 1)
    largest = np.take_along_axis(vector, np.abs(vector).argmax(2)[:, :, None], 2)
    return pd.DataFrame({"values": list(np.maximum(value, 0)), "vectors": [list(v) for v in vector * np.sign(largest)]})


def with_axes(moments: DataFrame) -> DataFrame:
    return moments.withColumn("e", eigen(*[F.col(f"c{p}") for p in PAIRS]))


def pca_features(points: DataFrame, r: float, least: int = 13, order: str = "desc") -> DataFrame:
    """(id, n, l1, l2, l3, linear, planar, scatter) of each point's neighbours nearer than r; nulls where they are fewer than ``least``.

    With ``order="asc"`` the eigenvalues are taken in ascending order.
    """
    axes = with_axes(covariance_about(points, r))
    at = (0, 1, 2) if order == "desc" else (2, 1, 0)
    l1, l2, l3 = (F.when(F.col("n") >= least, F.col("e.values")[i]) for i in at)
    s1, s2, s3 = (F.sqrt(v) for v in (l1, l2, l3))
    return axes.select("id", "n", l1.alias("l1"), l2.alias("l2"), l3.alias("l3"), F.try_divide(s1 - s2, s1).alias("linear"), F.try_divide(s2 - s3, s1).alias("planar"), F.try_divide(s3, s1).alias("scatter"))


def normals(points: DataFrame, k: int = 15) -> DataFrame:
    """(id, nx, ny, nz, curvature): the least axis of the k nearest points, turned to the origin."""
    near = knn(points, k).select("id", "nid")
    moved = near.join(points.select(F.col("id").alias("nid"), *XYZ), "nid")
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    means = moved.groupBy("id").agg(*[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])
    axes = with_axes(means).join(points.select("id", *XYZ), "id")
    n = [F.col("e.vectors")[2][i] for i in range(3)]
    side = F.when(n[0] * F.col("x") + n[1] * F.col("y") + n[2] * F.col("z") > 0, -1.0).otherwise(1.0)
    total = F.col("e.values")[0] + F.col("e.values")[1] + F.col("e.values")[2]
    return axes.select("id", *[(side * v).alias(f"n{c}") for v, c in zip(n, XYZ, strict=True)], F.coalesce(F.try_divide(F.col("e.values")[2], total), F.lit(0.0)).alias("curvature"))


def _moments(points: DataFrame, by: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in XYZ], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs])


def super_voxels(points: DataFrame, leaf: float = 3.0, least: int = 20, planar: float = 0.6) -> DataFrame:
    """Voxels with at least ``least`` points that lie in a plane: (vx, vy, vz, n, planar)."""
    keyed = points.select(*XYZ, *[cell(c, leaf).alias(f"v{c}") for c in XYZ])
    axes = with_axes(_moments(keyed, ["vx", "vy", "vz"]).where(F.col("n") >= least))
    s = [F.sqrt(F.col("e.values")[i]) for i in range(3)]
    return axes.select("vx", "vy", "vz", "n", F.try_divide(s[1] - s[2], s[0]).alias("planar")).where(F.col("planar") > planar)


def oriented_boxes(points: DataFrame, by: str) -> DataFrame:
    """Box of each group along its principal axes: (by, n, min_1..3, max_1..3) about its centre."""
    axes = with_axes(_moments(points, [by])).select(by, *[f"m{c}" for c in XYZ], "e")
    both = points.join(axes, by)
    along = [sum(((F.col(c) - F.col(f"m{c}")) * F.col("e.vectors")[k][i] for i, c in enumerate(XYZ) if i), (F.col("x") - F.col("mx")) * F.col("e.vectors")[k][0]) for k in range(3)]
    return both.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{n}_{k + 1}") for n, f in (("min", F.min), ("max", F.max)) for k, a in enumerate(along)])


def grow_regions(points: DataFrame, *, k: int = 15, tolerance: float = 1.0, most_degrees: float = 8.0, most_curvature: float = 0.2, least: int = 300, most: int = 8000) -> DataFrame:
    """(id, cluster): near points of low curvature whose normals differ little, joined into regions.

    Regions are components of a symmetric relation, so they do not depend on where growing starts.
    """
    up = normals(points, k).where(F.col("curvature") < most_curvature).select("id", *[F.col(f"n{c}").alias(f"up_{c}") for c in XYZ])
    smooth = points.select("id", *XYZ).join(up, "id")
    dot = lambda a, b: F.abs(sum((a[f"up_{c}"] * b[f"up_{c}"] for c in "yz"), a["up_x"] * b["up_x"]))
    limit = float(np.cos(np.radians(most_degrees)))
    return euclidean_clusters(smooth, tolerance, least, most, keep=("up_x", "up_y", "up_z"), predicate=lambda a, b, d2: dot(a, b) > limit)


def region_planes(points: DataFrame, regions: DataFrame, upright: float = 0.98) -> DataFrame:
    """(cluster, n, nx, ny, nz, offset, upright) of the least-squares plane through each region's points.

    The normal's largest part is positive; ``upright``: its x or y part is beyond the limit.
    """
    axes = with_axes(_moments(points.join(regions, "id"), ["cluster"]))
    normal = F.col("e.vectors")[2]
    offset = -sum((normal[i] * F.col(f"m{c}") for i, c in enumerate(XYZ) if i), normal[0] * F.col("mx"))
    stands = (F.abs(normal[0]) > upright) | (F.abs(normal[1]) > upright)
    return axes.select("cluster", "n", *[normal[i].alias(f"n{c}") for i, c in enumerate(XYZ)], offset.alias("offset"), stands.alias("upright"))
