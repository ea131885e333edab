"""Filters over point tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.operators.nearest import knn
from cloudframe.operators.neighbors import XYZ, meet, neighbour_counts
from cloudframe.sources.shared import drop_table, write_table


def without_ids(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select("id"), "id", "left_anti")


def only_ids(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select("id"), "id", "left_semi")


def pass_through(points: DataFrame, column: str = "z", low: float = -0.3, high: float = 5.0) -> DataFrame:
    return points.where(F.col(column).between(low, high))


def inside_box(low: Sequence[float], high: Sequence[float], grow: float = 0.0) -> Column:
    tests = [F.col(c).between(a - grow, b + grow) for c, a, b in zip(XYZ, low, high, strict=True)]
    return tests[0] & tests[1] & tests[2]


def in_boxes(points: DataFrame, boxes: DataFrame, grow: float = 0.3, most: int = 256) -> DataFrame:
    """Ids of points in any box (box columns min_x .. max_z), each box grown on all sides.

    Up to ``most`` boxes are sent to all tasks; more meet the points in cells of the widest box.
    """
    tests = [(F.col(c) >= F.col(f"min_{c}") - grow) & (F.col(c) <= F.col(f"max_{c}") + grow) for c in XYZ]
    inside = tests[0] & tests[1] & tests[2]
    if boxes.count() <= most:
        return points.join(F.broadcast(boxes), inside).select("id").distinct()
    width = boxes.agg(F.max(F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ]))).first()[0] + 2 * grow
    centres = boxes.select(F.monotonically_increasing_id().alias("id"), *[((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(c) for c in XYZ], *[f"{m}_{c}" for m in ("min", "max") for c in XYZ])
    near = meet(points, centres, width, keep=[f"{m}_{c}" for m in ("min", "max") for c in XYZ])
    for c in XYZ:
        near = near.where((F.col(c) >= F.col(f"nmin_{c}") - grow) & (F.col(c) <= F.col(f"nmax_{c}") + grow))
    return near.select("id").distinct()


def mark_outside(points: DataFrame, low: Sequence[float], high: Sequence[float], grow: float = 0.5, value: float = 150.0) -> DataFrame:
    return points.withColumn("intensity", F.when(inside_box(low, high, grow), F.col("intensity")).otherwise(F.lit(value)))


def range_gate(points: DataFrame, least: float) -> DataFrame:
    return points.where(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) >= least)


def statistical_outliers(points: DataFrame, k: int = 60, deviations: float = 1.0) -> DataFrame:
    """The points whose mean distance to their k nearest others is within ``deviations`` of the mean over all points."""
    near = knn(points, k + 1).where("id <> nid")
    means = near.groupBy("id").agg(F.avg("d").alias("mean_d"))
    limit = means.agg((F.avg("mean_d") + deviations * F.stddev_samp("mean_d")).alias("limit"))  # one row
    return only_ids(points, means.join(F.broadcast(limit)).where("mean_d <= limit"))


def radius_outliers(points: DataFrame, r: float = 0.3, least: int = 5) -> DataFrame:
    """(id, n) of the points with at least ``least`` neighbours within r, themselves not counted."""
    return neighbour_counts(points, r).select("id", (F.col("n") - 1).alias("n")).where(F.col("n") >= least)


def progressive_windows(window: float = 20.0, slope: float = 1.0, first: float = 1.0, most: float = 6.0, base: float = 2.0) -> list[tuple[float, float]]:
    """(half width, threshold) of each pass: windows of 2 base^k + 1 up to the first not below ``window``, thresholds that rise with the growth of the window."""
    out, width = [], 0.0
    while width < window:
        wider = 2 * base ** len(out) + 1
        out.append((wider / 2, min(most, slope * (wider - width) + first) if out else min(most, first)))
        width = wider
    return out


def _box_extremes(points: DataFrame, half: float, greatest: bool) -> DataFrame:
    """(id, x, y, z) with the least (or greatest) z of the points within ``half`` in x and y in place of z.

    Cells that lie wholly within the box of any point of a cell give it their minima, in a
    running pass along each axis. Of the cells that the box's edge crosses only points that
    lie beyond what these passes found are looked at, so a dense cell meets hardly any.
    Sides are powers of two, so cells and distances have no rounding between them.
    """
    side = 2.0 ** math.floor(math.log2(half / 2))
    inner, outer = math.floor(half / side) - 1, math.ceil(half / side)
    sign = -1.0 if greatest else 1.0
    placed = points.select("id", "x", "y", (F.col("z") * sign).alias("v"), *[F.floor(F.col(c) / side).alias(f"c{c}") for c in "xy"])
    cells = placed.groupBy("cx", "cy").agg(F.min("v").alias("low"))
    run = cells
    for c in ("cx", "cy"):
        run = run.withColumn(c, F.explode(F.sequence(F.col(c) - inner, F.col(c) + inner))).groupBy("cx", "cy").agg(F.min("low").alias("low"))
    held = cells.select("cx", "cy").join(run.withColumnRenamed("low", "sure"), ["cx", "cy"])
    steps = [(a, b) for a in range(-outer, outer + 1) for b in range(-outer, outer + 1) if max(abs(a), abs(b)) > inner]
    crossed = cells.withColumn("o", F.explode(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in steps]))).select(F.col("cx").alias("rx"), F.col("cy").alias("ry"), "low", (F.col("cx") + F.col("o")[0]).alias("cx"), (F.col("cy") + F.col("o")[1]).alias("cy"))
    open_pairs = crossed.join(held, ["cx", "cy"]).where("low < sure").select("rx", "ry", F.col("cx").alias("tx"), F.col("cy").alias("ty"), "sure")
    beyond = placed.join(open_pairs, (F.col("cx") == F.col("rx")) & (F.col("cy") == F.col("ry"))).where("v < sure").select(F.col("tx").alias("cx"), F.col("ty").alias("cy"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("v").alias("nv"))
    better = placed.join(beyond, ["cx", "cy"]).where((F.abs(F.col("x") - F.col("nx")) <= half) & (F.abs(F.col("y") - F.col("ny")) <= half)).groupBy("id").agg(F.min("nv").alias("nv"))
    return placed.join(held, ["cx", "cy"]).join(better, "id", "left").select("id", "x", "y", (F.least("sure", "nv") * sign).alias("z"))


def morphological_ground(points: DataFrame, passes: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """``points`` with is_ground. Each pass (half width of the window, threshold) keeps those less than the threshold above an opening (least, then greatest z over the window) of what is left.

    The default passes are those of ``progressive_windows``. What a pass keeps is written, so plans do not grow
    with the passes. Points without a place are no ground.
    """
    ground = write_table(points.select("id", "x", "y", "z").where("x is not null and y is not null and z is not null"), "ground")
    for half, most in progressive_windows() if passes is None else passes:
        eroded = write_table(_box_extremes(ground, half, False), "eroded")
        opened = _box_extremes(eroded, half, True).select("id", F.col("z").alias("w"))
        kept = write_table(ground.join(opened, "id").where(F.col("z") - F.col("w") < most).select("id", "x", "y", "z"), "ground")
        drop_table(eroded)
        drop_table(ground)
        ground = kept
    return points.join(ground.select("id", F.lit(True).alias("g")), "id", "left").withColumn("is_ground", F.coalesce("g", F.lit(False))).drop("g")
