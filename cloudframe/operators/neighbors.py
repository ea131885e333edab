"""Neighbourhood joins over grid cells: points meet only in the cells around them, never all with all."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.operators.balls import ball_sums

XYZ = ("x", "y", "z")
Predicate = Callable[[Column, Column, Column], Column]


def square(dims: Sequence[str], other: str = "n") -> Column:
    terms = [(F.col(c) - F.col(f"{other}{c}")) * (F.col(c) - F.col(f"{other}{c}")) for c in dims]
    return sum(terms[1:], terms[0])


def _cells(df: DataFrame, r: float, dims: Sequence[str]) -> list[Column]:
    return [F.floor(F.col(c) / r).alias(f"__{c}") for c in dims]


def meet(left: DataFrame, right: DataFrame, r: float, dims: Sequence[str] = XYZ, by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` in the cells around them: n<column> for id, dims and ``keep``.

    ``by``: further columns that must be equal on both sides.
    """
    columns = list(dict.fromkeys(["id", *dims, *keep]))
    right = right.select(*by, *[F.col(c).alias(f"n{c}") for c in columns])
    steps = F.array(*[F.array(*map(F.lit, o)) for o in product((-1, 0, 1), repeat=len(dims))])
    moved = right.withColumn("__o", F.explode(steps)).select("*", *[(F.floor(F.col(f"n{c}") / r) + F.col("__o")[i]).alias(f"__{c}") for i, c in enumerate(dims)]).drop("__o")
    return left.select("*", *_cells(left, r, dims)).join(moved, [*by, *[f"__{c}" for c in dims]]).drop(*[f"__{c}" for c in dims])


def radius_pairs(points: DataFrame, r: float, dims: Sequence[str] = XYZ, *, targets: DataFrame | None = None, predicate: Predicate | None = None, keep: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """(id, nid, d2) for all pairs nearer than r, a point with itself included. ``predicate(a, b, d2)`` gets the two points as structs."""
    near = meet(points, points if targets is None else targets, r, dims, by, keep).withColumn("d2", square(dims)).where(F.col("d2") < r * r)
    if predicate is not None:
        names = list(dict.fromkeys([*dims, *keep]))
        near = near.where(predicate(F.struct(*[F.col(c) for c in names]), F.struct(*[F.col(f"n{c}").alias(c) for c in names]), F.col("d2")))
    return near.select(*by, "id", "nid", "d2")


def neighbour_counts(points: DataFrame, r: float, dims: Sequence[str] = XYZ) -> DataFrame:
    """(id, n): how many points are nearer than r to each, itself included; pairs are not listed."""
    return ball_sums(points, r, dims).select("id", "n")


def nearest_target(sources: DataFrame, targets: DataFrame, within: float, by: Sequence[str] = ()) -> DataFrame:
    """(id, target_id, d): of targets nearer than ``within`` in x and y the nearest, ties to the smallest id; null without one."""
    best = radius_pairs(sources, within, ("x", "y"), targets=targets, by=by).groupBy("id").agg(F.min(F.struct("d2", "nid")).alias("b"))
    return sources.select("id").join(best, "id", "left").select("id", F.col("b.nid").alias("target_id"), F.sqrt("b.d2").alias("d"))
