"""Counts and sums over all points nearer than a radius, without a list of pairs.

Points at one place are one spot. Spots in the order of their places (as in ``nearest``)
form tiles of alike sizes, and runs of ``LEAF`` spots of a tile have boxes of their own.
Two tiles whose boxes are near meet in one task: a leaf that lies wholly within the radius of
another one gives its totals, one that is out of reach nothing, and only leaves between the
two are compared spot by spot. A tile meets the others in groups of ``GROUP``, so memory is
bounded however many lie around it. The work still grows with the pairs on the borders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.operators.nearest import BITS, _interleaved, _stretch
from cloudframe.sources.shared import write_table

TILE, LEAF, GROUP = 4096, 64, 32
#: Boxes within this share of the radius are looked at spot by spot, as rounding may decide.
_SLACK = 1e-9


def _placed(points: DataFrame, dims: Sequence[str], more: Sequence[str]) -> DataFrame:
    rows = points.select("id", *[(F.col(c).cast("double") + 0.0).alias(c) for c in dims], *more)
    for c in dims:
        rows = rows.where(F.col(c).isNotNull() & (F.abs(c) < float("inf")))
    return rows


def _tiles(spots: DataFrame, dims: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """(tile, rows, low, high): a row per tile with its spots' columns one after the other and its box."""
    spark, columns, n = spots.sparkSession, [*dims, *sums], spots.count()
    cuts = [np.array(q) for q in spots.approxQuantile(list(dims), [i / (1 << BITS) for i in range(1, 1 << BITS)], 2.0**-BITS / 2)] if n else [np.array([])] * len(dims)

    @F.pandas_udf("long")
    def place(*own: pd.Series) -> pd.Series:
        return pd.Series(_interleaved([_stretch(q, c.to_numpy(), BITS) for q, c in zip(cuts, own, strict=True)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, have = TaskContext.get().partitionId(), 0, [], 0

        def out(rows: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            own = rows[:, : len(dims)]
            lists = [pa.array([x.ravel()], pa.list_(pa.float64())) for x in (rows, own.min(0), own.max(0))]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number]), *lists], names=["tile", "rows", "low", "high"])

        for b in batches:
            held, have = [*held, np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)], have + b.num_rows
            while have >= TILE:
                rows = np.concatenate(held)
                yield out(rows[:TILE])
                held, have = [rows[TILE:]], have - TILE
        if have:
            yield out(np.concatenate(held))

    parts = max(1, min(n // (4 * TILE), max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 4_000_000)))
    dealt = spots.withColumn("__at", place(*dims)).repartitionByRange(parts, "__at", *dims).sortWithinPartitions("__at", *dims).select(*columns)
    return write_table(dealt.mapInArrow(run, "tile long, rows array<double>, low array<double>, high array<double>"), "ball-tiles")


def _within(own: np.ndarray, others: np.ndarray, d: int, r: float) -> np.ndarray:
    """For each of ``own`` (its places) the totals of the columns after the places of ``others`` nearer than r."""
    out = np.zeros((len(own), others.shape[1] - d))
    leaves = np.arange(0, len(others), LEAF)
    low, high = np.minimum.reduceat(others[:, :d], leaves), np.maximum.reduceat(others[:, :d], leaves)
    totals = np.add.reduceat(others[:, d:], leaves)
    for at in range(0, len(own), LEAF):
        some = own[at : at + LEAF]
        a, b = some.min(0), some.max(0)
        gap = np.maximum(np.maximum(low - b, a - high), 0.0)
        far = np.maximum(high - a, b - low)
        inside = (far * far).sum(1) < r * r * (1 - _SLACK)
        if inside.any():
            out[at : at + LEAF] += totals[inside].sum(0)
        open_ = np.flatnonzero(~inside & ((gap * gap).sum(1) < r * r * (1 + _SLACK)))
        for k in range(0, len(open_), 64):
            there = np.concatenate([others[i * LEAF : (i + 1) * LEAF] for i in open_[k : k + 64]])
            d2 = some[:, 0, None] - there[None, :, 0]
            d2 *= d2
            for c in range(1, d):
                step = some[:, c, None] - there[None, :, c]
                step *= step
                d2 += step
            out[at : at + LEAF] += (d2 < r * r).astype(float) @ there[:, d:]
    return out


def ball_sums(points: DataFrame, r: float, dims: Sequence[str], *, targets: DataFrame | None = None, sums: Sequence[str] = ()) -> DataFrame:
    """(id, n, <sums>): for each point the number of targets nearer than r (the points themselves unless given) and the sums of their columns.

    Points without a place, and those without a target so near, are left out; a value of ``sums`` has to be finite.
    """
    dims, values = list(dims), [f"__s{k}" for k in range(len(sums))]
    placed = _placed(points, dims, ())
    of_spots = [F.count(F.lit(1)).cast("double").alias("__n"), *[F.sum(F.col(f"__v{k}")).alias(v) for k, v in enumerate(values)]]
    there = _placed(points if targets is None else targets, dims, [F.col(c).cast("double").alias(f"__v{k}") for k, c in enumerate(sums)])
    right = _tiles(write_table(there.groupBy(*dims).agg(*of_spots), "ball-spots"), dims, ["__n", *values])
    left = right if targets is None else _tiles(write_table(placed.select(*dims).distinct(), "ball-spots"), dims, [])
    d, width = len(dims), len(dims) + 1 + len(values)
    own_width = width if targets is None else d
    gap = F.lit(0.0)
    for k in range(d):
        step = F.greatest(F.col("blow")[k] - F.col("high")[k], F.col("low")[k] - F.col("bhigh")[k], F.lit(0.0))
        gap = gap + step * step
    boxes = right.select(F.col("tile").alias("other"), F.col("low").alias("blow"), F.col("high").alias("bhigh"))
    # boxes are a row for thousands of spots
    meet = left.select("tile", "low", "high").crossJoin(F.broadcast(boxes)).where(gap < r * r * (1 + _SLACK)).select("tile", "other")
    meet = write_table(meet, "ball-meetings")
    groups = meet.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    dealt = meet.join(groups, "tile").withColumn("group", F.pmod(F.xxhash64("other"), F.col("groups")))
    visits = dealt.join(right.select(F.col("tile").alias("other"), F.col("rows").alias("there")), "other").select("tile", "group", "there")
    homes = left.select("tile", "rows").join(groups, "tile").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select("tile", "group", "rows")

    def run(home: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if home.empty or others.empty:
            return pd.DataFrame({c: [] for c in (*dims, "__n", *values)})
        own = np.asarray(home["rows"].iloc[0], float).reshape(-1, own_width)[:, :d]
        found = sum(_within(own, np.asarray(o, float).reshape(-1, width), d, r) for o in others["there"])
        return pd.DataFrame(np.column_stack([own, found]), columns=[*dims, "__n", *values])[found[:, 0] > 0]

    schema = ", ".join(f"`{c}` double" for c in (*dims, "__n", *values))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a group is much work for few bytes, so they are not put together by size
    found = homes.repartition(tasks, "tile", "group").groupBy("tile", "group").cogroup(visits.repartition(tasks, "tile", "group").groupBy("tile", "group")).applyInPandas(run, schema)
    total = found.groupBy(*dims).agg(F.sum("__n").cast("long").alias("n"), *[F.sum(v).alias(v) for v in values])
    return placed.join(total, dims).select("id", "n", *[F.col(v).alias(c) for v, c in zip(values, sums, strict=True)])
