"""Exact nearest neighbours over a balanced partition of space.

1. Points at one place are one spot, which keeps the k smallest ids at most.
2. Each axis is cut at its quantiles, so the places of cuts follow the points and one far
   point moves none of them. Spots are put in the order of the interleaved numbers of
   their stretches, dealt to tasks by ranges of that order, and every ``TILE`` of them in a
   row are a tile. Tiles are alike in size however the points lie.
3. Within its tile a spot finds k ids; the farthest is the radius of a ball that holds its
   true neighbours.
4. Only tiles whose boxes that ball reaches are searched as well. Balls meet boxes in
   cells of the same cuts, about one cell a tile; a tile that many balls reach is searched
   in several groups.
5. The best k of all searched tiles are the neighbours of the spot, and of every point there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.sources.shared import write_table

TILE, GROUP = 1024, 8192
#: Each axis is cut into so many stretches (a power of two).
BITS = 10


def _stretch(cuts: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """The number of each value's stretch, of 2^bits along the axis."""
    return np.searchsorted(cuts, values, side="right") >> (BITS - bits)


def _interleaved(numbers: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(numbers[0]), np.int64)
    for bit in range(BITS):
        for k, x in enumerate(numbers):
            out |= ((x >> bit) & 1).astype(np.int64) << (bit * len(numbers) + k)
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a[:, 0, None] - b[None, :, 0]) ** 2
    for c in range(1, a.shape[1]):
        out += (a[:, c, None] - b[None, :, c]) ** 2
    return out


def _radii(own: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The squared distance within which each spot finds k ids among those of its tile, infinite if there are fewer."""
    d2 = _squares(own, own)
    m = min(k, len(own))
    near = np.argpartition(d2, m - 1, axis=1)[:, :m]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d2, near, 1), axis=1, kind="stable"), 1)
    enough = np.cumsum(weights[near], axis=1) >= k
    first = np.argmax(enough, axis=1)
    out = np.take_along_axis(d2, np.take_along_axis(near, first[:, None], 1), 1)[:, 0]
    return np.where(enough.any(axis=1), out, np.inf)


def _cells(low: list[np.ndarray], high: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cells: every cell of each row's ranges."""
    spans = [h - a + 1 for a, h in zip(low, high, strict=True)]
    total = np.prod(np.array(spans), axis=0)
    row = np.repeat(np.arange(len(total)), total)
    rest = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    cell = np.zeros(len(row), np.int64)
    for a, s in zip(low, spans, strict=True):
        cell = (cell << bits) | (a[row] + rest % s[row])
        rest = rest // s[row]
    return row, cell


def knn(points: DataFrame, k: int, dims: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(id, nid, rank, d): the k nearest points of each point, itself among them, ties by id; all points if there are no more than k.

    Points without a place (null, not a number, infinite) have no neighbours and are none.
    """
    dims = list(dims)
    spark = points.sparkSession
    placed = points.select("id", *[(F.col(c).cast("double") + 0.0).alias(c) for c in dims])
    for c in dims:
        placed = placed.where(F.col(c).isNotNull() & (F.abs(c) < float("inf")))
    # Spark keeps no more than k rows of a spot in a task before it deals them out
    ranked = placed.withColumn("__r", F.row_number().over(Window.partitionBy(*dims).orderBy("id"))).where(F.col("__r") <= k)
    spots = write_table(ranked.groupBy(*dims).agg(F.array_sort(F.collect_list("id")).alias("ids")), "knn-spots")
    n = spots.count()
    if not n:
        return points.limit(0).select("id", F.col("id").alias("nid"), F.lit(1).alias("rank"), F.lit(0.0).alias("d"))
    cuts = [np.array(q) for q in spots.approxQuantile(dims, [i / (1 << BITS) for i in range(1, 1 << BITS)], 2.0**-BITS / 2)]

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        return pd.Series(_interleaved([_stretch(q, c.to_numpy(), BITS) for q, c in zip(cuts, columns, strict=True)]))

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(n // (8 * TILE), max(shuffles, n // 4_000_000)))
    dealt = spots.withColumn("__at", place(*dims)).repartitionByRange(parts, "__at", *dims).sortWithinPartitions("__at", *dims).select(*dims, "ids")
    schema = "tile long, " + ", ".join(f"{c} double" for c in dims) + ", ids array<long>, r2 double"

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, have = TaskContext.get().partitionId(), 0, [], 0

        def out(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            tile, number = (task << 32) + number, number + 1
            own = np.column_stack([rows[c].to_numpy() for c in dims])
            ids = rows["ids"].combine_chunks()
            weights = np.diff(ids.offsets.to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), tile)), *(rows[c].combine_chunks() for c in dims), ids, pa.array(_radii(own, weights, k))], names=["tile", *dims, "ids", "r2"])

        for b in batches:
            held, have = [*held, b], have + b.num_rows
            # a whole tile stays behind, so that the last one of a task is no smaller than the others
            while have >= 2 * TILE:
                rows = pa.Table.from_batches(held)
                yield out(rows.slice(0, TILE))
                held, have = rows.slice(TILE).to_batches(), have - TILE
        if have:
            yield out(pa.Table.from_batches(held))

    tiled = write_table(dealt.mapInArrow(tiles, schema), "knn-tiles")
    boxes = write_table(tiled.groupBy("tile").agg(*[f(c).alias(f"{m}_{c}") for c in dims for m, f in (("min", F.min), ("max", F.max))]), "knn-boxes")
    bits = min(BITS, max(0, (boxes.count().bit_length() + len(dims) - 1) // len(dims)))

    def in_cells(rows: DataFrame, low, high) -> DataFrame:
        """Each row once for every cell between ``low`` and ``high`` of its columns, with the first cell's numbers as <a>0, <a>1, ..."""
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = 4096
                for at in range(0, batch.num_rows, step):
                    b = batch.slice(at, step)
                    get = lambda c, b=b: b.column(names.index(c)).to_numpy()
                    a = [_stretch(q, low(get, c), bits).astype(np.int64) for q, c in zip(cuts, dims, strict=True)]
                    z = [_stretch(q, high(get, c), bits).astype(np.int64) for q, c in zip(cuts, dims, strict=True)]
                    row, cell = _cells(a, z, bits)
                    for cut in range(0, len(row), 1 << 18):
                        some = slice(cut, cut + (1 << 18))
                        taken = b.take(pa.array(row[some]))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell[some]), *(pa.array(x[row[some]]) for x in a)], names=[*names, "cell", *(f"from{i}" for i in range(len(dims)))])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        return rows.mapInArrow(run, f"{kinds}, cell long, " + ", ".join(f"from{i} long" for i in range(len(dims))))

    balls = in_cells(tiled.select(F.col("ids")[0].alias("spot"), F.col("tile").alias("home"), *dims, "r2"), lambda get, c: get(c) - np.sqrt(get("r2")) * (1 + 1e-9), lambda get, c: get(c) + np.sqrt(get("r2")) * (1 + 1e-9))
    held = in_cells(boxes, lambda get, c: get(f"min_{c}"), lambda get, c: get(f"max_{c}"))
    firsts = [f"from{i}" for i in range(len(dims))]
    both = balls.join(held.withColumnsRenamed({f: f"box_{f}" for f in firsts}), "cell")
    gap = F.lit(0.0)
    for c in dims:
        out = F.greatest(F.col(f"min_{c}") - F.col(c), F.col(c) - F.col(f"max_{c}"), F.lit(0.0))
        gap = gap + out * out
    # a ball and a box that share several cells meet in the first one
    first = F.lit(0).cast("long")
    for f in firsts:
        first = F.shiftleft(first, bits).bitwiseOR(F.greatest(F.col(f), F.col(f"box_{f}")))
    visits = both.where((F.col("cell") == first) & (gap <= F.col("r2") * (1 + 1e-12))).select("tile", "spot", *dims, "r2")
    visits = write_table(visits, "knn-visits")
    groups = visits.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    left = visits.join(groups, "tile").withColumn("group", F.pmod(F.xxhash64("spot"), F.col("groups"))).drop("groups")
    right = tiled.select("tile", *dims, "ids").join(groups, "tile").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")

    def search(visitors: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        there, ids = own[dims].to_numpy(float), own["ids"].tolist()
        found: list[tuple] = []
        for at in range(0, len(visitors), 1024):
            some = visitors.iloc[at : at + 1024]
            d2 = _squares(some[dims].to_numpy(float), there)
            m = min(k, len(there))
            near = np.argpartition(d2, m - 1, axis=1)[:, :m]
            # all spots as near as the m-th one: ids decide between them
            most = np.minimum(np.take_along_axis(d2, near, 1).max(axis=1), some["r2"].to_numpy())
            rows, columns = np.nonzero(d2 <= most[:, None])
            values = d2[rows, columns]
            spot = some["spot"].to_numpy()
            each = [len(ids[j]) for j in columns]
            found.append((np.repeat(spot[rows], each), list(chain.from_iterable(ids[j] for j in columns)), np.repeat(values, each)))
        columns = list(zip(*found, strict=True))
        if not columns:
            return pd.DataFrame({"spot": [], "nid": [], "d2": []})
        return pd.DataFrame({"spot": np.concatenate(columns[0]), "nid": list(chain.from_iterable(columns[1])), "d2": np.concatenate(columns[2])})

    found = left.groupBy("tile", "group").cogroup(right.groupBy("tile", "group")).applyInPandas(search, "spot long, nid long, d2 double")
    order = Window.partitionBy("spot").orderBy("d2", "nid")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near = best.groupBy("spot").agg(F.collect_list(F.struct("rank", "nid", F.sqrt("d2").alias("d"))).alias("near"))
    at = tiled.select(F.col("ids")[0].alias("spot"), *dims).join(near, "spot").drop("spot")
    return placed.join(at, dims).select("id", F.explode("near").alias("n")).select("id", "n.nid", "n.rank", "n.d")
