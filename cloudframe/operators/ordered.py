"""Long sequences: rows numbered by ranges, band systems in overlapping blocks, and state carried through sorted batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.sources.shared import write_table

#: knots of a block at least (a block has less than twice as many), and knots of its neighbours on each side
BLOCK, HALO = 4096, 64


def numbered(rows: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with i, their place from 0 in the order of their sequence, and n, its length. Ranges are counted, so no sequence is one task's work."""
    placed = write_table(rows.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = placed.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    parts = Window.partitionBy(by)
    before = F.sum("__n").over(parts.orderBy("__part")) - F.col("__n")
    sizes = counts.select(F.col(by).alias("__by"), F.col("__part").alias("__at"), before.alias("__before"), F.sum("__n").over(parts).alias("n"))
    ranked = placed.withColumn("__i", F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order)) - 1)
    both = ranked.join(sizes, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__at")))
    return both.select(*rows.columns, (F.col("__before") + F.col("__i")).cast("long").alias("i"), "n")


def _ranged(rows: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """``rows`` dealt to tasks by ranges of (by, order) and written, with the number of their range. Only one sequence of a range can have begun before it."""
    return write_table(rows.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()), "ranged")


def beside(rows: DataFrame, by: str, order: Sequence[str], fields: Sequence[str], before: int = 0, after: int = 0) -> DataFrame:
    """``rows`` with the fields of the rows before and after them in their sequence: <field>_m1, <field>_m2, ... and <field>_p1, <field>_p2, ...; null beyond its ends.

    Ranges look at their own rows. What lies beyond their borders comes from a table of the
    first and last rows of each range in sequences that cross a border, no more than four
    times ``before`` + ``after`` for a range, whatever the input; so no sequence is one task's work.
    """
    most = max(before, after)
    own = Window.partitionBy("__part", by)
    # rows that tie have an order of their own, the same in each use
    placed = _ranged(rows.withColumn("__tie", F.xxhash64(*rows.columns)), by, [*order, "__tie"])
    up = own.orderBy(*order, "__tie")
    point = F.struct(*fields)
    steps = [("m", k, F.lag) for k in range(1, before + 1)] + [("p", k, F.lead) for k in range(1, after + 1)]
    counted = placed.withColumns({"__n": F.row_number().over(up), "__all": F.count(F.lit(1)).over(own)})
    inner = counted.withColumns({f"__{m}{k}": f(point, k).over(up) for m, k, f in steps})
    # sequences of more than one range: at most two of them touch a range
    crossing = placed.groupBy(by).agg(F.min("__part").alias("__a"), F.max("__part").alias("__b")).where("__a < __b").select(by)
    edges = counted.where((F.col("__n") <= most) | (F.col("__n") > F.col("__all") - most)).join(F.broadcast(crossing), by, "left_semi")
    along = Window.partitionBy(by).orderBy("__part", "__n")
    outer = edges.select(F.col(by).alias("__by"), F.col("__part").alias("__at"), F.col("__n").alias("__i"), *[f(point, k).over(along).alias(f"__o{m}{k}") for m, k, f in steps])
    both = inner.join(F.broadcast(outer), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__at")) & (F.col("__n") == F.col("__i")), "left")
    found = {f"{m}{k}": F.when(F.col("__n") <= k, F.col(f"__om{k}")).otherwise(F.col(f"__m{k}")) if m == "m" else F.when(F.col("__n") > F.col("__all") - k, F.col(f"__op{k}")).otherwise(F.col(f"__p{k}")) for m, k, _ in steps}
    return both.select(*rows.columns, *[x[c].alias(f"{c}_{name}") for name, x in found.items() for c in fields])


def latest(rows: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """``rows`` with the last value so far in their sequence that is not null, their own included, in place of ``value``.

    Each range is gone through on its own; what comes from the ranges before is one row a
    range at most.
    """
    placed = _ranged(rows, by, order)
    so_far = Window.partitionBy("__part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = placed.groupBy(by, "__part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))
    ranges = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    come = ends.select(F.col(by).alias("__by"), F.col("__part").alias("__at"), F.last("__end", ignorenulls=True).over(ranges).alias("__come")).where("__come is not null")
    inner = placed.withColumn("__own", F.last(value, ignorenulls=True).over(so_far))
    both = inner.join(F.broadcast(come), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__at")), "left")
    return both.select(*[c for c in rows.columns if c != value], F.coalesce("__own", "__come").alias(value))


def in_blocks(rows: DataFrame, by: str, order: Sequence[str], closed: bool = False, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """``rows`` numbered and dealt to blocks of their sequence: i, n, block and own; a block also has ``halo`` rows (own false) of each neighbour.

    In a ``closed`` sequence the first and last block are neighbours; i then runs on below 0 and beyond n - 1.
    A sequence of one block has no such rows.
    """
    assert halo < block
    last = F.greatest(F.lit(1), F.floor(F.col("n") / block)) - 1
    place = numbered(rows, by, order).withColumn("__last", last).withColumn("__b", F.least(F.floor(F.col("i") / block), "__last"))
    own = F.struct(F.col("__b").alias("block"), F.col("i").alias("i"), F.lit(True).alias("own"))
    begin, end = F.col("__b") * block, F.when(F.col("__b") == F.col("__last"), F.col("n")).otherwise((F.col("__b") + 1) * block)
    many = F.col("__last") > 0
    down = F.when(many & (F.col("i") < begin + halo), F.when(F.col("__b") > 0, F.struct((F.col("__b") - 1).alias("block"), F.col("i").alias("i"), F.lit(False).alias("own"))))
    up = F.when(many & (F.col("i") >= end - halo), F.when(F.col("__b") < F.col("__last"), F.struct((F.col("__b") + 1).alias("block"), F.col("i").alias("i"), F.lit(False).alias("own"))))
    copies = [own, down, up]
    if closed:
        copies.append(F.when(many & (F.col("i") < halo), F.struct(F.col("__last").alias("block"), (F.col("i") + F.col("n")).alias("i"), F.lit(False).alias("own"))))
        copies.append(F.when(many & (F.col("i") >= F.col("n") - halo), F.struct(F.lit(0).cast("long").alias("block"), (F.col("i") - F.col("n")).alias("i"), F.lit(False).alias("own"))))
    dealt = place.withColumn("__c", F.explode(F.array_compact(F.array(*copies))))
    return dealt.select(*rows.columns, F.col("__c.i").alias("i"), "n", F.col("__c.block").alias("block"), F.col("__c.own").alias("own"))


def solve_tridiagonal(below: np.ndarray, diagonal: np.ndarray, above: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Thomas's elimination for a matrix with a dominant diagonal; below[0] and above[-1] are not read, right has a column or more."""
    n = len(diagonal)
    c, d = np.zeros(n), np.array(right, float)
    c[0], d[0] = above[0] / diagonal[0], d[0] / diagonal[0]
    for k in range(1, n):
        pivot = diagonal[k] - below[k] * c[k - 1]
        c[k] = above[k] / pivot
        d[k] = (d[k] - below[k] * d[k - 1]) / pivot
    for k in range(n - 2, -1, -1):
        d[k] -= c[k] * d[k + 1]
    return d


def solve_block_tridiagonal(below: np.ndarray, diagonal: np.ndarray, above: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for small square blocks (n, k, k); below[0] and above[-1] are not read, right is (n, k)."""
    n, k = right.shape
    c, d = np.zeros_like(above), np.zeros((n, k))
    for i in range(n):
        pivot, rest = diagonal[i], right[i]
        if i:
            pivot, rest = pivot - below[i] @ c[i - 1], rest - below[i] @ d[i - 1]
        both = np.linalg.solve(pivot, np.column_stack([above[i], rest]))
        c[i], d[i] = both[:, :k], both[:, k]
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] @ d[i + 1]
    return d


def carried(rows: DataFrame, by: str, order: Sequence[str], start: Callable[[Any], Any], schema: str) -> DataFrame:
    """Each sequence's rows in ``order``, sorted by Spark and read in batches; only the state goes from batch to batch.

    ``start(key)`` makes the state of a sequence: ``step(row)`` gets its values without the
    key and ``end()`` comes after the last one; both return rows of ``schema``.
    """
    others = [c for c in rows.columns if c != by]
    own = rows.select(by, *others)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        key, state = None, None
        for batch in batches:
            found: list[tuple] = []
            for at, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or at != key:
                    if state is not None:
                        found += state.end()
                    key, state = at, start(at)
                found += state.step(row)
            yield out(found)
        if state is not None:
            yield out(state.end())

    return own.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)
