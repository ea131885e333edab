"""Joins on a key of which one value may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of the rows on (so no more than so many keys can be), but not below LEAST_HEAVY rows.
SHARES, LEAST_HEAVY = 1_000, 1_000


def join_one(many: DataFrame, one: DataFrame, key: str, rows: int, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has at most one narrow row for each value of ``key``.

    Rows of heavy keys stay where they are: the rows of ``one`` for these keys, SHARES at
    most, are broadcast. All other rows meet in a shuffle in which no key is large.
    ``rows`` is the number of rows of ``many`` or more; ``counts`` has (key, n) of ``many``
    where the caller has it anyway. Null keys join with nothing.
    """
    if rows <= LEAST_HEAVY:
        return many.join(one, key)
    if counts is None:
        counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    heavy = F.broadcast(counts.where(F.col("n") > max(LEAST_HEAVY, rows // SHARES)).select(key))
    columns = [key, *(c for c in many.columns if c != key), *(c for c in one.columns if c != key)]
    split = many.join(F.broadcast(one.join(heavy, key)), key)
    whole = many.join(heavy, key, "left_anti").join(one, key)
    return split.select(columns).union(whole.select(columns))
