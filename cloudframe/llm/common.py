"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.sources.shared import drop_table, shared_dir, write_table

__all__ = ["broadcast_if_small", "drop_table", "fresh", "let_go", "shared_dir", "small_batches", "table", "text_or_empty", "write_table"]

_LIBC = ctypes.CDLL(None)
#: Texts may be long: so many rows at most go to Python at a time.
BATCH_ROWS = 1024
#: What operators remember from task to task, with how to forget it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast a table whose measured row count is within ``limit``; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let_go(*caches: dict, keep: str = "") -> None:
    """Empty a task's caches and give unused memory back: workers live on, and the next stage needs the room.

    What is remembered from task to task goes too, but for ``keep``.
    """
    for name, forget in REMEMBERED.items():
        if name != keep:
            forget()
    for cache in caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session set to send at most BATCH_ROWS rows to Python at a time, which bounds memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df
