"""Connected components by alternating large-star and small-star steps.

Both steps need only the smallest neighbour of each node: an aggregation that combines
before it shuffles, and a join that leaves the edges of heavy nodes where they are, so a
node with very many neighbours is no hot group. The smallest neighbours and the outcome of
every step are written to the shared folder: steps on top of steps would repeat their plans,
of which the driver holds all. Nothing is gathered on the driver but the number of edges
and a checksum over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.operators.joins import join_one
from cloudframe.sources.shared import drop_table, write_table

MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """Each u's smallest v and its number of edges, as a table."""
    return write_table(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "components-least")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links each node's larger neighbours to its smallest one (or itself). Edges (u, v) have u > v."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = _least(edges.union(turned))
    joined = join_one(turned, least.select("u", "m"), "u", 2 * n, least)
    out = write_table(joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "components-large")
    drop_table(least)
    return out


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them. Edges (u, v) have u > v."""
    least = _least(edges)
    moved = join_one(edges, least.select("u", "m"), "u", n, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = write_table(least.select("u", F.col("m").alias("v")).union(moved).distinct(), "components")
    drop_table(least)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.lit(0))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (u, v) of longs touches; the component is its smallest node.

    Loops, repeated edges and edges in both directions are allowed; rows with a null end
    are left out; no edges give an empty table.
    """
    now = write_table(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        large = _large_star(now, state[0])
        drop_table(now)
        then = _small_star(large, state[0])
        drop_table(large)
        now, before, state = then, state, _state(then)
        if state == before:
            break
    else:
        raise RuntimeError(f"no stable components after {MOST_ROUNDS} rounds")
    heads = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads.select("node", F.col("node").alias("component")))
