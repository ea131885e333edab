"""Region growing in the order of its seeds, as rounds over a written table instead of one queue.

The sequential rule: the flattest point without a region starts one. A point of the region
passes it on to those of its k nearest points whose normals differ little from its own and
that have no region yet; it does so only if its own curvature is below the limit, or if it
is the seed.

What that gives without a queue: let all points be ranked by (curvature, id). Points below
the limit pass regions on, so a region's points are all those its seed can reach, and of
the points that reach a point the first in rank is always the seed that takes it: had
another region taken that one before, it would have gone on to the point as well. So the
region of a point is the least rank that reaches it, which rounds of minima find; each
round also looks up how far the rank it has found has come itself, so long ways take few
rounds. Points above the limit that nobody reached come last. They pass a region on to
their neighbours only; each waits until those before it that could take it are decided.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.operators.cluster import rank_rows
from cloudframe.operators.nearest import knn
from cloudframe.operators.shape import normals
from cloudframe.sources.shared import drop_table, write_table

MOST_ROUNDS = 200


def _reached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, region): the least rank of a flat point that reaches each node, null without one. Edges (u, v) lead from flat nodes."""
    held = write_table(nodes.select("node", F.when(F.col("flat"), F.col("node")).alias("region")), "growing")
    for _ in range(MOST_ROUNDS):
        now = held.select("node", "region")
        of = now.withColumnRenamed("node", "u")
        come = edges.join(of, "u").where("region is not null").groupBy("v").agg(F.min("region").alias("come")).withColumnRenamed("v", "node")
        met = now.join(come, "node", "left").select("node", F.col("region").alias("before"), F.least("region", "come").alias("region"))
        further = now.select(F.col("node").alias("region"), F.col("region").alias("further"))
        then = write_table(met.join(further, "region", "left").select("node", "before", F.least("region", "further").alias("region")), "growing")
        changed = not then.where("not (before <=> region)").isEmpty()
        drop_table(held)
        held = then
        if not changed:
            return held.select("node", "region")
    raise RuntimeError(f"regions still grow after {MOST_ROUNDS} rounds")


def _taken(rest: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, region) of nodes in the order of their ranks: the first node before it with an edge to it that is a seed takes a node, else it is a seed."""
    edges = write_table(edges.where("u < v").join(rest.select(F.col("node").alias("u")), "u", "left_semi").join(rest.select(F.col("node").alias("v")), "v", "left_semi"), "growing-edges")
    now = write_table(rest.select("node", F.lit(None).cast("long").alias("region")), "growing-rest")
    for _ in range(MOST_ROUNDS):
        of = now.select(F.col("node").alias("u"), F.when(F.col("region") == F.col("node"), F.col("node")).alias("seed"), F.when(F.col("region").isNull(), F.col("node")).alias("open"))
        before = edges.join(of, "u").groupBy("v").agg(F.min("seed").alias("seed"), F.min("open").alias("open")).withColumnRenamed("v", "node")
        by_seed = F.col("seed").isNotNull() & (F.col("open").isNull() | (F.col("seed") < F.col("open")))
        own = F.col("seed").isNull() & F.col("open").isNull()
        then = write_table(now.join(before, "node", "left").select("node", F.coalesce("region", F.when(by_seed, F.col("seed")).when(own, F.col("node"))).alias("region")), "growing-rest")
        drop_table(now)
        now = then
        if now.where("region is null").isEmpty():
            return now
    raise RuntimeError(f"points are still undecided after {MOST_ROUNDS} rounds")


def grow_from_seeds(points: DataFrame, *, k: int = 50, k_normals: int = 15, most_degrees: float = 8.0, most_curvature: float = 0.2, least: int = 300, most: int = 8000) -> DataFrame:
    """(id, region, seed): regions of ``least`` to ``most`` points, numbered from 1 in the order of their seeds' curvature, and the seed's id.

    Points whose normal or curvature is not known have no region. Curvatures are compared
    after rounding to 12 digits, ties go to the smaller id.
    """
    up = normals(points, k_normals).where("curvature is not null and nx is not null").select("id", "nx", "ny", "nz", F.round("curvature", 12).alias("curvature"))
    ranked = rank_rows(up.withColumn("key", F.struct("curvature", "id")), "key", "node")
    nodes = write_table(ranked.select("id", F.col("node").cast("long").alias("node"), "nx", "ny", "nz", (F.col("curvature") <= most_curvature).alias("flat")), "growing-nodes")
    near = knn(points, k).where("id <> nid").select("id", "nid")
    there = nodes.select(F.col("id").alias("nid"), F.col("node").alias("v"), *[F.col(f"n{c}").alias(f"m{c}") for c in "xyz"])
    dot = F.abs(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))
    alike = near.join(nodes.withColumnRenamed("node", "u"), "id").join(there, "nid").where(dot >= math.cos(math.radians(most_degrees)))
    edges = write_table(alike.select("u", "v", "flat"), "growing-edges")
    reached = _reached(nodes, edges.where("flat"))
    rest = _taken(reached.where("region is null"), edges)
    regions = write_table(reached.where("region is not null").unionByName(rest), "growing-regions")
    sizes = regions.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most)).select("region")
    numbers = rank_rows(sizes, "region", "number")
    seeds = nodes.select(F.col("node").alias("region"), F.col("id").alias("seed"))
    return regions.join(numbers, "region").join(seeds, "region").join(nodes.select("node", "id"), "node").select("id", F.col("number").cast("long").alias("region"), "seed")
