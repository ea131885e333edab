"""Counts and sums within a radius against all pairs: hot places, points on the border, far points, small tiles, other targets."""

import numpy as np
from pyspark.sql import functions as F

from cloudframe.operators import balls, cluster, neighbors


def test_counts_and_sums_equal_all_pairs(spark, monkeypatch):
    """No pairs are listed, whatever lies around a point."""
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(0, 1, (300, 3)), np.round(rng.uniform(-2, 2, (200, 3))), np.full((80, 3), 0.5), [[1e7] * 3]])
    points = spark.createDataFrame([(i, *map(float, q), float(i)) for i, q in enumerate(p)], "id long, x double, y double, z double, w double").repartition(3)
    odd = points.unionByName(spark.createDataFrame([(-1, None, 0.0, 0.0, 1.0), (-2, float("nan"), 0.0, 0.0, 1.0)], points.schema))
    # the tasks get the values with the function
    monkeypatch.setattr(balls, "TILE", 64)
    monkeypatch.setattr(balls, "LEAF", 8)
    monkeypatch.setattr(balls, "GROUP", 3)
    monkeypatch.setattr(neighbors, "meet", None)
    near = ((p[:, None] - p[None]) ** 2).sum(2) < 1.0
    got = {r.id: r for r in balls.ball_sums(odd, 1.0, "xyz", sums=["w"]).collect()}
    assert set(got) == set(range(len(p)))
    assert all(got[i].n == near[i].sum() and got[i].w == np.flatnonzero(near[i]).sum() for i in got)
    assert {r.id: r.n for r in neighbors.neighbour_counts(odd, 1.0).collect()} == {i: r.n for i, r in got.items()}
    some = balls.ball_sums(odd, 1.0, "xyz", targets=points.where("id % 5 = 0")).collect()
    assert {r.id: r.n for r in some} == {i: n for i in range(len(p)) if (n := near[i, ::5].sum())}
    moved = {r.id: (r.x, r.y, r.z) for r in cluster.mean_shift(points, 1, 1.0, 5).collect()}
    assert all(np.allclose(moved[i], p[near[i]].mean(0) if near[i].sum() >= 5 else p[i]) for i in range(len(p)))
    assert balls.ball_sums(points.where(F.lit(False)), 1.0, "xyz").collect() == []
