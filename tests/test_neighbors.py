"""k nearest points against all pairs: ties, repeated places, hot places, far points and small tiles."""

import numpy as np
import pytest

from cloudframe.operators import nearest
from cloudframe.operators.nearest import knn


@pytest.mark.parametrize("far", (8.0, 1e9))
def test_far_points_are_not_left_out(spark, far):
    rows = [(0, 0.0, 0.0, 0.0), (1, 0.5, 0.0, 0.0), (2, 0.0, 0.7, 0.0), (3, far, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {(r.id, r["rank"]): r.nid for r in knn(points, 3).collect()}
    assert got == {(0, 1): 0, (0, 2): 1, (0, 3): 2, (1, 1): 1, (1, 2): 0, (1, 3): 2, (2, 1): 2, (2, 2): 0, (2, 3): 1, (3, 1): 3, (3, 2): 1, (3, 3): 0 if far > 0 else 2}


def plain(ids, p, k):
    out = set()
    for i, own in zip(ids, p, strict=True):
        d2 = sum((own[c] - p[:, c]) ** 2 for c in range(p.shape[1]))
        for rank, j in enumerate(sorted(range(len(ids)), key=lambda j: (d2[j], ids[j]))[:k], 1):
            out.add((i, ids[j], rank, float(np.sqrt(d2[j]))))
    return out


def found(df):
    rows = [(r.id, r.nid, r["rank"], r.d) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("dims", "k", "tile"), [(3, 6, 16), (2, 1, 16), (2, 40, 16), (1, 5, 32), (3, 15, 1024)])
def test_equals_all_pairs(spark, dims, k, tile, monkeypatch):
    """Clusters of different density, a lattice of ties, a place with many points and a far point; tiles so small that balls cross many."""
    rng = np.random.default_rng(dims)
    p = np.concatenate([rng.normal(0, 1, (300, dims)), rng.normal(20, 0.01, (150, dims)), np.round(rng.uniform(-3, 3, (150, dims))), np.full((120, dims), 1.5), [[1e7] * dims]])
    ids = [int(i) for i in rng.permutation(len(p)) * 3]
    # the tasks get the values with the function
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr(nearest, "GROUP", 50)
    rows = spark.createDataFrame([(i, *map(float, row)) for i, row in zip(ids, p, strict=True)], "id long, " + ", ".join(f"{c} double" for c in "xyz"[:dims])).repartition(3)
    assert found(knn(rows, k, "xyz"[:dims])) == plain(ids, p, k)


def test_few_points_and_points_without_a_place(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, -0.0, 1.0), (3, None, 0.0), (4, float("nan"), 0.0), (5, float("inf"), 0.0)], "id long, x double, y double")
    assert found(knn(rows, 7, "xy")) == {(1, 1, 1, 0.0), (1, 2, 2, 1.0), (2, 2, 1, 0.0), (2, 1, 2, 1.0)}
    assert knn(rows.limit(0), 3, "xy").collect() == []
    assert knn(rows.where("id = 3"), 3, "xy").collect() == []
