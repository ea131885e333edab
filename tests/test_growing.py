"""Seed-ordered growing against the queue it stands for, and the sampling policy against a plain list of knots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.operators import growing, rigid, rotations
from cloudframe.operators.nearest import knn
from cloudframe.operators.shape import normals


def plain(points, k, k_normals, degrees, limit):
    """One queue: the flattest point without a region starts one, which its flat points pass on."""
    up = {r.id: (np.array([r.nx, r.ny, r.nz]), round(r.curvature, 12)) for r in normals(points, k_normals).collect() if r.curvature is not None}
    near = {}
    for r in knn(points, k).collect():
        if r.id != r.nid:
            near.setdefault(r.id, []).append(r.nid)
    region = {}
    for seed in sorted(up, key=lambda i: (up[i][1], i)):
        if seed in region:
            continue
        region[seed], queue = seed, [seed]
        while queue:
            at = queue.pop(0)
            for other in near.get(at, []):
                if other in up and other not in region and abs(up[at][0] @ up[other][0]) >= np.cos(np.radians(degrees)):
                    region[other] = seed
                    if up[other][1] <= limit:
                        queue.append(other)
    return region


@pytest.mark.parametrize(("k", "degrees", "limit"), [(8, 30.0, 0.1), (12, 25.0, 0.12), (6, 40.0, 0.0), (10, 20.0, 1.0)])
def test_growing_equals_the_queue(spark, k, degrees, limit):
    rng = np.random.default_rng(k)
    a, b = rng.uniform(-2, 2, (2, 180))
    parts = [np.column_stack([a[:90], b[:90], 0.02 * rng.normal(size=90)]), np.column_stack([a[90:], 2 + 0.02 * rng.normal(size=90), np.abs(b[90:])]), rng.uniform(-3, 3, (120, 3))]
    p = np.concatenate(parts)
    points = spark.createDataFrame([(int(i), *map(float, row)) for i, row in zip(rng.permutation(len(p)), p, strict=True)], "id long, x double, y double, z double")
    want = plain(points, k, 8, degrees, limit)
    found = growing.grow_from_seeds(points, k=k, k_normals=8, most_degrees=degrees, most_curvature=limit, least=1, most=10_000).collect()
    assert {r.id: r.seed for r in found} == want
    order = [s for _, s in sorted({(r.region, r.seed) for r in found})]
    assert len(order) == len(set(want.values())) and [n for n, _ in sorted({(r.region, r.seed) for r in found})] == list(range(1, len(order) + 1))
    sizes = {s: list(want.values()).count(s) for s in set(want.values())}
    bounded = growing.grow_from_seeds(points, k=k, k_normals=8, most_degrees=degrees, most_curvature=limit, least=3, most=60).collect()
    assert {r.id for r in bounded} == {i for i, s in want.items() if 3 <= sizes[s] <= 60}


def test_sampling_keeps_and_replaces(spark):
    at = lambda t: rigid.exponential((1.0, 0.5 * np.sin(t), 0.1), (0.1, 0.0, 0.2), t)
    times = sorted({float(t) for t in np.round(np.cumsum(np.random.default_rng(4).uniform(0.1, 2, 60)), 3)})
    rows = spark.createDataFrame([(k, t, *map(float, at(t)[1]), *map(float, at(t)[0])) for k in (1, 2) for t in times[: 60 if k == 1 else 3]], "traj_id long, t double, x double, y double, z double, qw double, qx double, qy double, qz double")
    for least, period in ((4, 0.0), (2, 5.0), (1, 0.0)):
        kept, tails, measured, since = [times[0]], None, 0, times[0]
        for t in times[1:]:
            if measured >= least and since + period < t:
                kept.append(t)
                tails, measured, since = None, 0, t
            else:
                tails, measured = t, measured + 1
        found = rotations.sample_hermite(rows, least, period).where("traj_id = 1").orderBy("t").collect()
        assert [r.t for r in found] == kept + ([tails] if tails is not None else [])
        assert [r.provisional for r in found] == [False] * len(kept) + [True] * (tails is not None)
        place = lambda t: np.array(at(t)[1])
        for i, r in enumerate(found[: len(kept) - 1]):
            a, b = (kept[i - 1], kept[i + 1]) if i else (kept[0], kept[1])
            assert np.allclose((r.vx, r.vy, r.vz), (place(b) - place(a)) / (b - a))
        last = found[len(kept) - 1]
        assert np.allclose((last.vx, last.vy, last.vz), (place(kept[-1]) - place(kept[-2])) / (kept[-1] - kept[-2]))
        # the axis of turning is fixed here
        assert np.allclose([(r.wx, r.wy, r.wz) for r in found], [(0.1, 0, 0.2)] * len(found), atol=1e-9)
    short = rotations.sample_hermite(rows, 4).where("traj_id = 2").orderBy("t").collect()
    assert [(r.t, r.provisional) for r in short] == [(times[0], False), (times[2], True)]
    assert rotations.sample_hermite(rows.where(F.lit(False))).count() == 0
