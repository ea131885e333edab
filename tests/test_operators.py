"""Operators against small cases worked out by hand and against plain transcriptions of order-dependent rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.functions import geometry as g
from cloudframe.operators import cluster, filters, nearest, neighbors, ransac, ring, shape, splines, tracking, trajectory, voxels


def points(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x double, y double, z double").withColumn("intensity", F.lit(0.0))


def scattered(n, seed, spread=4.0, dims=3):
    p = np.random.default_rng(seed).uniform(-spread, spread, (n, 3))
    p[:, dims:] = 0
    return p


def near(p, r, dims=3):
    d = np.sqrt(((p[:, None, :dims] - p[None, :, :dims]) ** 2).sum(-1))
    return [set(np.flatnonzero(row < r).tolist()) for row in d]


def test_rotations(spark):
    p = points(spark, [(1, 0, 0), (0, 1, 0), (0, 0, 1)])
    quarter = math.pi / 2
    for name, want in (("yaw", [(0, 1, 0), (-1, 0, 0), (0, 0, 1)]), ("roll", [(1, 0, 0), (0, 0, 1), (0, -1, 0)]), ("pitch", [(0, 0, -1), (0, 1, 0), (1, 0, 0)])):
        pose = {k: 0.0 for k in ("x", "y", "z", "roll", "pitch", "yaw")} | {name: quarter}
        got = [(r.x, r.y, r.z) for r in g.transform_rpy(p, pose).orderBy("id").collect()]
        assert np.allclose(got, want)
    q = [math.cos(quarter / 2), 0, 0, math.sin(quarter / 2)]
    turned = g.rotate_quaternion(*[F.col(c) for c in "xyz"], *map(F.lit, q))
    assert np.allclose([tuple(r) for r in p.orderBy("id").select(*turned).collect()], [(0, 1, 0), (-1, 0, 0), (0, 0, 1)])


def test_slerp_ends_and_middle(spark):
    a, b = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)], [F.lit(v) for v in (-math.cos(0.4), 0.0, 0.0, -math.sin(0.4))]
    rows = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "s double").select(*g.slerp(a, b, F.col("s"))).collect()
    assert np.allclose(rows, [(1, 0, 0, 0), (math.cos(0.2), 0, 0, math.sin(0.2)), (math.cos(0.4), 0, 0, math.sin(0.4))])


@pytest.mark.parametrize(("r", "seed"), [(0.7, 1), (1.0, 2), (3.0, 3)])
def test_grid_join_is_the_plain_join(spark, r, seed):
    p = scattered(120, seed)
    got = {}
    for row in neighbors.radius_pairs(points(spark, p), r).collect():
        got.setdefault(row.id, set()).add(row.nid)
    assert [got[i] for i in range(len(p))] == near(p, r)


def test_knn_with_ties(spark):
    p = np.round(scattered(80, 4, 2.0))
    got = {}
    for row in nearest.knn(points(spark, p), 5).collect():
        got.setdefault(row.id, []).append((row["rank"], row.nid))
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    for i in range(len(p)):
        assert [n for _, n in sorted(got[i])] == sorted(range(len(p)), key=lambda j: (d[i, j], j))[:5]


def plain_dbscan(p, eps, least, first_visit):
    """The two sequential rules, transcribed from their definition."""
    around = near(p, eps)
    state, number = [0] * len(p), 0
    core = [len(a) >= least for a in around]
    if first_visit:
        for i in range(len(p)):
            if state[i]:
                continue
            if not core[i]:
                state[i] = -2
                continue
            number += 1
            state[i], queue = number, sorted(around[i])
            for j in queue:
                if state[j] in (0, -1):
                    state[j] = number
                    if core[j]:
                        queue += [k for k in sorted(around[j]) if k not in queue]
        return [max(s, 0) for s in state]
    visited = [False] * len(p)
    for i in range(len(p)):
        if visited[i]:
            continue
        visited[i] = True
        if not core[i]:
            continue
        number += 1
        for j in around[i]:
            state[j] = number
        queue = sorted(around[i])
        for j in queue:
            if visited[j]:
                continue
            visited[j] = True
            if core[j]:
                for k in sorted(around[j]):
                    if not state[k]:
                        state[k] = number
                    queue.append(k)
    return state


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("border", ["overwrite", "first_visit"])
def test_dbscan(spark, seed, border):
    p = scattered(70, seed, 2.0, 2)
    got = {r.id: r.cluster for r in cluster.dbscan(points(spark, p), 0.6, 4, border=border).collect()}
    assert [got[i] for i in range(len(p))] == plain_dbscan(p, 0.6, 4, border == "first_visit")


def test_few_clusters_have_no_boxes(spark):
    p = points(spark, [(x + dx, 0, z) for x in (0, 10, 20) for dx in (0, 0.1, 0.2) for z in (0, 1)])
    found = cluster.euclidean_clusters(p, 1.5, 3)
    assert found.select("cluster").distinct().count() == 3
    assert cluster.cluster_boxes(p, found).count() == 0
    assert cluster.cluster_boxes(p, found, more_than=2).count() == 3


def test_voxels(spark):
    p = points(spark, [(-0.1, 0, 0), (-0.3, 0, 0), (0.5, 0, 0), (0.0, 0, 0)])
    got = sorted((r.vx, r.n, round(r.x, 9)) for r in voxels.voxel_downsample(p, 0.5).collect())
    assert got == [(-1, 2, -0.2), (0, 1, 0.0), (1, 1, 0.5)]


def test_boxes_of_both_kinds(spark):
    p = points(spark, scattered(200, 5))
    boxes = p.where("id % 20 = 0").select(*[(F.col(c) - 0.5).alias(f"min_{c}") for c in "xyz"], *[(F.col(c) + 0.7).alias(f"max_{c}") for c in "xyz"])
    few, many = (sorted(r.id for r in filters.in_boxes(p, boxes, most=most).collect()) for most in (100, 1))
    assert few == many and len(few) >= 10


def test_ground_flags(spark):
    cells = [(0, 0, 0.0), (1, 0, 0.02), (2, 0, 0.5), (0, 1, 0.0), (2, 1, 0.0), (3, 1, 0.0), (6, 2, 0.0), (7, 2, 0.0), (8, 2, 0.0)]
    image = spark.createDataFrame([(r, c, 1.0 + r, 0.0, 1.0 + r, z, 0) for r, c, z in cells], "row int, col int, range double, x double, y double, z double, point_id int")
    got = {(r.row, r.col) for r in ring.ground(image).where("is_ground").collect()}
    # (1, 0) has a steep upper neighbour but a flat lower one; (3, 1) loses its mark: nothing stands above it
    assert got == {(0, 0), (1, 0), (2, 1), (6, 2), (7, 2)}


def test_segments_wrap_around(spark):
    cells = [(0, c, 5.0) for c in (0, 1, 2, 58, 59)] + [(1, 0, 5.0)] + [(5, c, 5.0) for c in range(10, 14)]
    image = spark.createDataFrame(cells, "row int, col int, range double")
    got = {(r.row, r.col): r.label for r in ring.segments(image, columns=60, angle=0.2, least=6).collect()}
    assert {got[0, c] for c in (0, 1, 2, 58, 59)} == {1} and got[1, 0] == 1 and {got[5, c] for c in range(10, 14)} == {0}


def test_planes_and_lines(spark):
    rng = np.random.default_rng(3)
    plane = np.column_stack([rng.uniform(-5, 5, (300, 2)), np.full(300, 1.0)])
    line = np.outer(rng.uniform(-20, 20, 100), [1, 1, 0]) + [0, 0, 9]
    noise = rng.uniform(-20, 20, (30, 3)) + [0, 0, 50]
    p = points(spark, np.vstack([plane, line, noise]))
    found = ransac.planes(p, 0.05, tries=200, least=200)
    assert sorted(r.id for r in found.collect()) == list(range(300)) and {r.model for r in found.collect()} == {0}
    lines = ransac.lines(p.where("id >= 300"), 0.05, tries=100, least=50)
    assert sorted(r.id for r in lines.collect()) == list(range(300, 400))
    assert ransac.planes(p, 0.05, tries=50, least=1000).count() == 0


def test_models_are_refined_on_their_points(spark):
    rng = np.random.default_rng(8)
    flat = np.column_stack([rng.uniform(-9, 9, (400, 2)), rng.uniform(-0.2, 0.2, 400)])
    centre = flat.mean(0)
    axis = np.linalg.svd(flat - centre)[2][2]
    axis *= np.sign(axis[np.abs(axis).argmax()])
    model, n = ransac.best_model(points(spark, flat), "plane", 0.6, 100)
    assert n == 400 and np.allclose(model.values, (*axis, -axis @ centre), atol=1e-9)
    rough, _ = ransac.best_model(points(spark, flat), "plane", 0.6, 100, refine=False)
    assert not np.allclose(rough.values, model.values, atol=1e-6)
    # no model where there are too few points, and a null place is on none
    assert ransac.best_model(points(spark, flat[:2]), "plane", 0.6, 10) is None
    gap = points(spark, flat).unionByName(spark.sql("select 900L id, cast(null as double) x, 0D y, 0D z"), allowMissingColumns=True)
    assert 900 not in {r.id for r in ransac.planes(gap, 0.6, tries=50, least=300).collect()}


def test_many_models(spark):
    stacked = np.vstack([np.column_stack([scattered(30, k)[:, :2], np.full(30, 10.0 * k)]) for k in range(4)])
    found = ransac.planes(points(spark, stacked), 0.01, tries=4000, least=20, stop_share=0.0).collect()
    assert len({r.model for r in found}) == len({(r.model, round(r.m3, 6)) for r in found}) and len(found) == len({r.id for r in found})
    assert ransac.planes(points(spark, stacked), 0.01, least=20, stop_share=0.0, most_models=0).count() == 0


def test_models_beyond_one_plan(spark, monkeypatch):
    """What is left is written in between; the result does not depend on when."""
    from cloudframe.operators import ransac as module

    stacked = np.vstack([np.column_stack([scattered(40, k)[:, :2], np.full(40, 10.0 * k)]) for k in range(5)])
    p = points(spark, stacked)
    found = []
    for every in (1, 2, 8):
        monkeypatch.setattr(module, "WRITE_AFTER", every)
        found.append(sorted(map(tuple, ransac.planes(p, 0.01, tries=3000, least=20, stop_share=0.0).collect())))
    assert found[0] == found[1] == found[2] and len({r[1] for r in found[0]}) > 2


def plain_ground(p, passes):
    left = {i: tuple(v) for i, v in enumerate(p)}
    for half, most in passes:
        def over(values, how, half=half):
            return {i: how(w for (nx, ny, w) in values.values() if abs(x - nx) <= half and abs(y - ny) <= half) for i, (x, y, _) in values.items()}

        low = over(left, min)
        opened = over({i: (left[i][0], left[i][1], low[i]) for i in left}, max)
        left = {i: v for i, v in left.items() if v[2] - opened[i] < most}
    return set(left)


@pytest.mark.parametrize("place", ["scattered", "grid", "one cell"])
def test_ground_equals_all_pairs(spark, place):
    """Also where points lie exactly on borders of windows and cells, and where one cell holds a third of them."""
    rng = np.random.default_rng(12)
    xy = rng.uniform(-12, 12, (240, 2))
    if place == "grid":
        xy = np.round(xy * 2) / 2
    elif place == "one cell":
        xy[:80] = rng.uniform(0.1, 0.3, (80, 2))
    p = np.column_stack([xy, xy[:, 0] * 0.3 + rng.exponential(1.5, 240)])
    for passes in (filters.progressive_windows(), [(0.3, 0.5), (1.0, 1.0)]):
        rows = filters.morphological_ground(points(spark, p), passes).collect()
        assert len(rows) == 240 and {r.id for r in rows if r.is_ground} == plain_ground(p.tolist(), passes)
    assert filters.morphological_ground(points(spark, p).limit(0)).count() == 0


def test_windows_of_the_ground():
    assert filters.progressive_windows() == [(1.5, 1.0), (2.5, 3.0), (4.5, 5.0), (8.5, 6.0), (16.5, 6.0)]


def test_members_of_voxels(spark):
    p = np.vstack([np.full((1500, 3), 0.5), np.full((3, 3), -0.5), [[0.1, 5.0, 0.0]]])
    full = voxels.voxel_points(points(spark, p), 1.0, 3)
    assert {(r.vx, r.vy, r.vz): r.n for r in full.groupBy("vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 0, 0): 1500, (-1, -1, -1): 3}


def test_region_planes(spark):
    wall = np.column_stack([np.full(50, 3.0), scattered(50, 2)[:, :2]])
    p = points(spark, wall)
    row = shape.region_planes(p, p.select("id", F.lit(1).alias("cluster"))).first()
    assert row.n == 50 and row.upright and abs(row.nx - 1) < 1e-9 and abs(row.offset + 3) < 1e-9


def test_curve_of_several_dimensions(spark):
    """x = t^5 and y = t^2 are met by quintic pieces with their own derivatives; times outside take the ends."""
    at = [0.0, 1.0, 2.5]
    knots = spark.createDataFrame([(1, t, t**5, 5 * t**4, 20 * t**3, t * t, 2 * t, 2.0) for t in at], "traj_id long, t double, x double, vx double, ax double, y double, vy double, ay double")
    times = spark.createDataFrame([(1, t) for t in (-1.0, 0.3, 1.0, 2.2, 2.5, 4.0)], "traj_id long, t double")
    for k, (fx, fy) in enumerate(((lambda t: t**5, lambda t: t * t), (lambda t: 5 * t**4, lambda t: 2 * t))):
        for r in splines.vector_curve(knots, times, ("x", "y"), 5, k).collect():
            t = min(2.5, max(0.0, r.t))
            assert abs(r.x - fx(t)) < 1e-9 * 100 and abs(r.y - fy(t)) < 1e-9
    assert splines.vector_curve(knots.limit(0), times, ("x",)).count() == 0


def test_normals_of_a_plane(spark):
    p = points(spark, np.column_stack([scattered(60, 6)[:, :2], np.full(60, 2.0)]))
    rows = shape.normals(p, 8).collect()
    assert all(abs(r.nx) < 1e-6 and abs(r.nz + 1) < 1e-6 and r.curvature < 1e-9 for r in rows)
    features = shape.pca_features(p, 100.0).collect()
    assert all(r.scatter < 1e-6 and r.l1 >= r.l2 >= r.l3 for r in features)
    assert all(r.l1 is None for r in shape.pca_features(p, 0.01).collect())
    asc = shape.pca_features(p, 100.0, order="asc").first()
    assert asc.l1 <= asc.l2 <= asc.l3


KNOTS = [(1, float(t), v, 2 * v, 0.0) for t, v in ((0, 0.0), (1, 2.0), (3, 6.0), (4, 3.0))]


def knots(spark):
    return spark.createDataFrame(KNOTS, "traj_id long, t double, x double, y double, z double")


def test_times_at_knots_and_outside(spark):
    times = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 0.5, 1.0, 2.0, 4.0, 5.0)] + [(2, 1.0)], "traj_id long, t double")
    assert sorted((r.t, r.x) for r in trajectory.interpolate(knots(spark), times).collect()) == [(0, 0), (0.5, 1), (1, 2), (2, 4)]
    assert sorted((r.t, r.t0, r.t1) for r in trajectory.bracket(knots(spark), times, ["x"]).collect()) == [(0, 0, 1), (0.5, 0, 1), (1, 1, 3), (2, 1, 3), (4, 3, 4)]


def test_hermite_meets_knots_and_slopes(spark):
    sloped = trajectory.slopes(knots(spark))
    times = knots(spark).select("traj_id", "t")
    assert sorted((r.t, round(r.x, 9)) for r in trajectory.hermite(sloped, times).collect()) == [(t, v) for _, t, v, _, _ in KNOTS]
    assert sorted((r.t, round(r.x, 9)) for r in trajectory.hermite(sloped, times, derivative=1).collect()) == sorted((r.t, round(r.vx, 9)) for r in sloped.collect())


def test_splines(spark):
    t, x = np.array([0.0, 1.0, 3.0, 4.0]), np.array([0.0, 2.0, 6.0, 3.0])
    a = splines.cubic_system(t, x)
    h = np.diff(t)
    assert np.allclose([np.polyval(c, u) for c, u in zip(a, h, strict=True)], x[1:])
    for k in (1, 2):
        ends = [np.polyval(np.polyder(c, k), u) for c, u in zip(a, h, strict=True)]
        starts = [np.polyval(np.polyder(c, k), 0) for c in a]
        assert np.allclose(ends[:-1], starts[1:])
    fitted = splines.fit_cubic(knots(spark))
    asked = spark.createDataFrame([(1, v) for v in (-1.0, 0.0, 0.5, 1.0, 3.5, 4.0, 9.0)], "traj_id long, t double")
    got = {r.t: r.pos for r in splines.evaluate(fitted, asked, 3).collect()}
    assert got[-1.0] == got[0.0] == 0 and abs(got[4.0] - 3) < 1e-9 and got[9.0] == got[4.0] and abs(got[1.0] - 2) < 1e-9
    assert splines.is_valid(fitted, 3).first().valid


@pytest.mark.parametrize("order", range(1, 6))
def test_coefficients_meet_their_ends(spark, order):
    p0, p1, v0, v1, a0, a1, d = 1.0, 4.0, 0.5, -1.0, 0.3, 0.7, 2.0
    c = list(spark.range(1).select(*splines.coefficients(order, *[F.lit(v) for v in (p0, p1, d, v0, v1, a0, a1)])).first())
    at = lambda u, k: np.polyval(np.polyder(c, k) if k else c, u)
    assert np.isclose(at(0, 0), p0) and np.isclose(at(d, 0), p1)
    for least, u, k, want in ((2, 0, 1, v0), (3, d, 1, v1), (4, 0, 2, a0), (5, d, 2, a1)):
        assert order < least or np.isclose(at(u, k), want)


def test_closed_spline_passes_through(spark):
    p = {r.i: (r.px, r.py) for r in trajectory.closed_bspline(knots(spark)).collect()}
    for i, (_, _, x, y, _) in enumerate(KNOTS):
        assert np.allclose((np.array(p[i - 1 if i else 3]) + 4 * np.array(p[i]) + np.array(p[(i + 1) % 4])) / 6, (x, y))


def test_knot_edits(spark):
    changed = spark.createDataFrame([(1, 1.0, 9.0, 9.0, 9.0), (1, 7.0, 1.0, 1.0, 1.0)], knots(spark).schema)
    assert sorted((r.t, r.x) for r in trajectory.upsert_knots(knots(spark), changed).collect()) == [(0, 0), (1, 9), (3, 6), (4, 3), (7, 1)]
    assert sorted(r.t for r in trajectory.delete_knots(knots(spark), changed).collect()) == [0, 3, 4]
    assert sorted(r.t for r in trajectory.knots_in_range(knots(spark), 1.5, 3.5).collect()) == [1, 3, 4]
    assert sorted(r.t for r in trajectory.knots_in_range(knots(spark), 1.0, 3.0).collect()) == [1, 3]


def test_knot_lookups(spark):
    asked = spark.createDataFrame([(1, 0.9), (1, 1.2), (1, 2.0), (1, 4.05), (2, 1.0), (1, -0.05)], "traj_id long, t double")
    for tolerance, want in ((0.1, {0.9, 4.05, -0.05}), (0.0, set()), (1.0, {0.9, 1.2, 2.0, 4.05, -0.05})):
        assert {r.t for r in trajectory.has_knots(knots(spark), asked, tolerance).collect() if r.present} == want, tolerance
    keyed = knots(spark).withColumn("key", (F.col("t") * 10).cast("long"))
    assert [r.t for r in trajectory.knots_by_key(keyed, spark.createDataFrame([(30,), (31,), (30,)], "key long")).orderBy("key").collect()] == [3.0, None]
    assert trajectory.knot_consistency(keyed).first().consistent
    for broken in (keyed.withColumn("key", F.lit(1)), keyed.union(keyed.where("t = 3").withColumn("key", F.lit(77))), keyed.withColumn("key", F.when(F.col("t") > 0, F.col("key")))):
        assert not trajectory.knot_consistency(broken).first().consistent
    moved = knots(spark).where("t > 0").withColumn("x", F.when(F.col("t") == 3, F.col("x") + 1).otherwise(F.col("x")))
    assert tuple(trajectory.knot_differences(knots(spark), moved).first()) == (1, 2, 1, 1, 0)


def test_tracks_miss_and_compete(spark):
    steady = [(1, f, 100 + f, 0.0, 0.0) for f in range(1, 6)]
    rival = [(1, f, 200 + f, 0.3, 0.0) for f in (3,)]
    again = [(1, 12, 112, 0.0, 0.0)]
    gaps = [(1, f, 300 + f, 50.0, 50.0) for f in range(6, 12)]
    rows = spark.createDataFrame(steady + rival + gaps + again, "seq_id long, frame long, det_id long, x double, y double")
    got = {r.det_id: r.track_id for r in tracking.track(rows).collect()}
    assert {got[100 + f] for f in range(1, 6)} == {1}  # the nearer detection is taken, the other starts a track
    assert got[203] == 2 and got[112] not in (1, 2)  # lost in frames 6 to 9


def test_moving_target_is_dynamic(spark):
    rows = spark.createDataFrame([(1, f, f, 0.05 * f, 0.0) for f in range(1, 200)], "seq_id long, frame long, det_id long, x double, y double")
    last = tracking.track(rows).orderBy(F.desc("frame")).first()
    assert last.track_id == 1 and abs(last.vx - 0.5) < 0.05 and last.dynamic


def test_order_of_rows_does_not_matter(spark):
    p = points(spark, scattered(60, 9, 2.0))
    for op in (lambda d: cluster.dbscan(d, 0.8, 4), lambda d: cluster.euclidean_clusters(d, 0.7, 2), lambda d: ransac.planes(d, 0.2, tries=20, least=5)):
        assert sorted(map(tuple, op(p).collect())) == sorted(map(tuple, op(p.repartition(5).orderBy(F.desc("x"))).collect()))


def test_transform_and_back(spark):
    p = points(spark, scattered(40, 11))
    q = np.array([0.3, -0.5, 0.7, 0.1])
    q /= np.linalg.norm(q)
    there = g.rotate_quaternion(*[F.col(c) for c in "xyz"], *map(F.lit, map(float, q)))
    moved = p.select("id", *[v.alias(c) for v, c in zip(there, "xyz", strict=True)])
    back = g.rotate_quaternion(*[F.col(c) for c in "xyz"], *map(F.lit, map(float, q * [1, -1, -1, -1])))
    got = [tuple(r) for r in moved.orderBy("id").select(*back).collect()]
    assert np.allclose(got, [(r.x, r.y, r.z) for r in p.orderBy("id").collect()])


def test_mean_shift_keeps_lone_points(spark):
    p = points(spark, [(0, 0, 0), (0.2, 0, 0), (0.1, 0.1, 0), (50, 0, 0)])
    got = {r.id: (round(r.x, 6), round(r.y, 6)) for r in cluster.mean_shift(p, 1, 1.0, 3).collect()}
    assert got[3] == (50, 0) and got[0] == got[1] == got[2] == (0.1, round(0.1 / 3, 6))


def test_conditional_clusters(spark):
    p = points(spark, [(0, 0, 0), (0.1, 0, 0), (0.2, 0, 0)]).withColumn("intensity", F.when(F.col("id") == 2, 9.0).otherwise(0.0))
    found = cluster.euclidean_clusters(p, 0.5, keep=("intensity",), predicate=lambda a, b, d2: F.abs(a["intensity"] - b["intensity"]) < 1)
    assert {r.id: r.cluster for r in found.collect()} == {0: 1, 1: 1, 2: 2}
