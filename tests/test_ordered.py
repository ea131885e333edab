"""Long sequences: blocks against the whole system, and state carried from batch to batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframe.operators import ordered, rotations, splines, tracking, trajectory


@pytest.fixture
def hot(spark):
    """A long trajectory, a short one and the shortest."""
    rng = np.random.default_rng(7)
    rows = [(k, float(t), float(rng.normal()), float(rng.normal()), 0.0) for k, n in ((1, 1003), (2, 130), (3, 2), (4, 1)) for t in np.cumsum(rng.uniform(0.1, 3, n))]
    rng.shuffle(rows)
    return spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in rows], "traj_id long, t double, x double, y double, z double").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(map(tuple, rows)):
        out.setdefault(r[0], []).append(r[1:])
    return {k: np.array(v, float) for k, v in out.items()}


def dense_cubic(t, x):
    n, h = len(t) - 1, np.diff(t)
    m, right = np.eye(n + 1), np.zeros(n + 1)
    for i in range(1, n):
        m[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        right[i] = 3 * (h[i] * (x[i] - x[i - 1]) / h[i - 1] + h[i - 1] * (x[i + 1] - x[i]) / h[i])
    return np.linalg.solve(m, right)[:-1]


def dense_closed(p):
    n = len(p)
    m = np.zeros((n, n))
    for k, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
        m[np.arange(n), (np.arange(n) + k) % n] += w
    return np.linalg.solve(m, p)


def test_blocks_solve_the_whole_system(hot):
    knots = by_key(hot.collect())
    fitted = by_key(splines.fit_cubic(hot, block=100).select("traj_id", "seg", "duration", "a1", "a0").collect())
    closed = by_key(trajectory.closed_bspline(hot, block=100).collect())
    assert set(fitted) == {1, 2, 3} and set(closed) == {1, 2, 3, 4}
    for k, own in knots.items():
        if k in fitted:
            assert fitted[k][:, 0].tolist() == list(range(len(own) - 1))
            assert np.allclose(fitted[k][:, 1], np.diff(own[:, 0])) and np.allclose(fitted[k][:, 3], own[:-1, 1])
            assert np.abs(fitted[k][:, 2] - dense_cubic(own[:, 0], own[:, 1])).max() < 1e-11
        assert closed[k][:, 0].tolist() == list(range(len(own)))
        assert np.abs(closed[k][:, 1:] - dense_closed(own[:, 1:3])).max() < 1e-12


def test_error_of_a_halo_is_bounded(hot):
    knots = by_key(hot.collect())[1]
    want = dense_cubic(knots[:, 0], knots[:, 1])
    for halo in (2, 8, 16):
        got = by_key(splines.fit_cubic(hot.where("traj_id = 1"), block=100, halo=halo).select("traj_id", "seg", "a1").collect())[1]
        assert np.abs(got[:, 1] - want).max() <= 2.0**-halo * 2 * max(np.abs(want).max(), np.abs(np.diff(knots[:, 1]) / np.diff(knots[:, 0])).max())


def test_no_block_holds_a_long_trajectory(spark):
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("traj_id"), F.col("id").cast("double").alias("t"), F.sin("id").alias("x"))
    sizes = [r["count"] for r in ordered.in_blocks(rows, "traj_id", ["t"]).groupBy("block").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 2 * ordered.BLOCK + 2 * ordered.HALO
    assert splines.fit_cubic(rows).count() == 29_999


def test_state_goes_from_batch_to_batch(spark, hot):
    rows = spark.createDataFrame([(s, f, 1000 * s + 10 * f + k, k + 0.01 * f, 0.0) for s in (1, 2) for f in range(1, 40) for k in range(3)], "seq_id long, frame long, det_id long, x double, y double")
    ways = [lambda: rotations.smooth_motions(hot.withColumns(dict.fromkeys(("roll", "pitch", "yaw"), F.lit(0.0))), 2.0), lambda: tracking.track(rows), lambda: tracking.kalman(rows.where("det_id % 10 = 0"))]
    want = [sorted(map(tuple, way().collect())) for way in ways]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        assert [sorted(map(tuple, way().collect())) for way in ways] == want
    finally:
        spark.conf.set(size, before)
    assert {r[2] for r in want[1] if r[0] == 1} == {1, 2, 3}
    for k, own in by_key(hot.collect()).items():
        p = own[:, 1:].copy()
        for i in range(2, len(p) - 2):
            p[i] = p[i - 1] + 5 / 6 * (p[i] - p[i - 1]) + 1 / 6 * (p[i + 1] - p[i])
        got = np.array([r[1:] for r in want[0] if r[0] == k and r[2] == 0])
        assert np.allclose(got[:, 2:5], p)


@pytest.fixture(scope="module")
def screw(spark):
    """A steady screw motion: the same turn about a slanted axis and the same way in every second."""
    from cloudframe.operators import rigid

    r, w = (0.6, -0.2, 0.4), (0.05, 0.2, -0.3)
    at = lambda t: rigid.exponential(r, w, t)
    return at, spark.createDataFrame([(k, float(t), *at(t)[1], *at(t)[0]) for k in (1, 2) for t in range(12)], "traj_id long, t double, x double, y double, z double, qw double, qx double, qy double, qz double")


def test_steady_motion_stays_as_it_is(spark, screw):
    """Smoothing changes nothing of a steady screw motion, and samples lie on it; without turns that is a straight, even motion."""
    at, poses = screw
    found = rotations.smooth_motions(poses, 1.0, (0.0, 0.25, 0.5, 0.75)).collect()
    assert sorted({(r.t - r.sample / 4, r.sample) for r in found if r.traj_id == 1}) == sorted([(float(t), 0) for t in range(12)] + [(float(t), k) for t in range(2, 10) for k in (1, 2, 3)])
    assert len(found) == 2 * (12 + 8 * 3)
    plain = poses.withColumns({"roll": F.lit(0.0), "pitch": F.lit(0.0), "yaw": F.lit(0.0)}).drop("qw", "qx", "qy", "qz")
    even = plain.withColumns({"x": F.col("t") * 2 - 3, "y": -F.col("t"), "z": F.lit(1.5)})
    for r in found:
        turn, place = at(r.t)
        assert np.allclose((r.x, r.y, r.z), place, atol=1e-9)
        assert np.isclose(abs(np.dot((r.qw, r.qx, r.qy, r.qz), turn)), 1, atol=1e-12)
    for rows in (trajectory.cumulative_bspline(even, 1.0, offsets=(0.0, 0.3)), rotations.bspline_motions(even, 1.0, (0.0, 0.3)), rotations.smooth_motions(even, 1.0, (0.0, 0.3))):
        rows = rows.collect()
        assert len(rows) >= 2 * 2 * 8 and np.allclose([(r.x, r.y, r.z) for r in rows], [(2 * r.t - 3, -r.t, 1.5) for r in rows])


def test_motions_of_rows_and_of_columns_agree(spark, screw):
    _, poses = screw
    turned = poses.drop("qw", "qx", "qy", "qz").withColumns({"roll": 0.3 * F.sin("t"), "pitch": 0.2 * F.cos("t"), "yaw": F.col("t") / 5 + F.col("traj_id")})
    want = {(r.traj_id, round(r.t, 3)): r for r in rotations.bspline_motions(turned, 1.0, (0.0, 0.4)).collect()}
    # the first window of the pass has no pose that was replaced
    for r in rotations.smooth_motions(turned, 1.0, (0.0, 0.4)).where("t between 1.9 and 2.5").collect():
        w = want[r.traj_id, round(r.t, 3)]
        assert np.allclose((r.x, r.y, r.z), (w.x, w.y, w.z)) and np.isclose(abs(r.qw * w.qw + r.qx * w.qx + r.qy * w.qy + r.qz * w.qz), 1)


@pytest.fixture
def many_ranges(spark):
    """As many ranges as there would be of large tables."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def sequences(spark):
    """A sequence over many ranges, one of two rows, some of one row, and one without a name."""
    rng = np.random.default_rng(3)
    sizes = {1: 400, 2: 2, 3: 1, 4: 30, 5: 1, None: 12}
    rows = [(k, float(t), float(rng.integers(100)), None if rng.random() < 0.7 else float(t)) for k, n in sizes.items() for t in rng.permutation(n)]
    rng.shuffle(rows)
    return spark.createDataFrame([(None if r[0] is None else int(r[0]), float(r[1]), float(r[2]), None if r[3] is None else float(r[3])) for r in rows], "k long, t double, v double, seen double")


def of_sequences(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.k is None, r.k or 0, r.t)):
        out.setdefault(r.k, []).append(r)
    return out


def test_rows_beside_cross_ranges(spark, many_ranges, sequences):
    rows = ordered.beside(sequences, "k", ["t"], ["t", "v"], before=2, after=2)
    assert ordered._ranged(sequences, "k", ["t"]).where("k = 1").select("__part").distinct().count() > 2
    got = of_sequences(rows.collect())
    assert sum(map(len, got.values())) == sequences.count()
    for own in of_sequences(sequences.collect()).values():
        for i, r in enumerate(got[own[0].k]):
            assert (r.t, r.v) == (own[i].t, own[i].v)
            for name, j in (("m1", i - 1), ("m2", i - 2), ("p1", i + 1), ("p2", i + 2)):
                want = (own[j].t, own[j].v) if 0 <= j < len(own) else (None, None)
                assert (r[f"t_{name}"], r[f"v_{name}"]) == want


def test_latest_values_cross_ranges(spark, many_ranges, sequences):
    sparse = sequences.withColumn("seen", F.when((F.col("k") == 1) & (F.col("t") > 20), None).otherwise(F.col("seen")))
    got = of_sequences(ordered.latest(sparse, "k", ["t"], "seen").collect())
    for own in of_sequences(sparse.collect()).values():
        last = None
        for r, mine in zip(got[own[0].k], own, strict=True):
            last = mine.seen if mine.seen is not None else last
            assert r.seen == last


def test_times_meet_segments_over_many_ranges(spark, many_ranges, sequences):
    """Times at knots, between them, before the first, at the last one and after it."""
    knots = sequences.where("k is not null").select(F.col("k").alias("traj_id"), "t", F.col("v").alias("x"))
    times = spark.createDataFrame([(k, t) for k in (1, 2, 3, 4, 9) for t in (-1.0, 0.0, 0.5, 1.0, 7.25, 28.5, 29.0, 29.5, 200.0, 398.9, 399.0, 400.0)], "traj_id long, t double")
    own = {r.traj_id: [] for r in knots.collect()}
    for r in sorted(knots.collect()):
        own[r.traj_id].append((r.t, r.x))
    for closed in (True, False):
        want = set()
        for r in times.collect():
            p = own.get(r.traj_id, [])
            for (t0, x0), (t1, x1) in zip(p, p[1:], strict=False):
                if t0 <= r.t < t1 or closed and r.t == t1 == p[-1][0]:
                    want.add((r.traj_id, r.t, t0, t1, x0, x1))
        assert {(r.traj_id, r.t, r.t0, r.t1, r.x0, r.x1) for r in trajectory.bracket(knots, times, ["x"], closed=closed).collect()} == want


def test_slopes_over_many_ranges(spark, many_ranges, sequences):
    knots = sequences.where("k is not null").select(F.col("k").alias("traj_id"), "t", F.col("v").alias("x"))
    own = {}
    for r in sorted(knots.collect()):
        own.setdefault(r.traj_id, []).append((r.t, r.x))
    for periodic in (False, True):
        for r in trajectory.slopes(knots, ("x",), periodic=periodic, ends={"x": (2.0, -3.0)}).collect():
            p = own[r.traj_id]
            i = [t for t, _ in p].index(r.t)
            if 0 < i < len(p) - 1:
                want = (p[i + 1][1] - p[i - 1][1]) / (p[i + 1][0] - p[i - 1][0])
            elif periodic:
                span = p[-1][0] - p[-2][0] + p[1][0] - p[0][0] if len(p) > 1 else 0
                want = (p[1][1] - p[-2][1]) / span if span else 0.0
            else:
                want = 2.0 if i == 0 else -3.0
            assert np.isclose(r.vx, want), (periodic, r)


def dense_pieces(order, t, x, first, last):
    """The least coefficients that meet all conditions, by one dense system; and the conditions."""
    h = np.diff(t)
    n, m = len(h), order + 1

    def row(piece, u, times):
        out = np.zeros(n * m)
        for k in range(times, m):
            out[piece * m + k] = np.prod(np.arange(k, k - times, -1)) * u ** (k - times)
        return out

    ends = 3 if 4 * (n - 1) + 6 <= m * n else 2
    pairs = [(row(at, u, d), w) for at, u, given in ((0, 0.0, (x[0], *first)), (n - 1, h[-1], (x[-1], *last))) for d, w in enumerate(given[:ends])]
    for s in range(n - 1):
        pairs += [(row(s, h[s], 0), x[s + 1]), (row(s + 1, 0.0, 0), x[s + 1])]
        pairs += [(row(s, h[s], d) - row(s + 1, 0.0, d), 0.0) for d in (1, 2)]
    a, b = (np.array(v) for v in zip(*pairs, strict=True))
    return np.linalg.lstsq(a, b, rcond=1e-15)[0].reshape(n, m)[:, ::-1], a, b


@pytest.mark.parametrize("order", [4, 5])
@pytest.mark.parametrize("pieces", [1, 2, 3, 40])
@pytest.mark.parametrize("spread", [(0.5, 2), (0.05, 3)])
def test_pieces_against_a_dense_system(order, pieces, spread):
    rng = np.random.default_rng(pieces)
    t, x = np.cumsum(rng.uniform(*spread, pieces + 1)), rng.normal(size=pieces + 1) * 5
    got = splines.smallest_pieces(order, t, x, (0.3, 1.0), (-0.2, 0.5))
    want, a, b = dense_pieces(order, t, x, (0.3, 1.0), (-0.2, 0.5))
    assert np.abs(a @ got[:, ::-1].ravel() - b).max() < 1e-9
    assert np.abs(got - want).max() < 1e-6 * np.abs(want).max()


@pytest.mark.parametrize("order", [4, 5])
@pytest.mark.parametrize("pieces", [2, 3, 40])
def test_exact_pieces_are_those_of_doubles(order, pieces):
    rng = np.random.default_rng(pieces)
    t, x = np.cumsum(rng.uniform(0.5, 2, pieces + 1)), rng.normal(size=pieces + 1) * 5
    want = splines.smallest_pieces(order, t, x, (0.3, 1.0), (-0.2, 0.5))
    assert np.abs(splines._exact_pieces(order, np.diff(t), x, (0.3, 1.0), (-0.2, 0.5)) - want).max() < 1e-9 * np.abs(want).max()


@pytest.mark.parametrize("order", [4, 5])
@pytest.mark.parametrize("gap", [1e-5, 1e-9])
def test_pieces_of_very_unlike_durations(order, gap):
    """Two knots beside each other among distant ones: in doubles the system of order 5 was singular, that of order 4 left its knots."""
    t = np.array([0.0, 8.0, 8.0 + gap, 20.0, 31.0, 31.0 + gap, 31.0 + 2 * gap, 40.0])
    x = np.array([1.0, 5.0, 5.0, -3.0, 2.0, 2.0, 2.0, 7.0])
    found = splines.smallest_pieces(order, t, x, (0.5, -0.25), (0.5, -0.25))
    assert np.array_equal(found, splines._exact_pieces(order, np.diff(t), x, (0.5, -0.25), (0.5, -0.25), more_digits=200))
    h = np.diff(t)
    for k, name in enumerate(("place", "velocity", "acceleration")):
        at_end = np.array([np.polynomial.polynomial.polyval(d, np.polynomial.polynomial.polyder(c[::-1], k)) for c, d in zip(found, h, strict=True)])
        want = found[1:, order - k] * (2 if k == 2 else 1)
        assert np.abs(at_end[:-1] - want).max() < 1e-4 * (1 + np.abs(want).max()), name


@pytest.mark.parametrize("order", [3, 4, 5])
def test_fits_in_blocks_equal_the_whole(spark, hot, order):
    knots = hot.withColumns({"vx": F.lit(0.3), "ax": F.when(F.col("traj_id") == 1, 0.5)})
    names = [f"a{k}" for k in range(order, -1, -1)]
    fitted = by_key(splines.fit(knots, order, block=100).select("traj_id", "seg", "duration", *names).collect())
    assert set(fitted) == {1, 2, 3}
    for k, own in by_key(hot.select("traj_id", "t", "x").collect()).items():
        if k == 4:
            continue
        end = (0.3, 0.5 if k == 1 else 0.0)
        want = splines.cubic_system(own[:, 0], own[:, 1], 0.3, 0.3) if order == 3 else splines.smallest_pieces(order, own[:, 0], own[:, 1], end, end)
        assert fitted[k][:, 0].tolist() == list(range(len(own) - 1))
        assert np.abs(fitted[k][:, 2:] - want).max() <= 1e-7 * np.abs(want).max()


def test_fits_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 0.0), (1, 2.0, 4.0), (2, 5.0, 1.0)], "traj_id long, t double, x double")
    for order, a1 in ((1, 2.0), (2, 2.0), (3, 0.0), (4, 0.0), (5, 0.0)):
        (found,) = splines.fit(rows, order).collect()
        assert (found.traj_id, found.seg, found.duration, found.a0, round(found.a1, 12)) == (1, 0, 2.0, 0.0, a1)
        assert splines.fit(rows.limit(0), order).collect() == []
    with pytest.raises(ValueError):
        splines.fit(rows, 6)
