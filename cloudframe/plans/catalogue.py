"""The query catalogue: one entry per operator, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.functions import geometry as g
from cloudframe.operators import cluster, filters, growing, nearest, neighbors, ordered, ransac, ring, rotations, shape, splines, tracking, trajectory, voxels
from cloudframe.plans import files, oracles, programs
from cloudframe.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

POSE = {"x": 1.5, "y": -2.0, "z": 0.5, "roll": 0.1, "pitch": -0.2, "yaw": 0.7}
#: four samples a window of 400 s
QUARTERS = (0.0, 100.0, 200.0, 300.0)
TURN = {"x": 1.5, "y": -2.0, "z": 0.5, "qw": 0.5, "qx": 0.5, "qy": -0.5, "qz": 0.5}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def r6(*columns: str, digits: int = 6) -> list[Column]:
    """Columns rounded; adding 0.0 turns -0.0 into 0.0."""
    return [(F.round(c, digits) + 0.0).alias(c) for c in columns]


def aside(*columns: str) -> list[Column]:
    """Columns rounded a little above, as values at quarters of a span often lie half way between two roundings."""
    return [(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) for c in columns]


def queries() -> dict[str, Query]:
    return _QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in _QUERIES} | files.SQL


# points: projections


@query
def voxel_downsample(spark, sf_dir):
    return voxels.voxel_downsample(t.points_large(spark, sf_dir), 5.0).select("vx", "vy", "vz", "n", *r6("x", "y", "z"))


@query
def voxel_downsample_lineitem(spark, sf_dir):
    return voxels.voxel_downsample(t.points_keyless(spark, sf_dir), 2.0, ("x", "y", "z", "intensity")).select("vx", "vy", "vz", "n", *r6("x", "y", "z"), *r6("intensity", digits=3))


@query
def voxel_blocks_min20(spark, sf_dir):
    return voxels.voxel_blocks(t.points_large(spark, sf_dir), 10.0).select("vx", "vy", "vz", "n", *r6("cx", "cy", "cz"))


@query
def voxel_members(spark, sf_dir):
    return voxels.voxel_points(t.points_large(spark, sf_dir), 10.0).select("id", "vx", "vy", "vz")


@query
def bbox_centroid(spark, sf_dir):
    found = voxels.boxes(t.frames(spark, sf_dir), ["frame_id"])
    return found.select("frame_id", "n", *r6(*[f"{m}_{c}" for c in "xyz" for m in ("min", "max", "avg")]))


@query
def covariance_about_point(spark, sf_dir):
    found = voxels.covariance_about(t.points_small(spark, sf_dir), 1.0)
    return found.select("id", "n", *r6("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))


@query
def rigid_transform_rpy(spark, sf_dir):
    return g.transform_rpy(t.points_small(spark, sf_dir), POSE).select("id", *r6("x", "y", "z"), "intensity")


@query
def quaternion_transform(spark, sf_dir):
    return g.transform_quaternion(t.points_small(spark, sf_dir), TURN).select("id", *r6("x", "y", "z"))


@query
def plane_projection(spark, sf_dir):
    return g.project_to_plane(t.points_small(spark, sf_dir), 1.0, 2.0, 2.0, 3.0).select("id", *r6("x", "y", "z"))


@query
def flatten_points(spark, sf_dir):
    return g.flatten(t.points_small(spark, sf_dir)).select("id", *r6("x", "y", "z"))


@query
def spherical_coords(spark, sf_dir):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    p = t.points_small(spark, sf_dir).withColumns({**g.spherical(x, y, z), "folded": g.folded_angle(x, y)})
    return p.select("id", *r6("range", "vang", "hang", "folded"))


@query
def wrap_angle(spark, sf_dir):
    a = (F.col("y") - 50) / 15
    return t.frames(spark, sf_dir).select("id", g.wrap_angle(a).alias("a1"), g.wrap_angle(a, second=True).alias("a2")).select("id", *r6("a1", "a2"))


@query
def euler_angles(spark, sf_dir):
    """Angles to a quaternion, its matrix and back."""
    turns = g.euler_to_quaternion(*[F.col(a) for a in ("roll", "pitch", "yaw")])
    q = t.angles(spark, sf_dir).select("id", *[v.alias(n) for n, v in zip(("qw", "qx", "qy", "qz"), turns, strict=True)])
    axes = [g.rotate_quaternion(*[F.lit(float(i == j)) for j in range(3)], *[F.col(c) for c in ("qw", "qx", "qy", "qz")]) for i in range(3)]
    back = g.rotation_to_euler([[axes[j][i] for j in range(3)] for i in range(3)])
    named = q.select("id", "qw", "qx", "qy", "qz", *[v.alias(n) for n, v in zip(("roll", "pitch", "yaw"), back, strict=True)])
    return named.select("id", *r6("qw", "qx", "qy", "qz", "roll", "pitch", "yaw"))


@query
def spline_basis(spark, sf_dir):
    b = g.spline_basis(F.col("y") / 100)
    return t.points_large(spark, sf_dir).select("id", *[v.alias(f"b{i}") for i, v in enumerate(b)]).select("id", *r6("b0", "b1", "b2", "b3", digits=8))


@query
def tau_vectors(spark, sf_dir):
    u = F.col("y") / 100
    cols = {f"d{k}_{i}": v for k in range(3) for i, v in enumerate(g.tau(u, 5, k))}
    return t.points_large(spark, sf_dir).select("id", *[v.alias(n) for n, v in cols.items()]).select("id", *r6(*cols))


@query
def stamp_differences(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.floor(us / 1_000_000).alias("sec"), F.pmod(us, F.lit(1_000_000)).alias("usec"))
    return e.select("id", g.stamp_difference(F.col("sec"), F.col("usec"), F.lit(1_700_000_000), F.lit(999_999)).cast("long").alias("us"))


@query
def coloured_types(spark, sf_dir):
    red = F.when(F.col("intensity") == 1, 255).when(F.col("intensity") == 2, 0).otherwise(128)
    green = F.when(F.col("intensity") == 1, 0).when(F.col("intensity") == 2, 255).otherwise(128)
    return t.points_small(spark, sf_dir).select("id", red.alias("r"), green.alias("g"), (255 - red - F.floor(green / 2)).cast("int").alias("b"))


# points: filters


@query
def passthrough_z(spark, sf_dir):
    return filters.pass_through(t.points_small(spark, sf_dir)).select("id")


@query
def crop_box(spark, sf_dir):
    p = t.points_small(spark, sf_dir)
    return p.where(~filters.inside_box((-1, -1, -1), (1, 1, 1), 0.5)).select("id")


@query
def crop_box_marks(spark, sf_dir):
    return filters.mark_outside(t.points_small(spark, sf_dir), (-1, -1, -1), (1, 1, 1)).select("id", "intensity")


@query
def points_in_boxes(spark, sf_dir):
    p = t.points_small(spark, sf_dir)
    cells = p.select("x", "y", "z", *[voxels.cell(c, 1.5).alias(f"v{c}") for c in "xyz"])
    return filters.in_boxes(p, voxels.boxes(cells, ["vx", "vy", "vz"]).where("n >= 8"))


@query
def range_gate(spark, sf_dir):
    return filters.range_gate(t.points_small(spark, sf_dir), 2.0).select("id")


@query
def near_points(spark, sf_dir):
    p = t.points_small(spark, sf_dir)
    return p.where(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) < 1).select("id")


@query
def anti_join_indices(spark, sf_dir):
    p = t.points_small(spark, sf_dir)
    return filters.without_ids(p, p.where("intensity < 3").select("id")).select("id")


@query
def semi_join_indices(spark, sf_dir):
    p = t.points_small(spark, sf_dir)
    return filters.only_ids(p, p.where("intensity < 3").select("id")).select("id")


@query
def statistical_outlier(spark, sf_dir):
    return filters.statistical_outliers(t.points_small(spark, sf_dir)).select("id")


@query
def radius_outlier(spark, sf_dir):
    return filters.radius_outliers(t.points_small(spark, sf_dir), 0.8)


@query
def morphological_ground(spark, sf_dir):
    return filters.morphological_ground(t.points_small(spark, sf_dir)).select("id", "is_ground")


@query
def feature_points(spark, sf_dir):
    n = shape.normals(t.points_small(spark, sf_dir), 10)
    return n.where(F.col("curvature") * 100 > 25).select("id")


# neighbourhoods


@query
def radius_neighbors(spark, sf_dir):
    return neighbors.radius_pairs(t.points_small(spark, sf_dir), 1.0).select("id", "nid", *r6("d2"))


@query
def radius_neighbor_counts(spark, sf_dir):
    return neighbors.neighbour_counts(t.points_large(spark, sf_dir), 2.0, ("x", "y"))


@query
def knn(spark, sf_dir):
    return nearest.knn(t.points_small(spark, sf_dir), 6).select("id", "nid", "rank", *r6("d"))


@query
def nearest_target(spark, sf_dir):
    p = t.frames(spark, sf_dir)
    found = neighbors.nearest_target(p.where("id % 4 > 0"), p.where("id % 4 = 0"), 20.0, by=("frame_id",))
    return found.select("id", "target_id", *r6("d"))


# trajectories


@query
def pose_interval_join(spark, sf_dir):
    return trajectory.interpolate(t.poses(spark, sf_dir), t.scan_times(spark, sf_dir)).select("traj_id", *r6("t", "x", "y", "z"))


@query
def pose_interpolation_rotation(spark, sf_dir):
    found = trajectory.interpolate(t.poses(spark, sf_dir), t.scan_times(spark, sf_dir), rotation=True)
    return found.select("traj_id", *r6("t", "x", "y", "z", "qw", "qx", "qy", "qz"))


@query
def poses_between(spark, sf_dir):
    return trajectory.poses_between(t.poses(spark, sf_dir), 3).select("traj_id", "step", *r6("t0", "x", "y", "z"))


@query
def knot_bracket(spark, sf_dir):
    found = trajectory.bracket(t.poses(spark, sf_dir), t.scan_times(spark, sf_dir), ["x"])
    return found.select("traj_id", *r6("t", "t0", "t1", "alpha"))


@query
def catmull_rom_slope(spark, sf_dir):
    return trajectory.slopes(t.poses(spark, sf_dir)).select("traj_id", *r6("t", "vx", "vy", "vz"))


@query
def end_slopes(spark, sf_dir):
    found = trajectory.slopes(t.poses(spark, sf_dir), "xy", ends={"x": (2.5, -1.5)})
    return found.select("traj_id", *r6("t", "vx", "vy"))


@query
def periodic_slopes(spark, sf_dir):
    return trajectory.slopes(t.poses(spark, sf_dir), "xy", periodic=True).select("traj_id", *r6("t", "vx", "vy"))


@query
def hermite_rotation(spark, sf_dir):
    found = rotations.hermite_turns(rotations.turn_slopes(t.poses(spark, sf_dir)), t.scan_times(spark, sf_dir))
    return found.select("traj_id", *r6("t", "qw", "qx", "qy", "qz"))


@query
def hermite_angular_velocity(spark, sf_dir):
    found = rotations.hermite_turns(rotations.turn_slopes(t.poses(spark, sf_dir)), t.scan_times(spark, sf_dir))
    return found.select("traj_id", *r6("t"), *r6("wx", "wy", "wz", digits=8))


@query
def cumulative_bspline_rotation(spark, sf_dir):
    return rotations.bspline_motions(t.poses(spark, sf_dir), 400.0, QUARTERS).select("traj_id", *r6("t", "x", "y", "z", "qw", "qx", "qy", "qz"))


@query
def curve_samples(spark, sf_dir):
    knots = trajectory.slopes(t.poses(spark, sf_dir), "xy")
    return trajectory.hermite(knots, trajectory.sample_times(knots, 6), "xy").select("traj_id", *r6("t", digits=3), *r6("x", "y", digits=4))


@query
def times_in_window(spark, sf_dir):
    return trajectory.times_in_window(t.poses(spark, sf_dir), 1_704_120_000.0).select("traj_id", *r6("t"))


def _hermite(spark, sf_dir, derivative):
    found = trajectory.hermite(trajectory.slopes(t.poses(spark, sf_dir), "xy"), t.scan_times(spark, sf_dir), "xy", derivative)
    return found.select("traj_id", *r6("t", "x", "y"))


@query
def hermite_eval(spark, sf_dir):
    return _hermite(spark, sf_dir, 0)


@query
def hermite_velocity(spark, sf_dir):
    return _hermite(spark, sf_dir, 1)


@query
def hermite_accel(spark, sf_dir):
    return _hermite(spark, sf_dir, 2)


@query
def cumulative_bspline(spark, sf_dir):
    return trajectory.cumulative_bspline(t.poses(spark, sf_dir), 400.0, offsets=QUARTERS).select("traj_id", *r6("t"), *aside("x", "y", "z"))


@query
def recursive_smoothing(spark, sf_dir):
    return rotations.smooth_motions(t.poses(spark, sf_dir), 400.0, QUARTERS).select("traj_id", "sample", *r6("t"), *aside("x", "y"), *r6("z", "qw", "qx", "qy", "qz"))


@query
def knot_upsert(spark, sf_dir):
    p = t.poses(spark, sf_dir).select("traj_id", "t", "x", "y")
    changes = p.where("traj_id % 2 = 0").withColumn("x", F.col("x") + 1).withColumn("t", F.when(F.col("y") < 50, F.col("t")).otherwise(F.col("t") + 0.5))
    return trajectory.upsert_knots(p, changes).select("traj_id", *r6("t", "x", "y"))


@query
def knot_delete(spark, sf_dir):
    p = t.poses(spark, sf_dir).select("traj_id", "t", "x")
    return trajectory.delete_knots(p, p.where("x < 20")).select("traj_id", *r6("t", "x"))


@query
def knot_range(spark, sf_dir):
    found = trajectory.knots_in_range(t.poses(spark, sf_dir).select("traj_id", "t", "x"), 1704120000.0, 1704200000.0)
    return found.select("traj_id", *r6("t", "x"))


@query
def knot_stats(spark, sf_dir):
    found = trajectory.knot_statistics(t.poses(spark, sf_dir))
    return found.select("traj_id", "n", *r6("min_t", "max_t"), *r6("mean_dt", "mean_distance", digits=4))


@query
def knot_lookup(spark, sf_dir):
    return trajectory.has_knots(t.poses(spark, sf_dir), t.scan_times(spark, sf_dir), 600.0).select("traj_id", *r6("t"), "present")


def _keyed(spark, sf_dir) -> DataFrame:
    """Detections as knots: in a third of the sequences frames come twice, in another keys do."""
    d = t.detections(spark, sf_dir)
    kind = F.col("seq_id") % 3
    return d.select(F.col("seq_id").alias("traj_id"), F.when(kind == 0, F.floor(F.col("frame") / 2)).otherwise(F.col("frame")).alias("t"), F.when(kind == 1, F.col("det_id") % 100).otherwise(F.col("det_id")).alias("key"), "x")


@query
def knot_consistency(spark, sf_dir):
    return trajectory.knot_consistency(_keyed(spark, sf_dir))


@query
def knots_by_key(spark, sf_dir):
    knots = _keyed(spark, sf_dir)
    keys = knots.where("x > 90").select((F.col("key") * 2).alias("key"))
    return trajectory.knots_by_key(knots, keys).select("key", "traj_id", "t", *r6("x"))


@query
def knot_differences(spark, sf_dir):
    p = t.poses(spark, sf_dir).select("traj_id", "t", "x", "y")
    shifted = p.withColumn("t", F.when(F.col("y") < 20, F.col("t") + 0.5).otherwise(F.col("t"))).withColumn("x", F.when(F.col("y") > 70, F.col("x") + 1).otherwise(F.col("x") + 0.25))
    return trajectory.knot_differences(p, shifted, ("x", "y"), 0.5)


@query
def sampling_policy(spark, sf_dir):
    return trajectory.sample_by_ratio(t.poses(spark, sf_dir).select("traj_id", "t", "x"), 4).select("traj_id", *r6("t", "x"))


@query
def slerp_eval(spark, sf_dir):
    found = trajectory.slerp_curve(t.poses(spark, sf_dir), t.scan_times(spark, sf_dir))
    return found.select("traj_id", *r6("t", "x", "y", "z", "qw", "qx", "qy", "qz"))


@query
def composition_eval(spark, sf_dir):
    p, times = t.poses(spark, sf_dir), t.scan_times(spark, sf_dir)
    base = trajectory.slerp_curve(p, times)
    correction = trajectory.slerp_curve(p.withColumns({"x": F.lit(0.5), "y": F.lit(0.0), "yaw": F.lit(0.1)}), times)
    return trajectory.compose(correction, base).select("traj_id", *r6("t", "x", "y", "z", "qw", "qx", "qy", "qz"))


@query
def transformed_curve(spark, sf_dir):
    p = t.poses(spark, sf_dir)
    q = g.euler_to_quaternion(F.col("roll"), F.col("pitch"), F.col("yaw"))
    knots = p.select("traj_id", "t", "x", "y", "z", *[v.alias(n) for v, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)])
    return trajectory.transform_curve(knots, (1.0, 2.0, 3.0), (0.5, 0.5, 0.5, 0.5)).select("traj_id", *r6("t", "x", "y", "z", "qw", "qx", "qy", "qz"))


@query
def closed_bspline(spark, sf_dir):
    return trajectory.closed_bspline(t.poses(spark, sf_dir)).select("traj_id", "i", *r6("px", "py"))


@query
def global_map(spark, sf_dir):
    scans = t.frames(spark, sf_dir)
    poses = scans.select("frame_id").distinct().select("frame_id", (F.col("frame_id") * 0.5).alias("tx"), F.lit(1.0).alias("ty"), F.lit(0.25).alias("tz"), F.lit(0.0).alias("roll"), F.lit(0.05).alias("pitch"), (F.col("frame_id") % 7 * 0.1).alias("yaw"))
    return trajectory.global_map(scans, poses).select("frame_id", "id", *r6("x", "y", "z"))


@query
def file_key_join(spark, sf_dir):
    p, s = t.poses(spark, sf_dir), t.scan_times(spark, sf_dir)
    key = F.format_string("%.6f", F.col("t"))
    named = p.select("traj_id", F.concat(key, F.lit(".pcd")).alias("file"))
    asked = s.select("traj_id", F.col("t")).union(p.select("traj_id", "t"))
    return asked.select("traj_id", F.concat(key, F.lit(".pcd")).alias("file")).join(named, ["traj_id", "file"])


# splines


def _pairs(spark, sf_dir) -> DataFrame:
    knots = trajectory.slopes(t.poses(spark, sf_dir).select("traj_id", "t", "x"), ["x"])
    return trajectory.segments(knots, ["x", "vx"]).withColumn("d", (F.col("t1") - F.col("t0")) / 1000)


def _coefficients(order: int) -> Query:
    def run(spark, sf_dir):
        c = {n: F.col(n) for n in ("x0", "x1", "vx0", "vx1", "d")}
        a = splines.coefficients(order, c["x0"], c["x1"], c["d"], c["vx0"], c["vx1"], F.lit(0.5), F.lit(-0.5))
        names = [f"a{k}" for k in range(order, -1, -1)]
        return _pairs(spark, sf_dir).where("d > 0.5").select("traj_id", "t0", *[v.alias(n) for v, n in zip(a, names, strict=True)]).select("traj_id", *r6("t0", *names))

    return run


for _order in range(1, 6):
    _QUERIES[f"poly_coeffs_{_order}"] = _coefficients(_order)


@query
def poly_eval(spark, sf_dir):
    p = t.poses(spark, sf_dir)
    start = p.groupBy("traj_id").agg(F.min("t").alias("start"))
    times = t.scan_times(spark, sf_dir).join(start, "traj_id").select("traj_id", (F.col("t") - F.col("start")).alias("t"))
    return splines.evaluate(splines.fit_linear(p), times, 1).select("traj_id", *r6("t", "pos", "vel", "acc", digits=5))


@query
def cubic_fit(spark, sf_dir):
    return splines.fit_cubic(t.poses(spark, sf_dir)).select("traj_id", "seg", *r6("duration", "a1", "a0"))


def _hours(spark, sf_dir) -> DataFrame:
    """Poses by hours from their trajectory's start, with a velocity and an acceleration of x that count at both ends."""
    p = t.poses(spark, sf_dir)
    start = p.groupBy("traj_id").agg(F.min("t").alias("start"))
    return p.join(start, "traj_id").select("traj_id", ((F.col("t") - F.col("start")) / 3600).alias("t"), "x", F.lit(0.5).alias("vx"), F.lit(-0.25).alias("ax"))


@query
def quintic_fit(spark, sf_dir):
    return splines.fit(_hours(spark, sf_dir), 5).select("traj_id", "seg", *r6("duration", "a5", "a4", "a3", "a2", "a1", "a0", digits=5))


@query
def fit_conditions(spark, sf_dir):
    """For each order and trajectory the pieces, and by how much places, velocities and accelerations miss what they have to meet."""
    p = _hours(spark, sf_dir)
    out = None
    for order in (3, 4, 5):
        names = [f"a{k}" for k in range(order, -1, -1)]
        pieces = ordered.beside(splines.fit(p, order), "traj_id", ["seg"], names[-3:], after=1)
        coefs, d = [F.col(a) for a in names], F.col("duration")
        value = [splines.polynomial(coefs, d, k) for k in range(3)]
        # beyond the last piece the given end; order 3 and a single piece of order 4 keep no acceleration there
        want = [F.col("a0_p1"), F.coalesce("a1_p1", F.lit(0.5)), F.coalesce(2 * F.col("a2_p1"), F.lit(-0.25) if order == 5 else F.when(F.lit(order == 4) & (F.col("seg") > 0), -0.25))]
        first = [(F.col("a1"), 0.5)] + ([(2 * F.col("a2"), -0.25)] if order == 5 else [])
        off = [F.abs(v - w) for v, w in zip(value, want, strict=True)]
        begin = [F.when(F.col("seg") == 0, F.abs(v - w)) for v, w in first]
        found = pieces.groupBy("traj_id").agg(F.count(F.lit(1)).alias("pieces"), *[F.max(F.coalesce(o, F.lit(0.0))).alias(c) for o, c in zip(off, ("off_place", "off_velocity", "off_acceleration"), strict=True)], F.max(F.greatest(*begin, F.lit(0.0))).alias("off_start"))
        found = found.withColumn("order", F.lit(order))
        out = found if out is None else out.unionByName(found)
    return out.select("order", "traj_id", "pieces", *r6("off_place", "off_velocity", "off_acceleration", "off_start", digits=4))


def _vector_curve(spark, sf_dir, derivative, digits):
    knots = trajectory.slopes(t.poses(spark, sf_dir), "xy")
    return splines.vector_curve(knots, t.scan_times(spark, sf_dir), ("x", "y", "yaw"), 5, derivative).select("traj_id", *r6("t"), *r6("x", "y", "yaw", digits=digits))


@query
def vector_curve(spark, sf_dir):
    return _vector_curve(spark, sf_dir, 0, 5)


@query
def vector_curve_velocity(spark, sf_dir):
    return _vector_curve(spark, sf_dir, 1, 6)


@query
def spline_validity(spark, sf_dir):
    fitted = splines.fit_linear(t.poses(spark, sf_dir))
    broken = fitted.withColumn("duration", F.when((F.col("traj_id") % 3 == 0) & (F.col("seg") == 2), -1.0).otherwise(F.col("duration")))
    return splines.is_valid(broken, 1)


# rings


def _scan(spark, sf_dir) -> DataFrame:
    return t.points_small(spark, sf_dir).withColumn("z", F.col("z") * 0.2)


@query
def range_image_scan16(spark, sf_dir):
    found = ring.range_image(t.points_small(spark, sf_dir), row_step=20.0, col_step=10.0)
    return found.select("row", "col", *r6("range"), "point_id", "covered")


@query
def scan_angle_range(spark, sf_dir):
    return ring.angle_range(t.points_small(spark, sf_dir)).select(*r6("min_v", "max_v", "min_h", "max_h"))


@query
def ring_projection(spark, sf_dir):
    return ring.project(_scan(spark, sf_dir)).select("row", "col", *r6("range"), "point_id", "covered")


@query
def cell_codes(spark, sf_dir):
    """Cells of the range image as single numbers."""
    found = ring.project(_scan(spark, sf_dir))
    return found.select("point_id", g.cell_code(F.col("row"), F.col("col")).alias("code")).select("point_id", *r6("code"))


@query
def indoor(spark, sf_dir):
    return ring.is_indoor(ring.project(_scan(spark, sf_dir)), far=3.0)


def _coarse(spark, sf_dir) -> DataFrame:
    return ring.project(_scan(spark, sf_dir), columns=60)


@query
def ring_ground(spark, sf_dir):
    return ring.ground(_coarse(spark, sf_dir), most_degrees=40.0).select("row", "col", "is_ground")


@query
def ring_ground_range(spark, sf_dir):
    return ring.ground_range(ring.ground(_coarse(spark, sf_dir), most_degrees=40.0)).select("col", *r6("max_range"))


def _segments(spark, sf_dir) -> DataFrame:
    return ring.segments(_coarse(spark, sf_dir), columns=60, angle=0.2, least=8, few=4, least_rows=2)


@query
def ring_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query
def ring_above_ground(spark, sf_dir):
    marked = ring.ground(_coarse(spark, sf_dir), most_degrees=40.0)
    found = ring.segmentation(marked, _segments(spark, sf_dir), 60)
    return found.select("point_id", "is_segmented", "is_outlier", "is_pure", "is_above_ground")


@query
def scan_end_angles(spark, sf_dir):
    return ring.end_angles(t.points_small(spark, sf_dir)).select(*r6("first", "last"))


def _rows(spark, sf_dir) -> DataFrame:
    """Events as cells of a dense scan: 16 rows, columns in the order of time."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 16).cast("int").alias("row"), "ts", "event_id", "value")
    col = (F.row_number().over(Window.partitionBy("row").orderBy("ts", "event_id")) - 1).cast("int")
    return e.select("row", col.alias("col"), F.col("value").alias("range"))


@query
def smoothness(spark, sf_dir):
    return ring.smoothness(_rows(spark, sf_dir)).select("row", "col", "block", *r6("s"))


@query
def smoothness_labels(spark, sf_dir):
    rated = ring.smoothness(_rows(spark, sf_dir)).withColumn("s", F.round("s", 6))
    return ring.smoothness_labels(rated)


# clusters and models


@query
def dbscan3d(spark, sf_dir):
    return cluster.dbscan(t.points_small(spark, sf_dir), 0.75, 6)


@query
def dbscan2d(spark, sf_dir):
    return cluster.dbscan(t.points_small(spark, sf_dir), 0.3, 6, ("x", "y"))


@query
def dbscan_first_visit(spark, sf_dir):
    return cluster.dbscan(t.points_small(spark, sf_dir), 0.3, 6, ("x", "y"), border="first_visit")


@query
def dbscan_boxes(spark, sf_dir):
    p = t.points_small(spark, sf_dir)
    found = cluster.cluster_boxes(p, cluster.dbscan(p, 0.2, 4, ("x", "y"), border="first_visit"), most_dx=6.0, most_dy=6.0)
    return found.select("cluster", "n", *r6(*[f"{m}_{c}" for c in "xyz" for m in ("min", "max", "avg")]))


@query
def euclidean_clusters(spark, sf_dir):
    return cluster.euclidean_clusters(t.points_small(spark, sf_dir), 0.5, 3, 4000)


@query
def adaptive_clusters(spark, sf_dir):
    return cluster.adaptive_clusters(t.points_small(spark, sf_dir), ((0, 2, 0.15), (2, 3, 0.3), (3, 8, 0.45)), 4, 1000)


@query
def voxel_then_cluster(spark, sf_dir):
    v = voxels.voxel_downsample(t.points_large(spark, sf_dir), 4.0)
    keyed = v.select((F.col("vx") * 1000 + F.col("vy")).alias("id"), *[F.round(c, 6).alias(c) for c in "xyz"])
    return cluster.euclidean_clusters(keyed, 5.0, 2)


@query
def conditional_clusters(spark, sf_dir):
    return cluster.euclidean_clusters(t.points_small(spark, sf_dir), 0.9, 2, keep=("intensity",), alike=lambda a, b: F.abs(a["intensity"] - b["intensity"]) < 2)


@query
def mean_shift(spark, sf_dir):
    return cluster.mean_shift(t.points_small(spark, sf_dir), 2, 1.0, 5).select("id", *r6("x", "y", "z"))


@query
def ransac_plane(spark, sf_dir):
    return ransac.planes(t.points_small(spark, sf_dir), 0.3, least=1, most_models=1).select("id", "model")


@query
def ransac_line(spark, sf_dir):
    return ransac.lines(t.points_small(spark, sf_dir), 0.3, least=1, most_models=1).select("id", "model")


@query
def ransac_planes_all(spark, sf_dir):
    return ransac.planes(t.points_small(spark, sf_dir), 0.3, least=20).select("id", "model", *r6("m0", "m1", "m2", "m3"))


@query
def pca_features(spark, sf_dir):
    return shape.pca_features(t.points_small(spark, sf_dir), 1.0).select("id", "n", *r6("l1", "l2", "l3", "linear", "planar", "scatter"))


@query
def normals(spark, sf_dir):
    return shape.normals(t.points_small(spark, sf_dir)).select("id", *r6("nx", "ny", "nz", "curvature"))


@query
def super_voxels(spark, sf_dir):
    return shape.super_voxels(t.points_small(spark, sf_dir), 1.5, 8, 0.4).select("vx", "vy", "vz", "n", *r6("planar"))


@query
def oriented_bbox(spark, sf_dir):
    found = shape.oriented_boxes(t.points_small(spark, sf_dir), "intensity")
    return found.select("intensity", "n", *r6(*[f"{m}_{k}" for m in ("min", "max") for k in (1, 2, 3)]))


@query
def region_grow(spark, sf_dir):
    return shape.grow_regions(t.points_small(spark, sf_dir), tolerance=0.8, most_degrees=30.0, least=3)


@query
def region_planes(spark, sf_dir):
    p = t.points_small(spark, sf_dir)
    found = shape.region_planes(p, shape.grow_regions(p, tolerance=0.8, most_degrees=30.0, least=3))
    return found.where("n > 3").select("cluster", "n", *r6("nx", "ny", "nz", "offset", digits=5), "upright")


# tracking


@query
def kalman_track(spark, sf_dir):
    return tracking.kalman(t.detections(spark, sf_dir)).select("seq_id", "frame", *r6("x", "y", "vx", "vy"))


@query
def multi_object_tracking(spark, sf_dir):
    return tracking.track(t.detections(spark, sf_dir)).select("seq_id", "frame", "track_id", "det_id", *r6("x", "y", "vx", "vy"), "dynamic")


# programs


@query
def dynamic_object_removal(spark, sf_dir):
    p = t.frames(spark, sf_dir)
    poses = p.select("frame_id").distinct().select("frame_id", *[F.lit(0.0).alias(f"t{c}") for c in "xyz"], F.lit(0.0).alias("roll"), F.lit(0.0).alias("pitch"), (F.col("frame_id") * 0.01).alias("yaw"))
    scans = p.select((F.col("frame_id") % 5).alias("seq_id"), "frame_id", "id", "x", "y", (F.col("y") / 50 - 1).alias("z"))
    found = programs.remove_dynamic_objects(scans, poses, programs.Scan(columns=360, ground_degrees=30.0, angle=0.3, radius=10.0, least=3))
    return found.select("frame_id", "id", *r6("x", "y", "z"))


@query
def interpolated_map(spark, sf_dir):
    poses, times = t.poses(spark, sf_dir), t.scan_times(spark, sf_dir)
    scans = times.select("traj_id", "t", F.lit(0).alias("id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    return programs.interpolated_map(poses, times, scans, 400.0).select("traj_id", *r6("t", "x", "y", "z"))


@query
def scan_features(spark, sf_dir):
    p = t.frames(spark, sf_dir).select((F.col("frame_id") % 4).alias("frame_id"), "id", "x", (F.col("y") - 50).alias("y"), (F.col("id") % 100 / 50 - 1).alias("z"))
    return programs.scan_features(p, programs.Scan(columns=360), block=60)


@query
def thinned_clusters(spark, sf_dir):
    return programs.thinned_clusters(t.points_small(spark, sf_dir), 0.3, 0.7).select("id", "cluster", *r6("x", "y", "z"))


@query
def region_grow_seeded(spark, sf_dir):
    return growing.grow_from_seeds(t.points_small(spark, sf_dir), k=12, k_normals=10, most_degrees=25.0, most_curvature=0.12, least=3)


@query
def hermite_sampling(spark, sf_dir):
    found = rotations.sample_hermite(t.poses(spark, sf_dir), 4, 30_000.0)
    return found.select("traj_id", *r6("t", "x", "y"), *aside("vx", "vy"), *[(F.round(F.col("wz") + 1e-12, 9) + 0.0).alias("wz")], "provisional")
