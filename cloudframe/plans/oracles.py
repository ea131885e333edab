"""The catalogue's queries in DuckDB's SQL."""

from __future__ import annotations

from cloudframe.sources.tables import SQL as TABLES

SQL: dict[str, str] = {}
XYZ = ("x", "y", "z")
ZERO = "CAST(0 AS DOUBLE)"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + {ZERO} AS {name}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def put(name: str, role: str | None, body: str, *more: str) -> None:
    """``role``: the tables the query starts from; ``more``: further common table expressions."""
    tables = [f"{x} AS ({TABLES[x]})" for x in (role or "").split()]
    recursive = "RECURSIVE " if any("UNION" in m for m in more) else ""
    SQL[name] = (f"WITH {recursive}" + ", ".join([*tables, *more]) + " " if tables or more else "") + body


def cells(leaf: float, names=XYZ) -> str:
    return ", ".join(f"CAST(floor({c} / {leaf}) AS BIGINT) AS v{c}" for c in names)


put("voxel_downsample", "points_large", f"SELECT {cells(5)}, count(*) AS n, {', '.join(r(f'avg({c})', c) for c in XYZ)} FROM points_large GROUP BY 1, 2, 3")
put("voxel_downsample_lineitem", "points_keyless", f"SELECT {cells(2)}, count(*) AS n, {', '.join(r(f'avg({c})', c) for c in XYZ)}, {r('avg(intensity)', 'intensity', 3)} FROM points_keyless GROUP BY 1, 2, 3")
put("voxel_blocks_min20", "points_large", f"SELECT vx, vy, vz, n, {', '.join(r(f'(v{c} + 0.5) * 10', f'c{c}') for c in XYZ)} FROM (SELECT {cells(10)}, count(*) AS n FROM points_large GROUP BY 1, 2, 3) WHERE n >= 20")
put("voxel_members", "points_large", f"SELECT id, vx, vy, vz FROM (SELECT id, {cells(10)}, count(*) OVER (PARTITION BY floor(x / 10), floor(y / 10), floor(z / 10)) AS n FROM points_large) WHERE n >= 20")
put("bbox_centroid", "frames", f"SELECT frame_id, count(*) AS n, {', '.join(r(f'{m}({c})', f'{m}_{c}') for c in XYZ for m in ('min', 'max', 'avg'))} FROM frames GROUP BY 1")

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
FLAT2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


def pairs(radius: float, d2: str = D2, source: str = "points_small", extra: str = "") -> str:
    return f"pairs AS (SELECT a.id, b.id AS nid, {d2} AS d2 FROM {source} a JOIN {source} b ON {d2} < {radius * radius!r}{extra})"


moments = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
put("covariance_about_point", "points_small", f"SELECT a.id, count(*) AS n, {', '.join(r(f'avg((b.{p} - a.{p}) * (b.{q} - a.{q}))', f'c{p}{q}') for p, q in moments)} FROM points_small a JOIN points_small b ON {D2} < 1.0 GROUP BY 1")
put(
    "rigid_transform_rpy", "points_small",
    f"SELECT id, {r('x1 * cos(-0.2) + z2 * sin(-0.2) + 1.5', 'x')}, {r('y2 - 2.0', 'y')}, {r('z2 * cos(-0.2) - x1 * sin(-0.2) + 0.5', 'z')}, intensity FROM (SELECT id, intensity, x1, y1 * cos(0.1) - z * sin(0.1) AS y2, y1 * sin(0.1) + z * cos(0.1) AS z2 FROM (SELECT *, x * cos(0.7) - y * sin(0.7) AS x1, x * sin(0.7) + y * cos(0.7) AS y1 FROM points_small))",
)
# w = .5, (qx, qy, qz) = (.5, .5, -.5) after the axes are permuted; translation (z, x, y) = (.5, 1.5, -2)
W, X, Y, Z = 0.5, 0.5, 0.5, -0.5
put(
    "quaternion_transform", "points_small",
    f"SELECT id, {r(f'({1 - 2 * (Y * Y + Z * Z)}) * x + ({2 * (X * Y - Z * W)}) * y + ({2 * (X * Z + Y * W)}) * z + 0.5', 'x')}, {r(f'({2 * (X * Y + Z * W)}) * x + ({1 - 2 * (X * X + Z * Z)}) * y + ({2 * (Y * Z - X * W)}) * z + 1.5', 'y')}, {r(f'({2 * (X * Z - Y * W)}) * x + ({2 * (Y * Z + X * W)}) * y + ({1 - 2 * (X * X + Y * Y)}) * z - 2.0', 'z')} FROM points_small",
)
OFF = "(x + 2 * y + 2 * z + 3) / CAST(9 AS DOUBLE)"
put("plane_projection", "points_small", f"SELECT id, {r(f'x - {OFF}', 'x')}, {r(f'y - 2 * {OFF}', 'y')}, {r(f'z - 2 * {OFF}', 'z')} FROM points_small")
put("flatten_points", "points_small", f"SELECT id, {rs('x', 'y')}, {ZERO} AS z FROM points_small")
put("spherical_coords", "points_small", f"SELECT id, {r('sqrt(x * x + y * y + z * z)', 'range')}, {r('degrees(atan2(z, sqrt(x * x + y * y)))', 'vang')}, {r('degrees(atan2(x, y))', 'hang')}, {r('CASE WHEN x <> 0 THEN degrees(atan(y / x)) END', 'folded')} FROM points_small")
HIGH = "CASE WHEN a > 3.1415 THEN -(a - 3.1415) ELSE -(3.1415 - a) END"
put(
    "wrap_angle", "frames",
    "SELECT id, " + ", ".join(r(f"CASE WHEN abs(a - 3) < 0.5 THEN {HIGH} WHEN abs(a + 3) < 0.5 THEN CASE WHEN a < -3.1415 THEN {low} ELSE {high} END ELSE a END", n) for n, low, high in (("a1", "-(a + 3.1415)", "a + 3.1415"), ("a2", "a + 3.1415", "-(a + 3.1415)"))) + " FROM (SELECT id, (y - 50) / 15 AS a FROM frames)",
)
put("euler_angles", "angles", f"SELECT id, {r('cr * cp * cy + sr * sp * sy', 'qw')}, {r('sr * cp * cy - cr * sp * sy', 'qx')}, {r('cr * sp * cy + sr * cp * sy', 'qy')}, {r('cr * cp * sy - sr * sp * cy', 'qz')}, {rs('roll', 'pitch', 'yaw')} FROM (SELECT *, {', '.join(f'{f}({a} / 2) AS {f[0]}{a[0]}' for f in ('cos', 'sin') for a in ('roll', 'pitch', 'yaw'))} FROM angles)")
put("spline_basis", "points_large", f"SELECT id, CAST(1 AS DOUBLE) AS b0, {r('(pow(u, 3) - 3 * u * u + 3 * u + 5) / 6', 'b1', 8)}, {r('(-2 * pow(u, 3) + 3 * u * u + 3 * u + 1) / 6', 'b2', 8)}, {r('pow(u, 3) / 6', 'b3', 8)} FROM (SELECT id, y / 100 AS u FROM points_large)")
TAU = [["pow(u,5)", "pow(u,4)", "pow(u,3)", "u*u", "u", "1"], ["5*pow(u,4)", "4*pow(u,3)", "3*u*u", "2*u", "1", "0"], ["20*pow(u,3)", "12*u*u", "6*u", "2", "0", "0"]]
put("tau_vectors", "points_large", "SELECT id, " + ", ".join(r(f"CAST({e} AS DOUBLE)", f"d{k}_{i}") for k, row in enumerate(TAU) for i, e in enumerate(row)) + " FROM (SELECT id, y / 100 AS u FROM points_large)")
put("stamp_differences", None, "SELECT event_id AS id, epoch_us(ts) - 1700000000999999 AS us FROM events")
put("coloured_types", "points_small", "SELECT id, r, g, CAST(255 - r - g // 2 AS INTEGER) AS b FROM (SELECT id, CASE intensity WHEN 1 THEN 255 WHEN 2 THEN 0 ELSE 128 END AS r, CASE intensity WHEN 1 THEN 0 WHEN 2 THEN 255 ELSE 128 END AS g FROM points_small)")

put("passthrough_z", "points_small", "SELECT id FROM points_small WHERE z BETWEEN -0.3 AND 5.0")
INSIDE = " AND ".join(f"{c} BETWEEN -1.5 AND 1.5" for c in XYZ)
put("crop_box", "points_small", f"SELECT id FROM points_small WHERE NOT ({INSIDE})")
put("crop_box_marks", "points_small", f"SELECT id, CASE WHEN {INSIDE} THEN intensity ELSE CAST(150 AS DOUBLE) END AS intensity FROM points_small")
put("points_in_boxes", "points_small", "SELECT DISTINCT p.id FROM points_small p JOIN boxes b ON " + " AND ".join(f"p.{c} >= b.min_{c} - 0.3 AND p.{c} <= b.max_{c} + 0.3" for c in XYZ), f"boxes AS (SELECT {cells(1.5)}, {', '.join(f'{m}({c}) AS {m}_{c}' for m in ('min', 'max') for c in XYZ)} FROM points_small GROUP BY 1, 2, 3 HAVING count(*) >= 8)")
put("range_gate", "points_small", "SELECT id FROM points_small WHERE sqrt(x * x + y * y + z * z) >= 2")
put("near_points", "points_small", "SELECT id FROM points_small WHERE sqrt(x * x + y * y + z * z) < 1")
put("anti_join_indices", "points_small", "SELECT id FROM points_small WHERE NOT intensity < 3")
put("semi_join_indices", "points_small", "SELECT id FROM points_small WHERE intensity < 3")
RANKED = f"ranked AS (SELECT a.id, b.id AS nid, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS rank FROM points_small a CROSS JOIN points_small b)"
put("statistical_outlier", "points_small", "SELECT id FROM means WHERE d <= (SELECT avg(d) + stddev_samp(d) FROM means)", RANKED, "means AS (SELECT id, avg(sqrt(d2)) AS d FROM ranked WHERE rank <= 61 AND id <> nid GROUP BY 1)")
put("radius_outlier", "points_small", "SELECT id, count(*) - 1 AS n FROM pairs GROUP BY 1 HAVING count(*) - 1 >= 5", pairs(0.8))
steps, last = [], "points_small"
for k, (half, most) in enumerate(((1.5, 1.0), (2.5, 3.0), (4.5, 5.0), (8.5, 6.0), (16.5, 6.0))):
    box = f"abs(a.x - b.x) <= {half} AND abs(a.y - b.y) <= {half}"
    steps += [f"low{k} AS (SELECT a.id, a.x, a.y, min(b.z) AS w FROM {last} a JOIN {last} b ON {box} GROUP BY 1, 2, 3)", f"open{k} AS (SELECT a.id, max(b.w) AS w FROM low{k} a JOIN low{k} b ON {box} GROUP BY 1)", f"kept{k} AS (SELECT p.id, p.x, p.y, p.z FROM {last} p JOIN open{k} o USING (id) WHERE p.z - o.w < {most})"]
    last = f"kept{k}"
put("morphological_ground", "points_small", f"SELECT id, id IN (SELECT id FROM {last}) AS is_ground FROM points_small", *steps)

put("radius_neighbors", "points_small", f"SELECT id, nid, {r('d2', 'd2')} FROM pairs", pairs(1.0))
put("radius_neighbor_counts", "points_large", f"SELECT a.id, count(*) AS n FROM points_large a JOIN points_large b ON a.x - b.x < 2 AND b.x - a.x < 2 AND {FLAT2} < 4.0 GROUP BY 1")
put("knn", "points_small", f"SELECT id, nid, CAST(rank AS INTEGER) AS rank, {r('sqrt(d2)', 'd')} FROM ranked WHERE rank <= 6", RANKED)
put("nearest_target", "frames", f"SELECT s.id, b.target_id, {r('b.d', 'd')} FROM frames s LEFT JOIN (SELECT id, target_id, d FROM (SELECT a.id, b.id AS target_id, sqrt({FLAT2}) AS d, row_number() OVER (PARTITION BY a.id ORDER BY {FLAT2}, b.id) AS k FROM frames a JOIN frames b ON a.frame_id = b.frame_id AND b.id % 4 = 0 AND a.id % 4 > 0 AND {FLAT2} < 400.0) WHERE k = 1) b USING (id) WHERE s.id % 4 > 0")


def segments(fields: str, source: str = "poses") -> str:
    cols = ", ".join(f"{c} AS {c}0, lead({c}) OVER w AS {c}1" for c in fields.split())
    return f"segs AS (SELECT traj_id, t AS t0, lead(t) OVER w AS t1, {cols}, max(t) OVER (PARTITION BY traj_id) AS tmax FROM {source} WINDOW w AS (PARTITION BY traj_id ORDER BY t))"


OPEN = "held AS (SELECT s.traj_id, s.t, g.* EXCLUDE (traj_id), (s.t - t0) / (t1 - t0) AS a, t1 - t0 AS dt FROM scan_times s JOIN segs g ON s.traj_id = g.traj_id AND s.t >= t0 AND s.t < t1)"
CLOSED = OPEN.replace("s.t < t1)", "(s.t < t1 OR s.t = t1 AND t1 = tmax))")
lerp = lambda c: r(f"{c}0 + a * ({c}1 - {c}0)", c)
put("pose_interval_join", "poses scan_times", f"SELECT traj_id, {rs('t')}, {', '.join(map(lerp, XYZ))} FROM held", segments("x y z"), OPEN)
# the turn is about z only: half the angle of the shorter way
YAW = "yaws AS (SELECT *, yaw0 + a * (yaw1 - yaw0) AS yaw FROM held)"
SIGN = "CASE WHEN cos((yaw1 - yaw0) / 2) < 0 THEN NULL ELSE 1 END"
quaternion = f"{r('cos(yaw / 2)', 'qw')}, {ZERO} AS qx, {ZERO} AS qy, {r('sin(yaw / 2)', 'qz')}"
put("pose_interpolation_rotation", "poses scan_times", f"SELECT traj_id, {rs('t')}, {', '.join(map(lerp, XYZ))}, {quaternion} FROM yaws", segments("x y z yaw"), OPEN, YAW)
put("slerp_eval", "poses scan_times", f"SELECT traj_id, {rs('t')}, {', '.join(map(lerp, XYZ))}, {quaternion} FROM yaws", segments("x y z yaw"), CLOSED, YAW)
put("composition_eval", "poses scan_times", f"SELECT traj_id, {rs('t')}, {r('x * cos(0.1) - y * sin(0.1) + 0.5', 'x')}, {r('x * sin(0.1) + y * cos(0.1)', 'y')}, {ZERO} AS z, {r('cos((yaw + 0.1) / 2)', 'qw')}, {ZERO} AS qx, {ZERO} AS qy, {r('sin((yaw + 0.1) / 2)', 'qz')} FROM (SELECT traj_id, t, x0 + a * (x1 - x0) AS x, y0 + a * (y1 - y0) AS y, yaw FROM yaws)", segments("x y z yaw"), CLOSED, YAW)
put("transformed_curve", "poses", f"SELECT traj_id, {rs('t')}, {r('z + 1', 'x')}, {r('x + 2', 'y')}, {r('y + 3', 'z')}, {r('(c - s) / 2', 'qw')}, {r('(c + s) / 2', 'qx')}, {r('(c - s) / 2', 'qy')}, {r('(c + s) / 2', 'qz')} FROM (SELECT *, cos(yaw / 2) AS c, sin(yaw / 2) AS s FROM poses)")
put("poses_between", "poses", f"SELECT traj_id, CAST(step AS INTEGER) AS step, {rs('t0')}, {', '.join(r(f'{c}0 + step / CAST(4 AS DOUBLE) * ({c}1 - {c}0)', c) for c in XYZ)} FROM segs, range(1, 4) s(step) WHERE t1 IS NOT NULL", segments("x y z"))
put("knot_bracket", "poses scan_times", f"SELECT traj_id, {rs('t', 't0', 't1')}, {r('a', 'alpha')} FROM held", segments("x"), CLOSED)
SLOPE = lambda c: f"coalesce((lead({c}) OVER w - lag({c}) OVER w) / (lead(t) OVER w - lag(t) OVER w), 0)"
WINDOW = "WINDOW w AS (PARTITION BY traj_id ORDER BY t)"
put("catmull_rom_slope", "poses", f"SELECT traj_id, {rs('t')}, {', '.join(r(SLOPE(c), f'v{c}') for c in XYZ)} FROM poses {WINDOW}")
SLOPED = f"sloped AS (SELECT traj_id, t, x, y, {SLOPE('x')} AS vx, {SLOPE('y')} AS vy FROM poses {WINDOW})"
for name, basis, scale in (
    ("hermite_eval", ("2*a*a*a - 3*a*a + 1", "a*a*a - 2*a*a + a", "-2*a*a*a + 3*a*a", "a*a*a - a*a"), "1"),
    ("hermite_velocity", ("6*a*a - 6*a", "3*a*a - 4*a + 1", "-6*a*a + 6*a", "3*a*a - 2*a"), "dt"),
    ("hermite_accel", ("12*a - 6", "6*a - 4", "-12*a + 6", "6*a - 2"), "(dt * dt)"),
):
    curve = lambda c: r(f"(({basis[0]}) * {c}0 + ({basis[1]}) * dt * v{c}0 + ({basis[2]}) * {c}1 + ({basis[3]}) * dt * v{c}1) / {scale}", c)  # noqa: B023, E731
    put(name, "poses scan_times", f"SELECT traj_id, {rs('t')}, {curve('x')}, {curve('y')} FROM held", SLOPED, segments("x y vx vy", "sloped"), CLOSED)
put("knot_upsert", "poses", f"SELECT traj_id, {rs('t', 'x', 'y')} FROM (SELECT traj_id, t, x, y FROM changes UNION ALL SELECT traj_id, t, x, y FROM poses p WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.traj_id = p.traj_id AND c.t = p.t))", "changes AS (SELECT traj_id, CASE WHEN y < 50 THEN t ELSE t + 0.5 END AS t, x + 1 AS x, y FROM poses WHERE traj_id % 2 = 0)")
put("knot_delete", "poses", f"SELECT traj_id, {rs('t', 'x')} FROM poses WHERE NOT x < 20")
put("knot_range", "poses", f"SELECT traj_id, {rs('t', 'x')} FROM (SELECT *, lead(t) OVER w AS a, lag(t) OVER w AS b FROM poses {WINDOW}) WHERE coalesce(a > 1704120000, t >= 1704120000) AND coalesce(b < 1704200000, t <= 1704200000)")
put("knot_stats", "poses", f"SELECT traj_id, count(*) AS n, {r('min(t)', 'min_t')}, {r('max(t)', 'max_t')}, {r('avg(dt)', 'mean_dt', 4)}, {r('avg(d)', 'mean_distance', 4)} FROM (SELECT traj_id, t, t - lag(t) OVER w AS dt, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM poses {WINDOW}) GROUP BY 1")
put("knot_lookup", "poses scan_times", f"SELECT traj_id, {rs('t')}, EXISTS (SELECT 1 FROM poses p WHERE p.traj_id = s.traj_id AND p.t >= s.t - 600 AND p.t <= s.t + 600) AS present FROM scan_times s")
KEYED = "keyed AS (SELECT seq_id AS traj_id, CASE WHEN seq_id % 3 = 0 THEN frame // 2 ELSE frame END AS t, CASE WHEN seq_id % 3 = 1 THEN det_id % 100 ELSE det_id END AS key, x FROM detections)"
put("knot_consistency", "detections", "SELECT traj_id, count(*) AS n, count(DISTINCT key) AS n_keys, count(DISTINCT t) AS n_times, count(*) = count(DISTINCT key) AND count(*) = count(DISTINCT t) AS consistent FROM keyed GROUP BY 1", KEYED)
put("knots_by_key", "detections", f"SELECT key, traj_id, t, {r('x', 'x')} FROM (SELECT DISTINCT key * 2 AS key FROM keyed WHERE x > 90) LEFT JOIN keyed USING (key)", KEYED)
put("knot_differences", "poses", "SELECT coalesce(a.traj_id, b.traj_id) AS traj_id, count(*) FILTER (abs(a.x - b.x) <= 0.5 AND abs(a.y - b.y) <= 0.5) AS n_same, count(*) FILTER (abs(a.x - b.x) > 0.5 OR abs(a.y - b.y) > 0.5) AS n_moved, count(*) FILTER (b.t IS NULL) AS n_left, count(*) FILTER (a.t IS NULL) AS n_right FROM poses a FULL JOIN shifted b ON a.traj_id = b.traj_id AND a.t = b.t GROUP BY 1", "shifted AS (SELECT traj_id, CASE WHEN y < 20 THEN t + 0.5 ELSE t END AS t, CASE WHEN y > 70 THEN x + 1 ELSE x + 0.25 END AS x, y FROM poses)")
put("sampling_policy", "poses", f"SELECT traj_id, {rs('t', 'x')} FROM (SELECT *, row_number() OVER w AS n, lead(t) OVER w AS m FROM poses {WINDOW}) WHERE n % 4 = 0 OR m IS NULL")
put("global_map", "frames", f"SELECT frame_id, id, {r('x1 * cos(0.05) + z * sin(0.05) + frame_id * 0.5', 'x')}, {r('y1 + 1', 'y')}, {r('z * cos(0.05) - x1 * sin(0.05) + 0.25', 'z')} FROM (SELECT *, x * cos(w) - y * sin(w) AS x1, x * sin(w) + y * cos(w) AS y1 FROM (SELECT *, frame_id % 7 * 0.1 AS w FROM frames))")
put("file_key_join", "poses scan_times", "SELECT a.traj_id, a.file FROM (SELECT traj_id, format('{:.6f}.pcd', t) AS file FROM (SELECT traj_id, t FROM scan_times UNION ALL SELECT traj_id, t FROM poses)) a JOIN (SELECT traj_id, format('{:.6f}.pcd', t) AS file FROM poses) b USING (traj_id, file)")

XSLOPE = f"sloped AS (SELECT traj_id, t, x, {SLOPE('x')} AS vx FROM poses {WINDOW})"
ENDS = "ends AS (SELECT traj_id, t0, x0, x1, vx0 AS v0, vx1 AS v1, d, x1 - x0 AS h, x1 - x0 - vx0 * d - 0.5 * d * d / 2 AS r, vx1 - vx0 - 0.5 * d AS s, CAST(-1 AS DOUBLE) AS q FROM (SELECT *, (t1 - t0) / 1000 AS d FROM segs) WHERE d > 0.5)"
COEFS = {
    1: ["h / d", "x0"],
    2: ["(h - v0 * d) / (d * d)", "v0", "x0"],
    3: ["((v0 + v1) * d - 2 * h) / (d*d*d)", "(3 * h - (2 * v0 + v1) * d) / (d*d)", "v0", "x0"],
    4: ["(s * d - 3 * r) / (d*d*d*d)", "(4 * r - s * d) / (d*d*d)", f"{ZERO} + 0.25", "v0", "x0"],
    5: ["(12 * r - 6 * s * d + q * d * d) / (2 * d*d*d*d*d)", "(-30 * r + 14 * s * d - 2 * q * d * d) / (2 * d*d*d*d)", "(20 * r - 8 * s * d + q * d * d) / (2 * d*d*d)", f"{ZERO} + 0.25", "v0", "x0"],
}
for order, each in COEFS.items():
    put(f"poly_coeffs_{order}", "poses", f"SELECT traj_id, {rs('t0')}, {', '.join(r(e, f'a{order - i}') for i, e in enumerate(each))} FROM ends", XSLOPE, segments("x vx", "sloped"), ENDS)
put(
    "poly_eval", "poses scan_times",
    f"SELECT traj_id, {r('asked', 't', 5)}, {r('x0 + (u - t0) * (x1 - x0) / (t1 - t0)', 'pos', 5)}, {r('(x1 - x0) / (t1 - t0)', 'vel', 5)}, {ZERO} AS acc FROM asked JOIN (SELECT traj_id, t0 - first AS t0, t1 - first AS t1, x0, x1, tmax - first AS stop FROM segs JOIN starts USING (traj_id) WHERE t1 IS NOT NULL) g USING (traj_id) WHERE u >= t0 AND (u < t1 OR u = t1 AND t1 = stop)",
    segments("x"), "starts AS (SELECT traj_id, min(t) AS first, max(t) AS latest FROM poses GROUP BY 1)", "asked AS (SELECT s.traj_id, s.t - first AS asked, greatest(0, least(s.t - first, latest - first)) AS u FROM scan_times s JOIN starts USING (traj_id))",
)
put("spline_validity", "poses", "SELECT traj_id, traj_id % 3 <> 0 OR count(*) < 4 AS valid FROM poses GROUP BY 1")

SCAN = "scan AS (SELECT id, x, y, z * 0.2 AS z FROM points_small)"


def image(columns: int) -> str:
    step = 360 / columns
    turned = f"((degrees(atan2(x, y)) - 90) / {step!r})"
    col = f"CAST(-(sign({turned}) * floor(abs({turned}) + 0.5)) + {columns // 2} AS INTEGER)"
    return f"cells AS (SELECT id, x, y, z, sqrt(x*x + y*y + z*z) AS range, CAST(trunc((degrees(atan2(z, sqrt(x*x + y*y))) + 15.1) / 2) AS INTEGER) AS row, CASE WHEN {col} >= {columns} THEN {col} - {columns} ELSE {col} END AS col FROM scan), image AS (SELECT row, col, max(id) AS point_id, count(*) - 1 AS covered, arg_max(range, id) AS range, arg_max(x, id) AS x, arg_max(y, id) AS y, arg_max(z, id) AS z FROM cells WHERE row BETWEEN 0 AND 15 AND col BETWEEN 0 AND {columns - 1} GROUP BY 1, 2)"


put("ring_projection", "points_small", f"SELECT row, col, {rs('range')}, point_id, covered FROM image", SCAN, image(1800))
put("cell_codes", "points_small", f"SELECT point_id, {r('row + col / 10000.0', 'code')} FROM image", SCAN, image(1800))
put("indoor", "points_small", "SELECT count(*) FILTER (range > 3) < 20 AS indoor FROM image", SCAN, image(1800))
DENSE = f"dense AS (SELECT * FROM points_small WHERE id IN (SELECT a.id FROM points_small a JOIN points_small b ON {D2} < 9.0 GROUP BY 1 HAVING count(*) >= 6))"
ANGLES = "SELECT id, sqrt(x*x + y*y + z*z) AS range, degrees(atan2(z, sqrt(x*x + y*y))) AS v, CASE WHEN x <> 0 THEN degrees(atan(y / x)) END AS h FROM"
put("scan_angle_range", "points_small", f"SELECT {r('least(min(v), 1000)', 'min_v')}, {r('greatest(max(v), 0)', 'max_v')}, {r('least(min(h), 1000)', 'min_h')}, {r('greatest(max(h), 0)', 'max_h')} FROM ({ANGLES} points_small)")
put("range_image_scan16", "points_small", f"SELECT row, col, {r('arg_max(range, id)', 'range')}, max(id) AS point_id, count(*) - 1 AS covered FROM (SELECT id, range, CAST(floor((v - (SELECT min(v) FROM angles)) / 20) AS INTEGER) AS row, CAST(floor((h - (SELECT min(h) FROM angles)) / 10) AS INTEGER) AS col FROM angles WHERE h IS NOT NULL) GROUP BY 1, 2", DENSE, f"angles AS ({ANGLES} dense)")
FLAT = "abs(degrees(atan2(u.z - i.z, sqrt(pow(u.x - i.x, 2) + pow(u.y - i.y, 2))))) <= 40"
MARKED = f"paired AS (SELECT i.row, i.col, u.row IS NOT NULL AS paired, coalesce({FLAT}, false) AS flat FROM image i LEFT JOIN image u ON u.row = i.row + 1 AND u.col = i.col WHERE i.row <= 6), marked AS (SELECT i.*, i.row <= 7 AND (coalesce(p.flat, false) OR (coalesce(b.flat, false) AND (coalesce(p.paired, false) OR i.row > 6))) AS is_ground FROM image i LEFT JOIN paired p USING (row, col) LEFT JOIN paired b ON b.row = i.row - 1 AND b.col = i.col)"
put("ring_ground", "points_small", "SELECT row, col, is_ground FROM marked", SCAN, image(60), MARKED)
put("ring_ground_range", "points_small", f"SELECT col, {r('coalesce(max(range) FILTER (is_ground), 0)', 'max_range')} FROM marked GROUP BY 1", SCAN, image(60), MARKED)


def reach(edges: str) -> str:
    """Transitive closure of ``edges`` (u, v), and the least node that each reaches."""
    return f"edges AS ({edges}), reach AS (SELECT u, v FROM edges UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u), parts AS (SELECT u, least(u, min(v)) AS first FROM reach GROUP BY 1)"


ANGLE = "atan2(least(a.range, b.range) * sin(radians({0})), greatest(a.range, b.range) - least(a.range, b.range) * cos(radians({0}))) > 0.2"
BESIDE = f"a.row = b.row AND b.col = (a.col + 1) % 60 AND {ANGLE.format('6.0')}"
ABOVE = f"b.row = a.row + 1 AND a.col = b.col AND {ANGLE.format('2.0')}"
ADJACENT = f"touch AS (SELECT a.row * 60 + a.col AS u, b.row * 60 + b.col AS v FROM image a JOIN image b ON ({BESIDE}) OR ({ABOVE}))"
LABELLED = "placed AS (SELECT i.row, i.col, i.row * 60 + i.col AS u, coalesce(p.first, i.row * 60 + i.col) AS first FROM image i LEFT JOIN parts p ON p.u = i.row * 60 + i.col), valid AS (SELECT first, row_number() OVER (ORDER BY first) AS label FROM (SELECT first FROM placed GROUP BY 1 HAVING count(*) >= 8 OR (count(*) >= 4 AND count(DISTINCT CASE WHEN u <> first THEN row END) >= 2))), labels AS (SELECT row, col, coalesce(label, 0) AS label FROM placed LEFT JOIN valid USING (first))"
RING = (SCAN, image(60), ADJACENT, reach("SELECT u, v FROM touch UNION SELECT v, u FROM touch"), LABELLED)
put("ring_segments", "points_small", "SELECT row, col, label FROM labels", *RING)
put("ring_above_ground", "points_small", "SELECT point_id, label > 0 OR (is_ground AND (col % 5 = 0 OR col <= 5 OR col >= 55)) AS is_segmented, label = 0 AND row > 7 AND col % 5 = 0 AS is_outlier, label > 0 AS is_pure, NOT is_ground AND range < far AS is_above_ground FROM marked JOIN labels USING (row, col) JOIN (SELECT col, coalesce(max(range) FILTER (is_ground), 0) AS far FROM marked GROUP BY 1) USING (col)", *RING, MARKED)
put("scan_end_angles", "points_small", f"SELECT {r('f', 'first')}, {r('l + CASE WHEN l - f > 3 * pi() THEN -2 * pi() WHEN l - f < pi() THEN 2 * pi() ELSE 0 END', 'last')} FROM (SELECT arg_min(-atan2(y, x), id) AS f, arg_max(-atan2(y, x), id) + 2 * pi() AS l FROM points_small)")
ROWS = "rows_ AS (SELECT CAST(user_id % 16 AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) - 1 AS INTEGER) AS col, value AS range FROM events)"
RATED = "rated AS (SELECT row, col, CAST(col // 180 AS INTEGER) AS block, abs(total - n * range) / (n * range) AS s FROM (SELECT *, sum(range) FILTER (range > 1) OVER w AS total, count(*) FILTER (range > 1) OVER w AS n FROM rows_ WINDOW w AS (PARTITION BY row ORDER BY col RANGE BETWEEN 9 PRECEDING AND 8 FOLLOWING)) WHERE range >= 1 AND n >= 9 AND col % 180 BETWEEN 9 AND 179)"
put("smoothness", None, f"SELECT row, col, block, {rs('s')} FROM rated", ROWS, RATED)
put("smoothness_labels", None, "SELECT row, col, CAST(CASE WHEN s < flat THEN 2 WHEN s >= edge THEN 1 ELSE 0 END AS INTEGER) AS type FROM ranked JOIN (SELECT row, block, count(*) AS n, max(s) FILTER (up = 4) AS flat, max(s) FILTER (down = 3) AS edge FROM ranked GROUP BY 1, 2) USING (row, block) WHERE n > 9", ROWS, RATED, "ranked AS (SELECT row, col, block, round(s, 6) AS s, row_number() OVER (PARTITION BY row, block ORDER BY round(s, 6), col) AS up, row_number() OVER (PARTITION BY row, block ORDER BY round(s, 6) DESC, col) AS down FROM rated)")


def dbscan(eps: float, least: int, d2: str, overwrite: bool) -> tuple[str, ...]:
    border = "CASE WHEN seeded > low THEN seeded ELSE low END" if overwrite else "CASE WHEN id > low THEN low END"
    return (
        pairs(eps, d2),
        f"core AS (SELECT id FROM pairs GROUP BY 1 HAVING count(*) >= {least})",
        reach("SELECT id AS u, nid AS v FROM pairs WHERE id IN (SELECT id FROM core) AND nid IN (SELECT id FROM core) UNION SELECT id, id FROM core"),
        f"found AS (SELECT u AS id, first FROM parts UNION ALL SELECT id, {border} AS first FROM (SELECT p.id, min(first) AS low, max(CASE WHEN nid = first THEN first END) AS seeded FROM pairs p JOIN parts ON parts.u = p.nid WHERE p.id NOT IN (SELECT id FROM core) GROUP BY 1))",
        "clusters AS (SELECT p.id, coalesce(number, 0) AS cluster FROM points_small p LEFT JOIN found USING (id) LEFT JOIN (SELECT first, row_number() OVER (ORDER BY first) AS number FROM (SELECT DISTINCT first FROM found WHERE first IS NOT NULL)) USING (first))",
    )


put("dbscan3d", "points_small", "SELECT id, cluster FROM clusters", *dbscan(0.75, 6, D2, True))
put("dbscan2d", "points_small", "SELECT id, cluster FROM clusters", *dbscan(0.3, 6, FLAT2, True))
put("dbscan_first_visit", "points_small", "SELECT id, cluster FROM clusters", *dbscan(0.3, 6, FLAT2, False))
put("dbscan_boxes", "points_small", f"SELECT cluster, count(*) AS n, {', '.join(r(f'{m}({c})', f'{m}_{c}') for c in XYZ for m in ('min', 'max', 'avg'))} FROM points_small JOIN clusters USING (id) WHERE cluster > 0 AND (SELECT count(DISTINCT cluster) FROM clusters WHERE cluster > 0) > 3 GROUP BY 1 HAVING max(x) - min(x) <= 6 AND max(y) - min(y) <= 6 AND max(z) - min(z) >= 0.3", *dbscan(0.2, 4, FLAT2, False))


def components(edges: str, source: str, least: int, most: int | None) -> tuple[str, ...]:
    upper = f" AND count(*) <= {most}" if most else ""
    return (
        reach(edges),
        f"placed AS (SELECT p.id, coalesce(first, p.id) AS first FROM {source} p LEFT JOIN parts ON parts.u = p.id)",
        f"clusters AS (SELECT id, number AS cluster FROM placed JOIN (SELECT first, row_number() OVER (ORDER BY first) AS number FROM placed GROUP BY 1 HAVING count(*) >= {least}{upper}) USING (first))",
    )


EDGES = "SELECT id AS u, nid AS v FROM pairs"
put("euclidean_clusters", "points_small", "SELECT id, cluster FROM clusters", pairs(0.5), *components(EDGES, "points_small", 3, 4000))
put("conditional_clusters", "points_small", "SELECT id, cluster FROM clusters", pairs(0.9, extra=" AND abs(a.intensity - b.intensity) < 2"), *components(EDGES, "points_small", 2, None))
RINGS = "rings AS (SELECT id, x, y, z, CASE WHEN d > 0 AND d <= 2 THEN 0 WHEN d > 2 AND d <= 3 THEN 1 WHEN d > 3 AND d <= 8 THEN 2 END AS ring FROM (SELECT *, sqrt(x*x + y*y + z*z) AS d FROM points_small WHERE z BETWEEN -0.3 AND 5)), full_rings AS (SELECT * FROM rings WHERE ring IN (SELECT ring FROM rings GROUP BY 1 HAVING count(*) > 4))"
put("adaptive_clusters", "points_small", "SELECT id, CAST(ring AS INTEGER) AS ring, row_number() OVER () * 0 + cluster AS cluster FROM (SELECT id, ring, dense_rank() OVER (PARTITION BY ring ORDER BY first) AS cluster FROM placed JOIN full_rings USING (id) WHERE first IN (SELECT first FROM placed GROUP BY 1 HAVING count(*) BETWEEN 4 AND 1000))", RINGS, *components(f"SELECT a.id AS u, b.id AS v FROM full_rings a JOIN full_rings b ON a.ring = b.ring AND {FLAT2} < CASE a.ring WHEN 0 THEN {0.15 * 0.15!r} WHEN 1 THEN {0.3 * 0.3!r} ELSE {0.45 * 0.45!r} END", "full_rings", 4, 1000)[:2])
put("voxel_then_cluster", "points_large", "SELECT id, cluster FROM clusters", f"voxels AS (SELECT vx * 1000 + vy AS id, x, y, z FROM (SELECT {cells(4)}, {', '.join(f'round(avg({c}), 6) AS {c}' for c in XYZ)} FROM points_large GROUP BY 1, 2, 3))", pairs(5.0, source="voxels"), *components(EDGES, "voxels", 2, None))
SHIFT = lambda k, source: f"s{k} AS (SELECT a.id, CASE WHEN count(*) >= 5 THEN avg(b.x) ELSE any_value(a.x) END AS x, CASE WHEN count(*) >= 5 THEN avg(b.y) ELSE any_value(a.y) END AS y, CASE WHEN count(*) >= 5 THEN avg(b.z) ELSE any_value(a.z) END AS z FROM {source} a JOIN {source} b ON {D2} < 1.0 GROUP BY 1)"
put("mean_shift", "points_small", f"SELECT id, {rs(*XYZ)} FROM s2", SHIFT(1, "points_small"), SHIFT(2, "s1"))

HASHED = "hashed AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS k FROM points_small)"
TRIPLES = "triples AS (SELECT a.k // 3 AS h, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM hashed a JOIN hashed b ON b.k = a.k + 1 JOIN hashed c ON c.k = a.k + 2 WHERE a.k % 3 = 0 AND a.k + 2 < 2400), planes AS (SELECT h, ax, ay, az, nx / l AS nx, ny / l AS ny, nz / l AS nz FROM (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS l FROM (SELECT h, ax, ay, az, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM triples)))"
ON_PLANE = "abs((p.x - ax) * nx + (p.y - ay) * ny + (p.z - az) * nz) < 0.3"
WAYS = "ways AS (SELECT a.k // 2 AS h, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz FROM hashed a JOIN hashed b ON b.k = a.k + 1 WHERE a.k % 2 = 0 AND a.k + 1 < 1600), lines AS (SELECT h, ax, ay, az, ux / l AS ux, uy / l AS uy, uz / l AS uz FROM (SELECT *, sqrt(ux*ux + uy*uy + uz*uz) AS l FROM ways))"
ON_LINE = "sqrt(pow((p.y - ay) * uz - (p.z - az) * uy, 2) + pow((p.z - az) * ux - (p.x - ax) * uz, 2) + pow((p.x - ax) * uy - (p.y - ay) * ux, 2)) < 0.3"

# per axis a filter of (place, speed): p11, p12, p22 is its covariance; the gains follow from it
put(
    "kalman_track", "detections",
    f"SELECT seq_id, frame, {rs('x', 'y', 'vx', 'vy')} FROM steps",
    """steps AS (SELECT seq_id, frame, x, y, CAST(0 AS DOUBLE) AS vx, CAST(0 AS DOUBLE) AS vy, CAST(1 AS DOUBLE) AS p11, CAST(0 AS DOUBLE) AS p12, CAST(1 AS DOUBLE) AS p22 FROM detections WHERE frame = 1
    UNION ALL SELECT seq_id, frame, px + k1 * (zx - px), py + k1 * (zy - py), vx + k2 * (zx - px), vy + k2 * (zy - py), q11 - k1 * q11, q12 - k1 * q12, q22 - k2 * q12
    FROM (SELECT *, q11 / (q11 + 0.1) AS k1, q12 / (q11 + 0.1) AS k2 FROM (SELECT d.seq_id, d.frame, d.x AS zx, d.y AS zy, s.x + 0.1 * s.vx AS px, s.y + 0.1 * s.vy AS py, s.vx, s.vy, s.p11 + 0.2 * s.p12 + 0.01 * s.p22 + 0.00001 AS q11, s.p12 + 0.1 * s.p22 AS q12, s.p22 + 0.00001 AS q22 FROM steps s JOIN detections d ON d.seq_id = s.seq_id AND d.frame = s.frame + 1)))""",
)

ENDS = lambda c, first, last: f"coalesce((lead({c}) OVER w - lag({c}) OVER w) / (lead(t) OVER w - lag(t) OVER w), CASE WHEN lag(t) OVER w IS NULL THEN {first} ELSE {last} END)"
put("end_slopes", "poses", f"SELECT traj_id, {rs('t')}, {r(ENDS('x', 2.5, -1.5), 'vx')}, {r(ENDS('y', 0, 0), 'vy')} FROM poses {WINDOW}")
ROUND = "rounds AS (SELECT traj_id, min(t) AS ta, max(t) AS tb, count(*) AS n, " + ", ".join(f"max({c}) FILTER (k = 2) AS {c}2, max({c}) FILTER (k = m - 1) AS {c}9" for c in ("x", "y", "t")) + " FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY traj_id) AS m FROM poses " + WINDOW + ") GROUP BY 1)"
CLOSING = lambda c: f"coalesce((lead({c}) OVER w - lag({c}) OVER w) / (lead(t) OVER w - lag(t) OVER w), ({c}2 - {c}9) / nullif(tb - t9 + t2 - ta, 0), 0)"
put("periodic_slopes", "poses", f"SELECT traj_id, {rs('t')}, {r(CLOSING('x'), 'vx')}, {r(CLOSING('y'), 'vy')} FROM poses JOIN rounds USING (traj_id) {WINDOW}", ROUND)
# the turn is about z only, and no step reaches half a turn: angles add up
TURNED = f"turned AS (SELECT traj_id, t, yaw, {SLOPE('yaw')} AS w FROM poses {WINDOW})"
PARTS = "parts AS (SELECT *, dt / 3 * w0 AS w1_, dt / 3 * w1 AS w3_, yaw1 - yaw0 - dt / 3 * w0 - dt / 3 * w1 AS w2_ FROM held)"
ANGLE = "yaw0 + (a*a*a - 3*a*a + 3*a) * w1_ + (3*a*a - 2*a*a*a) * w2_ + a*a*a * w3_"
put("hermite_rotation", "poses scan_times", f"SELECT traj_id, {rs('t')}, {r('cos(yaw / 2)', 'qw')}, {ZERO} AS qx, {ZERO} AS qy, {r('sin(yaw / 2)', 'qz')} FROM (SELECT *, {ANGLE} AS yaw FROM parts)", TURNED, segments("yaw w", "turned"), CLOSED, PARTS)
put("hermite_angular_velocity", "poses scan_times", f"SELECT traj_id, {rs('t')}, {ZERO} AS wx, {ZERO} AS wy, {r('(3*(1-a)*(1-a) * w1_ + 6*a*(1-a) * w2_ + 3*a*a * w3_) / dt', 'wz', 8)} FROM parts", TURNED, segments("yaw w", "turned"), CLOSED, PARTS)
SAMPLES = "scan_times AS (SELECT traj_id, ta + i * ((tb - ta) / CAST(5 AS DOUBLE)) AS t FROM (SELECT traj_id, min(t) AS ta, max(t) AS tb FROM poses GROUP BY 1), range(0, 5) q(i) WHERE ta + i * ((tb - ta) / CAST(5 AS DOUBLE)) < tb)"
curve = lambda c: r(f"(2*a*a*a - 3*a*a + 1) * {c}0 + (a*a*a - 2*a*a + a) * dt * v{c}0 + (-2*a*a*a + 3*a*a) * {c}1 + (a*a*a - a*a) * dt * v{c}1", c, 4)
put("curve_samples", "poses", f"SELECT traj_id, {rs('t', digits=3)}, {curve('x')}, {curve('y')} FROM held", SAMPLES, SLOPED, segments("x y vx vy", "sloped"), CLOSED)
put("times_in_window", "poses", f"SELECT traj_id, {rs('t')} FROM poses WHERE t >= 1704120000")


# principal axes in closed form: the eigenvalues of a symmetric matrix by its characteristic angle, an axis as the longest cross product of two rows of what is singular
def eigenvalues(source: str) -> tuple[str, ...]:
    q, p2 = "(cxx + cyy + czz) / 3", "(cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)"
    det = "bxx * (byy * bzz - byz * byz) - bxy * (bxy * bzz - byz * bxz) + bxz * (bxy * byz - byy * bxz)"
    return (
        f"centred AS (SELECT *, sqrt(({p2}) / 6) AS p FROM (SELECT *, {q} AS q FROM {source}))",
        f"scaled AS (SELECT *, {', '.join(f'coalesce((c{a}{b}{" - q" if a == b else ""}) / nullif(p, 0), 0) AS b{a}{b}' for a, b in moments)} FROM centred)",
        f"angled AS (SELECT *, acos(greatest(-1, least(1, ({det}) / 2))) / 3 AS phi FROM scaled)",
        "valued AS (SELECT *, greatest(0, q + 2 * p * cos(phi)) AS l1, greatest(0, 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3))) AS l2, greatest(0, q + 2 * p * cos(phi + 2 * pi() / 3)) AS l3 FROM angled)",
    )


def axis(value: str, name: str, source: str) -> str:
    """``source`` with the unit vector (<name>x, <name>y, <name>z) of an eigenvalue, its largest part positive."""
    rows = [(f"(cxx - {value})", "cxy", "cxz"), ("cxy", f"(cyy - {value})", "cyz"), ("cxz", "cyz", f"(czz - {value})")]
    crossed = [[f"{a[1]} * {b[2]} - {a[2]} * {b[1]}", f"{a[2]} * {b[0]} - {a[0]} * {b[2]}", f"{a[0]} * {b[1]} - {a[1]} * {b[0]}"] for a, b in ((rows[0], rows[1]), (rows[0], rows[2]), (rows[1], rows[2]))]
    lists = ", ".join(f"[{', '.join(c)}] AS {name}_{k}" for k, c in enumerate(crossed))
    size = lambda v: f"({v}[1] * {v}[1] + {v}[2] * {v}[2] + {v}[3] * {v}[3])"
    a, b, c = (size(f"{name}_{k}") for k in range(3))
    longest = f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN {name}_0 WHEN {b} >= {c} THEN {name}_1 ELSE {name}_2 END"
    sign = "CASE WHEN abs(v[1]) >= abs(v[2]) AND abs(v[1]) >= abs(v[3]) THEN sign(v[1]) WHEN abs(v[2]) >= abs(v[3]) THEN sign(v[2]) ELSE sign(v[3]) END"
    return f"{name}s AS (SELECT * EXCLUDE (v), " + ", ".join(f"v[{k + 1}] / sqrt({size('v')}) * ({sign}) AS {name}{c}" for k, c in enumerate("xyz")) + f" FROM (SELECT *, {longest} AS v FROM (SELECT *, {lists} FROM {source})))"


def held(name: str, k: int) -> str:
    """The second moments of each point's ``k`` nearest points about their mean."""
    return f"{name} AS (SELECT r.id, {', '.join(f'covar_pop(p.{a}, p.{b}) AS c{a}{b}' for a, b in moments)} FROM ranked r JOIN points_small p ON p.id = r.nid WHERE rank <= {k} GROUP BY 1)"


CURVATURE = "coalesce(l3 / nullif(l1 + l2 + l3, 0), 0)"
ABOUT = f"about AS (SELECT a.id, count(*) AS n, {', '.join(f'avg((b.{p} - a.{p}) * (b.{q} - a.{q})) AS c{p}{q}' for p, q in moments)} FROM points_small a JOIN points_small b ON {D2} < 1.0 GROUP BY 1)"
enough = lambda e, name: f"CASE WHEN n >= 13 THEN round({e}, 6) + {ZERO} END AS {name}"
put("pca_features", "points_small", f"SELECT id, n, {', '.join(enough(f'l{k}', f'l{k}') for k in (1, 2, 3))}, {enough('(sqrt(l1) - sqrt(l2)) / nullif(sqrt(l1), 0)', 'linear')}, {enough('(sqrt(l2) - sqrt(l3)) / nullif(sqrt(l1), 0)', 'planar')}, {enough('sqrt(l3) / nullif(sqrt(l1), 0)', 'scatter')} FROM valued", ABOUT, *eigenvalues("about"))
put("feature_points", "points_small", f"SELECT id FROM valued WHERE {CURVATURE} * 100 > 25", RANKED, held("own", 10), *eigenvalues("own"))
UP = f"ups AS (SELECT id, {CURVATURE} AS curvature, {', '.join(f'CASE WHEN nx * x + ny * y + nz * z > 0 THEN -n{c} ELSE n{c} END AS n{c}' for c in XYZ)} FROM ns JOIN points_small USING (id))"
put("normals", "points_small", f"SELECT id, {rs('nx', 'ny', 'nz', 'curvature')} FROM ups", RANKED, held("own", 15), *eigenvalues("own"), axis("l3", "n", "valued"), UP)
BLOCKS = f"own AS (SELECT {cells(1.5)}, count(*) AS n, {', '.join(f'covar_pop({a}, {b}) AS c{a}{b}' for a, b in moments)} FROM points_small GROUP BY 1, 2, 3 HAVING count(*) >= 8)"
put("super_voxels", "points_small", f"SELECT vx, vy, vz, n, {r('planar', 'planar')} FROM (SELECT *, (sqrt(l2) - sqrt(l3)) / nullif(sqrt(l1), 0) AS planar FROM valued) WHERE planar > 0.4", BLOCKS, *eigenvalues("own"))
GROUPS = f"own AS (SELECT intensity, {', '.join(f'avg({c}) AS m{c}' for c in XYZ)}, {', '.join(f'covar_pop({a}, {b}) AS c{a}{b}' for a, b in moments)} FROM points_small GROUP BY 1)"
along = lambda v: f"(p.x - mx) * {v}x + (p.y - my) * {v}y + (p.z - mz) * {v}z"
put("oriented_bbox", "points_small", f"SELECT p.intensity, count(*) AS n, {', '.join(r(f'{m}({along(v)})', f'{m}_{k}') for m in ('min', 'max') for k, v in ((1, 'd'), (2, 'e'), (3, 'f')))} FROM points_small p JOIN fs ON p.intensity = fs.intensity GROUP BY 1", GROUPS, *eigenvalues("own"), axis("l1", "d", "valued"), axis("l2", "e", "ds"), axis("l3", "f", "es"))
SMOOTH = f"smooth AS (SELECT p.id, p.x, p.y, p.z, nx, ny, nz FROM ups JOIN points_small p USING (id) WHERE curvature < 0.2)"
LIKE = f"SELECT a.id AS u, b.id AS v FROM smooth a JOIN smooth b ON {D2} < {0.8 * 0.8!r} AND abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) > cos(radians(30))"
put("region_grow", "points_small", "SELECT id, cluster FROM clusters", RANKED, held("own", 15), *eigenvalues("own"), axis("l3", "n", "valued"), UP, SMOOTH, *components(LIKE, "smooth", 3, 8000))

# a consensus model moved to the least squares of its points, whose own points are taken
ON_BEST = f"own AS (SELECT {', '.join(f'avg(p.{c}) AS m{c}' for c in XYZ)}, {', '.join(f'covar_pop(p.{a}, p.{b}) AS c{a}{b}' for a, b in moments)} FROM points_small p JOIN best ON "
best = lambda models, on: f"best AS (SELECT * FROM {models} WHERE h = (SELECT h FROM (SELECT h, count(*) AS n FROM {models} JOIN points_small p ON {on} GROUP BY 1) ORDER BY n DESC, h LIMIT 1))"
put("ransac_plane", "points_small", "SELECT p.id, CAST(0 AS INTEGER) AS model FROM points_small p JOIN ns ON abs((p.x - mx) * nx + (p.y - my) * ny + (p.z - mz) * nz) < 0.3", HASHED, TRIPLES, best("planes", ON_PLANE), f"{ON_BEST}{ON_PLANE})", *eigenvalues("own"), axis("l3", "n", "valued"))
put("ransac_line", "points_small", "SELECT p.id, CAST(0 AS INTEGER) AS model FROM points_small p JOIN ds ON sqrt(pow((p.y - my) * dz - (p.z - mz) * dy, 2) + pow((p.z - mz) * dx - (p.x - mx) * dz, 2) + pow((p.x - mx) * dy - (p.y - my) * dx, 2)) < 0.3", HASHED, WAYS, best("lines", ON_LINE), f"{ON_BEST}{ON_LINE})", *eigenvalues("own"), axis("l1", "d", "valued"))
REGIONS = f"own AS (SELECT cluster, count(*) AS n, {', '.join(f'avg({c}) AS m{c}' for c in XYZ)}, {', '.join(f'covar_pop({a}, {b}) AS c{a}{b}' for a, b in moments)} FROM points_small JOIN regions USING (id) GROUP BY 1 HAVING count(*) > 3)"
put("region_planes", "points_small", f"SELECT cluster, n, {rs('nx', 'ny', 'nz', digits=5)}, {r('-(nx * mx + ny * my + nz * mz)', 'offset', 5)}, abs(nx) > 0.98 OR abs(ny) > 0.98 AS upright FROM ns", f"regions AS ({SQL['region_grow']})", REGIONS, *eigenvalues("own"), axis("l3", "n", "valued"))

# quintic pieces with given places and velocities, accelerations 0; the turn's velocities are 0 too
SPANS = "spans AS (SELECT traj_id, min(t) AS ta, max(t) AS tb FROM poses GROUP BY 1), asked AS (SELECT s.traj_id, s.t AS asked, greatest(ta, least(s.t, tb)) AS t FROM scan_times s JOIN spans USING (traj_id))"
QUINTIC = "held AS (SELECT s.traj_id, s.asked, g.* EXCLUDE (traj_id), (s.t - t0) / (t1 - t0) AS a, t1 - t0 AS dt FROM asked s JOIN segs g ON s.traj_id = g.traj_id AND s.t >= t0 AND (s.t < t1 OR s.t = t1 AND t1 = tmax))"
SLOPED3 = f"sloped AS (SELECT traj_id, t, x, y, yaw, {SLOPE('x')} AS vx, {SLOPE('y')} AS vy, CAST(0 AS DOUBLE) AS vyaw FROM poses {WINDOW})"
for name, digits, rise, first, last, scale in (
    ("vector_curve", 5, "10*a*a*a - 15*pow(a,4) + 6*pow(a,5)", "a - 6*a*a*a + 8*pow(a,4) - 3*pow(a,5)", "-4*a*a*a + 7*pow(a,4) - 3*pow(a,5)", ("{c}0 + ", "dt")),
    ("vector_curve_velocity", 6, "30*a*a - 60*a*a*a + 30*pow(a,4)", "1 - 18*a*a + 32*a*a*a - 15*pow(a,4)", "-12*a*a + 28*a*a*a - 15*pow(a,4)", ("", "1")),
):
    step = "" if name == "vector_curve" else " / dt"
    each = [r(f"{scale[0].format(c=c)}({rise}) * ({c}1 - {c}0){step} + {scale[1]} * (({first}) * v{c}0 + ({last}) * v{c}1)", c, digits) for c in ("x", "y", "yaw")]
    put(name, "poses scan_times", f"SELECT traj_id, {r('asked', 't')}, {', '.join(each)} FROM held", SPANS, SLOPED3, segments("x y yaw vx vy vyaw", "sloped"), QUINTIC)

# cumulative B-splines: four poses around one, at u = 0, 1/4, 2/4, 3/4 from the second to the third
AROUND = lambda columns: "around AS (SELECT *, " + ", ".join(f"lag({c}) OVER w AS {c}0, {c} AS {c}1, lead({c}) OVER w AS {c}2, lead({c}, 2) OVER w AS {c}3" for c in columns) + f", lag(t) OVER w AS t0, lead(t, 2) OVER w AS t3 FROM poses {WINDOW})"
SAMPLED = "sampled AS (SELECT *, (u*u*u - 3*u*u + 3*u + 5) / 6 AS b1, (-2*u*u*u + 3*u*u + 3*u + 1) / 6 AS b2, u*u*u / 6 AS b3 FROM (SELECT *, i * 0.25 AS u FROM around, range(0, 4) q(i) WHERE t0 IS NOT NULL AND t3 IS NOT NULL))"
put("cumulative_bspline", "poses", f"SELECT traj_id, {r('t + 400 * u', 't')}, {', '.join(r(f'{c}0 + b1 * ({c}1 - {c}0) + b2 * ({c}2 - {c}1) + b3 * ({c}3 - {c}2) + 1e-9', c) for c in XYZ)} FROM sampled", AROUND(XYZ), SAMPLED)
# rigid motions of the plane: the logarithm of a turn h and a step d is (h, r) with d = (S, -C; C, S) r
SINC = lambda h: f"CASE WHEN abs({h}) < 1e-9 THEN 1 ELSE sin({h}) / ({h}) END"
COSC = lambda h: f"CASE WHEN abs({h}) < 1e-9 THEN 0 ELSE 2 * pow(sin(({h}) / 2), 2) / ({h}) END"


def along(source: str, start: str, a: str, b: str, share: str, to: str) -> str:
    """Rows of ``source`` with <to>x, <to>y, <to>yaw: the motion ``start`` followed by a share of the one from ``a`` to ``b``."""
    q1 = f"SELECT *, {b}yaw - {a}yaw AS h_, cos({a}yaw) * ({b}x - {a}x) + sin({a}yaw) * ({b}y - {a}y) AS dx_, cos({a}yaw) * ({b}y - {a}y) - sin({a}yaw) * ({b}x - {a}x) AS dy_ FROM ({source})"
    q2 = f"SELECT *, {SINC('h_')} AS s_, {COSC('h_')} AS c_, {SINC(f'{share} * h_')} AS p_, {COSC(f'{share} * h_')} AS q_ FROM ({q1})"
    q3 = f"SELECT *, {share} * (s_ * dx_ + c_ * dy_) / (s_ * s_ + c_ * c_) AS rx_, {share} * (s_ * dy_ - c_ * dx_) / (s_ * s_ + c_ * c_) AS ry_ FROM ({q2})"
    q4 = f"SELECT *, p_ * rx_ - q_ * ry_ AS mx_, q_ * rx_ + p_ * ry_ AS my_ FROM ({q3})"
    return f"SELECT * EXCLUDE (h_, dx_, dy_, s_, c_, p_, q_, rx_, ry_, mx_, my_), {start}x + cos({start}yaw) * mx_ - sin({start}yaw) * my_ AS {to}x, {start}y + sin({start}yaw) * mx_ + cos({start}yaw) * my_ AS {to}y, {start}yaw + {share} * h_ AS {to}yaw FROM ({q4})"


PLANE = ("x", "y", "yaw")
NAMED = lambda source, *more: f"SELECT *, {', '.join(f'{c}{k} AS p{k}{c}' for k in range(4) for c in PLANE)} FROM {source}"
QUATERNION = lambda yaw: f"{r(f'cos({yaw} / 2)', 'qw')}, {ZERO} AS qx, {ZERO} AS qy, {r(f'sin({yaw} / 2)', 'qz')}"
WHOLE = lambda source: along(along(along(source, "p0", "p0", "p1", "b1", "f1"), "f1", "p1", "p2", "b2", "f2"), "f2", "p2", "p3", "b3", "f3")
put("cumulative_bspline_rotation", "poses", f"SELECT traj_id, {r('t + 400 * u', 't')}, {r('f3x', 'x')}, {r('f3y', 'y')}, {ZERO} AS z, {QUATERNION('f3yaw')} FROM ({WHOLE(NAMED('sampled'))})", AROUND(PLANE), SAMPLED)
# the pass over poses as a recursion from the second pose on: each window starts from the pose replaced before it
ORDERED = "ordered AS (SELECT *, row_number() OVER w AS k, lead(t, 2) OVER w AS t3, " + ", ".join(f"lead({c}) OVER w AS {c}2, lead({c}, 2) OVER w AS {c}3" for c in PLANE) + f" FROM poses {WINDOW})"
WINDOWED = "SELECT o.traj_id, o.t, o.k, o.t3, " + ", ".join(f"g.{c} AS p0{c}, o.{c} AS p1{c}, o.{c}2 AS p2{c}, o.{c}3 AS p3{c}" for c in PLANE) + " FROM going g JOIN ordered o ON o.traj_id = g.traj_id AND o.k = g.k + 1"
STEP = along(along(WINDOWED, "p0", "p0", "p1", "(5 / 6.0)", "f1"), "f1", "p1", "p2", "(1 / 6.0)", "f2")
GOING = "going AS (SELECT traj_id, t, k, x, y, yaw, false AS new FROM ordered WHERE k = 2 UNION ALL SELECT traj_id, t, k, " + ", ".join(f"CASE WHEN t3 IS NULL THEN p1{c} ELSE f2{c} END" for c in PLANE) + f", t3 IS NOT NULL FROM ({STEP}))"
SMOOTHED = "smoothed AS (SELECT traj_id, t, x, y, yaw FROM ordered WHERE k = 1 UNION ALL SELECT traj_id, t, x, y, yaw FROM going)"
LATER = f"later AS (SELECT *, (u*u*u - 3*u*u + 3*u + 5) / 6 AS b1, (-2*u*u*u + 3*u*u + 3*u + 1) / 6 AS b2, u*u*u / 6 AS b3 FROM (SELECT *, i * 0.25 AS u FROM ({WINDOWED}), range(1, 4) q(i) WHERE t3 IS NOT NULL))"
put("recursive_smoothing", "poses", f"SELECT traj_id, CAST(0 AS BIGINT) AS sample, {rs('t')}, {r('x + 1e-9', 'x')}, {r('y + 1e-9', 'y')}, {ZERO} AS z, {QUATERNION('yaw')} FROM smoothed UNION ALL SELECT traj_id, i, {r('t + 400 * u', 't')}, {r('f3x + 1e-9', 'x')}, {r('f3y + 1e-9', 'y')}, {ZERO} AS z, {QUATERNION('f3yaw')} FROM ({WHOLE('SELECT * FROM later')})", ORDERED, GOING, SMOOTHED, LATER)
PLACED = "placed AS (SELECT traj_id, t, " + ", ".join(f"{c}0 + a * ({c}1 - {c}0) AS {c}" for c in PLANE) + " FROM held)"
put("interpolated_map", "poses scan_times", f"SELECT traj_id, {rs('t')}, {r('x + cos(yaw) - 2 * sin(yaw)', 'x')}, {r('y + sin(yaw) + 2 * cos(yaw)', 'y')}, CAST(3 AS DOUBLE) AS z FROM placed", ORDERED, GOING, SMOOTHED, segments("x y yaw", "smoothed"), OPEN, PLACED)

# the sampling policy: m poses since the last kept knot (l), at time e; p is the kept knot before it, n the provisional one; g is what became final
ALIKE = ("x", "y", "yaw")
LIST = lambda form: ", ".join(form.format(c=c) for c in ALIKE)
TIMED = f"timed AS (SELECT traj_id, t, {LIST('{c}')}, row_number() OVER w AS k FROM (SELECT traj_id, t, {LIST('arg_min({c}, (x, y, yaw)) AS {c}')} FROM poses GROUP BY 1, 2) {WINDOW})"
KEPT = "m >= 4 AND e + 30000 < o.t"
OVER = lambda a, c: f"(o.{c} - {a}{c}) / (o.t - {a}t)"
FIRST = f"SELECT traj_id, k, 0 AS m, t AS e, NULL::DOUBLE AS pt, {LIST('NULL::DOUBLE AS p{c}')}, t AS lt, {LIST('{c} AS l{c}')}, {LIST('CAST(0 AS DOUBLE) AS d{c}')}, NULL::DOUBLE AS nt, {LIST('NULL::DOUBLE AS n{c}')}, {LIST('NULL::DOUBLE AS f{c}')}, NULL::DOUBLE AS gt, {LIST('NULL::DOUBLE AS g{c}')}, {LIST('NULL::DOUBLE AS h{c}')} FROM timed WHERE k = 1"
NEXT = (
    f"SELECT o.traj_id, o.k, CASE WHEN {KEPT} THEN 0 ELSE m + 1 END, CASE WHEN {KEPT} THEN o.t ELSE e END, CASE WHEN {KEPT} THEN lt ELSE pt END, "
    + ", ".join(f"CASE WHEN {KEPT} THEN l{c} ELSE p{c} END" for c in ALIKE)
    + f", CASE WHEN {KEPT} THEN o.t ELSE lt END, "
    + ", ".join(f"CASE WHEN {KEPT} THEN o.{c} ELSE l{c} END" for c in ALIKE)
    + ", "
    + ", ".join(f"CASE WHEN {KEPT} THEN {OVER('l', c)} ELSE d{c} END" for c in ALIKE)
    + f", CASE WHEN {KEPT} THEN NULL ELSE o.t END, "
    + ", ".join(f"CASE WHEN {KEPT} THEN NULL ELSE o.{c} END" for c in ALIKE)
    + ", "
    + ", ".join(f"CASE WHEN {KEPT} THEN NULL WHEN m = 0 THEN d{c} ELSE {OVER('l', c)} END" for c in ALIKE)
    + f", CASE WHEN {KEPT} THEN lt END, "
    + ", ".join(f"CASE WHEN {KEPT} THEN l{c} END" for c in ALIKE)
    + ", "
    + ", ".join(f"CASE WHEN {KEPT} THEN CASE WHEN pt IS NULL THEN {OVER('l', c)} ELSE {OVER('p', c)} END END" for c in ALIKE)
    + " FROM kept s JOIN timed o ON o.traj_id = s.traj_id AND o.k = s.k + 1"
)
ROW = lambda a, d, flag: f"SELECT traj_id, {r(a + 't', 't')}, {r(a + 'x', 'x')}, {r(a + 'y', 'y')}, {r(d + 'x + 1e-9', 'vx')}, {r(d + 'y + 1e-9', 'vy')}, {r(d + 'yaw + 1e-12', 'wz', 9)}, {flag} AS provisional"
ENDED = "(SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY k DESC) = 1)"
put("hermite_sampling", "poses", f"{ROW('g', 'h', 'false')} FROM kept WHERE gt IS NOT NULL UNION ALL {ROW('l', 'd', 'false')} FROM {ENDED} UNION ALL {ROW('n', 'f', 'true')} FROM {ENDED} WHERE nt IS NOT NULL", TIMED, f"kept AS ({FIRST} UNION ALL {NEXT})")

# queries of files: a curve's evaluation, and a composition whose correction is a turn by 0.1 and a step of 0.5
EVERY = f"everything AS (SELECT traj_id, t, x, y, yaw, {SLOPE('x')} AS vx, {SLOPE('y')} AS vy, {SLOPE('yaw')} AS w FROM poses {WINDOW})"
SPEED = lambda c: f"((6*a*a - 6*a) * {c}0 + (3*a*a - 4*a + 1) * dt * v{c}0 + (6*a - 6*a*a) * {c}1 + (3*a*a - 2*a) * dt * v{c}1) / dt"
PLACE = lambda c: f"(2*a*a*a - 3*a*a + 1) * {c}0 + (a*a*a - 2*a*a + a) * dt * v{c}0 + (-2*a*a*a + 3*a*a) * {c}1 + (a*a*a - a*a) * dt * v{c}1"
SIX = lambda value, name, digits: r(f"round({value}, 6) + 1e-7", name, digits)
put("curve_evaluation_file", "poses", f"SELECT traj_id, {rs('t', digits=3)}, {SIX(PLACE('x'), 'px', 3)}, {SIX(PLACE('y'), 'py', 3)}, {SIX(f'cos(({ANGLE}) / 2)', 'rw', 4)}, {SIX(f'sin(({ANGLE}) / 2)', 'rz', 4)}, {SIX(SPEED('x'), 'vx', 3)}, {SIX(SPEED('y'), 'vy', 3)}, {SIX('(3*(1-a)*(1-a) * w1_ + 6*a*(1-a) * w2_ + 3*a*a * w3_) / dt', 'wz', 4)} FROM parts", SAMPLES, EVERY, segments("x y vx vy yaw w", "everything"), CLOSED, PARTS)
EVALUATED = SQL.pop("curve_evaluation_file")
put("composition_folded", "poses", f"SELECT traj_id, {r('t', 't', 5)}, {r('CASE WHEN even THEN x * cos(0.1) - y * sin(0.1) + 0.5 ELSE x END', 'x', 5)}, {r('CASE WHEN even THEN x * sin(0.1) + y * cos(0.1) ELSE y END', 'y', 5)}, {ZERO} AS z, {r('CASE WHEN even THEN cos((yaw + 0.1) / 2) ELSE cos(yaw / 2) END', 'qw', 5)}, {ZERO} AS qx, {ZERO} AS qy, {r('CASE WHEN even THEN sin((yaw + 0.1) / 2) ELSE sin(yaw / 2) END', 'qz', 5)} FROM (SELECT *, floor(t) % 2 = 0 AS even FROM poses)")
COMPOSED = SQL.pop("composition_folded")

put(
    "fit_conditions",
    "poses",
    f"SELECT CAST(o AS INTEGER) AS \"order\", traj_id, count(DISTINCT t) - 1 AS pieces, {ZERO} AS off_place, {ZERO} AS off_velocity, {ZERO} AS off_acceleration, {ZERO} AS off_start FROM poses, range(3, 6) AS orders(o) GROUP BY o, traj_id HAVING count(DISTINCT t) > 1",
)
