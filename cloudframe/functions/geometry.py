"""Transforms, angles and bases as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
#: fixed value: the coarse pi of the angle rule
COARSE_PI = 3.1415


def rotate_rpy(x: Column, y: Column, z: Column, roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """Rotated about z by yaw, then about x by roll, then about y by pitch."""
    x1, y1 = x * F.cos(yaw) - y * F.sin(yaw), x * F.sin(yaw) + y * F.cos(yaw)
    y2, z2 = y1 * F.cos(roll) - z * F.sin(roll), y1 * F.sin(roll) + z * F.cos(roll)
    return [x1 * F.cos(pitch) + z2 * F.sin(pitch), y2, z2 * F.cos(pitch) - x1 * F.sin(pitch)]


def rotate_quaternion(x: Column, y: Column, z: Column, qw: Column, qx: Column, qy: Column, qz: Column) -> list[Column]:
    """Rotated by a unit quaternion: v + 2 w (q x v) + 2 q x (q x v)."""
    tx, ty, tz = 2 * (qy * z - qz * y), 2 * (qz * x - qx * z), 2 * (qx * y - qy * x)
    return [x + qw * tx + qy * tz - qz * ty, y + qw * ty + qz * tx - qx * tz, z + qw * tz + qx * ty - qy * tx]


def transform_rpy(points: DataFrame, pose: dict[str, Column | float]) -> DataFrame:
    """Points moved by a pose with x, y, z, roll, pitch and yaw; other columns stay."""
    p = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in pose.items()}
    turned = rotate_rpy(F.col("x"), F.col("y"), F.col("z"), p["roll"], p["pitch"], p["yaw"])
    return points.withColumns({c: r + p[c] for c, r in zip(XYZ, turned, strict=True)})


def transform_quaternion(points: DataFrame, pose: dict[str, Column | float]) -> DataFrame:
    """Points moved by a pose whose axes are permuted: t = (z, x, y), q = (w; z, x, y)."""
    p = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in pose.items()}
    turned = rotate_quaternion(F.col("x"), F.col("y"), F.col("z"), p["qw"], p["qz"], p["qx"], p["qy"])
    return points.withColumns({c: r + p[s] for c, r, s in zip(XYZ, turned, "zxy", strict=True)})


def project_to_plane(points: DataFrame, a: float, b: float, c: float, d: float) -> DataFrame:
    """Orthogonal projection onto the plane ax + by + cz + d = 0."""
    n = (a * a + b * b + c * c) ** 0.5
    a, b, c, d = a / n, b / n, c / n, d / n
    off = F.col("x") * a + F.col("y") * b + F.col("z") * c + d
    return points.withColumns({k: F.col(k) - off * w for k, w in zip(XYZ, (a, b, c), strict=True)})


def flatten(points: DataFrame) -> DataFrame:
    return points.withColumn("z", F.lit(0.0))


def spherical(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Range, vertical angle and horizontal angle from the y axis, in degrees."""
    return {"range": F.sqrt(x * x + y * y + z * z), "vang": F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), "hang": F.degrees(F.atan2(x, y))}


def folded_angle(x: Column, y: Column) -> Column:
    """atan(y / x) in degrees; null where x is 0."""
    return F.degrees(F.atan(F.try_divide(y, x)))


def wrap_angle(r: Column, second: bool = False) -> Column:
    """Angles near 3 or -3 seen from the other side; the two rules differ near -3."""
    over, under = -(r - COARSE_PI), -(F.lit(COARSE_PI) - r)
    low_over, low_under = -(r + COARSE_PI), r + COARSE_PI
    if second:
        low_over, low_under = low_under, low_over
    near_high = F.when(r > COARSE_PI, over).otherwise(under)
    near_low = F.when(r < -COARSE_PI, low_over).otherwise(low_under)
    return F.when(F.abs(r - 3) < 0.5, near_high).when(F.abs(r + 3) < 0.5, near_low).otherwise(r)


def rotation_to_euler(m: Sequence[Sequence[Column]]) -> list[Column]:
    """(roll, pitch, yaw) of R = Rz(yaw) Ry(pitch) Rx(roll)."""
    return [F.atan2(m[2][1], m[2][2]), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[2][0]))), F.atan2(m[1][0], m[0][0])]


def euler_to_quaternion(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """(w, x, y, z) of R = Rz(yaw) Ry(pitch) Rx(roll)."""
    cr, sr, cp, sp, cy, sy = (f(a / 2) for a in (roll, pitch, yaw) for f in (F.cos, F.sin))
    return [cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy]


def multiply_quaternions(p: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    (a, b, c, d), (w, x, y, z) = p, q
    return [a * w - b * x - c * y - d * z, a * x + b * w + c * z - d * y, a * y - b * z + c * w + d * x, a * z + b * y - c * x + d * w]


def slerp(p: Sequence[Column], q: Sequence[Column], share: Column) -> list[Column]:
    """p (p^-1 q)^share along the shorter way."""
    dot = sum((a * b for a, b in zip(p[1:], q[1:], strict=True)), p[0] * q[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    flat = F.sin(angle) < 1e-9
    a = F.when(flat, 1 - share).otherwise(F.try_divide(F.sin((1 - share) * angle), F.sin(angle)))
    b = sign * F.when(flat, share).otherwise(F.try_divide(F.sin(share * angle), F.sin(angle)))
    return [a * u + b * v for u, v in zip(p, q, strict=True)]


def spline_basis(u: Column) -> list[Column]:
    """Cumulative basis of the uniform cubic B-spline."""
    return [F.lit(1.0), (u * u * u - 3 * u * u + 3 * u + 5) / 6, (-2 * u * u * u + 3 * u * u + 3 * u + 1) / 6, u * u * u / 6]


def tau(t: Column, order: int, derivative: int = 0) -> list[Column]:
    """[t^n .. 1] or its first or second derivative."""
    out = []
    for k in range(order, -1, -1):
        factor, power = 1, k
        for _ in range(derivative):
            factor, power = factor * power, power - 1
        out.append(F.lit(0.0) if factor == 0 else F.lit(float(factor)) * F.pow(t, F.lit(float(power))))
    return out


def stamp_difference(sec: Column, usec: Column, from_sec: Column, from_usec: Column) -> Column:
    """Microseconds between two (sec, usec) stamps."""
    return (sec - from_sec) * 1_000_000 + (usec - from_usec)


def distance(dims: Sequence[str], other: str = "n") -> Column:
    return F.sqrt(sum(((F.col(c) - F.col(f"{other}{c}")) * (F.col(c) - F.col(f"{other}{c}")) for c in dims[1:]), (F.col(dims[0]) - F.col(f"{other}{dims[0]}")) * (F.col(dims[0]) - F.col(f"{other}{dims[0]}"))))


def cell_code(row: Column, col: Column) -> Column:
    """A cell as one number: row + col / 10000."""
    return row + col / 10000
