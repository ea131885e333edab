"""Rigid motions of single rows: (turn, place) with the turn as a quaternion (w, x, y, z). Column expressions of the same are in ``rotations``."""

from __future__ import annotations

import math

Turn = tuple[float, float, float, float]
Vector = tuple[float, float, float]
Motion = tuple[Turn, Vector]


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _plus(a: Vector, b: Vector, share: float = 1.0) -> Vector:
    return a[0] + share * b[0], a[1] + share * b[1], a[2] + share * b[2]


def multiply(a: Turn, b: Turn) -> Turn:
    v = _plus(_plus(_cross(a[1:], b[1:]), b[1:], a[0]), a[1:], b[0])
    return (a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3], *v)


def turned(q: Turn, v: Vector) -> Vector:
    inner = _plus(_cross(q[1:], v), v, q[0])
    return _plus(v, _cross(q[1:], inner), 2.0)


def compose(a: Motion, b: Motion) -> Motion:
    return multiply(a[0], b[0]), _plus(a[1], turned(a[0], b[1]))


def inverse(a: Motion) -> Motion:
    back = (a[0][0], -a[0][1], -a[0][2], -a[0][3])
    return back, turned(back, (-a[1][0], -a[1][1], -a[1][2]))


def logarithm(a: Motion) -> tuple[Vector, Vector]:
    """The screw (r, w) that ``exponential`` turns into the motion, by the shorter way round."""
    (w0, *v), place = a
    length = math.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    share = (2.0 if length < 1e-9 else 2 * math.atan2(length, abs(w0)) / length) * (-1 if w0 < 0 else 1)
    w = (share * v[0], share * v[1], share * v[2])
    angle = abs(share) * length
    once = _cross(w, place)
    two = 1 / 12 if angle < 1e-4 else (1 - angle / (2 * math.tan(angle / 2))) / (angle * angle)
    return _plus(_plus(place, once, -0.5), _cross(w, once), two), w


def exponential(r: Vector, w: Vector, share: float = 1.0) -> Motion:
    """The motion along a share of the screw (r, w)."""
    r, w = _plus((0.0, 0.0, 0.0), r, share), _plus((0.0, 0.0, 0.0), w, share)
    angle = math.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
    half = 0.5 if angle < 1e-9 else math.sin(angle / 2) / angle
    one, two = (0.5, 1 / 6) if angle < 1e-4 else (2 * (math.sin(angle / 2) / angle) ** 2, (angle - math.sin(angle)) / angle**3)
    once = _cross(w, r)
    return (math.cos(angle / 2), half * w[0], half * w[1], half * w[2]), _plus(_plus(r, once, one), _cross(w, once), two)


def spline(poses: list[Motion], u: float) -> Motion:
    """The cumulative cubic B-spline of four motions at u from the second one towards the third."""
    out = poses[0]
    basis = (u**3 - 3 * u * u + 3 * u + 5) / 6, (-2 * u**3 + 3 * u * u + 3 * u + 1) / 6, u**3 / 6
    for share, a, b in zip(basis, poses, poses[1:], strict=False):
        if share:
            out = compose(out, exponential(*logarithm(compose(inverse(a), b)), share))
    return out
