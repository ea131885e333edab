"""Rotations of curves: exponential and logarithm of turns and rigid motions, Hermite curves and B-splines over them.

Everything is column expressions. Steps are laid down as columns of their own, so that no
expression repeats what it is made of. Quaternions are (w, x, y, z); of the two that mean
one rotation the logarithm takes the shorter way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.geometry import euler_to_quaternion, multiply_quaternions, slerp, spline_basis
from cloudframe.operators import rigid
from cloudframe.operators.ordered import beside, carried
from cloudframe.operators.trajectory import XYZ, bracket, hermite_values, slopes, upsert_knots

TURN = ("qw", "qx", "qy", "qz")
Vector = Sequence[Column]
#: Below this angle the series' first terms are exact.
FLAT = 1e-9


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def inverse(q: Vector) -> list[Column]:
    return [q[0], -q[1], -q[2], -q[3]]


def rotate(q: Vector, v: Vector) -> list[Column]:
    inner = [c + q[0] * a for c, a in zip(cross(q[1:], v), v, strict=True)]
    return [a + 2 * c for a, c in zip(v, cross(q[1:], inner), strict=True)]


def exponential(v: Vector) -> list[Column]:
    """The rotation about v by its length."""
    angle = F.sqrt(_dot(v, v))
    share = F.when(angle < FLAT, 0.5).otherwise(F.try_divide(F.sin(angle / 2), angle))
    return [F.cos(angle / 2), *[share * a for a in v]]


def logarithm(q: Vector) -> list[Column]:
    sign, length = F.when(q[0] < 0, -1.0).otherwise(1.0), F.sqrt(_dot(q[1:], q[1:]))
    share = F.when(length < FLAT, 2.0).otherwise(F.try_divide(2 * F.atan2(length, F.abs(q[0])), length))
    return [sign * share * a for a in q[1:]]


def _laid(rows: DataFrame, name: str, values: Vector) -> tuple[DataFrame, list[Column]]:
    names = [f"__{name}{i}" for i in range(len(values))]
    return rows.withColumns(dict(zip(names, values, strict=True))), [F.col(n) for n in names]


def with_turns(poses: DataFrame) -> DataFrame:
    """``poses`` with their rotation as qw, qx, qy, qz."""
    return poses.withColumns(dict(zip(TURN, euler_to_quaternion(F.col("roll"), F.col("pitch"), F.col("yaw")), strict=True)))


def interpolate_motions(poses: DataFrame, times: DataFrame, closed: bool = False) -> DataFrame:
    """(traj_id, t, x, y, z, qw, qx, qy, qz) of poses with turns at each time within its trajectory, its end too if ``closed``: places on the line, turns by the shorter way."""
    at = bracket(poses, times, [*XYZ, *TURN], closed=closed)
    place = [(F.col(f"{c}0") + F.col("alpha") * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c) for c in XYZ]
    rows, turn = _laid(at, "turn", slerp([F.col(f"{c}0") for c in TURN], [F.col(f"{c}1") for c in TURN], F.col("alpha")))
    return rows.select("traj_id", "t", *place, *[q.alias(n) for q, n in zip(turn, TURN, strict=True)])


def turn_slopes(knots: DataFrame, by: str = "traj_id", time: str = "t") -> DataFrame:
    """``knots`` with turns and their angular velocity about the fixed axes, wx, wy, wz: between the knots before and after, 0 at both ends."""
    turned = knots if "qw" in knots.columns else with_turns(knots)
    rows = beside(turned, by, [time], [time, *TURN], before=1, after=1)
    rows, after = _laid(rows, "after", [F.col(f"{c}_p1") for c in TURN])
    rows, before = _laid(rows, "before", [F.col(f"{c}_m1") for c in TURN])
    rows = rows.withColumn("__dt", F.col(f"{time}_p1") - F.col(f"{time}_m1"))
    rows, step = _laid(rows, "step", multiply_quaternions(after, inverse(before)))
    rows = rows.withColumns({f"w{c}": F.coalesce(F.try_divide(v, F.col("__dt")), F.lit(0.0)) for c, v in zip("xyz", logarithm(step), strict=True)})
    return rows.select(*turned.columns, "wx", "wy", "wz")


def hermite_turns(knots: DataFrame, times: DataFrame) -> DataFrame:
    """(traj_id, t, qw, qx, qy, qz, wx, wy, wz): the cubic Hermite curve of rotations through knots with angular velocities, and its own.

    The rotation is A exp(b1 w1) exp(b2 w2) exp(b3 w3): w1 and w3 a third of the segment's
    time at the angular velocities of its ends, seen from these; w2 what is left.
    """
    return _turns_at(bracket(knots, times, [*TURN, "wx", "wy", "wz"]))


def _turns_at(at: DataFrame, *more: str) -> DataFrame:
    """``hermite_turns`` over rows of ``bracket``, with more of their columns."""
    a, dt = F.col("alpha"), F.col("t1") - F.col("t0")
    qa, qb = ([F.col(f"{c}{i}") for c in TURN] for i in (0, 1))
    rows, w1 = _laid(at, "first", rotate(inverse(qa), [dt / 3 * F.col(f"w{c}0") for c in "xyz"]))
    rows, w3 = _laid(rows, "third", rotate(inverse(qb), [dt / 3 * F.col(f"w{c}1") for c in "xyz"]))
    rows, left = _laid(rows, "left", multiply_quaternions(exponential([-x for x in w1]), inverse(qa)))
    rows, right = _laid(rows, "right", multiply_quaternions(qb, exponential([-x for x in w3])))
    rows, middle = _laid(rows, "middle", multiply_quaternions(left, right))
    rows, w2 = _laid(rows, "second", logarithm(middle))
    basis = (a * a * a - 3 * a * a + 3 * a, -2 * a * a * a + 3 * a * a, a * a * a)
    speed = (3 * (1 - a) * (1 - a), 6 * a * (1 - a), 3 * a * a)
    turn, local = qa, [F.lit(0.0)] * 3
    for k, w in enumerate((w1, w2, w3)):
        rows, part = _laid(rows, f"part{k}", exponential([basis[k] * x for x in w]))
        rows, turn = _laid(rows, f"turn{k}", multiply_quaternions(turn, part))
        # what has turned so far is seen from the new place, and this part turns about its own axis
        rows, local = _laid(rows, f"local{k}", [x + speed[k] * y for x, y in zip(rotate(inverse(part), local), w, strict=True)])
    velocity = [F.try_divide(x, dt) for x in rotate(turn, local)]
    return rows.select("traj_id", "t", *more, *[x.alias(n) for x, n in zip([*turn, *velocity], (*TURN, "wx", "wy", "wz"), strict=True)])


def _motion_logarithm(turn: Vector, place: Vector) -> list[Column]:
    """(r, w) of a rigid motion, so that ``_motion`` gives it back. ``turn`` is laid down."""
    w = logarithm(turn)
    angle = F.sqrt(_dot(w, w))
    share = F.when(angle < 1e-4, F.lit(1 / 12)).otherwise(F.try_divide(1 - F.try_divide(angle, 2 * F.tan(angle / 2)), angle * angle))
    once = cross(w, place)
    twice = cross(w, once)
    return [*[p - o / 2 + share * t for p, o, t in zip(place, once, twice, strict=True)], *w]


def _motion(v: Vector) -> tuple[list[Column], list[Column]]:
    """The rigid motion (turn, place) along a screw (r, w), which is laid down."""
    r, w = v[:3], v[3:]
    angle = F.sqrt(_dot(w, w))
    flat = angle < 1e-4
    one = F.when(flat, F.lit(0.5)).otherwise(F.try_divide(2 * F.sin(angle / 2) * F.sin(angle / 2), angle * angle))
    two = F.when(flat, F.lit(1 / 6)).otherwise(F.try_divide(angle - F.sin(angle), angle * angle * angle))
    once = cross(w, r)
    twice = cross(w, once)
    return exponential(w), [a + one * b + two * c for a, b, c in zip(r, once, twice, strict=True)]


def bspline_motions(poses: DataFrame, span: float = 0.4, offsets: Sequence[float] = (0.0,)) -> DataFrame:
    """(traj_id, t, x, y, z, qw, qx, qy, qz): the cumulative B-spline of the rigid motions i - 1 to i + 2 at the time of pose i and each offset after it.

    The spline's place is offset / span, from the second pose of its window to the third.
    """
    fields = (*XYZ, *TURN)
    near = beside(with_turns(poses).select("traj_id", "t", *fields), "traj_id", ["t"], ["t", *fields], before=1, after=2)
    places = {0: "_m1", 1: "", 2: "_p1", 3: "_p2"}
    rows = near.where("t_m1 is not null and t_p2 is not null").select("traj_id", "t", *[F.col(f"{c}{name}").alias(f"{c}_{k}") for k, name in places.items() for c in fields])
    rows = rows.withColumn("__offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
    rows, basis = _laid(rows, "basis", spline_basis(F.col("__offset") / span))
    turns = [[F.col(f"{c}_{k}") for c in TURN] for k in range(4)]
    places = [[F.col(f"{c}_{k}") for c in XYZ] for k in range(4)]
    turn, place = turns[0], places[0]
    for k in (1, 2, 3):
        back = inverse(turns[k - 1])
        rows, step = _laid(rows, f"step{k}", multiply_quaternions(back, turns[k]))
        rows, way = _laid(rows, f"way{k}", rotate(back, [a - b for a, b in zip(places[k], places[k - 1], strict=True)]))
        rows, screw = _laid(rows, f"screw{k}", _motion_logarithm(step, way))
        rows, part = _laid(rows, f"part{k}", [basis[k] * x for x in screw])
        own_turn, own_place = _motion(part)
        rows, moved = _laid(rows, f"moved{k}", own_place)
        rows, place = _laid(rows, f"place{k}", [a + b for a, b in zip(place, rotate(turn, moved), strict=True)])
        rows, turn = _laid(rows, f"turn{k}", multiply_quaternions(turn, own_turn))
    return rows.select("traj_id", (F.col("t") + F.col("__offset")).alias("t"), *[c.alias(n) for c, n in zip([*place, *turn], fields, strict=True)])


class _Smoothing:
    """The pose before, already replaced, and those that wait for two more."""

    def __init__(self, traj: int, span: float, offsets: Sequence[float], first: int):
        self.traj, self.span, self.offsets, self.left = traj, span, offsets, first
        self.before: rigid.Motion | None = None
        self.waiting: list[tuple[float, rigid.Motion]] = []

    def _row(self, t: float, sample: int, pose: rigid.Motion) -> tuple:
        return self.traj, t, sample, *pose[1], *pose[0]

    def step(self, row: list[float]) -> list[tuple]:
        t, *place_and_turn = row
        pose = (tuple(place_and_turn[3:]), tuple(place_and_turn[:3]))
        if self.left:
            self.left, self.before = self.left - 1, pose
            return [self._row(t, 0, pose)]
        self.waiting.append((t, pose))
        if len(self.waiting) < 3:
            return []
        window = [self.before, *(p for _, p in self.waiting)]
        t, _ = self.waiting.pop(0)
        found = [rigid.spline(window, o / self.span) for o in self.offsets]
        self.before = found[0]
        return [self._row(t + o, k, p) for k, (o, p) in enumerate(zip(self.offsets, found, strict=True))]

    def end(self) -> list[tuple]:
        return [self._row(t, 0, p) for t, p in self.waiting]


def smooth_motions(poses: DataFrame, span: float = 0.4, offsets: Sequence[float] = (0.0, 0.1, 0.2, 0.3), first: int = 2) -> DataFrame:
    """(traj_id, t, sample, x, y, z, qw, qx, qy, qz): poses one after the other replaced by the spline of their window, which starts from the pose already replaced before.

    Sample 0 is the pose itself; a replaced pose also has the spline of its window at the
    other offsets after it (the first offset has to be 0). The ``first`` poses of a
    trajectory, one at least, and its last two stay as they are. A task reads a trajectory
    in batches and keeps four poses.
    """
    assert first >= 1 and offsets[0] == 0
    fields = (*XYZ, *TURN)
    turned = poses if "qw" in poses.columns else with_turns(poses)
    rows = turned.select("traj_id", *[F.col(c).cast("double").alias(c) for c in ("t", *fields)])
    return carried(rows, "traj_id", ("t", *fields), lambda traj: _Smoothing(traj, span, offsets, first), ", ".join(["traj_id long", "t double", "sample long", *(f"{c} double" for c in fields)]))


def curve_evaluation(knots: DataFrame, times: DataFrame) -> DataFrame:
    """(traj_id, t, px..pz, rw..rz, vx..vz, wx..wz): places, turns and velocities of the Hermite curve through poses at given times, ends included."""
    whole = turn_slopes(slopes(with_turns(knots) if "qw" not in knots.columns else knots))
    # one search for the segments serves places, speeds and turns
    at = bracket(whole, times, [*XYZ, *[f"v{c}" for c in XYZ], *TURN, "wx", "wy", "wz"])
    places, speeds = [f"p{c}" for c in XYZ], [f"v{c}" for c in XYZ]
    at = at.withColumns(dict(zip([*places, *speeds], [*hermite_values(XYZ), *hermite_values(XYZ, 1)], strict=True)))
    turned = _turns_at(at, *places, *speeds)
    return turned.select("traj_id", "t", *places, *[F.col(c).alias(f"r{c[1]}") for c in TURN], *speeds, "wx", "wy", "wz")


STAND = dict(zip((*XYZ, *TURN), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), strict=True))


def _composed(correction: DataFrame, knots: DataFrame, undo: bool) -> DataFrame:
    """Knots (traj_id, t, x..qz) multiplied from the left by the correction at their times, or by its inverse if ``undo``; those where there is no correction stay."""
    at = interpolate_motions(correction, knots.select("traj_id", "t").distinct(), closed=True)
    both = knots.join(at.select("traj_id", "t", *[F.col(c).alias(f"c{c}") for c in STAND]), ["traj_id", "t"], "left")
    both = both.withColumns({f"c{c}": F.coalesce(f"c{c}", F.lit(v)) for c, v in STAND.items()})
    turn, place = [F.col(f"c{c}") for c in TURN], [F.col(f"c{c}") for c in XYZ]
    if undo:
        both, turn = _laid(both, "turn", inverse(turn))
        both, place = _laid(both, "place", rotate(turn, [-p for p in place]))
    spun, moved = multiply_quaternions(turn, [F.col(c) for c in TURN]), rotate(turn, [F.col(c) for c in XYZ])
    values = [*[a + b for a, b in zip(moved, place, strict=True)], *spun]
    return both.select("traj_id", "t", *[v.alias(c) for v, c in zip(values, STAND, strict=True)])


def extend_composition(base: DataFrame, correction: DataFrame, poses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base and correction of a composed curve (knots traj_id, t, x, y, z, qw..qz) that also goes through further poses.

    The correction is carried on with its first and last value to the new ends of the base
    (it stands still where there was none); the base gets the poses without the correction
    at their times. A pose at a knot's time takes its place.
    """
    fields = list(STAND)
    all_times = base.select("traj_id", "t").union(poses.select("traj_id", "t"))
    spans = all_times.groupBy("traj_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    knot = F.struct("t", *fields)
    ends = correction.groupBy("traj_id").agg(F.min_by(knot, "t").alias("first"), F.max_by(knot, "t").alias("last"))
    both = spans.join(ends, "traj_id", "left")
    none = F.col("first").isNull()
    at = lambda side, end: F.struct(F.col(side).alias("t"), *[F.coalesce(F.col(f"{end}.{c}"), F.lit(v)).alias(c) for c, v in STAND.items()])
    more = F.array(F.when(none | (F.col("first.t") > F.col("a")), at("a", "first")), F.when((none & (F.col("b") > F.col("a"))) | (F.col("last.t") < F.col("b")), at("b", "last")))
    added = both.select("traj_id", F.explode(F.array_compact(more)).alias("k")).select("traj_id", "k.*")
    correction = correction.select("traj_id", "t", *fields).unionByName(added)
    return upsert_knots(base.select("traj_id", "t", *fields), _composed(correction, poses.select("traj_id", "t", *fields), undo=True)), correction


def fold_corrections(base: DataFrame, correction: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The base with the correction at its knots taken in, and a correction that stands still at its times."""
    still = correction.select("traj_id", "t", *[F.lit(v).alias(c) for c, v in STAND.items()])
    return _composed(correction, base, undo=False), still


class _Sampling:
    """The curve as far as it may still change: the last two kept knots and the provisional one after them."""

    def __init__(self, traj: int, least: int, period: float):
        self.traj, self.least, self.period = traj, least, period
        self.measured, self.extended = 0, 0.0
        self.before: tuple | None = None  # (t, motion) of the last kept knot but one
        self.last: list | None = None  # t, motion, slope of the last kept knot
        self.tail: tuple | None = None

    @staticmethod
    def slope(a: tuple, b: tuple) -> tuple:
        """Velocity and angular velocity about the fixed axes from one (t, motion) to another."""
        dt = b[0] - a[0]
        turn = rigid.multiply(b[1][0], rigid.inverse((a[1][0], (0.0, 0.0, 0.0)))[0])
        w = rigid.logarithm((turn, (0.0, 0.0, 0.0)))[1]
        return tuple((y - x) / dt for x, y in zip(a[1][1], b[1][1], strict=True)) + tuple(x / dt for x in w)

    def _row(self, knot: Sequence, provisional: bool) -> tuple:
        t, motion, slope = knot
        return self.traj, t, *motion[1], *motion[0], *slope, provisional

    def step(self, row: list[float]) -> list[tuple]:
        t, *rest = row
        new = (t, (tuple(rest[3:]), tuple(rest[:3])))
        newest = self.tail[0] if self.tail else self.last[0] if self.last else None
        if newest is not None and not t > newest:
            return []  # time has to increase
        if self.last is None:
            self.last, self.extended = [*new, (0.0,) * 6], t
            return []
        if self.measured >= self.least and self.extended + self.period < t:
            # the provisional knot goes, the new one stays, and the one before it gets its slope for good
            slope = self.slope(self.last[:2], new)
            self.last[2] = slope if self.before is None else self.slope(self.before, new)
            done = self._row(self.last, False)
            self.before, self.last, self.tail = tuple(self.last[:2]), [*new, slope], None
            self.measured, self.extended = 0, t
            return [done]
        slope = self.last[2] if self.measured == 0 else self.slope(self.last[:2], new)
        self.tail = (*new, slope)
        self.measured += 1
        return []

    def end(self) -> list[tuple]:
        return ([self._row(self.last, False)] if self.last else []) + ([self._row(self.tail, True)] if self.tail else [])


def sample_hermite(poses: DataFrame, least: int = 4, period: float = 0.0) -> DataFrame:
    """(traj_id, t, x, y, z, qw..qz, vx, vy, vz, wx, wy, wz, provisional): the knots of a Hermite curve extended pose by pose.

    A pose becomes a knot that stays when ``least`` poses have come since the last such
    knot and more than ``period`` has passed; until then the newest pose is a provisional
    knot that the next one replaces. A kept knot's slope spans the knot before it and the
    next one kept; the first one's goes to the second. The first provisional knot takes the
    slope of the knot before it, each later one that from there to itself. Poses that are
    not later than the newest are left out. A task reads a trajectory in batches.
    """
    fields = (*XYZ, *TURN)
    turned = poses if "qw" in poses.columns else with_turns(poses)
    rows = turned.select("traj_id", *[F.col(c).cast("double").alias(c) for c in ("t", *fields)])
    names = ["traj_id long", *(f"{c} double" for c in ("t", *fields, "vx", "vy", "vz", "wx", "wy", "wz")), "provisional boolean"]
    return carried(rows, "traj_id", ("t", *fields), lambda traj: _Sampling(traj, least, period), ", ".join(names))
