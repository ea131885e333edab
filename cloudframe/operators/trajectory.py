"""Poses over time: interval joins, interpolation, slopes, Hermite, B-spline and spherical curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.geometry import euler_to_quaternion, multiply_quaternions, slerp, spline_basis
from cloudframe.operators.ordered import BLOCK, HALO, beside, in_blocks, latest, numbered

XYZ = ("x", "y", "z")


def segments(knots: DataFrame, fields: Sequence[str], by: str = "traj_id", time: str = "t") -> DataFrame:
    """Consecutive knots as rows: ``by``, t0, t1, <field>0, <field>1."""
    fields = list(dict.fromkeys(fields))
    rows = beside(knots.select(by, time, *[c for c in fields if c != time]), by, [time], [time, *[c for c in fields if c != time]], after=1)
    return rows.select(by, F.col(time).alias("t0"), F.col(f"{time}_p1").alias("t1"), *[x for c in fields for x in (F.col(c).alias(f"{c}0"), F.col(f"{c}_p1").alias(f"{c}1"))]).where("t1 is not null")


def bracket(knots: DataFrame, times: DataFrame, fields: Sequence[str], by: str = "traj_id", time: str = "t", closed: bool = True) -> DataFrame:
    """Each time with the segment [t0, t1) that holds it; the last segment holds its end too if ``closed``. Times outside are left out.

    Segments and times are merged in one order of (trajectory, time), which is dealt to
    tasks by ranges; each time takes the last segment that has begun, so it is compared with
    no other, and a long trajectory is spread over many tasks.
    """
    own = segments(knots, fields, by, time)
    last = own.groupBy(by).agg(F.max("t0").alias("__last"))
    names = own.columns[1:]
    held = own.select(by, F.col("t0").alias("__t"), F.lit(0).alias("__kind"), F.struct(*names).alias("s"))
    asked = times.select(by, F.col(time).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(held.schema["s"].dataType).alias("s"))
    merged = latest(held.unionByName(asked), by, ["__t", "__kind"], "s").where("__kind = 1 and s is not null")
    held = merged.join(last, by).withColumn("is_last", F.col("s.t0") == F.col("__last"))
    inside = (F.col("t") < F.col("t1")) | (F.lit(closed) & F.col("is_last") & (F.col("t") == F.col("t1")))
    return held.select(by, F.col("__t").alias("t"), "s.*", "is_last").where(inside).drop("is_last").withColumn("alpha", F.try_divide(F.col("t") - F.col("t0"), F.col("t1") - F.col("t0")))


def interpolate(poses: DataFrame, times: DataFrame, rotation: bool = False) -> DataFrame:
    """(traj_id, t, x, y, z) at each time strictly within its trajectory or at a knot; with ``rotation`` also qw..qz by the shorter way."""
    fields = [*XYZ, "roll", "pitch", "yaw"] if rotation else list(XYZ)
    at = bracket(poses, times, fields, closed=False)
    place = [(F.col(f"{c}0") + F.col("alpha") * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c) for c in XYZ]
    if not rotation:
        return at.select("traj_id", "t", *place)
    ends = [euler_to_quaternion(*[F.col(f"{a}{i}") for a in ("roll", "pitch", "yaw")]) for i in (0, 1)]
    turn = slerp(*ends, F.col("alpha"))
    return at.select("traj_id", "t", *place, *[q.alias(n) for q, n in zip(turn, ("qw", "qx", "qy", "qz"), strict=True)])


def poses_between(poses: DataFrame, number: int) -> DataFrame:
    """``number`` poses at equal steps within each segment, translations only."""
    steps = segments(poses, XYZ).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(number))))
    share = F.col("step") / (number + 1)
    return steps.select("traj_id", "t0", "step", *[(F.col(f"{c}0") + share * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c) for c in XYZ])


def slopes(knots: DataFrame, fields: Sequence[str] = XYZ, by: str = "traj_id", time: str = "t", *, ends: Mapping[str, tuple[float, float]] | None = None, periodic: bool = False) -> DataFrame:
    """``knots`` with v<field>: between the knots before and after.

    At both ends 0, or the (first, last) slopes given by ``ends`` for a field, or with
    ``periodic`` that between the last knot but one and the second, the last knot being
    the first one again. A single knot has slope 0.
    """
    own = [time, *[c for c in fields if c != time]]
    rows = beside(knots, by, [time], own, before=1, after=1)
    before, after = (lambda c: F.col(f"{c}_m1")), (lambda c: F.col(f"{c}_p1"))
    dt = after(time) - before(time)
    if periodic:
        # the second knot and the last but one of each sequence: those beside its ends
        first, last = (F.min_by(F.struct(*[side(c).alias(c) for c in own], F.col(time).alias("end")), F.when(other(time).isNull(), F.col(time))) for side, other in ((after, before), (before, after)))
        ends_of = rows.groupBy(by).agg(first.alias("__second"), last.alias("__before"))
        rows = rows.join(ends_of, by)
        second, second_last = F.col("__second"), F.col("__before")
        round_trip = second_last["end"] - second_last[time] + second[time] - second["end"]

    def at_end(c: str) -> Column:
        if periodic:
            return F.coalesce(F.try_divide(second[c] - second_last[c], round_trip), F.lit(0.0))
        start, stop = (ends or {}).get(c, (0.0, 0.0))
        return F.when(before(time).isNull(), F.lit(float(start))).otherwise(F.lit(float(stop)))

    return rows.select(*knots.columns, *[F.coalesce(F.try_divide(after(c) - before(c), dt), at_end(c)).alias(f"v{c}") for c in fields])


def sample_times(knots: DataFrame, number: int, by: str = "traj_id", time: str = "t") -> DataFrame:
    """(by, time): ``number`` - 1 times at equal steps from the first knot on, the last knot left out."""
    spans = knots.groupBy(by).agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    at = F.col("__a") + F.col("__i") * ((F.col("__b") - F.col("__a")) / (number - 1))
    return spans.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(number - 2)))).select(by, at.alias(time), "__b").where(F.col(time) < F.col("__b")).drop("__b")


def times_in_window(knots: DataFrame, begin: float, by: str = "traj_id", time: str = "t") -> DataFrame:
    """(by, time) of the knots from ``begin`` on."""
    return knots.where(F.col(time) >= begin).select(by, time)


def hermite(knots: DataFrame, times: DataFrame, fields: Sequence[str] = XYZ, derivative: int = 0) -> DataFrame:
    """(traj_id, t, fields) of the cubic Hermite curve through knots with slopes, or its first or second derivative."""
    at = bracket(knots, times, [*fields, *[f"v{c}" for c in fields]])
    return at.select("traj_id", "t", *[v.alias(c) for c, v in zip(fields, hermite_values(fields, derivative), strict=True)])


def hermite_values(fields: Sequence[str], derivative: int = 0) -> list[Column]:
    """The curve of ``hermite``, or a derivative, over rows of ``bracket`` with the fields and their slopes."""
    a, dt = F.col("alpha"), F.col("t1") - F.col("t0")
    basis = {
        0: (2 * a * a * a - 3 * a * a + 1, a * a * a - 2 * a * a + a, -2 * a * a * a + 3 * a * a, a * a * a - a * a),
        1: (6 * a * a - 6 * a, 3 * a * a - 4 * a + 1, -6 * a * a + 6 * a, 3 * a * a - 2 * a),
        2: (12 * a - 6, 6 * a - 4, -12 * a + 6, 6 * a - 2),
    }[derivative]
    scale = F.lit(1.0) if derivative == 0 else F.try_divide(F.lit(1.0), dt if derivative == 1 else dt * dt)
    return [(basis[0] * F.col(f"{c}0") + basis[1] * dt * F.col(f"v{c}0") + basis[2] * F.col(f"{c}1") + basis[3] * dt * F.col(f"v{c}1")) * scale for c in fields]


def cumulative_bspline(poses: DataFrame, span: float = 0.4, fields: Sequence[str] = XYZ, offsets: Sequence[float] = (0.0,)) -> DataFrame:
    """(traj_id, t, fields): the cumulative B-spline of poses i - 1 to i + 2 at the time of pose i and each offset after it, translations only.

    A span is the time from one pose to the next: the spline's place is offset / span, from
    the second pose of its window to the third.
    """
    near = beside(poses.select("traj_id", "t", *fields), "traj_id", ["t"], ["t", *fields], before=1, after=2)
    places = {0: "_m1", 1: "", 2: "_p1", 3: "_p2"}
    rows = near.where("t_m1 is not null and t_p2 is not null").select("traj_id", "t", *[F.col(f"{c}{name}").alias(f"{c}_{k}") for k, name in places.items() for c in fields])
    at = rows.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
    b = spline_basis(F.col("offset") / span)
    value = lambda c: F.col(f"{c}_0") + sum((b[i] * (F.col(f"{c}_{i}") - F.col(f"{c}_{i - 1}")) for i in (2, 3)), b[1] * (F.col(f"{c}_1") - F.col(f"{c}_0")))
    return at.select("traj_id", (F.col("t") + F.col("offset")).alias("t"), *[value(c).alias(c) for c in fields])


def slerp_curve(poses: DataFrame, times: DataFrame) -> DataFrame:
    """(traj_id, t, x, y, z, qw, qx, qy, qz) of A (A^-1 B)^alpha, the last knot included."""
    at = bracket(poses, times, [*XYZ, "roll", "pitch", "yaw"])
    turn = slerp(*[euler_to_quaternion(*[F.col(f"{a}{i}") for a in ("roll", "pitch", "yaw")]) for i in (0, 1)], F.col("alpha"))
    place = [(F.col(f"{c}0") + F.col("alpha") * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c) for c in XYZ]
    return at.select("traj_id", "t", *place, *[q.alias(n) for q, n in zip(turn, ("qw", "qx", "qy", "qz"), strict=True)])


def compose(correction: DataFrame, base: DataFrame) -> DataFrame:
    """correction(t) * base(t) of two evaluated curves, joined by trajectory and time."""
    q = ("qw", "qx", "qy", "qz")
    both = correction.select("traj_id", "t", *[F.col(c).alias(f"c{c}") for c in (*XYZ, *q)]).join(base, ["traj_id", "t"])
    from cloudframe.functions.geometry import rotate_quaternion

    turned = rotate_quaternion(F.col("x"), F.col("y"), F.col("z"), *[F.col(f"c{c}") for c in q])
    spun = multiply_quaternions([F.col(f"c{c}") for c in q], [F.col(c) for c in q])
    return both.select("traj_id", "t", *[(v + F.col(f"c{c}")).alias(c) for v, c in zip(turned, XYZ, strict=True)], *[v.alias(c) for v, c in zip(spun, q, strict=True)])


def transform_curve(poses: DataFrame, shift: Sequence[float], quaternion: Sequence[float]) -> DataFrame:
    """All knots (x, y, z, qw..qz) multiplied from the left by one transform."""
    from cloudframe.functions.geometry import rotate_quaternion

    q = [F.lit(float(v)) for v in quaternion]
    turned = rotate_quaternion(F.col("x"), F.col("y"), F.col("z"), *q)
    spun = multiply_quaternions(q, [F.col(c) for c in ("qw", "qx", "qy", "qz")])
    return poses.withColumns({**{c: v + s for c, v, s in zip(XYZ, turned, shift, strict=True)}, **dict(zip(("qw", "qx", "qy", "qz"), spun, strict=True))})


def closed_bspline(points: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """(traj_id, i, px, py): control points of the closed cubic B-spline through each trajectory's points in the order of time.

    What a point gives to the control points around it falls to sqrt(3) - 2 of it with each
    step, so ``halo`` points on each side of a control point are all that counts. Points are
    dealt in blocks with so many of their neighbours.
    """
    share = np.sqrt(3) * (np.sqrt(3) - 2) ** np.abs(np.arange(-halo, halo + 1))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        p, own, i = rows[["x", "y"]].to_numpy(float), rows["own"].to_numpy(bool), rows["i"].to_numpy()
        if own.all():  # the whole sequence: it goes round
            around = np.arange(-halo, len(p) + halo)
            p, own = p[around % len(p)], (around >= 0) & (around < len(p))
            i = around
        found = np.column_stack([np.convolve(c, share, "same") for c in p.T])[own]
        return pd.DataFrame({"traj_id": key[0], "i": i[own], "px": found[:, 0], "py": found[:, 1]})

    rows = points.select("traj_id", "t", "x", "y")
    return in_blocks(rows, "traj_id", ["t", "x", "y"], True, block, halo).groupBy("traj_id", "block").applyInPandas(run, "traj_id long, i long, px double, py double")


def upsert_knots(knots: DataFrame, changes: DataFrame, by: str = "traj_id", time: str = "t") -> DataFrame:
    """Knots with changes put in; a change at a knot's time takes its place."""
    return knots.join(changes.select(by, time), [by, time], "left_anti").unionByName(changes)


def delete_knots(knots: DataFrame, gone: DataFrame, by: str = "traj_id", time: str = "t") -> DataFrame:
    return knots.join(gone.select(by, time), [by, time], "left_anti")


def knots_in_range(knots: DataFrame, start: Column | float, end: Column | float, by: str = "traj_id", time: str = "t") -> DataFrame:
    """From the last knot at or before the start to the first at or after the end."""
    start, end = (v if isinstance(v, Column) else F.lit(float(v)) for v in (start, end))
    near = beside(knots, by, [time], [time], before=1, after=1)
    after, before = F.col(f"{time}_p1"), F.col(f"{time}_m1")
    return near.where(F.coalesce(after > start, F.col(time) >= start) & F.coalesce(before < end, F.col(time) <= end)).select(*knots.columns)


def knot_statistics(knots: DataFrame, by: str = "traj_id", time: str = "t") -> DataFrame:
    """Per trajectory: knots, first and last time, mean step and mean distance between consecutive knots."""
    near = beside(knots.select(by, time, *XYZ), by, [time], [time, *XYZ], before=1)
    square = [(F.col(c) - F.col(f"{c}_m1")) * (F.col(c) - F.col(f"{c}_m1")) for c in XYZ]
    steps = near.select(by, time, (F.col(time) - F.col(f"{time}_m1")).alias("dt"), F.sqrt(sum(square[1:], square[0])).alias("d"))
    return steps.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("min_t"), F.max(time).alias("max_t"), F.avg("dt").alias("mean_dt"), F.avg("d").alias("mean_distance"))


def sample_by_ratio(knots: DataFrame, ratio: int, by: str = "traj_id", time: str = "t") -> DataFrame:
    """The knots that stay when every ``ratio``-th measurement starts a new knot and the others move the last one."""
    return numbered(knots, by, [time]).where(((F.col("i") + 1) % ratio == 0) | (F.col("i") == F.col("n") - 1)).select(*knots.columns)


def has_knots(knots: DataFrame, times: DataFrame, tolerance: float = 0.0, by: str = "traj_id", time: str = "t") -> DataFrame:
    """(by, time, present) of each of ``times``: whether a knot lies within ``tolerance`` of it. Knots and times are merged by ranges, as in ``bracket``."""
    kind = knots.schema[time].dataType
    held = knots.select(by, F.col(time).alias("__t"), F.lit(0).alias("__kind"), F.lit(None).cast(kind).alias("__asked"), F.col(time).alias("__knot"))
    asked = times.select(by, (F.col(time) + tolerance).alias("__t"), F.lit(1).alias("__kind"), F.col(time).alias("__asked"), F.lit(None).cast(kind).alias("__knot"))
    found = latest(held.unionByName(asked), by, ["__t", "__kind"], "__knot").where("__kind = 1")
    return found.select(by, F.col("__asked").alias(time), F.coalesce(F.col("__knot") >= F.col("__asked") - tolerance, F.lit(False)).alias("present"))


def knots_by_key(knots: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The knots with one of ``keys``; a key without a knot gives a row of nulls, so it is seen."""
    return keys.select(key).distinct().join(knots, key, "left")


def knot_consistency(knots: DataFrame, key: str = "key", by: str = "traj_id", time: str = "t") -> DataFrame:
    """(by, n, n_keys, n_times, consistent): a trajectory is consistent if each of its knots has a key and a time of its own."""
    own = knots.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_keys"), F.count_distinct(time).alias("n_times"))
    return own.withColumn("consistent", (F.col("n") == F.col("n_keys")) & (F.col("n") == F.col("n_times")))


def knot_differences(left: DataFrame, right: DataFrame, fields: Sequence[str] = XYZ, tolerance: float = 0.0, by: str = "traj_id", time: str = "t") -> DataFrame:
    """(by, n_same, n_moved, n_left, n_right) of two knot tables: knots at the same time within ``tolerance`` in all fields or not, and those of one side only."""
    a = left.select(by, time, F.struct(*fields).alias("__l"))
    both = a.join(right.select(by, time, F.struct(*fields).alias("__r")), [by, time], "full")
    near = reduce(Column.__and__, [F.coalesce(F.abs(F.col("__l")[c] - F.col("__r")[c]) <= tolerance, F.col("__l")[c].eqNullSafe(F.col("__r")[c])) for c in fields])
    paired = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return both.groupBy(by).agg(F.count_if(paired & near).alias("n_same"), F.count_if(paired & ~near).alias("n_moved"), F.count_if(F.col("__r").isNull()).alias("n_left"), F.count_if(F.col("__l").isNull()).alias("n_right"))


def global_map(scans: DataFrame, poses: DataFrame) -> DataFrame:
    """Points (frame_id, id, x, y, z) moved by the pose of their frame (frame_id, tx, ty, tz, roll, pitch, yaw)."""
    from cloudframe.functions.geometry import rotate_rpy

    both = scans.join(poses, "frame_id")
    turned = rotate_rpy(*[F.col(c) for c in ("x", "y", "z", "roll", "pitch", "yaw")])
    return both.select("frame_id", "id", *[(v + F.col(f"t{c}")).alias(c) for v, c in zip(turned, XYZ, strict=True)])
