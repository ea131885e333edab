"""Polynomial splines: coefficients from boundary conditions, evaluation, fits through many points."""

from __future__ import annotations

import decimal
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.operators.ordered import BLOCK, HALO, in_blocks, solve_block_tridiagonal, solve_tridiagonal

#: The longest piece over the shortest for which doubles solve for pieces of order 4 and 5 (errors of 1e-8 in trials).
MOST_SPREAD = {4: 1000, 5: 100}


def coefficients(order: int, p0: Column, p1: Column, d: Column, v0: Column | None = None, v1: Column | None = None, a0: Column | None = None, a1: Column | None = None) -> list[Column]:
    """[a_n .. a_0] of the polynomial over [0, d] with the given ends; missing velocities and accelerations are 0.

    Order 1 takes both places, 2 also the first velocity, 3 both velocities, 4 also the
    first acceleration, 5 both accelerations.
    """
    zero = F.lit(0.0)
    v0, v1, a0, a1 = (zero if x is None else x for x in (v0, v1, a0, a1))
    h = p1 - p0
    if order == 1:
        return [h / d, p0]
    if order == 2:
        return [(h - v0 * d) / (d * d), v0, p0]
    if order == 3:
        return [((v0 + v1) * d - 2 * h) / (d * d * d), (3 * h - (2 * v0 + v1) * d) / (d * d), v0, p0]
    if order == 4:
        r, s = h - v0 * d - a0 * d * d / 2, v1 - v0 - a0 * d  # a3 d^3 + a4 d^4 = r, 3 a3 d^2 + 4 a4 d^3 = s
        return [(s * d - 3 * r) / (d * d * d * d), (4 * r - s * d) / (d * d * d), a0 / 2, v0, p0]
    r, s, q = h - v0 * d - a0 * d * d / 2, v1 - v0 - a0 * d, a1 - a0
    return [
        (12 * r - 6 * s * d + q * d * d) / (2 * d * d * d * d * d),
        (-30 * r + 14 * s * d - 2 * q * d * d) / (2 * d * d * d * d),
        (20 * r - 8 * s * d + q * d * d) / (2 * d * d * d),
        a0 / 2,
        v0,
        p0,
    ]


def polynomial(coefs: list[Column], t: Column, derivative: int = 0) -> Column:
    """Horner's rule for a polynomial, highest power first, or a derivative of it."""
    n = len(coefs) - 1
    out = F.lit(0.0)
    for i, c in enumerate(coefs[: n + 1 - derivative] if derivative else coefs):
        power, factor = n - i, 1
        for k in range(derivative):
            factor *= power - k
        out = out * t + F.lit(float(factor)) * c
    return out


def evaluate(splines: DataFrame, times: DataFrame, order: int) -> DataFrame:
    """(traj_id, t, pos, vel, acc) of containers of splines (traj_id, seg, duration, a<n>..a0) at times from their start.

    Before the start the first spline is held at 0, beyond the end the last one at its end.
    """
    from cloudframe.operators.trajectory import bracket

    order_by = Window.partitionBy("traj_id").orderBy("seg")
    ends = F.sum("duration").over(order_by)
    names = [f"a{k}" for k in range(order, -1, -1)]
    starts = splines.withColumn("t", ends - F.col("duration"))
    stop = splines.groupBy("traj_id").agg(F.sum("duration").alias("stop"))
    # a knot at the end closes the last segment
    knots = starts.select("traj_id", "t", *names).unionByName(stop.select("traj_id", F.col("stop").alias("t"), *[F.lit(0.0).alias(a) for a in names]))
    held = times.join(stop, "traj_id").select("traj_id", F.col("t").alias("asked"), F.greatest(F.lit(0.0), F.least("t", "stop")).alias("t"))
    at = bracket(knots, held.select("traj_id", "t").distinct(), names)
    coefs, u = [F.col(f"{a}0") for a in names], F.col("t") - F.col("t0")
    values = at.select("traj_id", "t", *[polynomial(coefs, u, k).alias(n) for k, n in enumerate(("pos", "vel", "acc"))])
    return held.join(values, ["traj_id", "t"]).select("traj_id", F.col("asked").alias("t"), "pos", "vel", "acc")


def vector_curve(knots: DataFrame, times: DataFrame, fields: Sequence[str], order: int = 5, derivative: int = 0) -> DataFrame:
    """(traj_id, t, fields) of the curve in as many dimensions as ``fields``, or a derivative of it.

    Each segment is, per dimension, the polynomial of ``order`` with its knots' places and,
    where ``knots`` has the columns v<field> and a<field>, their velocities and accelerations,
    else 0. Times before the start and beyond the end take the curve's ends. All dimensions
    share one search for the segments.
    """
    from cloudframe.operators.trajectory import bracket

    given = [p + c for c in fields for p in ("", "v", "a") if p + c in knots.columns]
    span = knots.groupBy("traj_id").agg(F.min("t").alias("__a"), F.max("t").alias("__b"))
    held = times.join(span, "traj_id").select("traj_id", F.col("t").alias("asked"), F.greatest("__a", F.least("t", "__b")).alias("t"))
    at = bracket(knots, held.select("traj_id", "t").distinct(), given)
    d, u = F.col("t1") - F.col("t0"), F.col("t") - F.col("t0")

    def value(c: str) -> Column:
        ends = [F.col(f"{p}{c}{i}") if p + c in given else None for p in ("v", "a") for i in (0, 1)]
        return polynomial(coefficients(order, F.col(f"{c}0"), F.col(f"{c}1"), d, *ends), u, derivative)

    values = at.select("traj_id", "t", *[value(c).alias(c) for c in fields])
    return held.join(values, ["traj_id", "t"]).select("traj_id", F.col("asked").alias("t"), *fields)


def is_valid(splines: DataFrame, order: int) -> DataFrame:
    """(traj_id, valid): no negative or missing duration or place, no coefficient that is not a number."""
    good = (F.col("duration") >= 0) & (F.col("seg") >= 0)
    for k in range(order + 1):
        good = good & F.col(f"a{k}").isNotNull() & ~F.isnan(f"a{k}")
    return splines.groupBy("traj_id").agg(F.every(F.coalesce(good, F.lit(False))).alias("valid"))


def cubic_system(t: np.ndarray, x: np.ndarray, v0: float = 0.0, v1: float = 0.0) -> np.ndarray:
    """Rows [a3, a2, a1, a0] of the cubic spline through (t, x) with two continuous derivatives and given end velocities."""
    h, rise = np.diff(t), np.diff(x)
    below, diagonal, above, right = np.zeros(len(t)), np.ones(len(t)), np.zeros(len(t)), np.zeros(len(t))
    right[0], right[-1] = v0, v1
    below[1:-1], diagonal[1:-1], above[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    right[1:-1] = 3 * (h[1:] * rise[:-1] / h[:-1] + h[:-1] * rise[1:] / h[1:])
    v = solve_tridiagonal(below, diagonal, above, right)
    return np.column_stack([((v[:-1] + v[1:]) * h - 2 * rise) / h**3, (3 * rise - (2 * v[:-1] + v[1:]) * h) / h**2, v[:-1], x[:-1]])


def fit_cubic(knots: DataFrame, value: str = "x", block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """(traj_id, seg, duration, a3..a0): the cubic spline through each trajectory's knots; of knots at one time the least.

    The system is solved in blocks of knots with ``halo`` knots of each neighbour. A row's
    diagonal is twice the sum of its others, so a wrong velocity at the cut is halved by
    each knot on the way: 64 knots leave 2^-64 of it, less than rounding does.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        i, t, x, own = rows["i"].to_numpy(), rows["t"].to_numpy(float), rows[value].to_numpy(float), rows["own"].to_numpy(bool)
        n = int(rows["n"].iloc[0])
        if n < 2:
            return pd.DataFrame({"traj_id": [], "seg": [], "duration": [], "a3": [], "a2": [], "a1": [], "a0": []})
        cut = [0.0 if end else (x[k + 1] - x[k]) / (t[k + 1] - t[k]) for end, k in ((i[0] == 0, 0), (i[-1] == n - 1, len(t) - 2))]
        a, own = cubic_system(t, x, *cut), own[:-1]
        return pd.DataFrame({"traj_id": key[0], "seg": i[:-1][own], "duration": np.diff(t)[own], **{f"a{3 - k}": a[own, k] for k in range(4)}})

    single = knots.groupBy("traj_id", "t").agg(F.min(value).alias(value))
    return in_blocks(single, "traj_id", ["t"], block=block, halo=halo).groupBy("traj_id", "block").applyInPandas(run, "traj_id long, seg long, duration double, a3 double, a2 double, a1 double, a0 double")


def fit_linear(knots: DataFrame, value: str = "x") -> DataFrame:
    """(traj_id, seg, duration, a1, a0): straight pieces between the knots."""
    from cloudframe.operators.trajectory import segments

    order = Window.partitionBy("traj_id").orderBy("t0")
    d = F.col("t1") - F.col("t0")
    return segments(knots, [value]).where("t1 > t0").select("traj_id", (F.row_number().over(order) - 1).cast("long").alias("seg"), d.alias("duration"), ((F.col(f"{value}1") - F.col(f"{value}0")) / d).alias("a1"), F.col(f"{value}0").alias("a0"))


def _ends(order: int) -> np.ndarray:
    """Over [0, 1]: the power coefficients (lowest first) by place, velocity and acceleration at 0 and place, velocity (and of order 5 acceleration) at 1."""
    k = np.arange(order + 1.0)
    start = np.diag([1.0, 1.0, 2.0, *[0.0] * (order - 2)])[:3]
    # its entries are halves
    return np.round(2 * np.linalg.inv(np.vstack([start, np.ones(order + 1), k, k * (k - 1)])[: order + 1])) / 2


def _maps(order: int, h: np.ndarray) -> np.ndarray:
    """For each duration the matrix from a piece's ends to its coefficients, lowest power first."""
    scale = np.array([0, 1, 2, 0, 1, 2][: order + 1])
    return _ends(order) * h[:, None, None] ** (scale[None, None, :] - np.arange(order + 1)[None, :, None])


def _solved(pivot: list[list], right: list[list]) -> list[list]:
    """Elimination for a matrix of 2 or 3 rows of decimals and columns on the right."""
    if len(pivot) == 2:
        (a, b), (c, d) = pivot
        over = 1 / (a * d - b * c)
        return [[(d * u - b * v) * over for u, v in zip(*right, strict=True)], [(a * v - c * u) * over for u, v in zip(*right, strict=True)]]
    rows = [[*p, *q] for p, q in zip(pivot, right, strict=True)]
    for i in range(3):
        best = max(range(i, 3), key=lambda r: abs(rows[r][i]))
        rows[i], rows[best] = rows[best], rows[i]
        over = 1 / rows[i][i]
        own = rows[i] = [v * over for v in rows[i]]
        for r in range(3):
            if r != i and (f := rows[r][i]):
                rows[r] = [v - f * w if w else v for v, w in zip(rows[r], own, strict=True)]
    return [row[3:] for row in rows]


def _exact_pieces(order: int, h: np.ndarray, x: np.ndarray, first: tuple[float, float], last: tuple[float, float], more_digits: int = 0) -> np.ndarray:
    """The rows of ``smallest_pieces`` for two pieces or more, by the same elimination in decimals.

    Sums of squares have durations to the power of -10, so the digits follow from the spread of the durations.
    """
    n, m, size = len(h), order + 1, 2 if order == 5 else 3
    spread = max(1.0, float(h.max())) / min(1.0, float(h.min()))
    D = decimal.Decimal
    zero, one = D(0), D(1)
    with decimal.localcontext(decimal.Context(prec=50 + math.ceil(12 * math.log10(spread)) + more_digits, Emin=decimal.MIN_EMIN, Emax=decimal.MAX_EMAX)):
        decimals = lambda own: np.array([D(float(v)) for v in own], object)
        maps, scale = [[D(float(c)) for c in row] for row in _ends(order)], [0, 1, 2, 0, 1, 2]
        d, places, begin, end = decimals(h), decimals(x), [D(float(v)) for v in first], [D(float(v)) for v in last]
        rise, start, stop = np.diff(places), (1, 2), tuple(range(4, m))
        up, over = [one + 0 * d, d], [one + 0 * d, 1 / (d * d)]
        for _ in range(4):
            up.append(up[-1] * d)
            over.append(over[-1] * over[1])

        def squares(i: int, j: int) -> np.ndarray:
            """The products of two columns of each piece's map from its ends."""
            held = [(maps[k][i] * maps[k][j], k) for k in range(1, m) if maps[k][i] and maps[k][j]]
            return up[scale[i] + scale[j]] * sum(c * over[k] for c, k in held)

        at_start, across, at_stop = ([[squares(i, j) for j in right] for i in left] for left, right in ((start, start), (start, stop), (stop, stop)))
        # that of the second place with the others; of the first place it is the same, turned
        lift_start, lift_stop = ([squares(i, 3) * rise for i in own] for own in (start, stop))
        speed, bend = 6 / d, 12 * rise / (d * d)
        above_all, fixed, left = [], [], None
        # knots 1 .. n - 1 and, for order 4, the last one for its piece's multiplier
        for k in range(1, n + (order == 4)):
            diagonal, above, right = [[zero] * size for _ in range(size)], [[zero] * size for _ in range(size)], [zero] * size
            if k < n:
                for i in range(2):
                    right[i] = -lift_start[i][k]
                    diagonal[i][:2] = at_start[i][0][k], at_start[i][1][k]
                    for j in range(len(stop)):
                        above[i][j] = across[i][j][k]
                for i in range(len(stop)):
                    right[i] -= lift_stop[i][k - 1]
                    for j in range(len(stop)):
                        diagonal[i][j] += at_stop[i][j][k - 1]
                    if k == 1:
                        right[i] -= across[0][i][0] * begin[0] + across[1][i][0] * begin[1]
            else:
                diagonal[0][0] = diagonal[1][1] = one
                right[:2] = end
            if order == 4:
                # a piece's last acceleration is its first one + 6 (v0 + v1) / d - 12 rise / d^2
                right[2] = -bend[k - 1]
                if k == 1:
                    right[2] += speed[0] * begin[0] + begin[1]
                if k < n:
                    diagonal[0][2] = diagonal[2][0] = -speed[k - 1]
                    diagonal[1][2] = diagonal[2][1] = one
                    above[0][2], above[1][2] = -speed[k], -one
                else:
                    right[2] += speed[k - 1] * end[0] - end[1]
            if k == n - 1:
                # the last knot's velocity and acceleration are known
                for i in range(2):
                    right[i] -= above[i][0] * end[0] + (above[i][1] * end[1] if order == 5 else zero)
                    above[i][:2] = zero, zero
            if k > 1:
                c, f = above_all[-1], fixed[-1]
                for i in range(size):
                    for q in range(size):
                        if b := left[q][i]:
                            diagonal[i] = [v - b * w for v, w in zip(diagonal[i], c[q], strict=True)]
                            right[i] -= b * f[q]
            both = _solved(diagonal, [[*a, r] for a, r in zip(above, right, strict=True)])
            above_all.append([row[:-1] for row in both])
            fixed.append([row[-1] for row in both])
            left = above
        for k in range(len(fixed) - 2, -1, -1):
            fixed[k] = [f - sum(c * v for c, v in zip(row, fixed[k + 1], strict=True)) for f, row in zip(fixed[k], above_all[k], strict=True)]
        v, a = (np.array([begin[i], *[f[i] for f in fixed[: n - 1]], end[i]], object) for i in (0, 1))
        ends = [e * up[q] for e, q in zip((places[:-1], v[:-1], a[:-1], places[1:], v[1:], a[1:]), scale, strict=True)][:m]
        return np.column_stack([(sum(c * e for c, e in zip(maps[k], ends, strict=True) if c) / up[k]).astype(float) for k in range(order, -1, -1)])


def smallest_pieces(order: int, t: np.ndarray, x: np.ndarray, first: tuple[float, float], last: tuple[float, float]) -> np.ndarray:
    """Rows [a_n .. a_0] of the pieces of order 4 or 5 through (t, x) with two continuous derivatives and given (velocity, acceleration) at both ends.

    Of all such curves it is the one whose coefficients have the least sum of squares. The
    unknowns are velocity and acceleration at the inner knots, so places and derivatives
    meet whatever the solution's rounding; a piece of order 4 has its end's acceleration
    fixed by the rest, which is a condition with a multiplier beside that knot. One piece of
    order 4 can't keep both accelerations: it keeps places and velocities. Beyond some spread
    of the durations doubles have no digits left for the least squares: then decimals do it.
    """
    h, n = np.diff(t), len(t) - 1
    v, a = np.zeros(n + 1), np.zeros(n + 1)
    (v[0], a[0]), (v[-1], a[-1]) = first, last
    maps = _maps(order, h)
    if order == 4 and n == 1:
        ends = np.array([x[0], v[0], 0.0, x[1], v[1]])
        way = maps[0][:, 2]
        ends[2] = -(way @ (maps[0] @ ends)) / (way @ way)
        return (maps[0] @ ends)[None, ::-1]
    if n > 1 and h.max() > MOST_SPREAD[order] * h.min():
        return _exact_pieces(order, h, x, first, last)
    squares = np.swapaxes(maps, 1, 2) @ maps
    places = np.stack([x[:-1], x[1:]], 1)
    size = 2 if order == 5 else 3
    right_ends = [4, 5] if order == 5 else [4]
    # blocks of knots 1 .. n: velocity, acceleration and, for order 4, the multiplier of the piece before; the last knot is known
    diagonal, above, right = np.zeros((n, size, size)), np.zeros((n, size, size)), np.zeros((n, size))
    k = len(right_ends)
    diagonal[:, :k, :k] += squares[:, right_ends][:, :, right_ends]
    right[:, :k] -= np.einsum("sij,sj->si", squares[:, right_ends][:, :, [0, 3]], places)
    diagonal[:-1, :2, :2] += squares[1:, 1:3, 1:3]
    right[:-1, :2] -= np.einsum("sij,sj->si", squares[1:, 1:3][:, :, [0, 3]], places[1:])
    above[:-1, :2, :k] = squares[1:, 1:3][:, :, right_ends]
    known = np.array([v[0], a[0]])
    right[0, :k] -= squares[0][right_ends][:, [1, 2]] @ known
    if order == 4:
        # the end's acceleration by the other five ends
        bend = np.einsum("sk,skj->sj", np.array([0, 0, 2, 6, 12.0]) * h[:, None] ** (np.arange(5.0) - 2), maps)
        diagonal[:, 0, 2] = diagonal[:, 2, 0] = -bend[:, 4]
        diagonal[:, 1, 2] = diagonal[:, 2, 1] = 1.0
        above[:-1, :2, 2] = -bend[1:, 1:3]
        right[:, 2] = bend[:, 0] * x[:-1] + bend[:, 3] * x[1:]
        right[0, 2] += bend[0, 1:3] @ known
    below = np.zeros_like(above)
    below[1:] = np.swapaxes(above[:-1], 1, 2)
    # the known velocity and acceleration of the last knot go to the right
    end = np.array([v[-1], a[-1]])
    if n > 1:
        right[-2] -= above[-2][:, :2] @ end
        above[-2][:, :2] = 0.0
        below[-1][:2] = 0.0
    right[-1, 2:] -= diagonal[-1][2:, :2] @ end
    diagonal[-1][:, :2] = diagonal[-1][:2] = 0.0
    diagonal[-1][[0, 1], [0, 1]] = 1.0
    right[-1, :2] = end
    # units of alike size: accelerations and multipliers of short and long pieces differ by many powers of ten
    unit = np.ones((n, size))
    unit[:, :2] = 1 / np.sqrt(np.maximum(np.abs(diagonal[:, [0, 1], [0, 1]]), 1e-300))
    if order == 4:
        unit[:, 1] = np.where(diagonal[:, 1, 1] == 0, 1.0, unit[:, 1])
        unit[:, 2] = 1 / np.maximum(np.abs(bend[:, 4]) * unit[:, 0], unit[:, 1])
    after = np.vstack([unit[1:], np.ones((1, size))])
    before = np.vstack([np.ones((1, size)), unit[:-1]])
    found = solve_block_tridiagonal(below * unit[:, :, None] * before[:, None, :], diagonal * unit[:, :, None] * unit[:, None, :], above * unit[:, :, None] * after[:, None, :], right * unit) * unit
    v[1:-1], a[1:-1] = found[:-1, 0], found[:-1, 1]
    ends = np.stack([x[:-1], v[:-1], a[:-1], x[1:], v[1:], a[1:]], 1)[:, : order + 1]
    return np.einsum("skj,sj->sk", maps, ends)[:, ::-1]


def fit(knots: DataFrame, order: int, value: str = "x", block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """(traj_id, seg, duration, a<n>..a0): pieces of order 1 to 5 through each trajectory's knots with as many inner conditions as the order can keep.

    Orders 3 to 5 keep place, velocity and acceleration at the inner knots and, at both ends,
    the place and what the columns v<value> and a<value> of the first and last knot give (0
    where they are null or missing; order 3, and one piece of order 4, keep velocities only).
    What is still free makes the sum of the squared coefficients least. Orders 1 and 2 keep
    places only and are straight. Of knots at one time the least counts; a trajectory with
    one knot has no pieces. Long trajectories are solved in blocks with ``halo`` knots of
    each neighbour, from which wrong ends at the cut die out.
    """
    if order not in (1, 2, 3, 4, 5):
        raise ValueError("orders are 1 to 5")
    if order < 3:
        straight = fit_linear(knots.groupBy("traj_id", "t").agg(F.min(value).alias(value)), value)
        return straight if order == 1 else straight.select("traj_id", "seg", "duration", F.lit(0.0).alias("a2"), "a1", "a0")
    names = [f"a{k}" for k in range(order, -1, -1)]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        i, n = rows["i"].to_numpy(), int(rows["n"].iloc[0])
        if n < 2:
            return pd.DataFrame({c: [] for c in ("traj_id", "seg", "duration", *names)})
        t, x, v, a = (rows[c].to_numpy(float) for c in ("t", "x", "v", "a"))
        own = rows["own"].to_numpy(bool)[:-1]
        # at a cut the mean velocity stands for the one that is not known
        first = (v[0], a[0]) if i[0] == 0 else ((x[1] - x[0]) / (t[1] - t[0]), 0.0)
        last = (v[-1], a[-1]) if i[-1] == n - 1 else ((x[-1] - x[-2]) / (t[-1] - t[-2]), 0.0)
        found = cubic_system(t, x, first[0], last[0]) if order == 3 else smallest_pieces(order, t, x, first, last)
        return pd.DataFrame({"traj_id": key[0], "seg": i[:-1][own], "duration": np.diff(t)[own], **{c: found[own, k] for k, c in enumerate(names)}})

    given = {p: F.coalesce(F.col(p + value).cast("double"), F.lit(0.0)) if p + value in knots.columns else F.lit(0.0) for p in ("v", "a")}
    one = F.struct(F.col(value).alias("x"), given["v"].alias("v"), given["a"].alias("a"))
    single = knots.groupBy("traj_id", "t").agg(F.min(one).alias("k")).select("traj_id", "t", "k.x", "k.v", "k.a")
    schema = "traj_id long, seg long, duration double, " + ", ".join(f"{c} double" for c in names)
    return in_blocks(single, "traj_id", ["t"], block=block, halo=halo).groupBy("traj_id", "block").applyInPandas(run, schema)
