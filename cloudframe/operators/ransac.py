"""Planes and lines by consensus, with samples drawn by hash: the same points give the same models.

The candidates come from the points with the smallest md5 of their ids, a bounded number
whatever the input; counting their inliers is one aggregation over all points, and so is
the least-squares model through the best one's inliers. A found model's points are left out
by its equation, so no round adds a join; after a few models what is left is written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.sources.shared import drop_table, write_table

#: models whose conditions one plan holds
WRITE_AFTER = 8


@dataclass(frozen=True)
class Model:
    kind: str  #: plane: a, b, c, d; line: a point and a direction
    values: tuple[float, ...]

    def distance(self) -> Column:
        found = _measure(self.kind, self.values, *(F.col(c) for c in "xyz"))
        return F.abs(found) if self.kind == "plane" else F.sqrt(found)


def _measure(kind: str, values: Sequence, x, y, z):
    """Signed distance to a plane, squared distance to a line; of columns or of arrays."""
    if kind == "plane":
        a, b, c, d = values
        return x * a + y * b + z * c + d
    px, py, pz, ux, uy, uz = values
    dx, dy, dz = x - px, y - py, z - pz
    cx, cy, cz = dy * uz - dz * uy, dz * ux - dx * uz, dx * uy - dy * ux
    return cx * cx + cy * cy + cz * cz


def _counts(points: DataFrame, models: list[Model], within: float) -> list[int]:
    """How many points each model has nearer than ``within``: a task counts for all models at once and gives one row."""
    kind, values = models[0].kind, np.array([m.values for m in models]).T[:, None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(values.shape[2], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                xyz = [c.to_numpy(zero_copy_only=False)[:, None] for c in batch.slice(at, 1024).columns]
                found = _measure(kind, values, *xyz)
                counts += ((np.abs(found) if kind == "plane" else np.sqrt(found)) < within).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tolist()], pa.list_(pa.int64()))], names=["counts"])

    parts = points.select(*[F.col(c).cast("double") for c in "xyz"]).mapInArrow(run, "counts array<long>")
    sums = {r["pos"]: r["n"] for r in parts.select(F.posexplode("counts").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}
    return [sums.get(i, 0) for i in range(len(models))]


def _candidates(points: DataFrame, kind: str, tries: int) -> list[Model]:
    k = 3 if kind == "plane" else 2
    rows = points.select("id", "x", "y", "z").orderBy(F.md5(F.col("id").cast("string")), "id").limit(k * tries).collect()
    at = np.array([[r.x, r.y, r.z] for r in rows])
    out = []
    for i in range(0, len(rows) - k + 1, k):
        if kind == "plane":
            normal = np.cross(at[i + 1] - at[i], at[i + 2] - at[i])
            length = np.linalg.norm(normal)
            if length > 1e-12:
                n = normal / length
                out.append(Model("plane", (*n.tolist(), float(-(n @ at[i])))))
        else:
            way = at[i + 1] - at[i]
            if np.linalg.norm(way) > 1e-12:
                out.append(Model("line", (*at[i].tolist(), *(way / np.linalg.norm(way)).tolist())))
    return out


def best_model(points: DataFrame, kind: str, within: float, tries: int, refine: bool = True) -> tuple[Model, int] | None:
    """The candidate with the most points nearer than ``within``, the first of equals, and their number.

    With ``refine`` it is moved to the least-squares model of these points, and the number is the moved model's.
    """
    models = _candidates(points, kind, tries)
    if not models:
        return None
    counts = _counts(points, models, within)
    best = int(np.argmax(counts))
    if not refine:
        return models[best], counts[best]
    moved = _refined(points, models[best], within)
    return moved, points.agg(F.count_if(moved.distance() < within)).first()[0]


def _refined(points: DataFrame, model: Model, within: float) -> Model:
    """The model through the centre of its points along their principal axes; itself where they do not fix these."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    near = points.where(model.distance() < within).agg(*[F.avg(c).alias(c) for c in "xyz"], *[F.covar_pop(a, b).alias(a + b) for a, b in pairs]).first()
    if near["x"] is None:
        return model
    centre = np.array([near[c] for c in "xyz"])
    value, vector = np.linalg.eigh(np.array([[near[min(a, b) + max(a, b)] for b in "xyz"] for a in "xyz"]))
    # a plane needs two axes longer than its normal, a line one longer than the others
    if value[1 if model.kind == "plane" else 2] <= 1e-12 * max(value[2], 1e-300):
        return model
    along = vector[:, 0 if model.kind == "plane" else 2]
    # sums of doubles end differently in other orders of rows: what lies below these digits is cut off
    along = np.round(along * np.sign(along[np.abs(along).argmax()]), 10)
    centre = np.round(centre, 10 - int(np.ceil(np.log10(max(1.0, np.abs(centre).max())))))
    return Model("plane", (*along.tolist(), round(float(-(along @ centre)), 9))) if model.kind == "plane" else Model("line", (*centre.tolist(), *along.tolist()))


def extract(points: DataFrame, kind: str, within: float, *, tries: int = 800, least: int = 1000, stop_share: float = 0.3, most_models: int | None = None, refine: bool = True) -> DataFrame:
    """(id, model, m0, ...): models one after another, each from the points left by those before.

    Ends when at most ``stop_share`` of the points are left, when a model has fewer than
    ``least`` points (1 at least) or, if it is given, after ``most_models``. Points without a
    place take no part. What is left is written after each ``WRITE_AFTER`` models, so neither
    a round's plan nor what it reads grows with the models before.
    """
    base = write_table(points.select("id", "x", "y", "z").where("x is not null and y is not null and z is not null"), "unmodelled")
    left, total = base, base.count()
    n_left, models, fresh, parts = total, [], [], []

    def tagged() -> DataFrame:
        """What was left at the last write, with the first of the models since."""
        return base.withColumn("model", F.coalesce(*[F.when(m.distance() < within, F.lit(i)) for i, m in fresh], F.lit(None).cast("int")))

    while n_left > stop_share * total and (most_models is None or len(models) < most_models):
        found = best_model(left, kind, within, tries, refine)
        if not found or found[1] < max(1, least):
            break
        fresh.append((len(models), found[0]))
        models.append(found[0])
        left, n_left = left.where(~(found[0].distance() < within)), n_left - found[1]
        if len(fresh) == WRITE_AFTER:
            known = write_table(tagged(), "modelled")
            if not parts:
                drop_table(base)
            parts.append(known.where("model is not null").select("id", "model"))
            base = left = known.where("model is null").drop("model")
            fresh = []
    parts.append(tagged().where("model is not null").select("id", "model"))
    names = [f"m{i}" for i in range(4 if kind == "plane" else 6)]
    values = points.sparkSession.createDataFrame([(i, *m.values) for i, m in enumerate(models)], "model int, " + ", ".join(f"{n} double" for n in names))
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(values), "model").select("id", "model", *names)


def planes(points: DataFrame, within: float = 0.3, **options) -> DataFrame:
    return extract(points, "plane", within, **{"least": 1000, **options})


def lines(points: DataFrame, within: float = 0.1, **options) -> DataFrame:
    return extract(points, "line", within, **{"least": 5000, **options})
