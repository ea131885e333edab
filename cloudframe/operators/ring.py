"""Range images of a scanner's rings: binning, ground, components, smoothness. Images are sparse tables of cells.

``frame`` names a long column (not negative) by which one table holds many scans; each
is treated on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.functions.geometry import folded_angle, spherical
from cloudframe.operators.cluster import rank_rows
from cloudframe.operators.density import Cells
from cloudframe.operators.graph import connected_components
from cloudframe.operators.neighbors import XYZ
from cloudframe.sources.shared import write_table

COLUMNS = 1800


def _cell(frame: str | None) -> list[str]:
    return [*([frame] if frame else []), "row", "col"]


def _last_point(cells: DataFrame, *fields: str, frame: str | None = None) -> DataFrame:
    """One row per cell: that of the highest id, and how many others it covers."""
    key = _cell(frame)
    return cells.groupBy(*key).agg(F.max_by(F.struct(*fields), "id").alias("p"), F.max("id").alias("point_id"), (F.count(F.lit(1)) - 1).alias("covered")).select(*key, *[f"p.{f}" for f in fields], "point_id", "covered")


def angle_range(points: DataFrame) -> DataFrame:
    """One row: the least and greatest vertical and horizontal (folded) angles; the greatest is at least 0, the least at most 1000."""
    a = points.select(spherical(F.col("x"), F.col("y"), F.col("z"))["vang"].alias("v"), folded_angle(F.col("x"), F.col("y")).alias("h"))
    return a.agg(*[F.least(F.min(c), F.lit(1000.0)).alias(f"min_{c}") for c in "vh"], *[F.greatest(F.max(c), F.lit(0.0)).alias(f"max_{c}") for c in "vh"])


def range_image(points: DataFrame, *, r: float = 3.0, least: int = 6, row_step: float = 2.0, col_step: float = 0.2) -> DataFrame:
    """(row, col, range, point_id, covered) of the points with at least ``least`` points nearer than r; angles count from the smallest.

    Full cells are decided by their counts, as those of density clusters are, so near pairs are looked at for few points.
    """
    cells = Cells(r, XYZ)
    core, _ = cells.core(write_table(cells.place(points), "range-points"), least)
    dense = points.join(write_table(core.select("id"), "range-dense"), "id", "left_semi")
    sp = spherical(F.col("x"), F.col("y"), F.col("z"))
    lows = angle_range(dense)  # one row
    cells = dense.select("id", sp["range"].alias("range"), sp["vang"].alias("v"), folded_angle(F.col("x"), F.col("y")).alias("h")).join(F.broadcast(lows))
    cells = cells.where("h is not null").select("id", "range", F.floor((F.col("v") - F.col("min_v")) / row_step).cast("int").alias("row"), F.floor((F.col("h") - F.col("min_h")) / col_step).cast("int").alias("col"))
    return _last_point(cells, "range")


def project(points: DataFrame, rows: int = 16, columns: int = COLUMNS, bottom: float = 15.1, row_step: float = 2.0, frame: str | None = None) -> DataFrame:
    """(row, col, range, x, y, z, point_id, covered): rings by vertical angle, columns by azimuth, the last point of each cell."""
    step = 360.0 / columns
    sp = spherical(F.col("x"), F.col("y"), F.col("z"))
    row = ((sp["vang"] + bottom) / row_step).cast("int")  # towards zero
    turned = (sp["hang"] - 90) / step
    col = -(F.signum(turned) * F.floor(F.abs(turned) + 0.5)).cast("int") + columns // 2
    cells = points.select(*([frame] if frame else []), "id", "x", "y", "z", sp["range"].alias("range"), row.alias("row"), F.when(col >= columns, col - columns).otherwise(col).alias("col"))
    return _last_point(cells.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, columns - 1)), "range", "x", "y", "z", frame=frame)


def is_indoor(image: DataFrame, far: float = 60.0, least: int = 20) -> DataFrame:
    return image.agg((F.count_if(F.col("range") > far) < least).alias("indoor"))


def ground(image: DataFrame, last_row: int = 6, most_degrees: float = 10.0, frame: str | None = None) -> DataFrame:
    """``image`` with is_ground: from row 0 to ``last_row``, a cell and the one above it are ground if the way between them is flat.

    A cell whose upper neighbour is missing loses the mark it got from below.
    """
    key = _cell(frame)
    own = key[:-2]
    upper = image.select(*own, (F.col("row") - 1).alias("row"), "col", *[F.col(c).alias(f"u{c}") for c in "xyz"], F.lit(True).alias("paired"))
    dx, dy, dz = (F.col(f"u{c}") - F.col(c) for c in "xyz")
    flat = F.abs(F.degrees(F.atan2(dz, F.sqrt(dx * dx + dy * dy)))) <= most_degrees
    pairs = image.where(F.col("row") <= last_row).join(upper, key, "left").select(*key, F.coalesce("paired", F.lit(False)).alias("paired"), F.coalesce(flat, F.lit(False)).alias("flat"))
    below = pairs.select(*own, (F.col("row") + 1).alias("row"), "col", F.col("flat").alias("below"))
    marked = image.join(pairs, key, "left").join(below, key, "left")
    of_pair = F.coalesce("flat", F.lit(False)) | (F.coalesce("below", F.lit(False)) & (F.coalesce("paired", F.lit(False)) | (F.col("row") > last_row)))
    return marked.select(*image.columns, (of_pair & (F.col("row") <= last_row + 1)).alias("is_ground"))


def ground_range(marked: DataFrame, frame: str | None = None) -> DataFrame:
    """(col, max_range): the farthest ground of each column."""
    return marked.groupBy(*_cell(frame)[:-2], "col").agg(F.coalesce(F.max(F.when(F.col("is_ground"), F.col("range"))), F.lit(0.0)).alias("max_range"))


def segments(cells: DataFrame, *, columns: int = COLUMNS, row_degrees: float = 2.0, angle: float = 1.0472, least: int = 30, few: int = 5, least_rows: int = 3, frame: str | None = None) -> DataFrame:
    """(row, col, label) of (row, col, range): neighbours (columns wrap around) on one surface are joined.

    Components of ``least`` cells, or of ``few`` cells in ``least_rows`` rows without
    their first cell's, are labelled from 1 in the order of their first cells; others get 0.
    """
    cell = _cell(frame)
    own = cell[:-2]
    key = F.col("row").cast("long") * columns + F.col("col")
    if frame:
        key = F.col(frame) * (1 << 24) + key  # up to 2^24 cells a scan
    here = cells.select(*own, key.alias("u"), "row", "col", "range")
    right = cells.select(*own, key.alias("v"), "row", F.pmod(F.col("col") - 1, F.lit(columns)).cast("int").alias("col"), F.col("range").alias("other"), F.lit(360.0 / columns).alias("step"))
    up = cells.select(*own, key.alias("v"), (F.col("row") - 1).alias("row"), "col", F.col("range").alias("other"), F.lit(row_degrees).alias("step"))
    far, near, step = F.greatest("range", "other"), F.least("range", "other"), F.radians("step")
    joined = here.join(right.union(up), cell).where(F.atan2(near * F.sin(step), far - near * F.cos(step)) > angle)
    parts = connected_components(joined.select("u", "v"))
    placed = here.join(parts.withColumnRenamed("node", "u"), "u", "left").withColumn("first", F.coalesce("component", "u"))
    sizes = placed.groupBy(*own, "first").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("u") != F.col("first"), F.col("row"))).alias("n_rows"))
    valid = sizes.where((F.col("n") >= least) | ((F.col("n") >= few) & (F.col("n_rows") >= least_rows))).select(*own, "first")
    numbers = valid.withColumn("label", F.row_number().over(Window.partitionBy(frame).orderBy("first"))) if frame else rank_rows(valid, "first", "label")
    return placed.join(numbers.drop(*own), "first", "left").select(*cell, F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def segmentation(marked: DataFrame, labels: DataFrame, columns: int = COLUMNS, frame: str | None = None) -> DataFrame:
    """Cells with the outputs they belong to: is_segmented, is_outlier, is_pure, is_above_ground."""
    both = marked.join(labels, _cell(frame), "left").join(ground_range(marked, frame), [*_cell(frame)[:-2], "col"])
    label = F.coalesce("label", F.lit(-1))
    sparse = (F.col("col") % 5 == 0) | (F.col("col") <= 5) | (F.col("col") >= columns - 5)
    return both.withColumns({
        "is_segmented": (label > 0) | (F.col("is_ground") & sparse),
        "is_outlier": (label == 0) & (F.col("row") > 7) & (F.col("col") % 5 == 0),
        "is_pure": label > 0,
        "is_above_ground": ~F.col("is_ground") & (F.col("range") < F.col("max_range")),
    })


def end_angles(points: DataFrame, order: str = "id") -> DataFrame:
    """One row: the azimuths of the first and last points, the last made to follow the first."""
    a = points.select(order, (-F.atan2("y", "x")).alias("a")).agg(F.min_by("a", order).alias("first"), (F.max_by("a", order) + 2 * F.pi()).alias("last"))
    turn = F.when(F.col("last") - F.col("first") > 3 * F.pi(), -2 * F.pi()).when(F.col("last") - F.col("first") < F.pi(), 2 * F.pi()).otherwise(F.lit(0.0))
    return a.select("first", (F.col("last") + turn).alias("last"))


def smoothness(cells: DataFrame, *, block: int = 180, before: int = 9, after: int = 8, least: int = 9, near: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(row, col, block, s): how far a range is from those around it in its row, where enough of them are there.

    Only cells ``before`` or more columns from their block's ends are rated.
    """
    order = Window.partitionBy(*by, "row").orderBy("col").rangeBetween(-before, after)
    real = F.when(F.col("range") > near, F.col("range"))
    seen = cells.select(*by, "row", "col", "range", F.sum(real).over(order).alias("total"), F.count(real).over(order).alias("n"))
    s = F.abs(F.col("total") - F.col("n") * F.col("range")) / (F.col("n") * F.col("range"))
    rated = (F.col("range") >= near) & (F.col("n") >= least) & (F.col("col") % block).between(before, block - 1)
    return seen.where(rated).select(*by, "row", "col", F.floor(F.col("col") / block).cast("int").alias("block"), s.alias("s"))


def smoothness_labels(rated: DataFrame, *, more_than: int = 9, edges: int = 3, flats: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """(row, col, type): 2 below the ``flats``-th smallest value of its row and block, else 1 from the ``edges``-th largest on, else 0."""
    group = [*by, "row", "block"]
    up = F.row_number().over(Window.partitionBy(*group).orderBy("s", "col"))
    down = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("s"), "col"))
    ranked = rated.withColumn("up", up).withColumn("down", down)
    marks = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("up") == flats, F.col("s"))).alias("flat"), F.max(F.when(F.col("down") == edges, F.col("s"))).alias("edge"))
    kind = F.when(F.col("s") < F.col("flat"), 2).when(F.col("s") >= F.col("edge"), 1).otherwise(0)
    return ranked.join(marks.where(F.col("n") > more_than), group).select(*by, "row", "col", kind.alias("type"))
