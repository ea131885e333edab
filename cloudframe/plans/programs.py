"""Whole programs over many scans: each is one plan over all frames, with the sequential steps kept per sequence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.functions.geometry import rotate_rpy
from cloudframe.operators import cluster, ring, rotations, tracking, trajectory, voxels
from cloudframe.sources.shared import write_table


@dataclass(frozen=True)
class Scan:
    """Settings of the scanner and of the clustering."""

    columns: int = 1800
    ground_degrees: float = 10.0
    angle: float = 1.0472
    radius: float = 0.2
    least: int = 20
    most: int | None = None
    grow: float = 0.3


def above_ground(points: DataFrame, scan: Scan) -> DataFrame:
    """Points (frame_id, id, x, y, z) that stand above the ground of their own scan."""
    image = write_table(ring.project(points, columns=scan.columns, frame="frame_id"), "scan-image")
    marked = ring.ground(image, most_degrees=scan.ground_degrees, frame="frame_id")
    labels = ring.segments(image, columns=scan.columns, angle=scan.angle, frame="frame_id")
    found = ring.segmentation(marked, labels, scan.columns, frame="frame_id").where("is_above_ground")
    return found.select("frame_id", F.col("point_id").alias("id"), "x", "y", "z")


def to_world(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Points moved by the pose (frame_id, tx, ty, tz, roll, pitch, yaw) of their frame; frames without one are left out."""
    both = points.join(poses, "frame_id")
    turned = rotate_rpy(*[F.col(c) for c in ("x", "y", "z", "roll", "pitch", "yaw")])
    return both.withColumns({c: v + F.col(f"t{c}") for c, v in zip("xyz", turned, strict=True)}).select(*points.columns)


def objects(points: DataFrame, scan: Scan) -> DataFrame:
    """(frame_id, cluster, n, min/max/avg of x, y, z) of the clusters of each frame; ids are unique over all frames."""
    found = cluster.euclidean_clusters(points, scan.radius, scan.least, scan.most, dims=("x", "y"), by=("frame_id",))
    return voxels.boxes(points.join(found, "id"), ["frame_id", "cluster"])


def remove_dynamic_objects(points: DataFrame, poses: DataFrame, scan: Scan | None = None) -> DataFrame:
    """The map of all frames without the points in boxes of moving objects.

    ``points``: seq_id, frame_id, id, x, y, z with frames in order within a sequence and
    ids unique. Ground and lone points are found scan by scan, clusters frame by frame in
    the world, tracks sequence by sequence; boxes of tracks that move are grown and what
    is inside in the same frame is left out.
    """
    scan = scan or Scan()
    frames = points.select("seq_id", "frame_id").distinct()
    seen = write_table(to_world(above_ground(points.select("frame_id", "id", "x", "y", "z"), scan), poses), "scan-points")
    boxes = write_table(objects(seen, scan), "scan-objects")
    detections = boxes.join(frames, "frame_id").select("seq_id", F.col("frame_id").alias("frame"), F.col("cluster").alias("det_id"), F.col("avg_x").alias("x"), F.col("avg_y").alias("y"))
    moving = tracking.track(detections).where("dynamic").select(F.col("frame").alias("frame_id"), F.col("det_id").alias("cluster"))
    sides = boxes.join(moving, ["frame_id", "cluster"]).select("frame_id", *[(F.col(f"{m}_{c}") + s * scan.grow).alias(f"{m}_{c}") for m, s in (("min", -1), ("max", 1)) for c in "xyz"])
    world = to_world(points.select("frame_id", "id", "x", "y", "z"), poses)
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & F.col(c).between(F.col(f"min_{c}"), F.col(f"max_{c}"))
    # few boxes a frame: they meet its points by the frame
    return world.join(world.join(sides, "frame_id").where(inside).select("id").distinct(), "id", "left_anti")


def interpolated_map(poses: DataFrame, times: DataFrame, scans: DataFrame, span: float = 0.4) -> DataFrame:
    """Scans (traj_id, t, id, x, y, z) put into one map by smoothed poses, interpolated at the scans' times; points turn with the pose."""
    smooth = write_table(rotations.smooth_motions(poses, span, (0.0,)), "smooth-poses")
    at = rotations.interpolate_motions(smooth, times).select("traj_id", "t", *[F.col(c).alias(f"t{c}") for c in "xyz"], *rotations.TURN)
    both = scans.join(at, ["traj_id", "t"])
    turned = rotations.rotate([F.col(c) for c in rotations.TURN], [F.col(c) for c in "xyz"])
    return both.select("traj_id", "t", "id", *[(v + F.col(f"t{c}")).alias(c) for v, c in zip(turned, "xyz", strict=True)])


def scan_features(points: DataFrame, scan: Scan | None = None, block: int = 180) -> DataFrame:
    """(frame_id, id, type) of edge (1) and plane (2) points of every scan: binning, smoothness, labels."""
    scan = scan or Scan()
    image = write_table(ring.project(points, columns=scan.columns, frame="frame_id"), "scan-image")
    rated = ring.smoothness(image, block=block, by=("frame_id",))
    labels = ring.smoothness_labels(rated, by=("frame_id",))
    return labels.where("type > 0").join(image.select("frame_id", "row", "col", F.col("point_id").alias("id")), ["frame_id", "row", "col"]).select("frame_id", "id", "type")


def thinned_clusters(points: DataFrame, leaf: float = 0.3, tolerance: float = 0.7) -> DataFrame:
    """Voxel means and their clusters of 1/10000 to a third of all voxels: (id, x, y, z, cluster)."""
    means = voxels.voxel_downsample(points, leaf)
    keyed = write_table(means.select(F.xxhash64("vx", "vy", "vz").alias("id"), "x", "y", "z"), "thinned")
    n = keyed.count()
    return keyed.join(cluster.euclidean_clusters(keyed, tolerance, max(1, n // 10_000), max(1, n // 3)), "id")


