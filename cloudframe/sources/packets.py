"""Packet captures and point-cloud files: Spark reads their bytes, Arrow batches decode them.

Here a file is one row while it is read, so it has to be smaller than 2 GB; a folder is
read in parallel, in batch or as a stream. Files of any size are read in ranges by
``captures`` and ``clouds``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: fixed values: the layout of captures and of the scanner's packets
FILE_HEADER, PACKET_HEADER, PAYLOAD_AT, PACKET_BYTES = 24, 16, 42, 1206
BLOCKS, RETURNS, METRES = 12, 32, 0.002
UPPER = 0xEEFF
_RETURN = np.dtype([("distance", "<u2"), ("intensity", "u1")])
_BLOCK = np.dtype([("id", "<u2"), ("azimuth", "<u2"), ("returns", _RETURN, RETURNS)])
_PACKET = np.dtype([("blocks", _BLOCK, BLOCKS), ("gps", "<u4"), ("mode", "u1"), ("model", "u1")])
PACKETS = "file string, number long, ts_us long, length long, payload binary"
RETURN_ROWS = "file string, number long, block int, laser int, azimuth double, distance double, intensity int, gps long"


def _files(spark: SparkSession, path: str, pattern: str, stream: bool) -> DataFrame:
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read).format("binaryFile")
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "content")


def _packets(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    magic = data[:4]
    order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">" if magic in (b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d") else ""
    if not order:
        raise ValueError("not a packet capture")
    unit = 1000 if magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1
    at = FILE_HEADER
    while at + PACKET_HEADER <= len(data):
        sec, part, held, length = struct.unpack_from(f"{order}IIII", data, at)
        at += PACKET_HEADER
        if at + held > len(data):
            raise ValueError("a capture ends inside a packet")
        yield sec * 1_000_000 + part // unit, length, data[at : at + held]
        at += held


def read_captures(spark: SparkSession, path: str, *, pattern: str = "*.pcap", stream: bool = False) -> DataFrame:
    """One row per packet: file, number, time in microseconds, length, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(*b.columns, strict=True):
                rows = list(_packets(data.as_py()))
                for at in range(0, len(rows), 10_000):
                    some = rows[at : at + 10_000]
                    cols = [[name.as_py()] * len(some), range(at, at + len(some)), *zip(*some, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "number", "ts_us", "length", "payload"])

    return _files(spark, path, pattern, stream).mapInArrow(run, PACKETS)


def decode(packets: DataFrame) -> DataFrame:
    """One row per return of each packet that holds a scanner's record; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in RETURN_ROWS.split(", ")]
        for b in batches:
            held = [(f, n, p[PAYLOAD_AT : PAYLOAD_AT + PACKET_BYTES]) for f, n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True) if len(p) >= PAYLOAD_AT + PACKET_BYTES]
            if not held:
                continue
            raw = np.frombuffer(b"".join(p for _, _, p in held), _PACKET)
            each = BLOCKS * RETURNS
            blocks = raw["blocks"]
            laser = np.arange(RETURNS)[None, None, :] + np.where(blocks["id"] == UPPER, 0, RETURNS)[:, :, None]
            cols = [
                pa.array(np.repeat([f for f, _, _ in held], each)), pa.array(np.repeat([n for _, n, _ in held], each)),
                pa.array(np.tile(np.repeat(np.arange(BLOCKS, dtype=np.int32), RETURNS), len(held))), pa.array(laser.ravel().astype(np.int32)),
                pa.array(np.repeat(blocks["azimuth"].ravel() / 100.0, RETURNS)), pa.array(blocks["returns"]["distance"].ravel() * METRES),
                pa.array(blocks["returns"]["intensity"].ravel().astype(np.int32)), pa.array(np.repeat(raw["gps"].astype(np.int64), each)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return packets.mapInArrow(run, RETURN_ROWS)


def encode(returns: DataFrame) -> DataFrame:
    """(ts_us, payload) of (packet, place, raw, intensity, azimuth): the scanner's record of each packet, after a header of zeros. ``place`` is 32 times the block plus the laser, ``raw`` the distance in steps; places without a row are zero."""
    # a packet has no more places than BLOCKS * RETURNS
    held = returns.groupBy("packet").agg(F.collect_list(F.struct("place", "raw", "intensity")).alias("returns"), F.max("azimuth").alias("azimuth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.zeros(b.num_rows, _PACKET)
            raw["blocks"]["id"] = UPPER
            raw["blocks"]["azimuth"] = b.column(2).to_numpy()[:, None]
            raw["gps"] = b.column(0).to_numpy()
            rows = b.column(1).flatten()
            owner = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            place, distance, intensity = (rows.field(k).to_numpy() for k in range(3))
            raw["blocks"]["returns"]["distance"][owner, place // RETURNS, place % RETURNS] = distance
            raw["blocks"]["returns"]["intensity"][owner, place // RETURNS, place % RETURNS] = intensity
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([bytes(PAYLOAD_AT) + p.tobytes() for p in raw], pa.binary())], names=["ts_us", "payload"])

    return held.select("packet", "returns", "azimuth").mapInArrow(run, "ts_us long, payload binary")


def with_frames(returns: DataFrame) -> DataFrame:
    """``returns`` with ``frame``: a new one begins where the azimuth falls back within a file."""
    blocks = returns.groupBy("file", "number", "block").agg(F.first("azimuth").alias("azimuth"))
    order = Window.partitionBy("file").orderBy("number", "block")
    turned = F.when(F.col("azimuth") < F.lag("azimuth").over(order), 1).otherwise(0)
    frames = blocks.withColumn("turn", turned).withColumn("frame", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("file", "number", "block", "frame")
    return returns.join(frames, ["file", "number", "block"])


def to_points(returns: DataFrame, vertical: list[float]) -> DataFrame:
    """Returns with x, y, z by each laser's vertical angle in degrees; no return, no point."""
    angle = F.radians(F.element_at(F.array(*[F.lit(float(v)) for v in vertical]), F.col("laser") + 1))
    flat = F.col("distance") * F.cos(angle)
    turn = F.radians("azimuth")
    return returns.where((F.col("distance") > 0) & (F.col("laser") < len(vertical))).withColumns({"x": flat * F.sin(turn), "y": flat * F.cos(turn), "z": F.col("distance") * F.sin(angle)})


def _cloud(data: bytes) -> np.ndarray:
    """x, y, z, intensity rows of a PCD file, ascii or binary; a missing field is nan."""
    head: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in head:
        end = data.index(b"\n", at)
        words = data[at:end].decode("ascii", "replace").split()
        at = end + 1
        if words and not words[0].startswith("#"):
            head[words[0]] = words[1:]
    names, n = head["FIELDS"], int(head["POINTS"][0])
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    if head["DATA"][0] == "ascii":
        rows = np.array(data[at:].split(), float).reshape(-1, sum(counts))[:n]
        place = dict(zip(names, np.cumsum([0, *counts]), strict=False))
        fields = {f: rows[:, place[f]] for f in names}
    elif head["DATA"][0] == "binary":
        kinds = {"F": "f", "I": "i", "U": "u"}
        kind = np.dtype([(f, f"<{kinds[t]}{s}", (c,)) for f, t, s, c in zip(names, head["TYPE"], head["SIZE"], counts, strict=True)])
        raw = np.frombuffer(data, kind, n, at)
        fields = {f: raw[f][:, 0].astype(float) for f in names}
    else:
        raise ValueError(f"PCD data of kind {head['DATA'][0]}")
    return np.column_stack([fields.get(f, np.full(n, np.nan)) for f in ("x", "y", "z", "intensity")])


def read_clouds(spark: SparkSession, path: str, *, pattern: str = "*.pcd", stream: bool = False) -> DataFrame:
    """(frame_id, id, x, y, z, intensity) of PCD files; frame_id is the file's name without its ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(*b.columns, strict=True):
                rows = _cloud(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py().rpartition(".")[0]] * len(rows), pa.string()), pa.array(np.arange(len(rows))), *map(pa.array, rows.T)], names=["frame_id", "id", "x", "y", "z", "intensity"])

    return _files(spark, path, pattern, stream).mapInArrow(run, "frame_id string, id long, x double, y double, z double, intensity double")


def write_clouds(points: DataFrame, path: str, by: str = "frame_id") -> None:
    """An ascii PCD file per frame, in a folder named by it. A frame's lines are one row, so frames have to fit a task."""
    lines = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat_ws(" ", "x", "y", "z", "intensity").alias("line")))), lambda p: p["line"]), "\n").alias("body"))
    n = F.col("n").cast("string")
    head = F.concat(F.lit("# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity\nSIZE 8 8 8 8\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH "), n, F.lit("\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS "), n, F.lit("\nDATA ascii\n"))
    lines.select(by, F.concat(head, "body").alias("value")).write.mode("overwrite").partitionBy(by).option("lineSep", "\n").text(path)
