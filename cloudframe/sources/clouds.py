"""Binary point clouds as a data source: tasks read ranges of points out of a file, and many tasks write one cloud.

A cloud too large for one task is written as several files, ``<frame>.part-<n>.pcd``, each
a whole PCD file and n the number of points before it; a small one is ``<frame>.pcd``.
Read back, a point's id is its place in the cloud over all its files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from cloudframe.sources.ranges import Range, Ranges, Staging, Written, opened, plan

FIELDS = ("x", "y", "z", "intensity")
POINTS = "frame_id string, id long, x double, y double, z double, intensity double"
#: Points of a batch that is read, and of a file that is written at most.
BATCH, FILE_POINTS = 65_536, 1 << 20
#: fixed values: the format's kinds of numbers
_KINDS = {"F": "f", "I": "i", "U": "u"}


@dataclass
class Header:
    names: list[str]
    kind: np.dtype
    counts: list[int]
    points: int
    data: str
    length: int  #: bytes before the first point


def header_of(head: bytes) -> Header:
    """Read from the first bytes of a PCD file."""
    words: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in words:
        end = head.index(b"\n", at)
        line = head[at:end].decode("ascii", "replace").split()
        at = end + 1
        if line and not line[0].startswith("#"):
            words[line[0]] = line[1:]
    names = words["FIELDS"]
    counts = [int(c) for c in words.get("COUNT", ["1"] * len(names))]
    kind = np.dtype([(f"{f}{k}" if names.count(f) > 1 else f, f"<{_KINDS[t]}{s}", (c,)) for k, (f, t, s, c) in enumerate(zip(names, words["TYPE"], words["SIZE"], counts, strict=True))])
    return Header(names, kind, counts, int(words["POINTS"][0]), words["DATA"][0], at)


def cloud_name(name: str) -> tuple[str, int]:
    """The frame of a file's name, and how many of its points stand in the files before."""
    frame = name.removesuffix(".pcd")
    part = re.search(r"\.part-(\d+)$", frame)
    return (frame[: part.start()], int(part[1])) if part else (frame, 0)


class CloudReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Ranges]:
        return plan(self.options, "*.pcd")

    def read(self, task: Ranges | None) -> Iterator[pa.RecordBatch]:
        for part in task.parts if task else ():  # none if there are no files
            yield from self.part(part)

    def part(self, part: Range) -> Iterator[pa.RecordBatch]:
        frame, before = cloud_name(part.name)
        with opened(self.options, part) as f:
            head = f.read(min(part.size, 65_536))
            h = header_of(head)
            if h.data == "binary":
                size = h.kind.itemsize
                first, last = (min(h.points, max(0, -((h.length - at) // size))) for at in (part.begin, part.end))
                if part.end == part.size:
                    last = h.points
                f.seek(h.length + first * size)
                for at in range(first, last, BATCH):
                    n = min(BATCH, last - at)
                    data = f.read(n * size)
                    if len(data) < n * size:
                        raise ValueError(f"{part.path} ends before its last point")
                    raw = np.frombuffer(data, h.kind)
                    yield self.batch(frame, before + at, [raw[c][:, 0].astype(float) if c in h.names else np.full(n, np.nan) for c in FIELDS])
            elif h.data == "ascii":
                # lines have no fixed length, so ids need all lines before: the first range reads the file, in batches
                if part.begin == 0:
                    yield from self.lines(f, h, frame, before)
            else:
                raise ValueError(f"{part.path}: PCD data of kind {h.data}")

    def lines(self, f, h: Header, frame: str, before: int) -> Iterator[pa.RecordBatch]:
        f.seek(h.length)
        place = dict(zip(h.names, np.cumsum([0, *h.counts]), strict=False))
        rest, at = b"", 0
        while at < h.points:
            more = f.read(1 << 22)
            lines = (rest + more).split(b"\n")
            rest = lines.pop() if more else b""
            rows = np.array(b" ".join(lines[: h.points - at]).split(), float).reshape(-1, sum(h.counts))
            if len(rows):
                yield self.batch(frame, before + at, [rows[:, place[c]] if c in place else np.full(len(rows), np.nan) for c in FIELDS])
            at += len(rows)
            if not more:
                break

    @staticmethod
    def batch(frame: str, first: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array([frame] * n, pa.string()), pa.array(np.arange(first, first + n)), *map(pa.array, columns)], names=["frame_id", "id", *FIELDS])


def header_bytes(points: int) -> bytes:
    n = len(FIELDS)
    return f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(FIELDS)}\nSIZE{' 8' * n}\nTYPE{' F' * n}\nCOUNT{' 1' * n}\nWIDTH {points}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {points}\nDATA binary\n".encode()


class CloudWriter(DataSourceArrowWriter):
    """Rows (frame_id, x, y, z, intensity), those of a frame one after the other; no more than a file's points are held."""

    def __init__(self, options: dict, overwrite: bool):
        self.staging, self.overwrite = Staging(options), overwrite
        self.most = int(options.get("filepoints", FILE_POINTS))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        out, task = Written(), TaskContext.get().partitionId()
        frame, held, n = None, [], 0

        def flush() -> None:
            nonlocal held, n
            if n:
                stream, path = self.staging.create(f"{task}.pcd")
                with stream:
                    stream.write(header_bytes(n))
                    for rows in held:
                        stream.write(rows.tobytes())
                out.files.append((frame, (task, len(out.files)), n, path))
            held, n = [], 0

        for b in batches:
            coded = b.column(0).dictionary_encode()
            codes = coded.indices.to_numpy()
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]).astype("<f8")
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if at == to:
                    continue
                own = coded.dictionary[int(codes[at])].as_py()
                if own != frame:
                    flush()
                    frame = own
                while at < to:
                    end = min(to, at + self.most - n)
                    held.append(rows[at:end])
                    n += end - at
                    at = end
                    if n == self.most:
                        flush()
        flush()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f[0], f[1]))
        alone = {}
        for frame, *_ in files:
            alone[frame] = frame not in alone
        moves, before, last = [], 0, None
        for frame, _, n, path in files:
            before = 0 if frame != last else before
            moves.append((path, f"{frame}.pcd" if alone[frame] else f"{frame}.part-{before:012d}.pcd"))
            before, last = before + n, frame
        self.staging.publish(moves, self.overwrite, ".pcd")

    def abort(self, messages: list[Written | None]) -> None:
        self.staging.drop()


class CloudSource(DataSource):
    """``spark.read.format("pcd")`` and ``df.write.format("pcd")``; options: path; to read, pattern and splitBytes; to write, filePoints."""

    @classmethod
    def name(cls) -> str:
        return "pcd"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> CloudReader:
        return CloudReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> CloudWriter:
        return CloudWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_binary_clouds(spark: SparkSession, path: str, *, pattern: str = "*.pcd", split_bytes: int | None = None) -> DataFrame:
    """(frame_id, id, x, y, z, intensity) of PCD files, binary ones in ranges of ``split_bytes``."""
    spark.dataSource.register(CloudSource)
    reader = spark.read.format("pcd").option("pattern", pattern)
    return (reader if split_bytes is None else reader.option("splitBytes", split_bytes)).load(path)


def write_binary_clouds(points: DataFrame, path: str, by: str = "frame_id", order: str = "id", file_points: int = FILE_POINTS) -> None:
    """A binary PCD file for each frame, or several for one that is spread over tasks. Points are dealt to tasks by ranges of (frame, id)."""
    points.sparkSession.dataSource.register(CloudSource)
    named = points.withColumn("__frame", F.col(by).cast("string"))
    dealt = named.repartitionByRange("__frame", order).sortWithinPartitions("__frame", order)
    dealt.select(F.col("__frame").alias("frame_id"), *[F.col(c).cast("double").alias(c) for c in FIELDS]).write.format("pcd").option("filePoints", file_points).mode("overwrite").save(path)
