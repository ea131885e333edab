"""Packet captures as a data source: tasks read ranges of a file and find the first packet of their range themselves.

A capture has no marks between its packets. A task whose range begins inside the file
looks for the first place from which ``CHAIN`` packet headers in a row are plausible (or
all up to the end of the file): parts of a second below one, no more bytes held than the
packet and the file's limit have, no packet above ``MOST_BYTES``, times within ``MOST_GAP``
seconds of each other and ``MOST_SPAN`` of the file's first packet. A packet belongs to the
range in which its header starts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from cloudframe.sources.packets import FILE_HEADER, PACKET_HEADER
from cloudframe.sources.ranges import Range, Ranges, Staging, Written, opened, plan

CHAIN, MOST_GAP, MOST_SPAN, MOST_BYTES = 8, 86_400, 315_360_000, 262_144
WINDOW, BATCH = 1 << 20, 4096
RAW = "file string, split long, place long, at long, ts_us long, length long, payload binary"
#: fixed values: byte orders and parts of a second by a capture's first four bytes
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000)}


class _Bytes:
    """Bytes of a file by their place, read in stretches as they are asked for."""

    def __init__(self, f, size: int):
        self.f, self.size, self.first, self.data = f, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from a place on, fewer at the end of the file."""
        n = max(0, min(n, self.size - at))
        if at < self.first or at + n > self.first + len(self.data):
            self.f.seek(at)
            self.first, self.data = at, self.f.read(max(n, min(WINDOW, self.size - at)))
        return self.data[at - self.first : at - self.first + n]


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Ranges]:
        return plan(self.options, "*.pcap")

    def read(self, task: Ranges | None) -> Iterator[pa.RecordBatch]:
        for part in task.parts if task else ():  # none if there are no files
            yield from self.part(part)

    def part(self, part: Range) -> Iterator[pa.RecordBatch]:
        with opened(self.options, part) as f:
            source = _Bytes(f, part.size)
            head = source.get(0, FILE_HEADER)
            if head[:4] not in MAGIC:
                raise ValueError(f"{part.path} is no packet capture")
            order, parts = MAGIC[head[:4]]
            most = min(MOST_BYTES, struct.unpack_from(f"{order}I", head, 16)[0] or MOST_BYTES)
            layout = struct.Struct(f"{order}IIII")
            at = FILE_HEADER if part.begin <= FILE_HEADER else self.first(source, layout, parts, most, part.begin, min(part.end, part.size))
            rows: list[tuple] = []
            place = 0
            while at is not None and at < part.end and at + PACKET_HEADER <= part.size:
                sec, fraction, held, length = layout.unpack(source.get(at, PACKET_HEADER))
                payload = source.get(at + PACKET_HEADER, held)
                if len(payload) < held:
                    raise ValueError(f"{part.path} ends inside a packet")
                rows.append((place, at, sec * 1_000_000 + fraction * 1_000_000 // parts, length, payload))
                at, place = at + PACKET_HEADER + held, place + 1
                if len(rows) == BATCH:
                    yield self.batch(part, rows)
                    rows = []
            if rows:
                yield self.batch(part, rows)

    @staticmethod
    def first(source: _Bytes, layout: struct.Struct, parts: int, most: int, begin: int, end: int) -> int | None:
        """The first place of a packet header in a range, or None."""
        start = source.get(FILE_HEADER, 4)
        began = layout.unpack(start + bytes(12))[0] if len(start) == 4 else 0

        def plausible(at: int) -> bool:
            last = None
            for _ in range(CHAIN):
                if at == source.size:
                    return last is not None
                head = source.get(at, PACKET_HEADER)
                if len(head) < PACKET_HEADER:
                    return False
                sec, fraction, held, length = layout.unpack(head)
                if fraction >= parts or held > min(length, most) or length > MOST_BYTES or abs(sec - began) > MOST_SPAN or at + PACKET_HEADER + held > source.size or last is not None and abs(sec - last) > MOST_GAP:
                    return False
                last, at = sec, at + PACKET_HEADER + held
            return True

        return next((at for at in range(begin, end) if plausible(at)), None)

    @staticmethod
    def batch(part: Range, rows: list[tuple]) -> pa.RecordBatch:
        columns = [[part.name] * len(rows), [part.split] * len(rows), *zip(*rows, strict=True)]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split(" ")[0] for c in RAW.split(", ")])


class CaptureWriter(DataSourceArrowWriter):
    """Rows (ts_us, payload): a capture for each task that has rows, named in the order of tasks."""

    def __init__(self, options: dict, overwrite: bool):
        self.staging, self.overwrite = Staging(options), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        out, task, n, stream, path = Written(), TaskContext.get().partitionId(), 0, None, ""
        try:
            for b in batches:
                for ts, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if stream is None:
                        stream, path = self.staging.create(f"{task}.pcap")
                        stream.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, MOST_BYTES, 1))
                    stream.write(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(payload), len(payload)) + payload)
                    n += 1
        finally:
            if stream is not None:
                stream.close()
        if n:
            out.files.append(("", (task, 0), n, path))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        self.staging.publish([(path, f"part-{k:06d}.pcap") for k, (_, _, _, path) in enumerate(files)], self.overwrite, ".pcap")

    def abort(self, messages: list[Written | None]) -> None:
        self.staging.drop()


class CaptureSource(DataSource):
    """``spark.read.format("pcap")`` and ``df.write.format("pcap")``; options: path, pattern, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> CaptureReader:
        return CaptureReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        return CaptureWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_capture_ranges(spark: SparkSession, path: str, *, pattern: str = "*.pcap", split_bytes: int | None = None) -> DataFrame:
    """(file, split, place, at, ts_us, length, payload): a row per packet; ``at`` orders the packets of a file."""
    spark.dataSource.register(CaptureSource)
    reader = spark.read.format("pcap").option("pattern", pattern)
    return (reader if split_bytes is None else reader.option("splitBytes", split_bytes)).load(path)


def with_numbers(packets: DataFrame, whole: bool = False) -> DataFrame:
    """``packets`` with their number in the file, from 0: (file, number, ts_us, length, payload), as ``packets.decode`` takes them.

    Ranges are counted, and each adds the packets of those before it; the counts, a row per
    range, go to all tasks. With ``whole`` numbers go on from file to file in the order of names.
    """
    sizes = packets.groupBy("file", "split").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy("file", "split") if whole else Window.partitionBy("file").orderBy("split")
    before = F.sum("__n").over(order) - F.col("__n")
    return packets.join(F.broadcast(sizes.select("file", "split", before.alias("__before"))), ["file", "split"]).select("file", (F.col("__before") + F.col("place")).alias("number"), "ts_us", "length", "payload")


def write_captures(packets: DataFrame, path: str) -> None:
    """Rows with ts_us and payload as captures, in the order of time from file to file and within each."""
    packets.sparkSession.dataSource.register(CaptureSource)
    packets.select(F.col("ts_us").cast("long").alias("ts_us"), F.col("payload").cast("binary").alias("payload")).where("payload is not null and ts_us >= 0").repartitionByRange("ts_us").sortWithinPartitions("ts_us", "payload").write.format("pcap").mode("overwrite").save(path)
