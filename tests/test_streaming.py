"""The tracker over a stream whose detections come late, shuffled and in parts, against the batch over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from cloudframe.operators import tracking
from cloudframe.streaming.tracks import track_stream

COLUMNS = "seq_id long, frame long, det_id long, x double, y double, ts timestamp_ntz"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def detections(spark, sequences, frames, start=0):
    """Three things of each sequence walk apart; a frame a second."""
    base = 1_700_000_000
    rows = [(s, f, 100 * f + k, k * 10 + 0.03 * f * (k + 1), 0.01 * f * s, base + start + f) for s in sequences for f in range(1, frames + 1) for k in range(3) if (f + k + s) % 11]
    return spark.createDataFrame(rows, "seq_id long, frame long, det_id long, x double, y double, sec long").withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")).drop("sec").select("seq_id", "frame", "det_id", "x", "y", "ts")


def run(spark, tmp_path, parts, late="30 seconds", idle="10 minutes"):
    """Feeds the parts one file after the other and returns the rows and the numbers of states left."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for k, part in enumerate(parts):
        one = tmp_path / f"part-{k}"
        part.coalesce(1).write.parquet(str(one))
        next(one.glob("*.parquet")).rename(folder / f"{k:03d}.parquet")
    name = f"tracks_{random.randrange(10**9)}"
    q = track_stream(stream, late=late, idle=idle).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None
    rows = sorted(tuple(r) for r in spark.table(name).collect())
    return rows, left


def end_of_time(spark, seq=99, sec=1_700_900_000):
    """A detection far ahead, which moves the watermark beyond all others."""
    return spark.createDataFrame([(seq, 1, 1, 0.0, 0.0, sec)], "seq_id long, frame long, det_id long, x double, y double, sec long").withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")).drop("sec")


def rounded(rows):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]


def test_late_and_shuffled_frames_equal_the_batch(spark, rocksdb, tmp_path):
    whole = detections(spark, (1, 2), 40).orderBy("ts").collect()
    # within windows of 20 frames all is shuffled, and cut into parts in the middle of frames
    rng = random.Random(5)
    shuffled = [r for at in range(0, len(whole), 100) for r in rng.sample(whole[at : at + 100], len(whole[at : at + 100]))]
    parts = [spark.createDataFrame(shuffled[at : at + 37], COLUMNS) for at in range(0, len(shuffled), 37)]
    rows, _ = run(spark, tmp_path, [*parts, end_of_time(spark), end_of_time(spark, 98, 1_700_900_100)])
    want = sorted(tuple(r) for r in tracking.track(spark.createDataFrame(whole, COLUMNS)).collect())
    assert rounded(r for r in rows if r[0] < 90) == rounded(want)


def test_too_late_is_left_out_and_idle_sequences_leave(spark, rocksdb, tmp_path):
    first = detections(spark, (1,), 20)
    late = detections(spark, (1,), 3).withColumn("det_id", F.col("det_id") + 7)
    ahead = [end_of_time(spark, 99, 1_700_000_000 + s) for s in (500, 1000, 5000, 5001)]
    rows, left = run(spark, tmp_path, [first, ahead[0], late, *ahead[1:]], late="10 seconds", idle="60 seconds")
    want = sorted(tuple(r) for r in tracking.track(first).collect())
    assert rounded(r for r in rows if r[0] == 1) == rounded(want)
    # of sequence 1 nothing is left: what remains is the last frame of sequence 99
    assert left is not None and left <= 4
