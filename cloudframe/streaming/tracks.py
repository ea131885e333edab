"""The tracker over a stream: frames are closed by event time, so detections may come late and in any order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cloudframe.operators.tracking import SCHEMA, Track, Tracker

NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
TRACK = "track_id long, state array<double>, cov array<double>, hits long, misses long"
DETECTION = "ms long, frame long, det_id long, x double, y double"


class Tracking(StatefulProcessor):
    """The state of a sequence: its tracks, the detections of frames that are still open, and how far it has come.

    A detection waits until the watermark has passed its frame's time: then nothing before
    it can come any more, and the frame is tracked. A sequence of which nothing has come for
    ``idle_ms`` of event time leaves the state; if it comes again, its tracks begin anew.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getListState("tracks", TRACK)
        self.waiting = handle.getListState("waiting", DETECTION)
        self.come = handle.getValueState("come", "born long, frame long, ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last = self.come.get() if self.come.exists() else None
        for part in rows:
            own = part.loc[part["ms"] >= now, ["ms", "frame", "det_id", "x", "y"]]
            if last is not None:
                own = own.loc[own["frame"] > last[1]]
            if len(own):
                self.waiting.appendList([(int(ms), int(f), int(d), float(x), float(y)) for ms, f, d, x, y in own.itertuples(index=False)])
                # the watermark has to be beyond a time before nothing of it can come
                for ms in own["ms"].unique():
                    self.handle.registerTimer(int(ms) + 1)
        yield pd.DataFrame(columns=NAMES)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = sorted(r[1:] for r in held if r[0] < now)
        if due:
            open_ = [tuple(r) for r in held if r[0] >= now]
            yield self._tracked(key[0], due, max(r[0] for r in held if r[0] < now))
            self.waiting.clear()
            if open_:
                self.waiting.put(open_)
            return
        if self.come.exists() and not held and self.come.get()[2] + self.idle_ms < now:
            self.tracks.clear()
            self.come.clear()
        yield pd.DataFrame(columns=NAMES)

    def _tracked(self, seq: int, due: list[tuple], ms: int) -> pd.DataFrame:
        born = self.come.get()[0] if self.come.exists() else 0
        tracker = Tracker([Track(t[0], list(t[1]), list(t[2]), t[3], t[4]) for t in self.tracks.get()] if self.tracks.exists() else [], born)
        out: list[tuple] = []
        at = 0
        while at < len(due):
            to = at
            while to < len(due) and due[to][0] == due[at][0]:
                to += 1
            own = due[at:to]
            out += [(seq, *r) for r in tracker.step(own[0][0], [r[1] for r in own], np.array([r[2:] for r in own], float))]
            at = to
        self.tracks.clear()
        if tracker.tracks:
            self.tracks.put([(t.track_id, list(t.state), list(t.cov), t.hits, t.misses) for t in tracker.tracks])
        self.come.update((tracker.born, due[-1][0], ms))
        self.handle.registerTimer(ms + self.idle_ms + 1)
        return pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, time: str = "ts", late: str = "5 seconds", idle: str = "10 minutes") -> DataFrame:
    """Tracks of a stream of (seq_id, frame, det_id, x, y) with the event time of each frame in ``time``; append mode.

    Detections up to ``late`` behind the newest one are put where they belong; later ones
    are left out, as are those of frames already tracked. So the result is that of
    ``track`` over all detections that were not too late. It needs the RocksDB state store.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    slim = detections.select("seq_id", F.col("frame").cast("long").alias("frame"), F.col("det_id").cast("long").alias("det_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(time).cast("timestamp").alias("ts"))
    marked = slim.where("frame is not null and ts is not null").withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return marked.groupBy("seq_id").transformWithStateInPandas(Tracking(idle_ms), SCHEMA, "append", "EventTime")
