"""Tracking of detections over frames: one step function for batch and stream."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from cloudframe.operators.ordered import carried

#: fixed values of the filter: frame period, process and measurement noise
PERIOD, PROCESS, MEASURE = 0.1, 1e-5, 0.1
SCHEMA = "seq_id long, frame long, track_id long, det_id long, x double, y double, vx double, vy double, dynamic boolean"
_F = np.array([[1, 0, PERIOD, 0], [0, 1, 0, PERIOD], [0, 0, 1, 0], [0, 0, 0, 1]], float)


def predict(state: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _F @ state, _F @ cov @ _F.T + PROCESS * np.eye(4)


def correct(state: np.ndarray, cov: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gain = cov[:, :2] @ np.linalg.inv(cov[:2, :2] + MEASURE * np.eye(2))
    return state + gain @ (seen - state[:2]), cov - gain @ cov[:2, :]


@dataclass
class Track:
    track_id: int
    state: list[float]
    cov: list[float] = field(default_factory=lambda: np.eye(4).ravel().tolist())
    hits: int = 0
    misses: int = 0


class Tracker:
    """The tracks of one sequence. Tracks choose in the order of their birth; a detection is used once."""

    def __init__(self, tracks: list[Track] | None = None, born: int = 0, gate: float = 0.6, moving: float = 0.4, most_misses: int = 3):
        self.tracks, self.born = tracks or [], born
        self.gate, self.moving, self.most_misses = gate, moving, most_misses

    def step(self, frame: int, ids: list[int], at: np.ndarray) -> list[tuple]:
        """Rows (frame, track, detection, x, y, vx, vy, dynamic) of one frame's detections."""
        free, out, alive = np.ones(len(ids), bool), [], []
        for t in self.tracks:
            state, cov = predict(np.array(t.state), np.array(t.cov).reshape(4, 4))
            far = np.hypot(*(at - state[:2]).T) if len(ids) else np.zeros(0)
            far = np.where(free, far, np.inf)
            best = int(np.argmin(far)) if len(ids) else -1
            if best >= 0 and far[best] < self.gate:
                free[best] = False
                state, cov = correct(state, cov, at[best])
                t.hits, t.misses = t.hits + 1, 0
                dynamic = bool(max(abs(state[2]), abs(state[3])) > self.moving and t.hits > 3)
                out.append((frame, t.track_id, ids[best], *state.tolist(), dynamic))
            else:
                t.misses += 1
            t.state, t.cov = state.tolist(), cov.ravel().tolist()
            if t.misses <= self.most_misses:
                alive.append(t)
        for i in np.flatnonzero(free):
            self.born += 1
            alive.append(Track(self.born, [*at[i].tolist(), 0.0, 0.0]))
            out.append((frame, self.born, ids[i], *at[i].tolist(), 0.0, 0.0, False))
        self.tracks = alive
        return out


class _Frames:
    """A tracker and the detections of the frame that is being read."""

    def __init__(self, seq: int):
        self.seq, self.tracker, self.frame = seq, Tracker(), None
        self.ids: list[int] = []
        self.at: list[tuple[float, float]] = []

    def step(self, row: list) -> list[tuple]:
        frame, det, x, y = row
        out = self.end() if frame != self.frame else []
        self.frame = frame
        self.ids.append(det), self.at.append((x, y))
        return out

    def end(self) -> list[tuple]:
        if not self.ids:
            return []
        out = [(self.seq, *r) for r in self.tracker.step(self.frame, self.ids, np.array(self.at, float))]
        self.ids, self.at = [], []
        return out


def track(detections: DataFrame) -> DataFrame:
    """Tracks of (seq_id, frame, det_id, x, y). Frames depend on those before: a task reads a sequence in batches and keeps its tracks and one frame."""
    rows = detections.select("seq_id", "frame", "det_id", "x", "y").where("frame is not null")
    return carried(rows, "seq_id", ("frame", "det_id"), _Frames, SCHEMA)


class _Filter:
    def __init__(self, seq: int):
        self.seq, self.state, self.cov = seq, None, np.eye(4)

    def step(self, row: list) -> list[tuple]:
        frame, _, x, y = row
        if self.state is None:
            self.state = np.array([x, y, 0.0, 0.0], float)
        else:
            self.state, self.cov = correct(*predict(self.state, self.cov), np.array([x, y], float))
        return [(self.seq, frame, *self.state.tolist())]

    def end(self) -> list[tuple]:
        return []


def kalman(detections: DataFrame) -> DataFrame:
    """(seq_id, frame, x, y, vx, vy): one track per sequence, predicted and corrected in each frame after the first. A task reads a sequence in batches."""
    rows = detections.select("seq_id", "frame", "det_id", "x", "y")
    return carried(rows, "seq_id", ("frame", "det_id"), _Filter, "seq_id long, frame long, x double, y double, vx double, vy double")
