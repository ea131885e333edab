"""Files that are read in ranges of bytes and written by many tasks: what the data sources of clouds and captures share.

Paths are those that Arrow's file systems know: local and ``file:`` ones, ``hdfs:``,
``s3:``, ``gs:``. Tasks open files themselves; the driver lists and renames them.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as afs
from pyspark.sql.datasource import InputPartition, WriterCommitMessage

SPLIT_BYTES = 128 << 20
#: Beyond MANY ranges a task takes consecutive ones together, up to so many bytes, a file counting for OPEN_BYTES at least.
MANY, TASK_BYTES, OPEN_BYTES = 1_000, 8 << 20, 32 << 10


def filesystem(path: str) -> tuple[afs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return afs.FileSystem.from_uri(path)


class Range(InputPartition):
    """The bytes from ``begin`` to ``end`` of a file, its ``split``-th part; a record belongs to the range in which it starts."""

    def __init__(self, path: str, begin: int, end: int, size: int, split: int):
        super().__init__(None)
        self.path, self.begin, self.end, self.size, self.split = path, begin, end, size, split

    @property
    def name(self) -> str:
        return self.path.rpartition("/")[2]


class Ranges(InputPartition):
    """What one task reads."""

    def __init__(self, parts: list[Range]):
        super().__init__(None)
        self.parts = parts


def plan(options: dict, pattern: str) -> list[Ranges]:
    """Ranges of all files under ``path`` whose names match: only the listing is read.

    A task has one range. Of very many short ones it takes those that follow each other, as
    each task costs the driver time and memory; those of one file are then one longer range.
    """
    fs, base = filesystem(options["path"])
    info = fs.get_file_info(base)
    found = [info] if info.type == afs.FileType.File else fs.get_file_info(afs.FileSelector(base, recursive=True))
    step = int(options.get("splitbytes", SPLIT_BYTES))
    names = options.get("pattern", pattern)
    files = []
    for f in sorted(found, key=lambda f: f.path):
        inner = f.path[len(base) :].strip("/").split("/")
        if f.type == afs.FileType.File and fnmatch.fnmatch(f.base_name, names) and not any(p.startswith(("_", ".")) for p in inner):
            files.append((f.path, f.size))
    if sum(-(-size // step) for _, size in files) <= MANY:
        return [Ranges([Range(path, at, min(at + step, size), size, k)]) for path, size in files for k, at in enumerate(range(0, size, step))]
    longer = max(1, TASK_BYTES // step) * step
    out, held = [], TASK_BYTES
    for path, size in files:
        for at in range(0, size, longer):
            part = Range(path, at, min(at + longer, size), size, at // step)
            cost = max(OPEN_BYTES, part.end - part.begin)
            if held + cost > TASK_BYTES:
                out.append(Ranges([]))
                held = 0
            out[-1].parts.append(part)
            held += cost
    return out


def opened(options: dict, part: Range):
    fs, _ = filesystem(options["path"])
    return fs.open_input_file(part.path)


@dataclass
class Written(WriterCommitMessage):
    """Files one task has written: (group, place in the order of tasks, rows, staged path)."""

    files: list[tuple] = field(default_factory=list)


class Staging:
    """A folder beside the results that tasks write to; only what was committed is moved out of it."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.folder = f"_staging-{uuid.uuid4().hex}"

    def create(self, name: str):
        """A staged file of a task's attempt, and its path."""
        fs, base = filesystem(self.options["path"])
        fs.create_dir(f"{base}/{self.folder}", recursive=True)
        path = f"{base}/{self.folder}/{uuid.uuid4().hex}-{name}"
        return fs.open_output_stream(path), path

    def publish(self, moves: Iterator[tuple[str, str]], overwrite: bool, ending: str) -> None:
        fs, base = filesystem(self.options["path"])
        fs.create_dir(base, recursive=True)
        if overwrite:
            for f in fs.get_file_info(afs.FileSelector(base)):
                if f.type == afs.FileType.File and f.base_name.endswith(ending):
                    fs.delete_file(f.path)
        for staged, name in moves:
            fs.move(staged, f"{base}/{name}")
        self.drop()

    def drop(self) -> None:
        fs, base = filesystem(self.options["path"])
        if fs.get_file_info(f"{base}/{self.folder}").type == afs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.folder}")
