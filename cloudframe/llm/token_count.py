"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Pre-tokens not met before are held as one ragged array of symbols. In each round every
sequence merges its lowest-ranked pair, all sequences at once, until no pair is left;
what survives is counted. A merged pair can't make a pair of lower rank, so this gives
the ids the library gives, which a test compares.

Each Python worker remembers the counts of chunks it has met, up to ``CACHE`` of them;
forgetting them costs time, never results.

Defined results: a null or empty text has 0 bytes and 0 tokens; null or repeated
``doc_id`` rows are answered row by row; special strings inside a text count as one token
as the library's default has it; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.llm import chunks
from cloudframe.llm.common import small_batches

LIMIT = 1024
CACHE = 600_000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [others.get(b, chr(b)) for b in range(256)]


class MergeCounter:
    def __init__(self, path: str, pattern: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.base = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        self.pattern = regex.compile(pattern)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut_specials = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.tokens: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def merge_counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols left of each piece."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = lens.copy()
        live = np.flatnonzero(lens > 1)
        if not len(live):
            return counts
        ids = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in live]), np.uint8)]
        lens = lens[live]
        starts = _starts(lens)
        rank = np.full(len(ids), _NONE)
        rank[:-1] = self.rank_of(ids[:-1], ids[1:])
        rank[starts + lens - 1] = _NONE  # the last symbol of a sequence has no partner
        while True:
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest != _NONE
            if not going.all():
                counts[live] = lens
                live, keep = live[going], np.repeat(going, lens)
                if not len(live):
                    return counts
                ids, rank, lens, lowest = ids[keep], rank[keep], lens[going], lowest[going]
                starts = _starts(lens)
            place = np.flatnonzero(rank == np.repeat(lowest, lens))
            # in a run such as a a a only every other pair can merge, from the left
            begins = np.ones(len(place), bool)
            begins[1:] = place[1:] != place[:-1] + 1
            first = place[np.maximum.accumulate(np.where(begins, np.arange(len(place)), 0))]
            place = place[(place - first) % 2 == 0]
            ids[place] = self.merged[rank[place]]
            keep = np.ones(len(ids), bool)
            keep[place + 1] = False
            owner = np.searchsorted(starts, place, side="right") - 1
            lens = lens - np.bincount(owner, minlength=len(lens))
            ids, rank = ids[keep], rank[keep]
            starts = _starts(lens)
            # only the pairs beside a merged symbol have changed
            place = place - np.arange(len(place))
            before = place[place > starts[owner]] - 1
            ends = place == starts[owner] + lens[owner] - 1
            rank[place[ends]] = _NONE
            place = place[~ends]
            for changed in (before, place):
                rank[changed] = self.rank_of(ids[changed], ids[changed + 1])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.base + right
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == pair, self.ranks[at], _NONE)

    def token_counts(self, tokens: list[str]) -> np.ndarray:
        """The number of ids of each pre-token."""
        if len(self.tokens) > CACHE:
            self.tokens.clear()
        fresh = [t for t in set(tokens) if t not in self.tokens]
        self.tokens.update(zip(fresh, self.merge_counts([p.encode() for p in fresh]).tolist(), strict=True))
        return np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))

    def learn(self, names: list[str]) -> None:
        """Count the chunks that ``names`` stand for. Chunks that end in a non-space are cut as well when joined."""
        plain = [w for w in names if w and not w[-1].isspace() and "\u180e" not in w]
        parts = list(map(chunks.chunk, plain))
        tokens = self.pattern.findall("".join(parts))
        counts = self.token_counts(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))
        total = np.cumsum(counts)[last] if len(parts) else counts
        self.known.update(zip(plain, np.diff(total, prepend=0).tolist(), strict=True))
        if len(plain) < len(names):
            for w in set(names) - set(plain):
                self.known[w] = int(self.token_counts(self.pattern.findall(chunks.chunk(w))).sum())

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE:
            self.known.clear()
        jobs, heads = [], []
        for text in texts:
            parts, extra = [text], 0
            if any(s in text for s in self.specials):
                parts = self.cut_specials.split(text)
                extra = len(parts) - 1
            for k, part in enumerate(parts):
                w = chunks.words(part) if part else []
                heads.append(w[0] if w else "")
                jobs.append((w[1:], extra if k == 0 else 0, k > 0))
        missing = set().union(*(w for w, _, _ in jobs))
        if missing := [w for w in missing if w not in self.known]:
            self.learn(missing)
        # a text's first chunk has no space before it
        cut = [self.pattern.findall(h) for h in heads]
        first = self.token_counts([t for parts in cut for t in parts]).tolist()
        get, at = self.known.__getitem__, 0
        out: list[int] = []
        for (w, extra, more), parts in zip(jobs, cut, strict=True):
            n = sum(map(get, w)) + sum(first[at : at + len(parts)]) + extra
            at += len(parts)
            if more:
                out[-1] += n
            else:
                out.append(n)
        return out


def _starts(lens: np.ndarray) -> np.ndarray:
    starts = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=starts[1:])
    return starts


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> MergeCounter:
    return MergeCounter(path, pattern)


def count_tokens(docs: DataFrame, *, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """The columns ``keep`` with n_bytes, n_tokens and over_limit of each row."""
    slim = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text], F.lit("")).alias("__text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_bytes long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n_bytes, pa.array(c.count(texts.to_pylist()), pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    return small_batches(slim).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def token_count_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, path=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)
