"""Token ids as wavelet-matrix files: one file per shard of whole documents, in the order of ``doc_id``.

Rows are dealt by ranges of (doc_id, hash of the text) and sorted there; each task
encodes its rows and closes a shard once it has ``SHARD_TOKENS`` ids. Spark's writer stores the
shard files as rows of a table, so a task that is run again replaces its own files. A
shard knows the ids before it within its range; only the ranges' totals, one row each,
are summed up over all ranges.

Ids come from the tokenizers library. A chunk of text that occurs again is looked up
instead of encoded again (see ``chunks``); each worker remembers up to ``CACHE`` chunks,
beyond that those that came up again.

Defined results: a null or empty text has the end id only; rows with a null ``doc_id``
come first; rows with one ``doc_id`` follow each other in the order of their texts'
hashes; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.llm import chunks
from cloudframe.llm.common import REMEMBERED, let_go, small_batches, write_table
from cloudframe.llm.wavelet import WaveletMatrix, pack

SHARD_TOKENS = 1 << 18
CACHE, JOINED = 600_000, 48
END_ID = 0
SHARDS = "part int, seq int, offset long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, file binary"


class Encoder:
    """Ids of texts by the library, with each distinct chunk encoded once per worker while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.uneven = "|".join([chunks.UNEVEN, *map(re.escape, specials)])
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.bits = max(1, int(top).bit_length())
        self.dtype = np.uint16 if self.bits <= 16 else np.uint32
        (self.feed,) = self._whole("\n")
        self.forget()

    def forget(self) -> None:
        """Only the three names with fixed ids stay: an empty head, a line feed, the end of a text."""
        self.known = {chunks.HEAD: 0, chunks.FEED: 1, chunks.END: 2}
        self.flat = np.array([self.feed, END_ID], self.dtype)
        self.starts, self.lens = np.array([0, 0, 1]), np.array([0, 1, 1])
        self.again = np.zeros(3, bool)

    def trim(self) -> None:
        """Chunks that did not come up again since they were learned or last kept are forgotten; all are if the others are over half of CACHE."""
        keep = self.again
        keep[:3] = True
        if np.count_nonzero(keep) > CACHE // 2:
            return self.forget()
        self.known = {n: i for i, n in enumerate(compress(self.known, keep.tolist()))}  # names stand in the order of their places
        self.flat, self.lens = self._ids(np.flatnonzero(keep))
        self.starts = np.cumsum(self.lens) - self.lens
        self.again = np.zeros(len(self.lens), bool)

    def _ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known chunks one after the other, and the number of each one's."""
        lens = self.lens[place]
        ends = np.cumsum(lens)
        return self.flat[np.repeat(self.starts[place] - (ends - lens), lens) + np.arange(ends[-1])], lens

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, names: list[str]) -> None:
        """Encodes chunks JOINED at a time, a line feed after each: it is always a token of its own there."""
        plain = [n[1:] if n[0] == chunks.HEAD else " " + n for n in names]
        blocks = ["\n".join(plain[at : at + JOINED]) + "\n" for at in range(0, len(plain), JOINED)]
        got = np.concatenate([np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(blocks, add_special_tokens=False)])
        ends = np.flatnonzero(got == self.feed)
        if len(ends) != len(names):
            raise RuntimeError("a chunk was joined with its neighbour")
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.known.update(zip(names, range(len(self.starts), len(self.starts) + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.lens = np.concatenate([self.lens, ends - starts])
        self.flat = np.concatenate([self.flat, got])
        self.again = np.concatenate([self.again, np.zeros(len(names), bool)])

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE:
            self.trim()
        names = chunks.names(texts)
        coded = names.values.dictionary_encode()
        distinct = chunks.strings(coded.dictionary)
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(place < 0)
        self.again[place[place >= 0]] = True
        if len(missing):
            place[missing] = len(self.starts) + np.arange(len(missing))
            self._learn([distinct[i] for i in missing.tolist()])
        ids, lens = self._ids(place[coded.indices.to_numpy()])
        return ids, np.add.reduceat(lens, names.offsets.to_numpy()[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, the end id after each, and each text's number of ids."""
        uneven = pc.match_substring_regex(texts, self.uneven)
        if not pc.any(uneven).as_py():
            return self._even(texts)
        counts, parts = np.zeros(len(texts), np.int64), [None] * len(texts)
        odd = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        for i, e in zip(odd.tolist(), self.tokenizer.encode_batch_fast(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False), strict=True):
            parts[i] = np.array([*e.ids, END_ID], self.dtype)
            counts[i] = len(parts[i])
        even = np.flatnonzero(~uneven.to_numpy(zero_copy_only=False))
        if len(even):
            ids, n = self._even(texts.take(pa.array(even)))
            counts[even] = n
            for i, part in zip(even.tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                parts[i] = part
        return np.concatenate(parts), counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


REMEMBERED["encoder"] = encoder.cache_clear


def build_shards(docs: DataFrame, *, path: str, text: str = "text", doc_id: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shard files of ``docs``, written to the shared folder."""
    slim = docs.select(docs[doc_id].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = slim.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        names = [c.split(" ")[0] for c in SHARDS.split(", ")]
        docs_held, counts_held, ids_held = [], [], []
        seq = offset = size = 0

        def close() -> pa.RecordBatch:
            file = pack(np.concatenate(ids_held), enc.bits)
            docs_of, counts_of = pa.concat_arrays(docs_held), pa.array(np.concatenate(counts_held))
            lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (docs_of, counts_of)]
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([offset], pa.int64()), pa.array([size], pa.int64()), *lists, pa.array([file], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            for piece in chunks.pieces(batch, 1, shard_tokens * 16):
                ids, counts = enc.encode(piece.column(1))
                docs_held.append(piece.column(0)), counts_held.append(counts), ids_held.append(ids)
                size += len(ids)
                if size >= shard_tokens:
                    yield close()
                    docs_held, counts_held, ids_held = [], [], []
                    seq, offset, size = seq + 1, offset + size, 0
        if docs_held:
            yield close()
        let_go(keep="encoder")

    return write_table(small_batches(ordered).mapInArrow(run, SHARDS), "token-shards", **{"compression": "zstd", "parquet.block.size": str(16 << 20)})


def read_documents(shards: DataFrame, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids_crc32")) -> DataFrame:
    """One row per document out of the files: its first place among all ids, its number of ids and their checksum."""
    ranges = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per range: as many as the partitions that wrote the shards
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("part", base.alias("base"))
    placed = shards.join(F.broadcast(ranges), "part").select((F.col("base") + F.col("offset")).alias("start"), "doc_ids", "doc_tokens", "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # the chunks that writing remembered
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(i)[k] for i, n in enumerate(("start", "ids", "tokens", "file"))}
                ids = WaveletMatrix(row["file"].as_py()).unpack().astype("<u4")
                ends = np.flatnonzero(ids == END_ID) + 1
                if len(ends) != len(row["ids"]):  # a text that holds the end id itself: only the written numbers tell where it ends
                    ends = np.cumsum(np.array(row["tokens"].as_py(), np.int64))
                tokens = np.diff(ends, prepend=0)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), tokens.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([row["ids"].values, pa.array(row["start"].as_py() + ends - tokens), pa.array(tokens), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        let_go()

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long").select(*columns)


def token_places(shards: DataFrame, token: int) -> DataFrame:
    """All occurrences of an id: (part, seq, place), each found by rank and select in its shard's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, file in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                m = WaveletMatrix(file)
                places = [m.select(token, k) for k in range(m.count(token))]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(places), pa.int32()), pa.array([seq] * len(places), pa.int32()), pa.array(places, pa.int64())], names=["part", "seq", "place"])

    return shards.select("part", "seq", "file").mapInArrow(run, "part int, seq int, place long")


def token_output(docs: DataFrame, path: str) -> DataFrame:
    return read_documents(build_shards(docs, path=path))


def token_output_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))
