"""Alignment of two tokenizers over the same bytes by an event sweep.

Where a token of A and a token of B end at the same byte, the text can be cut for both: the
stretches between such offsets are groups, and the two tokens are linked.

1. Each text is encoded by both tokenizers; a byte-level one remembers the chunks it has met. A token is an event at the byte where it ends;
   events travel in blocks of ``BLOCK`` tokens, whose ends follow from their start, as a
   token's id says how many bytes it has. Blocks of A and B are rows of one table, and
   every input row has one row before them.
2. That union is repartitioned by input row and sorted within partitions by offset.
3. A sweep reads the sorted blocks. It holds the open group and the one block of either
   side that reaches beyond it; as soon as both sides have an end at one byte the group
   goes into the row's digest and counts. The tokens of a long text are never held at once.
4. How often the corpus links two ids is summed over the swept rows. Of two linked tokens
   one's bytes are the end of the other's, so no corpus has more pairs than the tokens of
   both vocabularies have ends (``most_pairs``, about 600,000 for the two in use, 16 bytes
   each): that table may go to all tasks, and one more pass over the swept rows, which hold
   each row's pairs, sums their counts.

Input rows are numbered where they are read, so rows that repeat an id, or all columns, are
rows like any others, and none of them makes a hot key. The numbers hold for one reading:
the input should be a table or written before.

Defined results: texts that are null or empty, or whose tokens of A or B do not give the
bytes of space+text (a tokenizer that normalizes, or a "▁" in the text), have no tokens:
zeros and an empty digest. An empty table gives an empty table; only the two named columns
are read, whatever others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.chunks import pieces
from cloudframe.llm.common import let_go, small_batches, table, write_table
from cloudframe.llm.token_count import byte_letters
from cloudframe.llm.token_output import Encoder

BLOCK = 16_384
ENCODE_BYTES = 1 << 20
#: kinds of rows: what each input row has once, then blocks of A and of B
HEAD, A, B = 0, 1, 2


class Tokenizer:
    """Ids of space and text, and the bytes of each id."""

    def __init__(self, ids: Callable[[list[str]], list[np.ndarray]], names: list[bytes]):
        self.ids, self.names = ids, names
        self.lengths = np.array([len(n) for n in names], np.int64)
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def said(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens one after the other."""
        lens = self.lengths[ids]
        ends = np.cumsum(lens)
        return self.bytes[np.repeat(self.starts[ids] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text, or None where their bytes are not those of space and text."""
        if not texts:
            return []
        found, raw = self.ids(texts), [b" " + t.encode() for t in texts]
        sizes = [int(self.lengths[ids].sum()) for ids in found]
        # all texts at once; one by one only if some text is not met
        if sizes == list(map(len, raw)) and self.said(np.concatenate(found)) == b"".join(raw):
            return found
        return [ids if n == len(t) and self.said(ids) == t else None for ids, n, t in zip(found, sizes, raw, strict=True)]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """By the file's ending: byte-level BPE (.json), or pieces (.model), which put a space before a text themselves."""
    if path.endswith(".json"):
        encoder = Encoder(path)
        t = encoder.tokenizer
        t.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_letters())}
        tokens = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        names = [bytes(byte[c] for c in n) if all(c in byte for c in n) else n.encode() for n in tokens]

        def ids(texts: list[str]) -> list[np.ndarray]:
            # a letter is never joined with the space after it: what follows it is encoded as if it stood alone,
            # and a text that begins with a letter has chunks that are met again
            flat, counts = encoder.encode(pa.array([f"a {x}" for x in texts], pa.string()))
            ends = np.cumsum(counts)
            return [flat[e - n + 1 : e - 1] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]

        return Tokenizer(ids, names)
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces_of = [p.id_to_piece(i) for i in range(p.get_piece_size())]
    names = [bytes([int(n[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) else n.replace("▁", " ").encode() for i, n in enumerate(pieces_of)]
    return Tokenizer(lambda texts: [np.array(ids, np.uint32) for ids in p.encode(texts, num_threads=1)], names)


def most_pairs(a: str, b: str) -> int:
    """No corpus links more pairs of ids than this: one token's bytes are the end of the other's."""
    ends = [set(tokenizer(x).names) for x in (a, b)]
    return sum(sum(name[i:] in other for i in range(len(name))) for own, other in (ends, ends[::-1]) for name in own)


def token_events(docs: DataFrame, a: str, b: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, at, kind, id, ids): blocks of tokens of A and B by the byte at which they start, and a row with the id (at -1) for each input row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.monotonically_increasing_id().alias("row"), docs[doc_id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))

    def blocks(ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, bytes]]:
        ends = np.cumsum(lengths[ids])
        for k in range(0, len(ids), BLOCK):
            yield int(ends[k - 1]) if k else 0, ids[k : k + BLOCK].astype(np.uint16 if len(lengths) <= 1 << 16 else np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [(A, tokenizer(a)), (B, tokenizer(b))]
        for batch in batches:
            for part in pieces(batch, 2, ENCODE_BYTES):
                texts = part.column(2).to_pylist()
                full = [i for i, t in enumerate(texts) if t]
                found = [t.encode([texts[i] for i in full]) for _, t in both]
                places, at, kinds, ids = list(range(len(texts))), [-1] * len(texts), [HEAD] * len(texts), [None] * len(texts)
                for k, i in enumerate(full):
                    if all(f[k] is not None for f in found):
                        for (side, t), f in zip(both, found, strict=True):
                            for start, data in blocks(f[k], t.lengths):
                                places.append(i)
                                at.append(start)
                                kinds.append(side)
                                ids.append(data)
                rows = pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["row", "id"]).take(pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(at, pa.int64()), pa.array(kinds, pa.int32()), rows.column(1), pa.array(ids, pa.binary())], names=["row", "at", "kind", "id", "ids"])

    return small_batches(slim).mapInArrow(run, f"row long, at long, kind int, id {kind}, ids binary")


class Sweep:
    """What is open of one input row: the tokens of either side since the last common end, and the sums so far."""

    def __init__(self, texts: list[str], places: tuple[int, int], lengths: tuple[np.ndarray, np.ndarray]):
        self.texts, self.places, self.lengths = texts, places, lengths

    def begin(self) -> None:
        self.ids = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.ends = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.tokens, self.groups, self.links, self.digest, self.pairs = [0, 0], 0, 0, hashlib.sha256(), []

    def add(self, side: int, at: int, ids: np.ndarray) -> None:
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.ends[side] = np.concatenate([self.ends[side], at + np.cumsum(self.lengths[side][ids])])
        self.tokens[side] += len(ids)
        if all(map(len, self.ends)):
            self.close()

    def close(self) -> None:
        """Groups up to the last common end go into the digest, the counts and the pairs."""
        (a, b), (ends_a, ends_b) = self.ids, self.ends
        common, in_a, in_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        if not len(common):
            return
        self.pairs.append(a[in_a] * len(self.lengths[1]) + b[in_b])
        self.links += len(common)
        # the groups' tokens in one row: those of A, then those of B, group by group
        n_a, n_b = np.diff(in_a, prepend=-1), np.diff(in_b, prepend=-1)
        to_a, to_b = in_a[-1] + 1, in_b[-1] + 1
        names = np.empty(to_a + to_b, np.int64)
        before_b = np.repeat(np.cumsum(n_b) - n_b, n_a)
        before_a = np.repeat(np.cumsum(n_a), n_b)
        # a comma follows each token, but the last one of A in a group (a bar) and the last one of B (a semicolon)
        own_a = a[:to_a] + 0
        own_a[in_a] += self.places[0]
        own_b = b[:to_b] + 2 * self.places[0]
        own_b[in_b] += self.places[1]
        names[np.arange(to_a) + before_b] = own_a
        names[np.arange(to_b) + before_a] = own_b
        said = "".join(map(self.texts.__getitem__, names.tolist()))
        self.digest.update((";" * (self.groups > 0) + said[:-1]).encode())
        self.groups += len(common)
        self.ids, self.ends = [a[to_a:], b[to_b:]], [ends_a[to_a:], ends_b[to_b:]]

    def end(self) -> tuple:
        codes, times = np.unique(np.concatenate(self.pairs), return_counts=True) if self.pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
        return (*self.tokens, self.groups, self.links, self.digest.hexdigest() if self.groups else "", codes.tobytes(), times.astype(np.uint32).tobytes())


def swept(events: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each input row: id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs (codes and how often, packed)."""
    kind = events.schema["id"].dataType.simpleString()
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]
    types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
    # a text with one very long group keeps its tokens, all others a block of either side
    dealt = events.repartition(F.col("row")).sortWithinPartitions("row", "at", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (tokenizer(a).lengths, tokenizer(b).lengths)
        sizes = tuple(map(len, lengths))
        sweep = Sweep([f"{i}{mark}" for n, marks in zip(sizes, (",|", ",;"), strict=True) for mark in marks for i in range(n)], sizes, lengths)
        kinds = [np.uint16 if n <= 1 << 16 else np.uint32 for n in sizes]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), (batch.column(3).slice(i, 1) for i in range(batch.num_rows)), strict=True)

        out, held = [], 0
        for _, own in groupby(rows(), key=lambda x: x[0]):
            sweep.begin()
            for _, at, which, data, name in own:
                if which == HEAD:
                    doc = name
                else:
                    sweep.add(which - 1, at, np.frombuffer(data, kinds[which - 1]).astype(np.int64))
            out.append((doc, sweep.end()))
            held += len(out[-1][1][-2])
            if len(out) >= 512 or held >= ENCODE_BYTES:
                yield packed(out)
                out, held = [], 0
        if out:
            yield packed(out)

    def packed(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays([d for d, _ in out]), *(pa.array(c, t) for c, t in zip(zip(*(x for _, x in out), strict=True), types, strict=True))], names=names)

    return small_batches(dealt).mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(code, n, best): how often each pair of ids is linked in all rows, and whether its id of B has no pair with more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            more = [np.frombuffer(b"".join(batch.column(i).to_pylist()), t).astype(np.int64) for i, t in ((0, np.int64), (1, np.uint32))]
            codes, place = np.unique(np.concatenate([codes, more[0]]), return_inverse=True)
            times = np.bincount(place, np.concatenate([times, more[1]]), len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], names=["code", "n"])

    counts = small_batches(rows.select("codes", "times")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("code") % n_b)))


def align(docs: DataFrame, a: str, b: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``."""
    rows = write_table(swept(token_events(docs, a, b, text=text, doc_id=doc_id), a, b), "alignment")
    # at most most_pairs(a, b) rows, set by the vocabularies
    found = pair_counts(rows, len(tokenizer(b).names)).orderBy("code").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("code", "n", "best")))
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = sent.value
        for batch in batches:
            sums, tops = [], []
            for codes, times in zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True):
                place, n = np.searchsorted(known, np.frombuffer(codes, np.int64)), np.frombuffer(times, np.uint32).astype(np.int64)
                sums.append(int((counts[place] * n).sum()))
                tops.append(int(n[best[place]].sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(tops, pa.int64()), pa.array(sums, pa.int64())], names=[*names, "n_best", "count_sum"])
        let_go()

    kind = rows.schema["id"].dataType.simpleString()
    out = small_batches(rows).mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def alignment_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
