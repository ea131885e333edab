"""Benchmark decontamination by pigeonhole edit matching.

Test items and texts are lower-cased and their white space becomes single spaces. An item
of n characters may be found with up to k edits, k about ``ERROR_RATE`` of n and odd. It
is split into k + 1 pieces, so at least one stands in the text unchanged: all pieces of
all items are found in one pass over a text by an automaton. Taken two by two, the
pieces have a pair with at most one edit; a hit goes on only if its pair has that. What
is left is verified over the whole place by Myers' bit-parallel distance.

Items are taken in rounds of about ``ROUND_CHARS`` characters, each sent to all tasks, so
what is sent is bounded however many items there are; texts are never shuffled.

Defined results: null and empty items match nothing, null and empty texts hold nothing;
an item too short for one edit must stand in the text as it is; rows with null or
repeated ids are matched row by row; repeated items are reported for each of their ids;
empty tables give an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cloudframe.llm.common import let_go, small_batches

ERROR_RATE = 0.1
ROUND_CHARS = 2_000_000
#: Edits allowed in a pair of neighbouring pieces, one of which is a hit.
_PAIR = 1


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(n: int, rate: float = ERROR_RATE) -> int:
    """The edits allowed in an item of n characters: none, or an odd number."""
    k = int(n * rate)
    return k - 1 + k % 2 if k else 0


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the first best occurrence of the pattern in the text with at most ``most`` edits."""
    m = len(pattern)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    get = places.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full  # an occurrence may start anywhere
        plus = (down << 1 & full) | ~(diagonal | up) & full
        minus = up & diagonal
        if score <= most:
            best, most = (score, at + 1), score - 1
            if most < 0:
                break
    return best


def _one_edit(piece: str, text: str, at: int, ahead: bool) -> bool:
    """Whether the piece stands right behind (or, if not ahead, right before) a place with at most one edit."""
    n = len(piece)
    near = text[at : at + n + 1] if ahead else text[max(0, at - n - 1) : at][::-1]
    if not ahead:
        piece = piece[::-1]
    if near.startswith(piece):
        return True
    p = 0
    for a, b in zip(piece, near):
        if a != b:
            break
        p += 1
    rest = piece[p + 1 :]
    # another character, one too many, one too few
    return near.startswith(rest, p + 1) or near.startswith(piece[p:], p + 1) or near.startswith(rest, p)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.automaton = ahocorasick.Automaton()
        texts: dict[str, list[int]] = {}
        for item, text in items:
            if body := normal(text):
                texts.setdefault(body, []).append(item)
        self.items = [(ids, body, budget(len(body), rate)) for body, ids in texts.items()]
        for i, (_, body, k) in enumerate(self.items):
            n = len(body)
            cuts = [n * j // (k + 1) for j in range(k + 2)]
            for j in range(k + 1):
                piece = body[cuts[j] : cuts[j + 1]]
                # the other piece of its pair, and on which side that is
                other = None if not k else (body[cuts[j + 1] : cuts[j + 2]], True) if j % 2 == 0 else (body[cuts[j - 1] : cuts[j]], False)
                held = self.automaton.get(piece, None)
                if held is None:
                    self.automaton.add_word(piece, held := [])
                held.append((i, cuts[j], cuts[j + 1], other))
        if self.items:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[list[int], int, int]]:
        """(item ids, edits, end in the normal text) of the best occurrence of each item."""
        if not text or not self.items:
            return []
        body = normal(text)
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, list[int]] = {}
        for end, held in self.automaton.iter(body):
            for i, a, b, other in held:
                _, item, k = self.items[i]
                begin = end + 1 - b  # where the item would start
                starts = tried.setdefault(i, [])
                near = bisect_left(starts, begin - k)
                if i in best and best[i][0] == 0 or near < len(starts) and starts[near] <= begin + k:
                    continue
                if other and not _one_edit(other[0], body, end + 1 if other[1] else begin + a, other[1]):
                    continue
                insort(starts, begin)
                # wide enough for all starts that are not tried again
                left = max(0, begin - 2 * k)
                got = myers(item, body[left : begin + len(item) + 2 * k], k)
                if got and (i not in best or got[0] < best[i][0]):
                    best[i] = (got[0], left + got[1])
        return [(self.items[i][0], *found) for i, found in sorted(best.items())]


def _rounds(benchmark: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[int, str]]]:
    """The items, about ROUND_CHARS characters at a time."""
    some = benchmark.select(benchmark[item_id].alias("id"), benchmark[text].alias("text")).where("text is not null")
    chars = some.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    rounds = -(-chars // ROUND_CHARS)
    for r in range(rounds):
        part = some.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r)
        yield [(row.id, row.text) for row in part.orderBy("id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, end_at): each item found in each text, where it is found best."""
    slim = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, distance int, end_at long"
    item_type = to_arrow_type(item_kind)
    out = None
    for items in _rounds(benchmark, item_text, item_id):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for b in batches:
                rows = [(at, item, edits, end) for at, body in enumerate(b.column(1)) for ids, edits, end in matcher.find(body.as_py()) for item in ids]
                at, found, edits, ends = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, item_type), pa.array(edits, pa.int32()), pa.array(ends, pa.int64())], names=["doc_id", "item_id", "distance", "end_at"])

        one = small_batches(slim).mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    place = docs.columns.index(text)
    for items in _rounds(benchmark, item_text, item_id):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(body.as_py()) for body in b.column(place)], pa.bool_()))
            let_go()

        docs = small_batches(docs).mapInArrow(run, docs.schema)
    return docs


def decontamination_query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs.select("doc_id", "text"), benchmark)
