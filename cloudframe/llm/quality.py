"""A quality classifier by naive Bayes support vectors over n-gram indicators.

Indicators: which n-grams a text has, not how often. There are three kinds, all hashed to
``WIDTH`` features:

* words, lower-cased, one and two in a row;
* classes of characters (capital, small, other letter, digit, white space; signs stand for
  themselves), two to five in a row, with stretches of one class of letters or digits
  counted as one or many;
* tokens by their outline: the class of their letters, the signs at their ends, and
  whether they repeat the token before; one to three in a row.

Training, on at most ``MOST_ROWS`` labelled texts of each class (those of the smallest
hashed ids; of texts that share an id the first in order; an id labelled both ways is of
class 0):

1. p and q are the smoothed counts of the texts of either class with a feature. Its weight
   is the log of the ratio of their shares, r = log((p / |p|) / (q / |q|)).
2. Indicators times r, brought to length 1, are the inputs of a linear machine with hinge
   loss. Dual coordinate descent takes one text after the other in a random order and moves
   its multiplier to where the dual is largest between 0 and the penalty, until no
   multiplier moves by much.
3. Platt's sigmoid turns margins into scores. It is fitted to margins of texts the machine
   has not seen (the machine is fitted once without each of ``FOLDS`` parts), weighted so
   that classes stand in the shares of all labelled rows.

Features that fewer than ``LEAST_TEXTS`` texts hold are left out, and of the others the
``MOST_FEATURES`` with the most evidence stay, which bounds what a text sends to the
driver to that many numbers.

Defined results: null texts are empty and get the score of a text without n-grams; without
labelled texts of both classes every score is 0.5; labels that are null or neither 0 nor 1
are left out; null ids are never learned from; rows with null or repeated ids are scored
row by row; an empty table gives an empty table; only the named columns are read, whatever
others are called. Whole texts are scored, whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.common import let_go, small_batches, table, write_table

MOST_ROWS = 5_000
BITS = 18
WIDTH = 1 << BITS
MOST_FEATURES, LEAST_TEXTS = 20_000, 3
SMOOTHING, PENALTY = 1.0, 1.0
MOST_PASSES, TOLERANCE = 60, 1e-2
FOLDS = 3
THRESHOLD = 0.3
CACHE = 300_000
#: Characters of a text looked at at a time.
STRIDE = 1 << 20
_ENDS = re.compile(r"\A([\W_]*)(.*?)([\W_]*)\Z", re.DOTALL)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def outline(token: str) -> str:
    """A token's signs around the class of its letters: 'Abc,' is 'Aa,', '12' is '0', 'ABC!!' is 'A!!'."""
    before, body, after = _ENDS.match(token).groups()
    kind = "" if not body else "0" if body.isdigit() else "A" if body.isupper() and len(body) > 1 else "Aa" if body[:1].isupper() and body[1:].islower() or len(body) == 1 and body.isupper() else "a" if body.islower() else "x"
    return before[:4] + kind + after[:4]


def _joined(numbers: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Hashes of n numbers in a row."""
    if len(numbers) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(numbers) - n + 1, np.uint64(kind))
    for k in range(n):
        out = (out ^ numbers[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out


class _Classes:
    """The class of each code point, as numbers."""

    def __init__(self):
        self.low = np.array([self.of(c) for c in range(0x3000)], np.uint64)

    @staticmethod
    def of(code: int) -> int:
        c = chr(code)
        return 1 if c.isupper() else 2 if c.islower() else 3 if c.isalpha() else 4 if c.isdigit() else 5 if c.isspace() else 16 + code

    def __call__(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.low[np.minimum(codes, len(self.low) - 1)]
        if len(codes) and codes.max() >= len(self.low):
            far = codes >= len(self.low)
            distinct, place = np.unique(codes[far], return_inverse=True)
            out[far] = np.array([self.of(int(c)) for c in distinct], np.uint64)[place]
        return out


class Grams:
    """Texts to the features they hold; what is known of tokens is remembered, up to CACHE of them."""

    def __init__(self):
        self.classes, self.held = _Classes(), np.zeros(WIDTH, bool)
        self.known: dict[str, int] = {}
        self.words, self.outlines = np.empty(1024, np.uint64), np.empty(1024, np.uint64)

    def _places(self, tokens: list[str]) -> np.ndarray:
        """The places of tokens in the arrays of hashes."""
        fresh = list(set(tokens).difference(self.known))
        if fresh:
            at, to = len(self.known), len(self.known) + len(fresh)
            if to > len(self.words):
                self.words, self.outlines = (np.concatenate([x, np.empty(max(to, len(x)), np.uint64)]) for x in (self.words, self.outlines))
            self.words[at:to] = [_hash(t.lower()) for t in fresh]
            self.outlines[at:to] = [_hash(outline(t)) << 1 for t in fresh]
            self.known.update(zip(fresh, range(at, to), strict=True))
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def _pieces(self, text: str) -> Iterator[str]:
        """Stretches of a long text; a few characters of each stand at the head of the next."""
        for at in range(0, max(1, len(text)), STRIDE):
            yield text[max(0, at - 64) : at + STRIDE]

    def __call__(self, text: str) -> np.ndarray:
        for piece in self._pieces(text):
            if len(self.known) > CACHE:
                self.known.clear()
            for hashes in self._hashes(piece):
                self.held[hashes >> np.uint64(64 - BITS)] = True
        found = np.flatnonzero(self.held)
        self.held[found] = False
        return found.astype(np.int32)

    def _hashes(self, text: str) -> Iterator[np.ndarray]:
        classes = self.classes(text)
        # of a stretch of one class of letters or digits the first two characters stay
        same = np.zeros(len(classes), bool)
        same[2:] = (classes[2:] == classes[1:-1]) & (classes[1:-1] == classes[:-2]) & (classes[2:] < 5)
        classes = classes[~same]
        for n in range(2, 6):
            yield _joined(classes, n, n)
        places = self._places(text.split())
        words = self.words[places]
        yield _joined(words, 1, 6)
        yield _joined(words, 2, 7)
        again = np.zeros(len(places), np.uint64)
        again[1:] = words[1:] == words[:-1]
        outlines = self.outlines[places] | again
        for n in range(1, 4):
            yield _joined(outlines, n, 7 + n)


@dataclass
class Model:
    weights: np.ndarray  #: of each feature, times its log-count ratio
    squares: np.ndarray  #: of the log-count ratios of the features in use
    offset: float
    slope: float
    shift: float

    def margin(self, held: np.ndarray) -> float:
        return float(self.weights[held].sum(dtype=np.float64) / np.sqrt(max(1e-12, self.squares[held].sum(dtype=np.float64)))) + self.offset

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def log_count_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    p, q = good + SMOOTHING, bad + SMOOTHING
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, cost: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and offset of the hinge-loss machine of rows of features; row i has the entries r[rows[i]] brought to length 1, and 1 for the offset."""
    rng = np.random.default_rng(seed)
    scale = np.array([1 / np.sqrt(max(1e-12, float(r[x] @ r[x]))) for x in rows])
    alpha, w, b = np.zeros(len(rows)), np.zeros(len(r)), 0.0
    norm = np.array([2.0 if len(x) else 1.0 for x in rows])
    for _ in range(MOST_PASSES):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x = rows[i]
            entries = r[x] * scale[i]
            slope = y[i] * (w[x] @ entries + b) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[x] += step * y[i] * entries
                b += step * y[i]
                most = max(most, abs(step) / cost[i])
        if most < TOLERANCE:
            break
    return w, b


def _sigmoid(margins: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's coefficients by Newton's method on softened targets."""
    x = np.column_stack([margins, np.ones(len(margins))])
    up, down = weight[good].sum(), weight[~good].sum()
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    w, keep = np.array([1.0, 0.0]), np.array([1e-3, 1e-6])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (weight * (p - target)) + keep * w)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    # a larger margin never means a worse text
    return max(float(w[0]), 1e-6), float(w[1])


def is_held_out(doc_id: str | Column) -> Column:
    """Rows never learned from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.pmod(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(id, good, text) of at most MOST_ROWS texts of each class, one of each id, none held out; and the labelled rows of each class."""
    known = labels.select(labels[doc_id].alias("id"), labels[label].cast("int").alias("good")).where(~is_held_out("id") & F.col("id").isNotNull() & F.col("good").isin(0, 1))
    known = known.groupBy("id").agg(F.min("good").alias("good"))
    shares = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    some = [known.where(F.col("good") == k).orderBy(F.xxhash64("id"), "id").limit(MOST_ROWS) for k in (0, 1)]
    # no more ids than the bound of both classes: safe to broadcast
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).where("text is not null").join(F.broadcast(some[0].union(some[1])), "id")
    return small_batches(write_table(rows.groupBy("id", "good").agg(F.min("text").alias("text")), "quality-sample")), shares


def _count(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of classes 1 and 0 hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(), np.zeros((2, WIDTH), np.int64)
        for b in batches:
            for text, good in zip(b.column("text").to_pylist(), b.column("good").to_pylist(), strict=True):
                counts[good][grams(text)] += 1
        held = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[0][held]), pa.array(counts[1][held])], names=["feature", "bad", "good"])

    counted = sample.mapInArrow(run, "feature long, bad long, good long").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    found = counted.toArrow()  # no more rows than WIDTH
    good, bad = np.zeros(WIDTH), np.zeros(WIDTH)
    place = found["feature"].to_numpy()
    good[place], bad[place] = found["good"].to_numpy(), found["bad"].to_numpy()
    return good, bad


def _in_use(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> np.ndarray:
    """The features with the most evidence: the log-likelihood ratio of the classes' own rates against one common rate."""

    def likelihood(k: np.ndarray, n: int, rate: np.ndarray) -> np.ndarray:
        rate = np.clip(rate, 1e-9, 1 - 1e-9)
        return k * np.log(rate) + (n - k) * np.log(1 - rate)

    both = (good + bad) / (n_good + n_bad)
    evidence = likelihood(good, n_good, good / n_good) + likelihood(bad, n_bad, bad / n_bad) - likelihood(good, n_good, both) - likelihood(bad, n_bad, both)
    enough = np.flatnonzero(good + bad >= LEAST_TEXTS)
    return np.sort(enough[np.argsort(-evidence[enough], kind="stable")[:MOST_FEATURES]])


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model | None:
    """A model of the labels, or None where one of the two classes is missing."""
    sample, shares = _sample(docs, labels, text, doc_id, label)
    n = {r.good: r["count"] for r in sample.groupBy("good").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    good, bad = _count(sample)
    used = _in_use(good, bad, n[1], n[0])
    r = log_count_ratios(good[used], bad[used])
    place = np.full(WIDTH, -1, np.int32)
    place[used] = np.arange(len(used))
    sent = sample.sparkSession.sparkContext.broadcast(place)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            held = [(x := sent.value[grams(t)])[x >= 0].astype(np.uint16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("good"), pa.array(held, pa.binary())], names=["id", "good", "held"])

    # MOST_FEATURES numbers of two bytes for each text of the bounded sample at most
    kind = sample.schema["id"].dataType.simpleString()
    found = sample.mapInArrow(rows_of, f"id {kind}, good int, held binary").orderBy(F.xxhash64("id"), "id").toArrow()
    sent.destroy()
    rows = [np.frombuffer(x, np.uint16).astype(np.int64) for x in found["held"].to_pylist()]
    y = np.where(found["good"].to_numpy() == 1, 1.0, -1.0)
    # both classes weigh alike
    cost = PENALTY * np.where(y > 0, len(y) / (2 * n[1]), len(y) / (2 * n[0]))
    margins = np.zeros(len(y))
    for fold in range(FOLDS):
        out = np.arange(len(y)) % FOLDS == fold
        inside = np.flatnonzero(~out)
        if len(set(y[inside])) < 2:
            inside = np.arange(len(y))
        w, b = dual_descent([rows[i] for i in inside], r, y[inside], cost[inside])
        for i in np.flatnonzero(out):
            x = rows[i]
            margins[i] = w[x] @ r[x] / np.sqrt(max(1e-12, float(r[x] @ r[x]))) + b
    weight = np.where(y > 0, shares[1] / n[1], shares[0] / n[0])
    slope, shift = _sigmoid(margins, y > 0, weight)
    w, b = dual_descent(rows, r, y, cost)
    weights, squares = np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32)
    weights[used], squares[used] = w * r, r * r
    return Model(weights, squares, b, slope, shift)


def score(docs: DataFrame, model: Model | None, *, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``score``, from 0 to 1."""
    slim = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text], F.lit("")).alias("__text"))
    if model is None:
        return slim.drop("__text").withColumn("score", F.lit(0.5))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two numbers a feature, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(), sent.value
        for b in batches:
            margins = np.array([m.margin(grams(t)) for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.score(margins), pa.float64())], names=[*keep, "score"])
        let_go(grams.known)

    return small_batches(slim).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; ``predicted`` is 1 for texts worth keeping."""
    scored = score(docs, train(docs, labels, text=text, doc_id=doc_id, label=label), keep=(doc_id,), text=text)
    return scored.select(F.col(doc_id).alias("doc_id"), is_held_out(doc_id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_query(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
