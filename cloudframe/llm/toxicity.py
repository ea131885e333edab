"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nyström landmarks.

Kernel: two strings are alike as far as they share subsequences of 3 and 4 letters, each
weighted by ``DECAY`` for every place it spans (up to two gaps), so an inserted or
missing letter leaves most of the likeness. Values are divided by what the two lengths
alone let expect.

Sentences are bags of words (letters without what stands between them; runs of single
letters are one word), and a bag is as toxic as its most toxic words: a text scores by
the best word and the best three words of its sentences.

Training, on at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled texts (those of the
smallest hashed ids; of texts that share an id the first in order; an id labelled both
ways is toxic). A text is labelled, its words are not, so this is learning from bags: a
toxic text needs one toxic word, a clean one has none. Words of more than ``MOST_LETTERS``
letters are scored, but not learned from.

1. Words, grams of four and five letters and longer beginnings of them are counted by the texts that hold
   them: how much more a text with one is toxic than others is its evidence. In each
   toxic text the words with the most evidence are positive examples, as they are and
   with one letter inserted, doubled or left out; words of clean texts are negative ones.
2. Landmarks are taken from both; K(x, landmarks) K(landmarks, landmarks)^-1/2 are the
   features of a linear machine (squared hinge, Newton's method). Then, ``HARD_ROUNDS``
   times, each toxic text names its witness, the word the machine itself finds most
   toxic; witnesses with as much evidence join the positive examples and the words of clean texts with the
   highest margins the negative ones.
3. Platt's sigmoid turns the margins of a text's best words into its score. It is fitted
   to the sample's texts, and to clean texts with a positive word that no clean text has.

As the machine is linear in the kernel and the kernel in the subsequences, the landmarks
fold into one weight per subsequence; each distinct word is scored by a few lookups.

Letters beyond the Latin ones of ``_MORE`` stand for one of the alphabet by their code, so
words of other scripts stay apart from each other.

Defined results: null texts are empty and get the score of a text without words; without
toxic or without clean labelled texts every score is 0; labels that are null are left
out; rows with null or repeated ids are scored row by row; an empty table gives an empty
table. Whole texts are scored, whatever their length.
"""

from __future__ import annotations

import heapq
import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.common import drop_table, let_go, small_batches, write_table

MOST_TOXIC, MOST_CLEAN = 3_000, 6_000
MOST_WORDS, LANDMARKS = 8_000, 384
HARD_ROUNDS, BEST = 3, 3
THRESHOLD = 0.3
DECAY, GAPS = 0.4, 2
LEAST_TEXTS, LEAST_ODDS, LEAST_EVIDENCE = 3, 20.0, 8.0
PENALTY = 10.0
CACHE = 400_000
#: Letters of a word to learn from or to remember; padded letters in a batch of words; letters of a long word read at a time.
MOST_LETTERS, PADDED, STRIDE = 64, 1 << 17, 1 << 16
#: fixed values: letters beyond a to z that count as themselves, and signs and letters that stand for others
_MORE = "éèêáàäíîóôöúùüñçß"
_SIGNS = dict(zip("013457@$ëâåãïûøœæ", "oieastasêàaaîùooa", strict=True))
#: every letter is a character from 'a' on: a to z, a free one, the two end marks, _MORE
_FIRST, _LAST = "|", "}"
LETTERS = 29 + len(_MORE) + 1
_SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
_PLACES = [(n, (0, *c)) for n in (3, 4) for c in combinations(range(1, n + GAPS), n - 1)]


class _Letters(dict):
    """For str.translate: what each character counts as, or nothing."""

    def __missing__(self, code: int) -> str:
        c = _SIGNS.get(chr(code), chr(code))
        out = c if "a" <= c <= "z" else chr(126 + _MORE.index(c)) if c in _MORE else chr(97 + code % 26) if c.isalpha() else ""
        self[code] = out
        return out


_letters = _Letters()


def letters_of(token: str) -> str:
    """A lower-cased token's letters between end marks."""
    return f"{_FIRST}{token.translate(_letters)}{_LAST}"


def tokens_of(text: str) -> set[str]:
    """Distinct lower-cased tokens; letters spelled out one by one also stand as one token."""
    low = text.lower()
    out = set(low.split())
    for run in _SPELLED.finditer(low):
        out.add("".join(run[0].split()))
    return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers, padded with 0, and the lengths."""
    raw = [w.encode("latin-1") for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    width = int(lens.max(initial=1)) + 4 + GAPS
    out = np.zeros((len(raw), width), np.int32)
    where = np.arange(width)[None, :] < lens[:, None]
    out[where] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) - 96
    return out, lens


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Each kind of place pattern: the numbers of the subsequences at all starts (0: none), and their weight."""
    width = codes.shape[1]
    for n, places in _PLACES:
        span = width - places[-1]
        number = np.zeros((len(codes), span), np.int32)
        there = codes[:, places[-1] :] > 0
        for p in places:
            number = number * LETTERS + codes[:, p : p + span]
        yield np.where(there, number + (0 if n == 3 else LETTERS**3), 0), DECAY ** (places[-1] - (n - 1))


def _norms(lens: np.ndarray) -> np.ndarray:
    total = np.zeros(len(lens))
    for n, places in _PLACES:
        total += np.maximum(lens - places[-1], 0) * DECAY ** (2 * (places[-1] - (n - 1)))
    return np.sqrt(np.maximum(total, 1.0))


def kernel(words: list[str], marks: list[str]) -> np.ndarray:
    """The kernel's values between words and landmarks."""
    mark_codes, mark_lens = _codes(marks)
    parts = list(_subsequences(mark_codes))
    held = np.unique(np.concatenate([p.ravel() for p, _ in parts]))
    row = np.zeros(LETTERS**3 + LETTERS**4, np.int32)
    row[held] = np.arange(len(held))
    table = np.zeros((len(held), len(marks)))
    for number, weight in parts:
        np.add.at(table, (row[number], np.arange(len(marks))[:, None]), weight)
    table /= _norms(mark_lens)
    table[row[0]] = 0
    known = np.zeros(len(row), bool)
    known[held] = True
    known[0] = False
    out = np.zeros((len(words), len(marks)))
    for at in range(0, len(words), 512):
        codes, lens = _codes(words[at : at + 512])
        for number, weight in _subsequences(codes):
            i, j = np.nonzero(known[number])
            np.add.at(out, at + i, weight * table[row[number[i, j]]])
        out[at : at + 512] /= _norms(lens)[:, None]
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A linear machine with squared hinge loss; the last entry is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.ones(len(w))
    keep[-1] = 1e-3
    for _ in range(50):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xs, ws = x[on], weight[on]
        gradient = keep * w - 2 * PENALTY * xs.T @ (ws * y[on] * slack[on])
        hessian = np.diag(keep) + 2 * PENALTY * (xs * ws[:, None]).T @ xs
        step = np.linalg.solve(hessian, gradient)

        def loss(v):
            return 0.5 * keep @ (v * v) + PENALTY * weight @ np.maximum(1 - y * (x @ v), 0) ** 2

        rate, before = 1.0, loss(w)
        while loss(w - rate * step) > before and rate > 1e-4:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return w


def _features(best: np.ndarray) -> np.ndarray:
    """Of the best three margins of each text: the best one, their mean, and 1."""
    return np.column_stack([best[:, 0], best.mean(axis=1) - best[:, 0], np.ones(len(best))])


def _sigmoid(best: np.ndarray, toxic: np.ndarray, weight: np.ndarray, only_best: bool = False) -> np.ndarray:
    """Platt's coefficients by Newton's method on softened targets."""
    x = _features(best)
    if only_best:
        x[:, 1] = 0
    up, down = weight[toxic].sum(), weight[~toxic].sum()
    target = np.where(toxic, (up + 1) / (up + 2), 1 / (down + 2))
    w, keep = np.zeros(x.shape[1]), np.array([1e-2, 1e-2, 1e-6])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (weight * (p - target)) + keep * w)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    # more insults never make a text less toxic
    return _sigmoid(best, toxic, weight, only_best=True) if w[1] < 0 else w


@dataclass
class Model:
    table: np.ndarray  #: a weight per subsequence
    offset: float
    platt: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order, at = np.argsort(lens, kind="stable"), 0
        while at < len(order):
            # so many words that no batch is padded beyond PADDED, one at least
            to = at + 1
            while to < len(order) and (to + 1 - at) * int(lens[order[to]]) <= PADDED:
                to += 1
            some = order[at:to]
            out[some] = self._sums([words[i] for i in some]) / _norms(lens[some]) + self.offset
            at = to
        return out

    def _sums(self, words: list[str]) -> np.ndarray:
        """Sums of the weights of all subsequences; those that start in a stretch of STRIDE letters at a time."""
        total, ahead = np.zeros(len(words)), _PLACES[-1][1][-1] + 1
        for at in range(0, max(map(len, words)), STRIDE):
            codes, _ = _codes([w[at : at + STRIDE + ahead] for w in words])
            for number, weight in _subsequences(codes):
                total += weight * self.table[number[:, :STRIDE]].sum(axis=1, dtype=np.float64)
        return total

    def scores(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(best) @ self.platt, -500, 500)))


class Scorer:
    """A model with the margins of tokens met before."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def best(self, texts: list[str]) -> np.ndarray:
        """The three highest margins of each text, filled up with the lowest there can be."""
        if len(self.known) > CACHE:
            self.known.clear()
        bags = [tokens_of(t) for t in texts]
        fresh = [t for t in set().union(*bags) if t not in self.known]
        margins = dict(zip(fresh, self.model.margins(list(map(letters_of, fresh))).tolist(), strict=True))
        self.known.update((t, m) for t, m in margins.items() if len(t) <= MOST_LETTERS)
        get = ChainMap(margins, self.known).__getitem__ if len(margins) and max(map(len, margins)) > MOST_LETTERS else self.known.__getitem__
        low = [min(self.model.offset, 0.0)] * BEST
        return np.array([(heapq.nlargest(BEST, map(get, bag)) + low)[:BEST] for bag in bags]).reshape(-1, BEST)


def is_held_out(doc_id: str | Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str) -> DataFrame:
    """At most MOST_TOXIC and MOST_CLEAN labelled texts with ids that are not held out, one of each id: (text, toxic)."""
    known = labels.select(labels[doc_id].alias("id"), labels[label].cast("int").alias("toxic")).where(~is_held_out("id") & F.col("id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    # no more ids than the two bounds: safe to broadcast
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).where("text is not null").join(F.broadcast(some[0].union(some[1])), "id")
    return small_batches(write_table(rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxicity-sample"))


def _words(text: str) -> set[str]:
    return {w for t in tokens_of(text) if 5 <= len(w := letters_of(t)) <= MOST_LETTERS}


def _grams(word: str) -> set[str]:
    """A word itself, its grams of four and five letters, and its beginnings of up to nine."""
    return {word} | {word[i : i + n] for n in (4, 5) for i in range(len(word) - n + 1)} | {word[:n] for n in range(6, min(10, len(word)))}


def _evidence(toxic: str, clean: str, share: float) -> Column:
    """The log-likelihood ratio of so many texts being toxic at their own rate and at the common one."""
    t, c = F.col(toxic), F.col(clean)
    rate = t / (t + c)
    return t * F.log(rate / share) + F.when(c > 0, c * F.log((1 - rate) / (1 - share))).otherwise(0.0)


def _strong_grams(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Grams far commoner in toxic texts, with the odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[toxic].update(set().union(*map(_grams, _words(text))))
        grams = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *(pa.array([c[g] for g in grams], pa.int64()) for c in found)], names=["gram", "clean", "toxic"])
        let_go()

    counted = sample.mapInArrow(count, "gram string, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("t") >= LEAST_TEXTS)
    odds = (F.col("t") + 0.5) / (F.col("c") + 0.5) * (n_clean / n_toxic)
    strong = counted.where(odds >= LEAST_ODDS).select("gram", _evidence("t", "c", n_toxic / (n_toxic + n_clean)).alias("evidence")).where(F.col("evidence") >= LEAST_EVIDENCE)
    return {r.gram: r.evidence for r in strong.orderBy(F.desc("evidence"), "gram").limit(MOST_WORDS).collect()}


def _examples(sample: DataFrame, strong: dict[str, float]) -> tuple[dict[str, int], list[str], set[str], DataFrame]:
    """Positive words, those most texts point to first, with the number of these texts; negative words; positive ones that clean texts hold too; all words with their counts."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = _words(text)
                if toxic:
                    evidence = {w: max(strong[g] for g in held) for w in words if (held := _grams(w) & strong.keys())}
                    words = [w for w, e in evidence.items() if e >= 0.5 * max(evidence.values())]
                found[toxic].update(words)
        words = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in found)], names=["word", "clean", "toxic"])
        let_go()

    counted = write_table(sample.mapInArrow(pick, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")), "toxicity-words")
    good = counted.where(F.col("t") > 4 * F.col("c")).orderBy(F.desc("t"), F.xxhash64("word"), "word").limit(MOST_TOXIC).collect()
    positive = {r.word: r.t for r in good}
    shared = {r.word for r in good if r.c}
    common = counted.where("c > 0").orderBy(F.desc("c"), F.xxhash64("word"), "word").limit(MOST_WORDS // 4)
    others = counted.where("c > 0").orderBy(F.xxhash64("word"), "word").limit(MOST_WORDS // 2)
    return positive, sorted({r.word for r in common.union(others).collect()} - positive.keys()), shared, counted


def _found(sample: DataFrame, model: Model, counted: DataFrame, share: float) -> tuple[dict[str, int], list[str]]:
    """The witnesses of toxic texts with their number of texts, and the words of clean texts with the highest margins."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [sorted(_words(t)) for t in b.column(0).to_pylist()]
            words = sorted(set().union(*bags))
            margin = dict(zip(words, sent.value.margins(words).tolist(), strict=True))
            toxic = b.column(1).to_pylist()
            best = Counter(max(bag, key=margin.__getitem__) for bag, y in zip(bags, toxic, strict=True) if y and bag)
            clean = set().union(*(bag for bag, y in zip(bags, toxic, strict=True) if not y))
            rows = [(w, n, margin[w]) for w, n in best.items() if margin[w] > 0]
            rows += [(w, 0, margin[w]) for w in heapq.nlargest(MOST_WORDS, sorted(clean), key=margin.__getitem__)]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.float64()), strict=True)], names=["word", "texts", "margin"])
        let_go()

    found = write_table(sample.mapInArrow(run, "word string, texts long, margin double").groupBy("word").agg(F.sum("texts").alias("texts"), F.max("margin").alias("m"), F.min("texts").alias("least")), "toxicity-found")
    named = found.where("texts > 0").join(counted.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    named = named.where((F.col("texts") > 4 * F.col("c")) & (_evidence("texts", "c", share) >= LEAST_EVIDENCE))
    witnesses = {r.word: r.texts for r in named.orderBy(F.desc("texts"), "word").limit(MOST_TOXIC).collect()}
    hard = [r.word for r in found.where("least = 0").orderBy(F.desc("m"), "word").limit(MOST_WORDS // 4).collect()]
    sent.destroy()
    drop_table(found)
    return witnesses, hard


def _variants(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with a letter inserted, one doubled, and one left out if it is long."""
    out = []
    for w in words:
        at = int(rng.integers(2, max(3, len(w) - 1)))
        out += [w[:at] + chr(97 + int(rng.integers(26))) + w[at:], w[:at] + w[at - 1] + w[at:]]
        if len(w) >= 8:
            out.append(w[:at] + w[at + 1 :])
    return out


def _fit(texts: dict[str, int], negative: list[str], rng: np.random.Generator, first: int) -> Model:
    """``first``: so many negative words are the hard ones and serve as landmarks before others."""
    taken, positive = set(negative), list(texts)
    more = [w for w in _variants(positive, rng) if w not in taken]
    words = [*positive, *more, *negative]
    y = np.where(np.arange(len(words)) < len(positive) + len(more), 1.0, -1.0)
    ours = min(LANDMARKS // 2, len(positive))
    order = [*range(first), *(first + rng.permutation(len(negative) - first)).tolist()]
    marks = list(dict.fromkeys([*positive[:ours], *(negative[i] for i in order[: (LANDMARKS - ours) // 2]), *(negative[i] for i in order[::-1][: (LANDMARKS - ours) // 2])]))
    value, vector = np.linalg.eigh(kernel(marks, marks))
    root = (vector / np.sqrt(np.maximum(value, 1e-4))) @ vector.T
    # a word counts by the texts that point to it, its variants as those of one text
    weight = np.where(y > 0, np.sqrt(len(negative) / (len(positive) + len(more))), 1.0)
    weight[: len(positive)] *= np.log2(1.0 + np.fromiter(texts.values(), float, len(texts)))
    w = _machine(kernel(words, marks) @ root, y, weight)
    each = root @ w[:-1]
    table = np.zeros(LETTERS**3 + LETTERS**4, np.float32)
    codes, lens = _codes(marks)
    for number, share in _subsequences(codes):
        np.add.at(table, number, np.broadcast_to((share * each / _norms(lens))[:, None], number.shape))
    table[0] = 0
    return Model(table, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", seed: int = 7) -> Model | None:
    """A model of the labels, or None where one of the two classes (or all difference) is missing."""
    sample = _sample(docs, labels, text, doc_id, label)
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    strong = _strong_grams(sample, n[1], n[0])
    if not strong:
        return None
    positive, negative, shared, counted = _examples(sample, strong)
    if not positive or not negative:
        return None
    rng = np.random.default_rng(seed)
    model = _fit(positive, negative, np.random.default_rng(seed), 0)
    hard: list[str] = []
    for _ in range(HARD_ROUNDS):
        witnesses, harder = _found(sample, model, counted, n[1] / (n[0] + n[1]))
        positive |= {w: t for w, t in witnesses.items() if w not in positive}
        hard = [w for w in dict.fromkeys([*harder, *hard]) if w not in positive]
        model = _fit(positive, [*hard, *(w for w in negative if w not in positive and w not in set(hard))], np.random.default_rng(seed), len(hard))
    # three numbers for each text of the bounded sample
    rows = score(sample, model, keep=("toxic",), text="text", raw=True).collect()
    toxic, best = np.array([r.toxic == 1 for r in rows]), np.array([r.margins for r in rows])
    alone = [(w, t) for w, t in positive.items() if t >= LEAST_TEXTS and w not in shared]
    clean = best[~toxic]
    with_one = np.column_stack([model.margins([w for w, _ in alone]), clean[rng.integers(0, len(clean), len(alone))]])
    with_one = -np.sort(-with_one, axis=1)[:, :BEST]
    ones = np.array([t for _, t in alone], float)
    weight = np.concatenate([np.ones(len(best)), 0.5 * toxic.sum() * ones / max(1.0, ones.sum())])
    model.platt = _sigmoid(np.vstack([best, with_one]), np.concatenate([toxic, np.ones(len(alone), bool)]), weight)
    return model


def score(docs: DataFrame, model: Model | None, *, keep: tuple[str, ...], text: str = "text", raw: bool = False) -> DataFrame:
    """The columns ``keep`` with ``score`` (or the ``margins`` of the best words)."""
    slim = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text], F.lit("")).alias("__text"))
    if model is None:
        return slim.drop("__text").withColumn("score", F.lit(0.0))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "margins array<double>" if raw else "score double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each subsequence there can be, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                piece = b.slice(at, 512)
                best = scorer.best(piece.column(piece.num_columns - 1).to_pylist())
                out = pa.array(best.tolist(), pa.list_(pa.float64())) if raw else pa.array(scorer.model.scores(best))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], out], names=[*keep, "margins" if raw else "score"])
        let_go(scorer.known)

    return small_batches(slim).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    scored = score(docs, train(docs, labels, text=text, doc_id=doc_id, label=label), keep=(doc_id,), text=text)
    return scored.select(F.col(doc_id).alias("doc_id"), is_held_out(doc_id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    model = train(docs, labels, text=text, doc_id=doc_id, label=label)
    if model is None:
        return docs
    place, sent = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                piece = b.slice(at, 512)
                best = scorer.best([t or "" for t in piece.column(place).to_pylist()])
                yield piece.filter(pa.array(scorer.model.scores(best) < threshold))
        let_go(scorer.known)

    return small_batches(docs).mapInArrow(run, docs.schema)


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs, labels)
