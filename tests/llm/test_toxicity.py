"""The string kernel against its definition, and the machine's accuracy on rows it never learned from."""

import zlib
from itertools import combinations

import numpy as np
import pytest

from cloudframe.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def plain_kernel(a, b):
    def features(w):
        out = {}
        for n in (3, 4):
            for at in combinations(range(len(w)), n):
                if at[-1] - at[0] <= n - 1 + T.GAPS:
                    s = "".join(w[i] for i in at)
                    out[s] = out.get(s, 0) + T.DECAY ** (at[-1] - at[0] - n + 1)
        return out

    x, y = features(a), features(b)
    norm = [np.sqrt(max(1.0, sum(T.DECAY ** (2 * (at[-1] - at[0] - n + 1)) for n in (3, 4) for at in combinations(range(len(w)), n) if at[-1] - at[0] <= n - 1 + T.GAPS))) for w in (a, b)]
    return sum(v * y.get(s, 0) for s, v in x.items()) / norm[0] / norm[1]


def test_kernel_is_the_gapped_subsequence_kernel():
    words = [T.letters_of(w) for w in ("idiot", "idi-ot", "idxiot", "banana", "a", "", "straße", "мир")]
    got = T.kernel(words, words[:4])
    want = [[plain_kernel(a, b) for b in words[:4]] for a in words]
    assert np.allclose(got, want)


def test_words_spelled_out():
    assert {"i", "d", "o", "t", "idiot"} <= T.tokens_of("You i d i o t there")
    assert T.letters_of("i.d.1-ó") == "|idi\x86}"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, T.train(docs, labels)


def test_accuracy_on_held_out_rows(spark, model):
    docs, labels, machine = model
    rows = T.score(docs, machine, keep=("doc_id",)).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    toxic = [r.score >= T.THRESHOLD for r in held if r.toxic]
    clean = [r.score >= T.THRESHOLD for r in held if not r.toxic]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02


def test_gapped_insults(model):
    scorer = T.Scorer(model[2])
    texts = ["the {} was in", "{}"]
    variants = ["idiot", "i.d.i.o.t", "i d i o t", "id-iot", "IDIOT!", "stupiid"]
    scores = model[2].scores(scorer.best([t.format(v) for t in texts for v in variants]))
    assert (scores >= T.THRESHOLD).all()
    assert (model[2].scores(scorer.best(["the house is on the hill", "", "a b c d e f g", "stupendous"])) < T.THRESHOLD).all()


def test_edge_cases(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (None, "idiot", None), (3, "idiot " * 50_000, "x"), (3, "fine", "x"), (4, "x" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {(r.doc_id, r.score >= T.THRESHOLD) for r in T.score(docs, model[2], keep=("doc_id",)).collect()}
    assert got == {(1, False), (2, False), (None, True), (3, True), (3, False), (4, False)}
    assert T.score(docs.limit(0), model[2], keep=("doc_id",)).count() == 0


def test_without_labels(spark, model):
    docs, labels, _ = model
    got = T.toxicity(docs.limit(20), labels.where("toxic = 0"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert {(r.score, r.predicted) for r in got.collect()} == {(0.0, 0)}
    ids = spark.createDataFrame([(i,) for i in range(500)] + [(None,)], "doc_id long").select("doc_id", T.is_held_out("doc_id").alias("h"))
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ids.collect())


def test_long_tokens_among_short_words(model):
    """A batch is not padded to its longest word, and a long word read in stretches counts every subsequence once."""
    import tracemalloc

    machine = model[2]
    long = ("qwertzuiop" * 100_000)[:1_000_000]
    words = [T.letters_of(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}") for i in range(4096)] + [T.letters_of(long)]
    tracemalloc.start()
    got = machine.margins(words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 500e6
    assert np.allclose(got[:4096], machine.margins(words[:4096]))
    word = T.letters_of(long[:150_000])
    codes, lens = T._codes([word])
    want = sum(weight * machine.table[number].sum(dtype=float) for number, weight in T._subsequences(codes)) / T._norms(lens)[0] + machine.offset
    assert np.allclose(machine.margins([word]), want)


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_TOXIC", 3)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in ids for k in range(5)] + [(None, "x"), (ids[0], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(ids[0], 0), (ids[1], None), (None, 1), (ids[2], 7)], "doc_id long, toxic int")
    rows = T._sample(docs, labels, "text", "doc_id", "toxic").collect()
    assert len(rows) == 3 and all(r.toxic == 1 and r.text.endswith(" 0") for r in rows)
