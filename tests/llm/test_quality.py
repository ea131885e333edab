"""The quality classifier: its parts against plain recomputations, and held-out rows."""

import math
import zlib

import numpy as np
import pytest

from cloudframe.llm import quality as Q

DATA = "/root/testdata/sf0.01"


def test_outlines():
    got = {t: Q.outline(t) for t in ("The", "THE!!", "of,", "12", "A", "|", "word***", "((x))", "iPod", "", "--")}
    assert got == {"The": "Aa", "THE!!": "A!!", "of,": "a,", "12": "0", "A": "Aa", "|": "|", "word***": "a***", "((x))": "((a))", "iPod": "x", "": "", "--": "--"}


def test_grams_are_indicators_of_the_whole_text():
    g = Q.Grams()
    a, b = g("one two three"), g("one two three")
    assert (a == b).all() and len(set(a.tolist())) == len(a)
    assert len(g("")) == 0 and len(g(" ")) == 0 and len(g("x")) > 0
    tail = "word*** " * 3
    long = "The text of a page. " * 200_000
    assert set(g(long + tail).tolist()) > set(g(long).tolist())
    # a repeated token is told from two different ones, whatever the words
    assert set(g("aaa aaa bbb").tolist()) != set(g("aaa bbb aaa").tolist())


def test_log_count_ratios():
    good, bad = np.array([8.0, 0.0, 3.0]), np.array([2.0, 5.0, 3.0])
    p, q = [9, 1, 4], [3, 6, 4]
    assert Q.log_count_ratios(good, bad) == pytest.approx([math.log((x / 14) / (y / 13)) for x, y in zip(p, q)])


def test_dual_descent_reaches_the_optimum():
    """Against the primal loss: no small step of weights or offset lowers it, and it equals the dual."""
    rng = np.random.default_rng(3)
    r = rng.normal(size=12)
    rows = [np.sort(rng.choice(12, rng.integers(1, 7), replace=False)) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    cost = np.full(60, 0.7)
    x = np.zeros((60, 13))
    for i, held in enumerate(rows):
        x[i, held] = r[held] / np.sqrt((r[held] ** 2).sum())
    x[:, 12] = 1

    def loss(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()

    passes, Q_TOL = Q.MOST_PASSES, Q.TOLERANCE
    Q.MOST_PASSES, Q.TOLERANCE = 4000, 1e-9
    try:
        w, b = Q.dual_descent(rows, r, y, cost)
    finally:
        Q.MOST_PASSES, Q.TOLERANCE = passes, Q_TOL
    v = np.append(w, b)
    for _ in range(300):
        assert loss(v + 1e-3 * rng.normal(size=13)) >= loss(v) - 1e-9


def test_score_is_what_the_model_says(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = Q.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    some = docs.orderBy("doc_id").limit(10).collect()
    got = {r.doc_id: r.score for r in Q.score(docs, model, keep=("doc_id",)).collect()}
    g = Q.Grams()
    for r in some:
        held = g(r.text)
        margin = sum(float(model.weights[f]) for f in held) / math.sqrt(sum(float(model.squares[f]) for f in held)) + model.offset
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))), abs=1e-6)


def test_held_out_rows(spark):
    """Rows never learned from; and changing their labels changes nothing."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in Q.quality(docs, labels).collect()}
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(r.quality, rows[r.doc_id]) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(held) > 60
    assert sum(q == r.predicted for q, r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(Q.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in Q.quality(docs, turned).collect()} == {i: r.score for i, r in rows.items()}


def test_odd_rows(spark):
    good, bad = "The river runs past a quiet town.", "BUY!! NOW!! CHEAP!!"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + f" {i}", 0.5, "x") for i in range(60)] + [(None, good, 0.5, "x"), (1, bad, 0.5, "x"), (2, None, 0.5, "x"), (901, "", 0.5, "x"), (902, good * 3000, 0.5, "x")], "doc_id long, text string, score double, __text string")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(None, 1, "x"), (3, None, "x"), (5, 7, "x"), (5, 1, "x"), (5, 1, "x")], "doc_id long, quality int, text string")
    rows = Q.quality(docs, labels).collect()
    assert len(rows) == 65 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[902].predicted == 1 and by[None].predicted == 1
    empty = [r.score for r in rows if r.doc_id == 901]
    assert empty == [r.score for r in rows if r.doc_id == 2 and r.score == empty[0]]
    assert {r.score for r in Q.quality(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert {r.score for r in Q.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality(docs.limit(0), labels).count() == 0
