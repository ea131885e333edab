"""Spelling variants against all pairs of words, compared place by place."""

import re
import zlib
from collections import Counter

import pytest

from cloudframe.llm import spelling as S


def counts(rows, drop):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop and h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, drop=None, letters=6, times=5, factor=5):
    n = {w: k for w, k in counts(rows, drop).items() if len(w) >= letters and k >= times}
    around = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= factor * n[w] else None for w, v in around.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(around[w]), n.get(form[w])) for w in n}


def found(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["garden " * 200, "Garden GARDEN gardne gardn " * 6, "gardens " * 30, "gardenss " * 6, "aaaaaa aaaaaaa aaaaaaaa " * 6, "élégante elégante élegante " * 7, "ÉLÉGANTE " * 5, None, "", "x", "12 !! ×÷×÷×÷ " * 5, f"{'ab' * 400} " * 6, f"{'ab' * 399}aab " * 5]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(None, "planks " * 5 + "plank" * 2, "x", 1, 2), (3, "tablet tablex tabley tablez " * 5, "x", 1, 2)] + [(7, "repeat repeats " * 3, "x", 1, 2)] * 2
    # columns with names that are used inside
    return spark.createDataFrame(rows, "doc_id long, text string, word string, id int, n int")


@pytest.mark.parametrize("drop", [None, 3, 199])
def test_odd_rows(odd, drop):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = plain(rows, drop)
    assert found(S.spelling_variants(odd, drop_one_in=drop)) == want
    if drop is None:
        by = {w[0]: w for w in want}
        assert by["gardenss"][1:3] == ("gardens", "garden") and by["tablet"][4] == 3


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(S.spelling_variants(docs, drop_one_in=199)) == plain(rows, 199)


def test_small_bounds_and_empty_table(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(S.spelling_variants(odd, least_letters=1, least_times=1, times=2)) == plain(rows, None, 1, 1, 2)
    assert S.spelling_variants(odd.limit(0)).collect() == []


def test_long_chains_of_forms(spark):
    """Each form five times as frequent as its word: roots lie several steps up."""
    words = ["chains" + "s" * k for k in range(5)]
    docs = spark.createDataFrame([(k, f"{w} " * (5 ** (5 - k))) for k, w in enumerate(words)], "doc_id long, text string")
    assert {r.word: r.root for r in S.spelling_variants(docs).collect()} == dict.fromkeys(words, "chains")
