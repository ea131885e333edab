"""Tokenizer alignment against the two libraries and a plain walk over both tokens' ends."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cloudframe.llm import alignment as L

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "a", "The thing.\nEnd of it", "two  spaces", "a▁b", "<|endoftext|> and <s> </s> <0x41> <unk>", "日本語 テキスト 12", "é à ü ß", "🙂🙃 emoji", "tab\tand\r\n", "x" * 3000,
    "tion the thing " * 4000, "12345678901234567890", "\x00\x01", "ﬁne ½", "the the the", " leading", "trailing ",
]


def plain(texts):
    """Rows as the contract words them, token by token."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: i for i, c in enumerate(L.byte_letters())}

    def of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p[:3] == "<0x" and p[-1] == ">" and len(p) == 6 else p.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for t in texts:
        row = {"n_a": 0, "n_b": 0, "groups": [], "links": []}
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            names = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [of_b(i) for i in ids[1]]
            if all(b"".join(n) == b" " + t.encode() for n in names):
                ends = [dict(zip(np.cumsum([len(x) for x in n]).tolist(), i)) for n, i in zip(names, ids)]
                row["n_a"], row["n_b"] = len(ids[0]), len(ids[1])
                cut = 0
                for end in sorted(ends[0].keys() & ends[1].keys()):
                    row["groups"].append("|".join(",".join(str(i) for at, i in e.items() if cut < at <= end) for e in ends) if len(t) < 5000 else None)
                    row["links"].append((ends[0][end], ends[1][end]))
                    cut = end
        counts.update(row["links"])
        rows.append(row)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (r["n_a"], r["n_b"], len(r["groups"]), len(r["links"]), sum(counts[x] == best[x[1]] for x in r["links"]), sum(counts[x] for x in r["links"]),
         (hashlib.sha256(";".join(r["groups"]).encode()).hexdigest() if r["groups"] else "") if None not in r["groups"] else None)
        for r in rows
    ]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(rows, want):
    assert len(rows) == len(want)
    for row, w in zip(rows, want, strict=True):
        got = tuple(row[c] for c in NAMES)
        assert got[:6] == w[:6] and w[6] in (None, got[6]), (row, w)


@pytest.fixture(scope="module")
def odd(spark):
    # an id of its own each, and columns of names used inside
    return spark.createDataFrame([(k, t, 1, "x", b"y") for k, t in enumerate(ODD)], "doc_id long, text string, row int, kind string, ids binary")


@pytest.mark.parametrize("block", [1, 3, 16_384])
def test_odd_texts(spark, odd, block, monkeypatch):
    """The same with every size of the blocks that the sweep reads."""
    if block == 1:
        odd = odd.where("length(text) < 2000 or text is null")
    monkeypatch.setattr(L, "BLOCK", block)
    texts = [r.text for r in odd.orderBy("doc_id").collect()]
    check(L.align(odd, A, B).orderBy("doc_id").collect(), plain(texts))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    check(L.align(docs, A, B).orderBy("doc_id").collect(), plain(texts))


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "the thing"), (1, "the thing"), (1, "other"), (None, "the thing"), (None, None)], "doc_id long, text string")
    rows = sorted(L.align(docs, A, B).collect(), key=lambda r: (r.doc_id is None, r.n_a, r.groups_sha256))
    assert [r.doc_id for r in rows] == [1, 1, 1, None, None]
    assert sorted(r.n_a for r in rows if r.doc_id is None)[0] == 0
    assert sorted(tuple(r[c] for c in NAMES) for r in rows) == sorted(plain(["the thing", "the thing", "other", "the thing", None]))


def test_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert L.align(empty, A, B).collect() == []
    assert L.align(empty, A, B).schema["doc_id"].dataType.simpleString() == "string"
    assert L.align(spark.createDataFrame([("k", None)], "doc_id string, text string"), A, B).collect()[0].groups_sha256 == ""


def test_pairs_are_bounded_by_the_vocabularies():
    assert 0 < L.most_pairs(A, B) < 1_000_000


def test_other_tokenizers(spark):
    """A against itself: every token is a group of its own and its own best partner."""
    docs = spark.createDataFrame([(1, "The same, twice.")], "doc_id long, text string")
    row = L.align(docs, A, A).collect()[0]
    assert row.n_a == row.n_b == row.n_groups == row.n_links == row.n_best
