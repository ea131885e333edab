"""Every stage of the pipeline against a plain recomputation on its own input."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloudframe.llm import decontaminate, minhash, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        found.append((name, docs))
    return dict(found)


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def test_columns(steps):
    names = list(steps)
    assert names == ["documents", "toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    assert all(steps[n].columns == steps["documents"].columns for n in names[:-1])


def test_toxicity(spark, steps):
    scored = toxicity.toxicity(steps["documents"], spark.read.parquet(f"{DATA}/labels.parquet"))
    want = Counter(r.doc_id for r in scored.collect() if not r.predicted)
    assert Counter(r["doc_id"] for r in rows(steps["toxicity"])) == want


def test_near_duplicates(steps):
    from tests.llm.test_minhash import brute

    before = [(r["doc_id"], r["text"]) for r in rows(steps["toxicity"])]
    groups = brute(before, minhash.SHINGLE_WORDS)
    assert sorted(r["doc_id"] for r in rows(steps["near_duplicates"])) == sorted(d for d, c in groups.items() if d == c)


def test_decontamination(spark, steps):
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before = rows(steps["near_duplicates"])
    kept = {r["doc_id"] for r in rows(steps["decontamination"])}
    for r in before:
        body = decontaminate.normal(r["text"])
        if any(i in body for i in items):
            assert r["doc_id"] not in kept
    assert len(kept) >= len(before) - sum(any(decontaminate.myers(i, decontaminate.normal(r["text"]), decontaminate.budget(len(i))) for i in items) for r in before)


def test_mixing(steps):
    before = {r["doc_id"]: len((r["text"] or "").split()) for r in rows(steps["decontamination"])}
    copies = Counter(r["doc_id"] for r in rows(steps["mixing"]))
    assert set(copies) <= set(before) and max(copies.values()) <= 2
    assert abs(sum(before[d] * n for d, n in copies.items()) / sum(before.values()) - 1.5) < 0.1


def test_token_output(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for d, text in sorted((r["doc_id"], r["text"]) for r in rows(steps["mixing"])):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(steps["token_output"]))
    assert [(d, s, n) for d, s, n, _ in got] == [(d, s, n) for d, s, n, _ in want]
    assert Counter((d, c) for d, _, _, c in got) == Counter((d, c) for d, _, _, c in want)


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, DATA).count() == steps["token_output"].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names and empty tables."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (None, "some words here", "en", "a", 15, 1), (None, "some words here", "en", "a", 15, 1), (3, long, "en", "b", len(long), 1), (4, long + " end", "en", "b", 0, 1), (5, "twin text", "en", "a", 9, 1), (5, "twin text", "en", "a", 9, 1), (5, "another text", "en", "a", 9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    want = {
        "toxicity": Counter(r[0] for r in rows),
        "near_duplicates": Counter([1, 2, None, None, 3, 5, 5]),
        "decontamination": Counter(r[0] for r in rows),
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, DATA)
        found = got.collect()
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        if name != "token_output":
            assert got.columns == docs.columns, name
        if name in want:
            assert Counter(r.doc_id for r in found) == want[name], name
        elif name == "mixing":
            assert {(r.doc_id, r.text) for r in found} <= {r[:2] for r in rows} and 1 not in {r.doc_id for r in found}
        else:
            assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows) and min(r.n_tokens for r in found) == 1
