"""Counts and token files against the tokenizers library, and the wavelet matrix against the array it packs."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cloudframe.llm import token_count as C
from cloudframe.llm import token_output as O
from cloudframe.llm.wavelet import WaveletMatrix, pack

DATA = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n", "a", " a", "a  b", "it's we'll I'M", "x\n y\n\nz", "tab\tand\r\nmore ", "<|endoftext|> in <|endoftext|><|endoftext|>", "日本語 テキスト 123,456.78", "é à ü ß",
    "🙂🙃 emoji", "a, b. c.", ".,", "A.B,C", "a b c᠎d", "x" * 3000, "ab " * 20_000, "12345678901234567890", "\x01\x02\x03", "word\x01word", "tion the thing. The end",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD)] + [(None, "a b", 0), (3, "again", 0)], "doc_id long, text string, n_tokens int")


def test_counts(spark, library, odd):
    rows = C.count_tokens(odd, path=PATH, pattern=public_tokenizers.PATTERN, keep=("doc_id", "text")).collect()
    assert len(rows) == len(ODD) + 2
    for r, ids in zip(rows, library([r.text for r in rows]), strict=True):
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), len(ids), len(ids) > 1024)
    assert C.count_tokens(odd.limit(0), path=PATH, pattern=public_tokenizers.PATTERN).count() == 0


def test_counts_of_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = dict(zip(texts, map(len, library(texts.values())), strict=True))
    assert {r.doc_id: r.n_tokens for r in C.token_count_query(spark, DATA).collect()} == want


def expected(rows, library):
    out, start = [], 0
    for (d, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        raw = np.array([*ids, 0], "<u4")
        out.append((d, start, len(raw), zlib.crc32(raw.tobytes())))
        start += len(raw)
    return out


def test_files_of_whole_table(spark, library):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in O.token_output_query(spark, DATA).collect())
    assert got == expected(rows, library)


def test_files_of_odd_texts(spark, library, odd):
    rows = [(i, t) for i, t in enumerate(ODD)]
    plain = odd.where("doc_id is not null and text is distinct from 'again'")
    shards = O.build_shards(plain, path=PATH, shard_tokens=500)
    assert shards.count() > 1
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in O.read_documents(shards).collect()) == expected(rows, library)
    everything = O.token_output(odd, PATH)
    assert everything.count() == len(ODD) + 2
    assert everything.agg({"n_tokens": "sum"}).first()[0] == sum(len(x) + 1 for x in library([*ODD, "a b", "again"]))
    assert O.token_output(odd.limit(0), PATH).count() == 0
    (one,) = library(["the"])
    places = O.token_places(shards, one[0]).collect()
    ids = {(r.part, r.seq): WaveletMatrix(r.file).unpack() for r in shards.collect()}
    assert sorted((p.part, p.seq, p.place) for p in places) == sorted((*k, i) for k, a in ids.items() for i in np.flatnonzero(a == one[0]).tolist())


@pytest.mark.parametrize(("most", "kept"), [(50, 3), (4_000, 500)])
def test_full_cache(spark, library, monkeypatch, most, kept):
    """Ids stay the library's after chunks were forgotten, all of them or those that did not come up again."""
    monkeypatch.setattr(O, "CACHE", most)
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    encoder, sizes = O.Encoder(PATH), []
    trim = encoder.trim
    monkeypatch.setattr(encoder, "trim", lambda: (trim(), sizes.append(len(encoder.known))))
    for at in range(0, len(texts), 6):
        ids, counts = encoder.encode(pa.array(texts[at : at + 6]))
        want = [[*x, 0] for x in library(texts[at : at + 6])]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
        assert len(encoder.known) == len(encoder.starts) == len(encoder.lens) == len(encoder.again)
    assert len(sizes) > 1 and (max(sizes) == 3 if kept == 3 else max(sizes) >= kept)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).zipf(1.4, n).clip(0, 50_256).astype(np.uint16)
    m = WaveletMatrix(pack(ids, 16))
    assert len(m) == n and (m.unpack() == ids).all()
    for i in range(0, n, 97):
        assert m.access(i) == ids[i]
    for token in {1, 2, 50_256, *ids[:5].tolist()}:
        where = np.flatnonzero(ids == token)
        assert m.count(token) == len(where) and m.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
        assert [m.select(token, k) for k in range(min(20, len(where)))] == where[:20].tolist()
    with pytest.raises(IndexError):
        m.access(n)


def test_other_stages_let_go_of_the_encoder():
    import public_tokenizers

    from cloudframe.llm import token_output
    from cloudframe.llm.common import let_go

    token_output.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    let_go(keep="encoder")
    assert token_output.encoder.cache_info().currsize == 1
    let_go()
    assert token_output.encoder.cache_info().currsize == 0
