"""Targets against water filling by hand, and the copies of systematic sampling."""

import re
from collections import defaultdict

import pytest

from cloudframe.llm import mixing as M

DATA = "/root/testdata/sf0.01"


def targets(sizes):
    """Source sizes by name -> targets, the excess over the cap reshared by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, todo, out = 1.5 * sum(sizes.values()), set(names), {}
    while todo:
        total = sum(weight[s] for s in todo)
        over = {s for s in todo if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in todo}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        todo -= over
    return out


def check(rows, texts):
    sizes = defaultdict(int)
    for d, s, t in texts:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(want[r.source])
        assert 0 <= r.mix_copies <= 2
        taken[r.source] += r.mix_copies * r.mix_size
        largest[r.source] = max(largest[r.source], r.mix_size)
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(0.02 * want[s], 2 * largest[s])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    rows = M.mix(docs).collect()
    check(rows, [(r.doc_id, r.source, r.text) for r in docs.collect()])
    again = {r.doc_id: r.mix_copies for r in M.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.mix_copies for r in rows}
    assert M.mixed_documents(docs).count() == sum(again.values())


def test_edge_cases(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 3}", 0) for i in range(400)] + [(None, "a b c", None, 0), (5, "a b c", None, 0), (5, "a b c", None, 0), (900, None, "empty", 0), (901, "", "empty", 0), (902, "x " * 60_000, "long", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    check(got, [(d, s, t) for d, t, s, _ in rows])
    assert {r.mix_copies for r in got if r.source == "empty"} == {0}
    assert M.mix(docs.limit(0)).count() == 0


def test_copies_are_those_of_a_plain_systematic_sampler(spark):
    """Prefix sums over the documents of a source in order, an offset, a copy for each integer crossed."""
    import math

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    assert docs.count() // M.TARGET_BLOCKS < M.LEAST_ROWS  # blocks of LEAST_ROWS rows
    rows = M.mix(docs).collect()
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id, coalesce(text, '')) as h").collect()}
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    keys = spark.createDataFrame([(f"s{s}" if s is not None else "n",) for s in by_source], "k string")
    offsets = {r.k: r.o for r in keys.selectExpr("k", f"pmod(xxhash64(42, k), {M.OFFSET_STEPS}) / {float(M.OFFSET_STEPS)}D as o").collect()}
    for s, some in by_source.items():
        classes = defaultdict(list)
        for r in some:
            classes[math.floor(4 * math.log2(1 + r.mix_size))].append(r)
        order = []
        for c in sorted(classes):
            blocks = -(-len(classes[c]) // M.LEAST_ROWS)
            order += sorted(classes[c], key=lambda r: (hashes[r.doc_id] % blocks, r.mix_size, r.doc_id))
        at, expected = offsets[f"s{s}" if s is not None else "n"], some[0].mix_target / some[0].mix_source_size
        for place, r in enumerate(order, 1):
            assert r.mix_copies == math.floor(at + expected * place) - math.floor(at + expected * (place - 1)), r


def test_clashing_names(spark):
    names = ["mix_copies", "__size", "__key", "__hash", "__class", "__id", "c0", "key", "class"]
    docs = spark.createDataFrame([(i, "a b c", "s", *range(len(names))) for i in range(50)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = M.mix(docs)
    assert got.columns == [c for c in docs.columns if c != "mix_copies"] + list(M.MARKS)
    assert all(r["__size"] == 1 and r["class"] == 8 and r.mix_size == 3 for r in got.collect())
    assert all(r["mix_copies"] == 0 and r["c0"] == 6 for r in M.mixed_documents(docs).collect())
