"""MinHash links, components and kept rows against brute force over all pairs."""

import random

import pytest

from cloudframe.llm import minhash
from cloudframe.operators import joins
from cloudframe.operators.graph import connected_components

DATA = "/root/testdata/sf0.01"


def brute(rows, k, percent=80):
    """{doc_id: (component, sizes)} by comparing all pairs."""
    sets = [(d, minhash.shingle_set((t or "").encode(), k)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for at, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(at)
    for at, (d, s) in enumerate(sets):
        counts = {}
        for g in s:
            for other in holders[g]:
                if other > at:
                    counts[other] = counts.get(other, 0) + 1
        for other, both in counts.items():
            e, t = sets[other]
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: root(d) for d, _ in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_whole_table(spark, k):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows, k)
    got = minhash.near_duplicates(docs, shingle_words=k).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert r.n_shingles == len(minhash.shingle_set((texts[r.doc_id] or "").encode(), k))
        assert r.component_id == want[r.doc_id]
        assert r.kept == (want[r.doc_id] == r.doc_id)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None, 0), (2, "", 0), (3, "  \t\n", 0),
        (4, "one", 0), (5, "ONE", 0), (6, "one two", 0),
        (7, long, 0), (8, long + " end", 0), (9, long.upper(), 0),
        (10, "twin text here", 0), (10, "twin text here", 0), (None, "one", 0), (None, None, 0),
        (11, "É a", 0), (12, "é a", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, shingle_words=2).collect()), key=str)
    assert got == sorted(
        [
            (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True),
            (7, 29_999, 7, True), (8, 30_000, 7, False), (9, 29_999, 7, False), (10, 2, 10, True), (10, 2, 10, True),
            (None, 1, None, True), (None, 0, None, True), (11, 1, 11, True), (12, 1, 12, True),
        ],
        key=str,
    )
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_bucket_with_several_groups(spark):
    """Members that do not resemble the one their bucket is led by are still joined with each other."""
    base = [f"a{i}" for i in range(100)]
    rows = []
    for i in range(40):  # a chain: neighbours are similar, the ends are not
        words = [f"b{i}_{j}" if j < 0 else w for j, w in enumerate(base)]
        for j in range(i):
            words[2 * j % 100] = f"c{j}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle_words=1).collect()}
    assert got == brute(rows, 1)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (7, 6), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_each_text_of_a_repeated_id_keeps_its_links(spark):
    texts = [[f"{k}{i}" for i in range(120)] for k in "pqr"]
    rows = [(5, " ".join(w)) for w in texts] + [(6 + k, " ".join([*w, "end"])) for k, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, shingle_words=2).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(d, 5) for d, _ in rows}


def test_templated_texts_and_a_hot_group(spark, monkeypatch):
    """Texts that share buckets with many others but are similar to few, and a group and a text that hold most rows."""
    monkeypatch.setattr(joins, "LEAST_HEAVY", 50)
    rng = random.Random(4)
    frame = [f"f{i}" for i in range(140)]
    rows = []
    for i in range(500):  # half of the words are shared by all: a percolating chain of buckets
        own = frame[:70] + [f"o{i // 2}_{j}" for j in range(50)]
        if i % 2:
            own[rng.randrange(70, 120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    for i in range(1500, 2200):  # near copies of one text, of which many are not similar to each other
        words = list(frame)
        for _ in range(rng.randrange(9, 14)):
            words[rng.randrange(140)] = f"y{i}_{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows += [(4000 + i, "the very same text") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle_words=1).collect()}
    assert got == brute(rows[:1200], 1) | {4000 + i: 4000 for i in range(1000)}


def test_repeated_ids_in_any_order(spark):
    texts = {g: [" ".join(f"{k}{g}_{i}" for i in range(60)) for k in "ab"] for g in range(8)}
    rows = [(10 * g, t) for g, pair in texts.items() for t in pair] + [(10 * g + 5, pair[1] + " end") for g, pair in texts.items()]
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[1][::-1])):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle_words=2).collect()}
        assert got == {d: 10 * (d // 10) for d, _ in rows}


def test_names_that_clash(spark):
    body = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(2, body, 1, 2), (1, body, 3, 4), (1, body, 3, 4), (None, "alone", 5, 6)], "doc_id long, text string, __other int, __gone int")
    kept = sorted((r.doc_id or 0, r["__other"], r["__gone"]) for r in minhash.one_of_each(docs).collect())
    assert kept == [(0, 5, 6), (1, 3, 4)]
