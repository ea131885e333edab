"""Links of the quantised index against all pairs."""

import numpy as np

from cloudframe.llm import embedding as E

DATA = "/root/testdata/sf0.1"


def brute(rows, least=E.LEAST_COSINE):
    links, parent = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for label in {r[2] for r in rows}:
        some = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in some], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            a, b = some[i][0], some[j][0]
            links[a] += 1
            links[b] += 1
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (n, root(i)) for i, n in links.items()}


def result(frame):
    return {r.vec_id: (r.n_links, r.component_id) for r in frame.collect()}


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert result(E.embedding_query(spark, DATA)) == brute(rows)


def test_near_copies_across_lists(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(3000):
        v = base[i % 60] + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.2])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(2))))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want, got = brute(rows), result(E.near_duplicates(docs))
    assert sum(n for n, _ in got.values()) >= 0.999 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_edge_cases(spark):
    a, b = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    rows = [
        (1, a, 0, "x"), (2, a, 0, "x"), (3, b, 0, "x"), (4, a, 1, "x"), (5, a, None, "x"), (6, None, 0, "x"), (7, [0.0, 0.0, 0.0], 0, "x"),
        (8, [1.0, None, 3.0], 0, "x"), (9, [1.0, float("nan"), 3.0], 0, "x"), (10, [1.0, float("inf"), 3.0], 0, "x"), (11, [], 0, "x"), (12, [1.0, 2.0], 0, "x"), (13, [1.0, 2.0], 0, "x"), (None, a, 0, "x"),
    ]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component_id string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(docs).collect()}
    alone = {i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)}
    assert got == alone | {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 12: (1, 12, True), 13: (1, 12, False), None: (0, None, True)}
    assert E.near_duplicates(docs.limit(0)).count() == 0
    assert [tuple(r) for r in E.near_duplicates(docs.where("vec_id = 7")).collect()] == [(7, 0, 7, True)]


def near_copies(n, d, rng, groups=60, spread=(0.05, 0.12, 0.2)):
    base = rng.normal(size=(groups, d))
    return [(i, (base[i % groups] + rng.normal(size=d) * rng.choice(spread)).tolist(), int(rng.integers(2))) for i in range(n)]


def test_two_levels_and_blocks(spark, monkeypatch):
    """Leaves within lists, and lists of several blocks and cells."""
    for name, value in {"QUERIES": 40, "CODED": 300, "CELL": 16}.items():
        monkeypatch.setattr(E, name, value)
    rows = near_copies(2500, 16, np.random.default_rng(2))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(E.near_duplicates(docs, reach=None, rows_per_list=50, top_lists=8)) == brute(rows)
    got, want = result(E.near_duplicates(docs, rows_per_list=50, top_lists=8)), brute(rows)
    assert sum(n for n, _ in got.values()) >= 0.999 * sum(n for n, _ in want.values())


def test_partners_in_few_directions(spark):
    """Copies that differ in one direction only, which is not what the probes' reach assumes."""
    rng = np.random.default_rng(5)
    base, rows = rng.normal(size=(300, 32)), []
    for i in range(3000):
        v = base[i % 300].copy()
        v[i % 3] += rng.normal() * 0.9
        rows.append((i, v.tolist(), 0))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    got = result(E.near_duplicates(docs, rows_per_list=100))
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert result(E.near_duplicates(docs, reach=None, rows_per_list=100)) == want


def test_labels_of_other_types(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [2.0, 4.0], "a"), (3, [1.0, 2.0], "b"), (4, [1e300, 2e300], "a"), (5, [1e-300, 2e-300], "b")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert result(E.near_duplicates(docs)) == {1: (2, 1), 2: (2, 1), 4: (2, 1), 3: (1, 3), 5: (1, 3)}
