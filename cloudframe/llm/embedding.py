"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, table distances, exact rerank.

1. Equal vectors of one label are one class, led by the smallest id; everything below
   works on class leaders scaled to length 1.
2. On a bounded sample a coarse codebook (inverted lists) and one codebook for each
   subspace of the residuals are fitted by k-means. There is a list for each
   ``ROWS_PER_LIST`` vectors; beyond ``TOP_LISTS`` the lists are cut into leaves, fitted in
   parallel on a bounded sample of each.
3. Every vector is a query in the list of its nearest centre. Its residual is coded there
   and in all lists whose border is so near that a query within the threshold may lie
   beyond it ("sufficient probes": ``reach`` standard deviations of where a partner lies
   across a border, if partners lie in all directions alike; the whole threshold distance
   with ``reach=None``, which cannot miss a link). The code's error is kept with it.
4. Lists are cut into blocks of queries and of codes. Distances from a query's residual to
   codes are sums of looked-up squares. No code whose looked-up distance less its error is
   within the threshold is left out: the two ends of such pairs are noted for a cell of
   the block, so that a cell of 256 by 256 pairs gives 512 notes at most; n near copies of
   one another that are not equal still give notes by the square of n, a 128th of it.
5. Only noted vectors are read again, cell by cell, for the cosine in double precision. A
   task returns each vector's number of linked copies and no more links than join what
   belongs together, so a group of n near copies never becomes n^2 rows.

Defined results: vectors that are null, zero or hold null or non-finite parts, and those
without a label, link with nothing; vectors link only with those of the same length (the
lengths up to each power of two share an index, filled up with zeros); labels of any
type are compared as text; rows with repeated ids are one node of the graph and their
links add up; rows without an id link with nothing and are kept; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.common import broadcast_if_small, drop_table, write_table
from cloudframe.operators.graph import connected_components
from cloudframe.operators.joins import join_one

LEAST_COSINE = 0.98
SAMPLE, ROWS_PER_LIST = 32_768, 1_000
#: Lists of the first level; leaves of each of them, at most; numbers in all centres, at most; vectors a list's leaves are fitted on.
TOP_LISTS, MOST_LEAVES, MOST_NUMBERS, LEAF_SAMPLE = 1_024, 256, 1 << 24, 4_096
SUBSPACES, CODES = 8, 256
REACH = 4.5
#: Queries and codes in a block of a list, and vectors on a side of a cell.
QUERIES, CODED, CELL = 1_024, 65_536, 256
_ENTRY = "cell string, list int, node long, vector binary, code binary, error float"


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=k)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[at : at + 4096], centres).argmin(1) for at in range(0, len(x), 4096)])


def _probes(x: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centre, and which centres' cells begin within the margin."""
    square = _squares(x, centres)
    own = square.argmin(1)
    between = np.sqrt(_squares(centres, centres))[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        border = (square - square[np.arange(len(x)), own][:, None]) / (2 * between)
    border[np.isnan(border)] = 0  # equal centres
    border[np.arange(len(x)), own] = 0
    return own, border <= margin


@dataclass
class Quantiser:
    tops: np.ndarray
    leaves: list[np.ndarray]  #: the centres within each of the first level's cells
    margin: float  #: how far beyond a border a vector is coded
    books: list[np.ndarray]  #: of each subspace of the residuals
    cuts: list[int]

    @classmethod
    def coarse(cls, sample: np.ndarray, lists: int, margin: float, seed: int = 3) -> Quantiser:
        tops = _kmeans(sample, lists, np.random.default_rng(seed))
        return cls(tops, [t[None, :] for t in tops], margin, [], [])

    def fit_books(self, sample: np.ndarray, seed: int = 3) -> None:
        rng, d = np.random.default_rng(seed), sample.shape[1]
        row, number, own = self.lists_of(sample)
        residual = sample - self.centres[number[own]]
        self.cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int).tolist()
        self.books = [_kmeans(residual[:, a:b], CODES, rng, 8) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    @property
    def centres(self) -> np.ndarray:
        return self.tops if len(self.leaves) == sum(map(len, self.leaves)) else np.concatenate(self.leaves)

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, own) for the lists each vector is coded in, in order of rows."""
        top, near = _probes(x, self.tops, self.margin)
        if len(self.leaves) == sum(map(len, self.leaves)):
            row, number = np.nonzero(near)
            return row, number, number == top[row]
        start = np.concatenate([[0], np.cumsum([len(leaf) for leaf in self.leaves])])
        found = []
        for t in np.flatnonzero(near.any(0)):
            here = np.flatnonzero(near[:, t])
            own, within = _probes(x[here], self.leaves[t], self.margin)
            i, leaf = np.nonzero(within)
            found.append((here[i], start[t] + leaf, (top[here[i]] == t) & (own[i] == leaf)))
        row, number, own = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        return row[order], number[order], own[order]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes and how far each is from what it stands for."""
        codes = np.empty((len(residual), len(self.books)), np.uint8)
        error = np.zeros(len(residual))
        for s, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            square = _squares(residual[:, a:b], book)
            codes[:, s] = square.argmin(1)
            error += square.min(1)
        return codes, np.sqrt(error)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """For each subspace: the squared distances of residuals to all codes."""
        return [_squares(residual[:, a:b], book) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)]


def _proper(rows: DataFrame) -> DataFrame:
    """(id, label, vector) of the rows that may link."""
    plain = F.transform("vector", lambda v: v.cast("double"))
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    some = F.exists("vector", lambda v: v != 0)
    fit = rows.where("id is not null and label is not null and vector is not null").where((F.size("vector") > 0) & finite & some)
    return fit.select("id", "label", plain.alias("vector"))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows filled up with zeros to the width."""
    out = np.zeros((len(vectors), width))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(width)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1)[:, None]  # so that squares neither overflow nor vanish
    return raw / np.linalg.norm(raw, axis=1)[:, None]


def near_duplicates(rows: DataFrame, *, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", least: float = LEAST_COSINE, reach: float | None = REACH, rows_per_list: int = ROWS_PER_LIST, top_lists: int = TOP_LISTS) -> DataFrame:
    """One row per row: vec_id, n_links, component_id and kept."""
    slim = rows.select(rows[vec_id].cast("long").alias("id"), rows[label].alias("label"), rows[vector].alias("vector"))
    if slim.schema["label"].dataType.typeName() in ("float", "double"):
        slim = slim.withColumn("label", F.col("label") + 0.0)  # one zero
    slim = slim.withColumn("label", F.col("label").cast("string"))
    key = F.sha2(F.concat_ws(",", F.transform("vector", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v).cast("string"))), 256)
    hashed = _proper(slim).withColumn("label", F.concat_ws(":", F.size("vector").cast("string"), "label")).withColumn("node", F.xxhash64("label", key))
    classes = hashed.groupBy("label", "node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    classes = write_table(classes.withColumn("width", F.ceil(F.log2(F.size("vector"))).cast("int")), "embedding-classes")

    members = hashed.select("id", "node")
    own = write_table(join_one(members, classes.select("node", F.col("id").alias("lead"), "n"), "node", slim.count()), "embedding-members")
    edges = own.select(F.col("id").alias("u"), F.col("lead").alias("v"))
    linked = None
    for width, total in classes.groupBy("width").count().orderBy("width").collect():  # one for each power of two
        found = _linked(classes.where(F.col("width") == width).drop("width"), 1 << width, total, least, reach, rows_per_list, top_lists)
        linked = found if linked is None else linked.union(found)
    if linked is None:
        counted = own.select("id", (F.col("n") - 1).alias("n_links"))
    else:
        edges = edges.union(linked.where("v is not null").select("u", "v"))
        counts = linked.where("v is null").groupBy("node").agg(F.sum("n").alias("linked"))
        counts = write_table(counts, "embedding-counts")
        counted = own.join(broadcast_if_small(counts, counts.count()), "node", "left").select("id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    parts = connected_components(edges).select(F.col("node").alias("id"), "component")
    all_links = counted.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    out = slim.select("id").join(all_links, "id", "left").join(parts, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _fit(classes: DataFrame, d: int, total: int, radius: float, reach: float | None, rows_per_list: int, top_lists: int) -> Quantiser:
    """Coarse lists, their leaves where the table is large, and codebooks, on bounded samples of the smallest hashes."""

    def units(frame) -> np.ndarray:
        out = np.zeros((len(frame), d))
        for i, v in enumerate(frame):
            out[i, : len(v)] = v
        return _unit(out) if len(out) else out

    x = units(classes.select("vector").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toPandas()["vector"])
    lists = max(1, total // rows_per_list)
    # a partner lies radius away in some direction; across a border that is radius / sqrt(d) in the mean
    q = Quantiser.coarse(x, min(lists, top_lists), radius if reach is None else min(radius, reach * radius / np.sqrt(d)))
    leaves = min(-(-lists // top_lists), MOST_LEAVES, max(1, MOST_NUMBERS // (d * top_lists)))
    if leaves > 1:
        tops = classes.sparkSession.sparkContext.broadcast(q.tops)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = _nearest(_unit(_matrix(b.column(1), d)), tops.value) if b.num_rows else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), b.column(1)], names=["node", "top", "vector"])

        part = min(1.0, 4.0 * LEAF_SAMPLE * len(q.tops) / total)
        some = classes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(part * (1 << 30))).select("node", "vector")
        placed = write_table(some.mapInArrow(place, "node long, top int, vector array<double>"), "embedding-sample")
        share = placed.groupBy("top").agg((LEAF_SAMPLE / F.count(F.lit(1))).alias("share"))
        chosen = placed.join(F.broadcast(share), "top").where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) < F.col("share") * (1 << 30))

        def cut(frame):
            centres = _kmeans(units(frame["vector"]), leaves, np.random.default_rng(5))
            return frame.iloc[:1][["top"]].assign(centres=[centres.ravel().tolist()])

        for top, centres in chosen.select("top", "vector").groupBy("top").applyInPandas(cut, "top int, centres array<double>").collect():
            q.leaves[top] = np.array(centres).reshape(-1, d)
        drop_table(placed)
    q.fit_books(x)
    return q


def _linked(classes: DataFrame, d: int, total: int, least: float, reach: float | None, rows_per_list: int, top_lists: int) -> DataFrame:
    """Of vectors of up to d parts: (node, n) counts to be summed, and links (u, v) that join the linked."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    sent = classes.sparkSession.sparkContext.broadcast(_fit(classes, d, total, radius, reach, rows_per_list, top_lists))  # bounded by the constants above

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        centres = q.centres
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                unit = _unit(_matrix(b.column(2), d))
                row, number, own = q.lists_of(unit)
                codes, error = q.encode(unit[row] - centres[number])
                slim = unit.astype(np.float32)
                labels = b.column(0).to_pylist()
                cols = [pa.array([f"{n}:{labels[r]}" for r, n in zip(row, number, strict=True)], pa.string()), pa.array(number, pa.int32()), b.column(1).take(pa.array(row))]
                cols += [pa.array([slim[r].tobytes() if o else None for r, o in zip(row, own, strict=True)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float32())]
                yield pa.RecordBatch.from_arrays(cols, names=["cell", "list", "node", "vector", "code", "error"])

    entries = write_table(classes.select("label", "node", "vector").mapInArrow(enter, _ENTRY), "embedding-lists")
    queries, coded = F.count("vector"), F.count(F.lit(1))
    sizes = entries.groupBy("cell").agg(coded.alias("n"), F.ceil(queries / QUERIES).cast("int").alias("q_blocks"), F.ceil(coded / CODED).cast("int").alias("c_blocks")).where("q_blocks > 0 and n > 1")
    sizes = write_table(sizes, "embedding-sizes")
    placed = join_one(entries, sizes.drop("n"), "cell", entries.count(), sizes).withColumns({"i": F.pmod(F.xxhash64("node"), F.col("q_blocks")).cast("int"), "j": F.pmod(F.xxhash64("node"), F.col("c_blocks")).cast("int")})

    def every(count: str) -> DataFrame:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    nothing = F.lit(None).cast("binary")
    asked = placed.where("vector is not null").withColumn("j", every("c_blocks")).select("cell", "list", "i", "j", F.lit(0).alias("role"), "node", "vector", nothing.alias("code"), "error")
    answers = placed.withColumn("i", every("q_blocks")).select("cell", "list", "i", "j", F.lit(1).alias("role"), "node", nothing.alias("vector"), "code", "error")
    ordered = asked.union(answers).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "role")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors with a possible partner, by cells."""
        q = sent.value
        centres = q.centres
        key, number, nodes, vectors, tables, right, chunk = None, 0, [], [], None, [], 0

        def close() -> pa.RecordBatch:
            nonlocal tables, right, chunk
            out: list[tuple] = []
            if nodes and right:
                if tables is None:
                    unit = np.frombuffer(b"".join(vectors), np.float32).reshape(len(vectors), d).astype(float)
                    tables = [t.astype(np.float32) for t in q.tables(unit - centres[number])]
                codes = np.frombuffer(b"".join(r[1] for r in right), np.uint8).reshape(len(right), -1)
                square = np.zeros((len(nodes), len(right)), np.float32)
                for s, t in enumerate(tables):
                    square += t[:, codes[:, s]]
                theirs = np.array([r[0] for r in right])
                within = (radius + np.array([r[2] for r in right], np.float32) + 1e-3) ** 2
                x, y = np.nonzero((square <= within[None, :]) & (np.array(nodes)[:, None] < theirs[None, :]))
                for a, b in set(zip((x // CELL).tolist(), (y // CELL).tolist(), strict=True)):
                    here = (x // CELL == a) & (y // CELL == b)
                    cell = (key[0], key[1] << 20 | a, key[2] << 20 | chunk << 3 | b)
                    out += [(*cell, 0, nodes[i]) for i in np.unique(x[here]).tolist()]
                    out += [(*cell, 1, right[j][0]) for j in np.unique(y[here]).tolist()]
            right, chunk = [], chunk + 1
            columns = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["cell", "i", "j", "role", "node"])

        for batch in batches:
            for cell, list_, i, j, role, node, vector, code, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, i, j) != key:
                    if right:
                        yield close()
                    key, number, nodes, vectors, tables, right, chunk = (cell, i, j), list_, [], [], None, [], 0
                if role == 0:
                    nodes.append(node), vectors.append(vector)
                    continue
                right.append((node, code, error))
                if len(right) == 4 * CELL:
                    yield close()
        if right:
            yield close()

    noted = write_table(ordered.mapInArrow(meet, "cell string, i long, j long, role long, node long"), "embedding-noted")
    for done in (entries, sizes):
        drop_table(done)
    read = classes.select("node", "id", "n", "label", "vector").join(broadcast_if_small(noted, noted.count(), 1_000_000), "node")
    ordered = read.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").select("cell", "i", "j", "role", "node", "id", "n", "label", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            vectors = _matrix(batch.column(8), d)
            for k, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[:8]), strict=True)):
                if row[:3] != key:
                    if held:
                        yield _links_in(held, least)
                    key, held = row[:3], []
                held.append((*row[3:], vectors[k].copy()))
        if held:
            yield _links_in(held, least)

    found = write_table(ordered.mapInArrow(compare, "node long, n long, u long, v long"), "embedding-links")
    drop_table(noted)
    return found


def _links_in(held: list[tuple], least: float) -> pa.RecordBatch:
    """Of the vectors of a cell, (role, node, id, n, label, vector): counts of linked copies by node, and links that join the linked."""
    sides = [[h[1:] for h in held if h[0] == r] for r in (0, 1)]
    counts: dict[int, int] = {}
    links, leader = [], {}

    def root(x):
        while leader.setdefault(x, x) != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    if all(sides):
        av, bv = (np.array([h[4] for h in side]) for side in sides)
        av, bv = (v / np.abs(v).max(axis=1)[:, None] for v in (av, bv))
        cosine = av @ bv.T / (np.linalg.norm(av, axis=1)[:, None] * np.linalg.norm(bv, axis=1)[None, :])
        first = np.array([h[0] for h in sides[0]])[:, None] < np.array([h[0] for h in sides[1]])[None, :]
        for x, y in zip(*(k.tolist() for k in np.nonzero((cosine >= least) & first)), strict=True):
            (p, pid, pn, pl, _), (r, rid, rn, rl, _) = sides[0][x], sides[1][y]
            if pl != rl:
                continue
            counts[p] = counts.get(p, 0) + rn
            counts[r] = counts.get(r, 0) + pn
            u, v = root(pid), root(rid)
            if u != v:
                leader[max(u, v)] = min(u, v)
                links.append((pid, rid))
    k, m = len(counts), len(links)
    cols = [[*counts, *[None] * m], [*counts.values(), *[None] * m], [*[None] * k, *(u for u, _ in links)], [*[None] * k, *(v for _, v in links)]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "n", "u", "v"])


def embedding_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def oracle_sql() -> str:
    """The same by all pairs of a label in DuckDB."""
    return f"""WITH RECURSIVE all_rows AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    proper AS (SELECT * FROM all_rows WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    linked AS (SELECT a.vec_id AS u, b.vec_id AS v FROM proper a JOIN proper b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}),
    reach AS (SELECT u, v FROM linked UNION SELECT reach.u, linked.v FROM reach JOIN linked ON reach.v = linked.u),
    counts AS (SELECT u, count(*) AS n FROM linked GROUP BY 1), parts AS (SELECT u, min(v) AS least FROM reach GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(p.least, vec_id)) AS component_id, vec_id <= coalesce(p.least, vec_id) AS kept
    FROM all_rows LEFT JOIN counts c ON c.u = vec_id LEFT JOIN parts p ON p.u = vec_id"""
