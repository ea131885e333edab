"""Near-duplicate documents by MinHash: many universal hash minima, banding, signature checks, confirmed links, components.

1. Each text gets the minima of ``BANDS * ROWS`` universal hashes over its distinct word
   shingles. ``ROWS`` minima make a band key; one bit of each minimum is kept as a
   compact signature. Texts with the same words are one class, led by its smallest id.
2. Leaders that share a band key are candidates. In each bucket every member is paired
   with one member (the text whose hash is smallest, the same in all buckets that hold
   it), so a bucket of n gives n - 1 pairs, never all of them. Texts stand for themselves
   up to the signature check, so each text of an id that has several is judged by its own.
3. Pairs whose signatures differ too much are dropped; the others are confirmed on their
   full shingle sets. Confirmed pairs and copies are joined into components.
4. In buckets whose members are still in several components, the members outside the
   bucket's largest component meet all its members, block by block: first as slim rows
   of signatures and band keys, each pair in the first bucket it shares only, then, where
   a signature lets hope, as texts. A task gets the texts of two blocks, counts common
   shingles as a product of 0/1 matrices and returns no more links than it takes to join
   what belongs together. After that no pair that shares a bucket can change a component.

Buckets, pivots and copied texts that hold a large share of all rows are joined without
shuffling their rows (``join_one``).

A pair at the threshold shares no bucket with probability (1 - 0.8^5)^32 = 3e-6.

Defined results: null texts and texts without words have no shingles and no links; texts
with fewer words than a shingle are one shingle as a whole; rows that repeat an id are
one node of the graph; a row without an id is in no component and is kept; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudframe.llm.common import broadcast_if_small, drop_table, fresh, let_go, small_batches, write_table
from cloudframe.operators.graph import connected_components
from cloudframe.operators.joins import join_one

BANDS, ROWS = 32, 5
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
#: A confirming task compares about so many members with one text it has read once, or the square root of all its members.
MEMBERS_PER_READ = 64
#: Signature bits that may differ beyond what the threshold lets expect, in standard deviations.
DEVIATIONS = 5.5
#: Texts, and slim rows, in a block of a bucket.
BLOCK, SLIM_BLOCK = 128, 256
#: Low bytes of minima that agree by which slim rows are judged: deviations below what the threshold lets expect.
SKETCH_DEVIATIONS = 4.5
WORD_CACHE = 400_000
SEED = 20_240_601
_SIGNED = "doc_id long, n_shingles long, text_key binary, bands array<long>, bits array<long>, sketch binary"


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def shingle_set(text: bytes, k: int) -> set:
    w = words_of(text)
    if len(w) <= k:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(k)), strict=False))


@lru_cache(maxsize=4)
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_words: dict[bytes, int] = {}


def _hashed_words(words: list[bytes]) -> np.ndarray:
    if len(_words) > WORD_CACHE:
        _words.clear()
    for w in set(words):
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _shingles(words: list[bytes], k: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles."""
    h = _hashed_words(words)
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = _mix(out + h[i : i + n])
    return np.unique(out)


def _signature(shingles: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Band keys, a bit of each minimum, and a byte of each."""
    a, b = _coefficients(bands * rows)
    least, room = None, np.empty((bands * rows, min(len(shingles), 512)), np.uint64)
    for at in range(0, len(shingles), 512):
        some = shingles[None, at : at + 512]
        hashed = np.multiply(some, a, out=room[:, : some.shape[1]])
        one = np.add(hashed, b, out=hashed).min(axis=1)
        least = one if least is None else np.minimum(least, one)
    keys = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        keys = _mix(keys + least.reshape(bands, rows)[:, r])
    bits = np.zeros(-(-bands * rows // 64) * 64, bool)
    bits[: bands * rows] = (least >> np.uint64(32)) & np.uint64(1)
    return keys.view(np.int64), np.packbits(bits, bitorder="little").view(np.int64), (least >> np.uint64(40)).astype(np.uint8).tobytes()


def sign(docs: DataFrame, text: str, doc_id: str, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    slim = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sizes, texts, band_keys, bits, sketches = [], [], [], [], []
                for body in piece.column(1):
                    words = words_of(body.as_py() or b"")
                    if not words:
                        sizes.append(0), texts.append(None), band_keys.append([]), bits.append([]), sketches.append(None)
                        continue
                    own = _shingles(words, k)
                    keys, packed, sketch = _signature(own, bands, rows)
                    sizes.append(len(own)), texts.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    band_keys.append(keys), bits.append(packed), sketches.append(sketch)
                cols = [piece.column(0), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary()), pa.array(band_keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "text_key", "bands", "bits", "sketch"])
        let_go(_words)

    return small_batches(slim).mapInArrow(run, _SIGNED)


def _bits_differing(a: Column, b: Column, n: int) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(n)), F.lit(0))


def _confirmed(docs: DataFrame, pairs: DataFrame, text: str, doc_id: str, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar. v's text is read once for each block of u's."""
    # as many blocks of one v as members in each, so that v's own text is not read too often either
    n = F.count(F.lit(1))
    size = write_table(pairs.groupBy("v").agg(n.alias("n"), F.ceil(n / F.greatest(F.lit(MEMBERS_PER_READ), F.sqrt(n))).cast("int").alias("blocks")), "minhash-leads")
    placed = join_one(pairs, size.select("v", "blocks"), "v", pairs.count(), size).withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    members = placed.select(F.col("u").alias("id"), F.col("v").alias("lead"), "block", F.lit(1).alias("role"))
    leads = placed.select(F.col("v").alias("id"), F.col("v").alias("lead"), "block", F.lit(0).alias("role")).distinct()
    needed = write_table(members.union(leads), "minhash-pairs")
    drop_table(size)
    rows = needed.count()
    texts = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("binary").alias("text")).join(broadcast_if_small(needed, rows, 1_000_000), "id")
    ordered = texts.repartition("lead", "block").sortWithinPartitions("lead", "block", "role").select("lead", "id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            us, vs = [], []
            for lead, doc, role, body in zip(*batch.columns, strict=True):
                lead, doc, role = lead.as_py(), doc.as_py(), role.as_py()
                shingles = shingle_set(body.as_py() or b"", k)
                if role == 0:
                    if lead != now:
                        now, own = lead, []
                    own.append(shingles)
                    continue
                for other in own if lead == now else ():
                    both = len(shingles & other)
                    if both and 100 * both >= percent * (len(shingles) + len(other) - both):
                        us.append(doc), vs.append(lead)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        let_go()

    return write_table(ordered.mapInArrow(run, "u long, v long"), "minhash-links")


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept."""
    n = bands * rows
    words = -(-n // 64)
    apart = (1 - percent / 100) / 2
    most_apart = int(n * apart + DEVIATIONS * (n * apart * (1 - apart)) ** 0.5)
    signed = write_table(sign(docs, text, doc_id, shingle_words, bands, rows), "minhash-signed")

    named = signed.where("doc_id is not null and text_key is not null").select("doc_id", "text_key", "bands", "bits", "sketch")
    # texts with the same words have the same signature; those that share t only give more candidates
    held = [F.first(c).alias(c) for c in ("bands", "bits", "sketch")]
    leaders = named.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), *held).withColumn("t", F.xxhash64("text_key"))
    leaders = write_table(leaders, "minhash-leaders")
    classes = leaders.select("text_key", F.col("doc_id").alias("lead"))
    copies = join_one(named.select("doc_id", "text_key"), classes, "text_key", signed.count(), leaders).where("doc_id <> lead").select(F.col("doc_id").alias("u"), F.col("lead").alias("v"))

    in_bands = leaders.select("t", F.explode("bands").alias("band"))
    buckets = write_table(in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first")).where("n > 1"), "minhash-bands")
    members = write_table(join_one(in_bands, buckets.select("band", "first"), "band", bands * leaders.count(), buckets), "minhash-buckets")
    drop_table(buckets)

    pairs = write_table(members.where("t <> first").select(F.col("t").alias("tu"), F.col("first").alias("tv")).distinct(), "minhash-candidates")
    ends = [leaders.select(F.col("t").alias(f"t{x}"), F.col("doc_id").alias(x), F.col("bits").alias(f"b{x}")) for x in "uv"]
    near = join_one(pairs.join(ends[0], "tu"), ends[1], "tv", pairs.count(), pairs.groupBy("tv").agg(F.count(F.lit(1)).alias("n")))
    near = near.where((F.col("u") != F.col("v")) & (_bits_differing(F.col("bu"), F.col("bv"), words) <= most_apart)).select("u", "v")
    near = write_table(near, "minhash-near")
    links = _confirmed(docs, near, text, doc_id, shingle_words, percent)
    parts = write_table(connected_components(links.union(copies)), "minhash-parts")

    more = _split_links(docs, members, leaders, parts, text, doc_id, shingle_words, percent, n)
    if more is not None:
        if more.count():
            # what is joined already is so by its smallest ids
            before, parts = parts, write_table(connected_components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), "minhash-parts")
            drop_table(before)
        drop_table(more)
    for done in (leaders, members, pairs, near, links):
        drop_table(done)
    component = F.coalesce("component", "doc_id")
    return signed.select("doc_id", "n_shingles").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the one with the smallest id.

    Of rows that repeat both id and text one stays; rows without an id all stay. Further
    columns may have any names.
    """
    found = write_table(near_duplicates(docs, text=text, doc_id=doc_id, **options).where("doc_id is not null"), "minhash-found")
    name = fresh(docs, "__other")
    gone = found.where("not kept").select(F.col("doc_id").alias(name)).distinct()
    stay = docs.join(broadcast_if_small(gone, gone.count(), 1_000_000), docs[doc_id] == F.col(name), "left_anti")
    again = found.where("kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(name))
    again = write_table(again, "minhash-again")
    n = again.count()
    if not n:
        return stay
    again = broadcast_if_small(again, n, 1_000_000)
    repeated = stay.join(again, stay[doc_id] == F.col(name), "left_semi").dropDuplicates([doc_id, text])
    return stay.join(again, stay[doc_id] == F.col(name), "left_anti").unionByName(repeated)


def _near_in(left: list[tuple], right: list[tuple], band: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of slim rows (t, doc_id, part, bands, sketch) of two components may be similar and share no earlier bucket."""
    (at, _, ap, ab, ax), (bt, _, bp, bb, bx) = (tuple(zip(*side, strict=True)) for side in (left, right))
    at, bt, ap, bp, ab, bb = (np.array(c, np.int64) for c in (at, bt, ap, bp, ab, bb))
    ax, bx = (np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) for c in (ax, bx))
    found = []
    for k in range(0, len(ax), 32):  # bounds the room for pairs
        near = (ax[k : k + 32, None, :] == bx[None, :, :]).sum(2, dtype=np.uint16) >= least
        i, j = np.nonzero(near & (ap[k : k + 32, None] != bp[None, :]))
        i += k
        same = ab[i] == bb[j]
        first = same.any(1) & (ab[i, same.argmax(1)] == band) & (at[i] != bt[j])
        found.append((i[first], j[first]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    return i, j


def _split_links(docs: DataFrame, members: DataFrame, leaders: DataFrame, parts: DataFrame, text: str, doc_id: str, k: int, percent: int, minima: int) -> DataFrame | None:
    """Links between components of one bucket, other than those of its first member, which have been tried."""
    placed = leaders.select("t", "doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("t", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    inside = members.where("t <> first").join(placed, "t").select("band", "t", "doc_id", "part")
    counts = inside.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("largest")).where(F.col("n") > F.col("largest.n"))
    blocks = [F.ceil(c / SLIM_BLOCK).cast("int").alias(a) for c, a in ((F.col("n"), "all_blocks"), (F.col("n") - F.col("largest.n"), "few_blocks"))]
    sizes = write_table(sizes.select("band", "n", F.col("largest.part").alias("largest"), *blocks), "minhash-split")
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not rows:
        return None
    split = write_table(join_one(inside, sizes.drop("n"), "band", rows, sizes), "minhash-split").join(leaders.select("t", "bands", "sketch"), "t")

    def dealt(rows: DataFrame, role: int, own: str, other: str) -> DataFrame:
        names = ("i", "j") if role == 0 else ("j", "i")
        mine = rows.withColumn(names[0], F.pmod(F.xxhash64("t", "doc_id"), F.col(own)).cast("int")).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return mine.select("band", "i", "j", F.lit(role).alias("role"), "t", "doc_id", "part", "bands", "sketch")

    grid = dealt(split.where("part <> largest"), 0, "few_blocks", "all_blocks").union(dealt(split, 1, "all_blocks", "few_blocks"))
    ordered = grid.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    share = percent / 100
    least = int(minima * share - SKETCH_DEVIATIONS * (minima * share * (1 - share)) ** 0.5)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slim rows with a possible partner, in pairs of text blocks."""

        def close(key: list, held: list[tuple]) -> pa.RecordBatch:
            sides = [[h[1:] for h in held if h[0] == r] for r in (0, 1)]
            out: list[tuple] = []
            if all(sides):
                i, j = _near_in(*sides, key[0], least)
                for cell in set(zip((i // BLOCK).tolist(), (j // BLOCK).tolist(), strict=True)):
                    here = (i // BLOCK == cell[0]) & (j // BLOCK == cell[1])
                    at = (key[0], key[1] << 20 | cell[0], key[2] << 20 | cell[1])
                    for role, which in ((0, i), (1, j)):
                        out += [(*at, role, *sides[role][x][1:3]) for x in np.unique(which[here]).tolist()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "i", "j", "role", "id", "part"])

        key, held = None, []
        for batch in batches:
            for *at, role, t, doc, part, bands, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    if held:
                        yield close(key, held)
                    key, held = at, []
                held.append((role, t, doc, part, bands, sketch))
        if held:
            yield close(key, held)
        let_go()

    needed = write_table(small_batches(ordered).mapInArrow(meet, "cluster long, i long, j long, role long, id long, part long"), "minhash-grid")
    drop_table(sizes)
    texts = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].cast("binary").alias("text")).where("id is not null").join(broadcast_if_small(needed, needed.count(), 1_000_000), "id")
    ordered = texts.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").select("cluster", "i", "j", "role", "id", "part", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for *at, role, doc, part, body in zip(*(c.to_pylist() for c in batch.columns[:6]), batch.column(6), strict=True):
                if at != key:
                    yield _links_of(held, percent)
                    key, held = at, []
                held.append((role, doc, part, _shingles(words_of(body.as_py() or b""), k)))
        yield _links_of(held, percent)
        let_go(_words)

    links = write_table(ordered.mapInArrow(run, "u long, v long"), "minhash-links")
    drop_table(needed)
    return links


def _links_of(held: list[tuple], percent: int) -> pa.RecordBatch:
    """Links between the members of a few components (role 0) and all members, as few as join them."""
    sides = [[h[1:] for h in held if h[0] == r] for r in (0, 1)]
    us, vs = [], []
    if all(sides):
        sizes = [np.array([len(h[2]) for h in side]) for side in sides]
        _, number, count = np.unique(np.concatenate([h[2] for side in sides for h in side]), return_inverse=True, return_counts=True)
        owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
        column = (np.cumsum(count > 1) - 1)[number]
        common = (count > 1)[number]
        cut = sizes[0].sum()
        both = np.zeros((len(sides[0]), len(sides[1])), np.float32)
        for at in range(0, int((count > 1).sum()), 4096):
            halves = []
            for side, (a, b) in enumerate(((0, cut), (cut, len(number)))):
                here = common[a:b] & (column[a:b] >= at) & (column[a:b] < at + 4096)
                matrix = np.zeros((len(sides[side]), 4096), np.float32)
                matrix[owner[side][here], column[a:b][here] - at] = 1
                halves.append(matrix)
            both += halves[0] @ halves[1].T
        parts = [np.array([h[1] for h in side]) for side in sides]
        union = sizes[0][:, None] + sizes[1][None, :] - both
        linked = (both > 0) & (100 * both.astype(np.int64) >= percent * union.astype(np.int64)) & (parts[0][:, None] != parts[1][None, :])
        leader: dict[int, int] = {}

        def root(x: int) -> int:
            while leader.setdefault(x, x) != x:
                x = leader[x]
            return x

        for i, j in zip(*np.nonzero(linked), strict=True):
            # members of one component are joined already
            a, b = root(int(parts[0][i])), root(int(parts[1][j]))
            if a != b:
                leader[max(a, b)] = min(a, b)
                us.append(sides[0][i][0]), vs.append(sides[1][j][0])
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def minhash_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle_words=2)
