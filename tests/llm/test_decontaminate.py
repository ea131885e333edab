"""Pigeonhole matches against the plain edit-distance table over whole texts."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cloudframe.llm import decontaminate as D

DATA = "/root/testdata/sf0.001"


def least_edits(item, text):
    """Sellers' table: the fewest edits of an occurrence anywhere in the text."""
    now = list(range(len(item) + 1))
    best = now[-1]
    for c in text:
        before, now[0] = now[:], 0
        for i, p in enumerate(item, 1):
            now[i] = min(before[i - 1] + (p != c), before[i] + 1, now[i - 1] + 1)
        best = min(best, now[-1])
    return best


def brute(items, text):
    out = {}
    body = D.normal(text or "")
    for i, item in items:
        item = D.normal(item or "")
        if item and (n := least_edits(item, body)) <= D.budget(len(item)):
            out[i] = n
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=12), st.text("ab c", max_size=30), st.integers(0, 6))
def test_myers(pattern, text, most):
    n = least_edits(pattern, text)
    got = D.myers(pattern, text, most)
    assert (got[0] if got else None) == (n if n <= most and text and n < len(pattern) + 1 and (n < len(pattern) or got) else None)


def damaged(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        rng.choice([lambda: chars.pop(at), lambda: chars.insert(at, rng.choice("abc xyz")), lambda: chars.__setitem__(at, rng.choice("abcxyz"))])()
    return "".join(chars)


def test_damaged_passages():
    rng = random.Random(5)
    words = ["the", "of", "tion", "ing", "anth", "er", "a", "reach", "stone"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(2, 40)))) for i in range(25)]
    matcher = D.Matcher(items)
    for _ in range(120):
        i, item = rng.choice(items)
        body = " ".join(rng.choices(words, k=30)) + " " + damaged(rng, item, rng.randint(0, len(item) // 8)) + " " + " ".join(rng.choices(words, k=10))
        got = {x: edits for ids, edits, _ in matcher.find(body) for x in ids}
        assert got == brute(items, body)


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.item_id, r.text) for r in items.collect()][:12]
    texts = [(r.doc_id, r.text[:3000]) for r in docs.collect()][:60]
    texts += [(1000 + k, "Before it. " + rows[k][1].upper() + " after") for k in range(10)]
    got = D.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.distance for r in got.collect()} == {(d, i): n for d, t in texts for i, n in brute(rows, t).items()}


def test_filter_and_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (None, "xx The  quick brown fox jumps\nover it", 1), (3, "y" * 300_000, 0), (4, "clean", 0), (4, "The quick brown fox jumps over it", 0)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "the quick brown fox jumps over it"), (3, None), (4, ""), (5, "zq"), (None, "never")], "item_id long, text string")
    found = sorted((str(r.doc_id), r.item_id, r.distance) for r in D.leaks(docs, items).collect())
    assert found == [("4", 1, 0), ("4", 2, 0), ("None", 1, 0), ("None", 2, 0)]
    assert sorted(str(r.doc_id) for r in D.decontaminate(docs, items).collect()) == ["1", "2", "3", "4"]
    assert D.decontaminate(docs, items).columns == docs.columns
    assert D.leaks(docs, items.limit(0)).count() == 0 and D.leaks(docs.limit(0), items).count() == 0
    assert D.decontaminate(docs, items.limit(0)).count() == 6


def test_items_named_by_text(spark):
    body = "the quick brown fox jumps over the lazy dog by the river bank at dawn"
    docs = spark.createDataFrame([(1, f"before {body} after")], "doc_id long, text string")
    items = spark.createDataFrame([("a-1", body), (None, None)], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()] == [(1, "a-1")]
