"""Language identification against languages that are known, and the evidence beyond the text."""

import html
import re
import time
from collections import Counter

import numpy as np

from cloudframe.llm import language as L

DATA = "/root/testdata/sf0.01"


def test_labelled_texts_as_pages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    pages = docs.selectExpr("doc_id as page_id", "concat('http://x', doc_id % 7, '.example.org/', doc_id) as url", "concat('<html><script>var the = 1</script><p>', text, '</p></html>') as html", "lang as truth")
    rows = L.identify(pages, docs, keep=("page_id", "truth")).collect()
    assert len(rows) == docs.count()
    assert sum(r.lang == r.truth for r in rows) > 0.95 * len(rows)


def test_every_page_once(spark):
    rows = L.language_query(spark, DATA).collect()
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in pages.collect())
    assert all(r.lang in ("de", "en", "es", "fr") and 0.25 <= r.probability <= 1 for r in rows)


def test_markup_host_and_suffix_decide_without_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    texts = {r.lang: r.text for r in docs.where("length(text) between 300 and 3000").collect()}
    rows, n = [], 0
    for lang, suffix in (("de", "de"), ("fr", "fr"), ("es", "es")):
        for _ in range(20):
            rows.append((n, f"https://www.site.{suffix}/{n}", f'<html lang="{lang}"><p>{texts[lang]}</p>', 0))
            n += 1
    rows += [(1000, "https://www.site.fr/empty", "", 0), (1001, None, '<html lang="es">', 0), (1002, None, None, 0), (None, "https://other.de/x", "<p>12 34</p>", 0), (3, "https://www.site.fr/again", "", 0)]
    got = L.identify(spark.createDataFrame(rows, "page_id long, url string, html string, lang int"), docs)
    found = {(r.page_id, r.url): r.lang for r in got.collect()}
    assert len(found) == len(rows)
    assert found[1000, "https://www.site.fr/empty"] == "fr" and found[3, "https://www.site.fr/again"] == "fr"
    assert found[1001, None] == "es" and found[None, "https://other.de/x"] == "de"
    assert found[1002, None] in ("de", "en", "es", "fr")
    assert all(found[i, u] == lang for (i, u, _, _), lang in zip(rows[:60], ["de"] * 20 + ["fr"] * 20 + ["es"] * 20, strict=True))


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    assert L.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in L.identify(pages.limit(3), docs.limit(0)).collect()} == {None}


def test_visible_text_is_what_the_pattern_says(spark):
    unseen = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    pages += ["a<b", "a<b>c<!-- x --> d<!-- e > f", "<SCRIPT>x</scrip></Script >y", "<style><script></style>z</script>", "<script", "<!-->a-->b", "&lt;<p>&amp;", ""]
    for page in pages:
        assert L.visible(page).split() == html.unescape(unseen.sub(" ", page)).split()
    began = time.perf_counter()
    assert "script" in L.visible("<script" * 100_000) and L.visible("<!--" * 100_000 + ">") and L.visible("<script>" * 100_000)
    assert time.perf_counter() - began < 5


def test_posteriors_by_a_plain_recomputation(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    langs, number, logs = L.train(docs)
    rows, k = pages.collect(), len(langs)

    def host(url):
        found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        return found[1].lower() if found else ""

    def declared(page):
        found = re.search(r"""<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", page or "", re.I)
        return found[1].lower() if found else ""

    def softmax(x):
        x = np.exp(x - x.max())
        return x / x.sum()

    texts = []
    for r in rows:
        total = np.zeros(k)
        for g, n in L.trigrams(L.visible(r.html or "")).items():
            if g in number:
                total += L.TEMPER * n * logs[number[g]]
        texts.append(total)
    p = [softmax(x) for x in texts]
    signs = [{"host": (h := host(r.url)), "domain": ".".join(h.split(".")[-2:]), "suffix": h.split(".")[-1], "declared": declared(r.html)} for r in rows]
    sums = Counter()
    for own, names in zip(p, signs, strict=True):
        for name in names.items():
            sums[name] = sums.get(name, np.zeros(k)) + own
    every = sum(p)
    want = {}
    for r, own, names, text in zip(rows, p, signs, texts, strict=True):
        without = {name: np.maximum(0, sums[name, value] - own) for name, value in names.items()}
        share = every / every.sum()
        for name in ("domain", "host"):
            share = (without[name] + L.PRIOR_PAGES * share) / (without[name].sum() + L.PRIOR_PAGES)
        logits = text + np.log(share + 1e-12)
        for name in ("suffix", "declared"):
            common = (without[name].sum() + 1) / (every.sum() + 1)
            logits += np.log((without[name] + L.PRIOR_SIGNS * common) / (every + L.PRIOR_SIGNS)) - np.log(common)
        best = softmax(logits)
        want[r.page_id] = (langs[int(best.argmax())], best.max())
    got = {r.page_id: (r.lang, r.probability) for r in L.identify(pages, docs).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in want)


def test_every_labelled_language_takes_part(spark):
    names = [f"l{i:03}" for i in range(130)]
    docs = spark.createDataFrame([(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{c}q" for c in "abcdefgh") * 3, n) for i, n in enumerate(names)], "doc_id long, text string, lang string")
    pages = docs.selectExpr("doc_id as page_id", "cast(null as string) as url", "concat(text, ' ', text) as html")
    got = {r.page_id: r.lang for r in L.identify(pages, docs).collect()}
    assert sum(got[i] == n for i, n in enumerate(names)) >= 128


def test_texts_without_ids_do_not_swell_the_sample(spark, monkeypatch):
    held = []
    keep = L.write_table
    monkeypatch.setattr(L, "write_table", lambda df, name, **o: held.append((name, keep(df, name, **o))) or held[-1][1])
    rows = [(None, f"text number {i} with words", "en") for i in range(6000)] + [(7, "the same row", "en")] * 3000
    L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sample = dict(held)["language-sample"].collect()
    assert L.SAMPLE_TEXTS <= len(sample) <= 2 * L.SAMPLE_TEXTS
    assert sum(r.id == 7 for r in sample) <= 1


def test_hosts_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html", "url")
    # one host for two pages of three
    pages = pages.selectExpr("page_id", "if(page_id % 3 = 0, url, 'http://hot.example.org/') as url", "html")
    want = {r.page_id: r for r in L.identify(pages, docs).collect()}
    monkeypatch.setattr(L, "MOST_SENT", 0)
    monkeypatch.setattr("cloudframe.operators.joins.LEAST_HEAVY", 20)
    got = {r.page_id: r for r in L.identify(pages, docs).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].lang == r.lang and abs(got[i].probability - r.probability) < 1e-9 for i, r in want.items())
