"""Language of pages by Bayesian fusion of evidence.

* Text: log-likelihoods of a page's letter trigrams under each language, from counts over
  at most ``SAMPLE_TEXTS`` labelled texts of each language (those of the smallest hashed
  ids) and the commonest trigrams of each language: so many that the table of all
  languages has ``MOST_NUMBERS`` numbers, but not below ``LEAST_GRAMS``. As trigrams
  overlap, they weigh ``TEMPER`` each. Every labelled language takes part.
* Declared language (``<html lang=...>``) and address suffix: how often each goes with
  each language, by sums of the text's posteriors over all pages.
* Host: shares of the languages on the host, smoothed by those of its domain, and these
  by those of all pages; a page's own part is taken out of the sums first.

Sums are grouped aggregations that combine before they shuffle, so a host or suffix with
a third of all pages is no hot group; their tables are joined, broadcast only where
their measured rows are few.

Defined results: a null or empty page has no text evidence and is decided by the rest; a
page without any evidence gets the commonest language; null addresses have the empty
host; without labelled texts every language is null; ties go to the language first in
order; null or repeated ids are answered row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.llm.common import small_batches, write_table
from cloudframe.operators.joins import join_one

SAMPLE_TEXTS, MOST_NUMBERS, LEAST_GRAMS = 500, 6_000_000, 50
TEMPER = 0.25
#: Rows of a prior's table that are broadcast.
MOST_SENT = 100_000
#: Pseudo-counts of the level above a host or domain, and of a declared language or suffix.
PRIOR_PAGES, PRIOR_SIGNS = 4.0, 1.0
_RAW = re.compile(r"<(script|style)\b", re.I)
_ENDS = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style")}
_WORDS = re.compile(r"[^\W\d_]+")


def visible(page: str) -> str:
    """A page without tags, comments, scripts and styles, in one pass: what has no end anywhere is looked for once."""
    out, at, endless = [], 0, set()
    while (start := page.find("<", at)) >= 0:
        out.append(page[at:start])
        raw = _RAW.match(page, start)
        kind = "comment" if page.startswith("<!--", start) else raw[1].lower() if raw else None
        if kind and kind not in endless:
            if kind == "comment":
                end = page.find("-->", start + 4) + 3
            else:
                found = _ENDS[kind].search(page, raw.end())
                end = found.end() if found else 2
            if end > 2:
                out.append(" ")
                at = end
                continue
            endless.add(kind)
        end = page.find(">", start)
        if end < 0:
            at = start
            break
        out.append(" ")
        at = end + 1
    return markup.unescape("".join(out) + page[at:])


def trigrams(text: str) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(_WORDS.findall(text.lower())).items():
        padded = f" {word} "
        for i in range(len(padded) - 2):
            out[padded[i : i + 3]] += n
    return out


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> tuple[list[str], dict[str, int], np.ndarray]:
    """The languages in order, the trigrams' numbers, and their log-probabilities under each language."""
    slim = docs.select(docs[doc_id].alias("id"), docs[lang].alias("lang"), docs[text].alias("text")).where("lang is not null and text is not null")
    counts = slim.groupBy("lang").count().collect()  # a row for each language
    langs = sorted(r.lang for r in counts)
    if not langs:
        return [], {}, np.zeros((0, 0))
    # one pass over the texts: about twice the sample by a threshold of the hashed id and text, then exactly the smallest; repeated rows count once
    shares = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, 2.0 * SAMPLE_TEXTS / r["count"])))])
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 31))
    some = slim.withColumn("place", place).where(F.col("place") < shares[F.col("lang")] * (1 << 31))
    some = write_table(some.dropDuplicates(["lang", "id", "text"]), "language-sample")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id", "text"))
    sample = some.withColumn("n", order).where(F.col("n") <= SAMPLE_TEXTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Counter] = {}
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(name, Counter()).update(trigrams(body))
            rows = [(name, g, n) for name, c in found.items() for g, n in c.items()]
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = write_table(counted, "language-grams")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    chosen = counted.withColumn("rank", rank).where(F.col("rank") <= max(LEAST_GRAMS, MOST_NUMBERS // len(langs) ** 2)).select("gram").distinct()
    rows = counted.join(chosen, "gram").collect()
    place_of = {name: i for i, name in enumerate(langs)}
    number = {g: i for i, g in enumerate(sorted({r.gram for r in rows}))}
    table = np.full((len(number), len(langs)), 0.5)
    for r in rows:
        table[number[r.gram], place_of[r.lang]] += r.n
    return langs, number, np.log(table / table.sum(axis=0))


def text_logs(page: str, number: dict[str, int], logs: np.ndarray) -> np.ndarray:
    held = [(number[g], n) for g, n in trigrams(visible(page)).items() if g in number]
    if not held:
        return np.zeros(logs.shape[1])
    which, times = zip(*held, strict=True)
    return TEMPER * (np.array(times, float) @ logs[list(which)])


def host_of(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def declared_in(page: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(page) if isinstance(page, str) else page, F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1))


def _softmax(logits: Column) -> Column:
    each = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(each, lambda x: x / _sum(each))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def identify(pages: DataFrame, docs: DataFrame, *, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with ``lang`` and its posterior ``probability``."""
    langs, number, logs = train(docs)
    if not langs:
        return pages.select(*keep, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    k = len(langs)
    kept = [pages[c].alias(f"k{i}") for i, c in enumerate(keep)]
    host = host_of(pages[url])
    slim = pages.select(*kept, host.alias("host"), declared_in(pages[html]).alias("declared"), F.coalesce(pages[html], F.lit("")).alias("html"))
    sent = pages.sparkSession.sparkContext.broadcast((number, logs))  # bounded by MOST_NUMBERS
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", text_logs array<double>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_logs(body.as_py(), *sent.value).tolist() for body in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "text_logs"])

    scored = small_batches(slim).mapInArrow(read, schema)
    labels = F.split("host", r"\.")
    scored = scored.withColumns({
        "suffix": F.element_at(labels, -1),
        "domain": F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."),
        "p": _softmax(F.col("text_logs")),
    })
    scored = write_table(scored, "language-pages")

    def sums(name: str) -> DataFrame:
        each = [F.sum(F.col("p")[i]) for i in range(k)]
        return write_table(scored.groupBy(name).agg(F.array(*each).alias(f"{name}_n")), f"language-{name}")

    overall = scored.agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(k)]).first()
    everything = [float(x) for x in overall]
    pages_in_all = sum(everything) or 1.0
    out, rows = scored, scored.count()
    for name in ("host", "domain", "suffix", "declared"):
        found = sums(name)
        # a host of a third of all pages is no hot group: beyond what is broadcast to all, the rows of heavy keys stay where they are
        out = out.join(F.broadcast(found), name) if found.count() <= MOST_SENT else join_one(out, found, name, rows)

    # of each table: its sums without the page itself, and the total of these
    for name in ("host", "domain", "suffix", "declared"):
        out = out.withColumn(f"{name}_n", F.zip_with(f"{name}_n", "p", lambda n, p: F.greatest(F.lit(0.0), n - p))).withColumn(f"{name}_all", _sum(F.col(f"{name}_n")))
    out = out.withColumn("share", F.array(*[F.lit(x / pages_in_all) for x in everything])).withColumn("all", F.array(*[F.lit(x) for x in everything]))
    for name in ("domain", "host"):
        total = F.col(f"{name}_all")
        out = out.withColumn("share", F.zip_with(f"{name}_n", "share", lambda n, s: (n + PRIOR_PAGES * s) / (total + PRIOR_PAGES)))  # noqa: B023
    out = out.withColumn("logits", F.zip_with("text_logs", "share", lambda t, s: t + F.log(s + 1e-12)))
    for name in ("suffix", "declared"):
        common = (F.col(f"{name}_all") + 1.0) / (pages_in_all + 1.0)
        sign = F.zip_with(f"{name}_n", "all", lambda n, a: F.log((n + PRIOR_SIGNS * common) / (a + PRIOR_SIGNS)) - F.log(common))  # noqa: B023
        out = out.withColumn("logits", F.zip_with("logits", sign, lambda a, b: a + b))
    out = out.withColumn("posterior", _softmax(F.col("logits")))
    best = F.array_max("posterior")
    lang = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("posterior", best).cast("int"))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], lang.alias("lang"), best.alias("probability"))


def language_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(pages, docs)
    return found.withColumn("probability", F.round("probability", 6))
