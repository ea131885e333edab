"""Grouping of spelling variants by pairless wildcard groups.

Words are counted over the whole corpus; two are near if they differ by one inserted,
deleted or replaced code point. Near words are never listed as pairs:

1. Words get ids in the order of their counts (most frequent first, ties by code points),
   so the better of two words is the one with the smaller id, and all further rows hold
   an id and a key only.
2. Replacements: each word stands in one group for each place, named by what comes before
   and after it. All words of a group but the word itself are near it, and none of them is
   in another of its groups. So the size of the group and its top two words say how many
   near words it gives to each member, and which of them is the best.
3. Insertions and deletions: each word without one code point is looked up in the
   vocabulary. A match counts once for the longer word and once for the shorter one.
4. All these counts and best ids add up in one aggregation by word.
5. A form has at least ``TIMES`` the count of its word, so forms lead upwards and end after
   as many steps as the counts allow; roots are found by doubling the steps each round.

Names of groups longer than ``LONG`` code points are replaced by their SHA-256, so a word
of many thousand letters sends rows of constant size. A group has at most one word for
each letter of the alphabet.

Defined results: null and empty texts have no words; repeated rows count as often as they
occur; a null id stands as an empty text in the rule of dropped letters; ties between near
words go to the smallest in code-point order; an empty table gives an empty table; of the
input only the two named columns are read, whatever others are called.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.llm.common import drop_table, table, write_table
from cloudframe.operators.cluster import rank_rows

LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS, LEAST_TIMES, TIMES = 6, 5, 5
DROP_ONE_IN = 199
LONG = 64
MOST_ROUNDS = 40


def without(word: Column, place: Column) -> Column:
    """The word without the code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def _name(text: Column) -> Column:
    return F.when(F.length(text) <= LONG, text).otherwise(F.sha2(text, 256))


def _each_place(word: Column, name) -> Column:
    """The distinct results of ``name(place)`` over the places of a word."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: _name(name(i))))


def word_counts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least_letters: int = LEAST_LETTERS, drop_one_in: int | None = DROP_ONE_IN) -> DataFrame:
    """(word, n): runs of letters with A to Z lower-cased, counted over all texts.

    With ``drop_one_in``, runs lose a letter by a rule of (id, run): these are the planted
    misspellings that the query's contract asks for.
    """
    low = F.translate(docs[text], string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"([{LETTERS}]{{{least_letters},}})"), F.lit(1))).alias("word"))
    if drop_one_in:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "word").cast("binary")))
        cut = without(F.col("word"), F.pmod("h", F.length("word")).cast("int"))
        runs = runs.select(F.when(F.pmod("h", F.lit(drop_one_in)) == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_letters)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of (id, word): how many words are near, and the smallest id of them. Words without near words have no row."""
    word = F.col("word")
    in_group = Window.partitionBy("key")
    by_id = in_group.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    holes = words.select("id", F.explode(_each_place(word, lambda i: F.concat(F.substring(word, F.lit(1), i), F.lit("*"), F.substring(word, i + 2, F.length(word))))).alias("key"))
    groups = holes.select("id", F.count(F.lit(1)).over(in_group).alias("size"), F.first("id").over(by_id).alias("top"), F.nth_value("id", 2).over(by_id).alias("second")).where("size > 1")
    replaced = groups.select("id", (F.col("size") - 1).alias("n"), F.when(F.col("top") == F.col("id"), F.col("second")).otherwise(F.col("top")).alias("best"))
    shorter = words.select(F.col("id").alias("long_id"), F.explode(_each_place(word, lambda i: without(word, i))).alias("key"))
    matched = shorter.join(words.select(_name(word).alias("key"), F.col("id").alias("short_id")), "key")
    both = matched.select(F.explode(F.array(F.struct(F.col("long_id").alias("id"), F.col("short_id").alias("best")), F.struct(F.col("short_id").alias("id"), F.col("long_id").alias("best")))).alias("x"))
    indels = both.select("x.id", F.lit(1).cast("long").alias("n"), "x.best")
    return replaced.union(indels).groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form): where the forms of forms end, each round twice as far. Forms may not go in circles."""
    now = write_table(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    for _ in range(MOST_ROUNDS):
        further = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        then = write_table(now.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("over")), "spelling-roots")
        drop_table(now)
        now = then
        if now.where("not over").isEmpty():
            return now.select("id", "root")
    raise RuntimeError(f"forms do not end after {MOST_ROUNDS} rounds")


def spelling_variants(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, times: int = TIMES, drop_one_in: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least ``least_times`` occurrences.

    ``form`` is the near word with the largest count, if that is at least ``times`` the
    word's own; ``root`` is the last of the forms of forms, or the word itself.
    """
    counted = word_counts(docs, text=text, doc_id=doc_id, least_letters=least_letters, drop_one_in=drop_one_in).where(F.col("n") >= least_times)
    ranked = rank_rows(counted.select(F.struct((-F.col("n")).alias("less"), "word").alias("key"), "n"), "key", "id")
    words = write_table(ranked.select(F.col("id").cast("long").alias("id"), F.col("key.word").alias("word"), "n"), "spelling-words")
    near = near_words(words.select("id", "word"))
    best = words.select(F.col("id").alias("best"), F.col("n").alias("best_n"))
    linked = words.select("id", "n").join(near, "id").join(best, "best")
    linked = write_table(linked.select("id", "n_near", F.when(F.col("best_n") >= times * F.col("n"), F.struct("best", "best_n")).alias("form")), "spelling-near")
    ends = roots(linked.where("form is not null").select("id", F.col("form.best").alias("form")))
    named = words.select(F.col("id").alias("other"), F.col("word").alias("other_word"))
    out = words.join(linked, "id", "left").join(ends, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form.best").alias("form_id"), F.col("form.best_n").alias("form_n"), "root")
    out = out.join(named.withColumnsRenamed({"other": "form_id", "other_word": "form_word"}), "form_id", "left").join(named.withColumnsRenamed({"other": "root", "other_word": "root_word"}), "root", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def spelling_query(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_one_in=DROP_ONE_IN)


def oracle_sql() -> str:
    """The same rows from all near pairs; crc32 is spelled out, as DuckDB has none."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    digit = "instr('0123456789ABCDEF', substr(hx, 2 * i + {}, 1)) - 1"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[{LETTERS}]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
hexed AS (SELECT run, k, hex(encode(concat(CAST(doc_id AS VARCHAR), ':', run))) AS hx FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda i: 16 * ({digit.format(1)}) + {digit.format(2)})), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, crc),
cut AS (SELECT CASE WHEN h % {DROP_ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_TIMES}),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
holes AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS hole FROM places),
shorter AS (SELECT DISTINCT p.word, p.n, w.word AS other, w.n AS m FROM places p JOIN words w ON w.word = substr(p.word, 1, i) || substr(p.word, i + 2)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION ALL SELECT word, n, other, m FROM shorter UNION ALL SELECT other, m, word, n FROM shorter),
best AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word, n),
forms AS (SELECT word, n_near, CASE WHEN m >= {TIMES} * n THEN other END AS form, CASE WHEN m >= {TIMES} * n THEN m END AS form_n FROM best),
steps AS (SELECT word, form AS root, 1 AS far FROM forms WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form, far + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, far) AS root FROM steps GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)"""
