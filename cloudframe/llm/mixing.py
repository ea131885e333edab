"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected ``target / source_size`` times. The expected
copies are prefix-summed in a fixed order within the source (by size, so that the words
taken follow the target closely), one random offset is added, and a document is emitted
once for each integer boundary that its share of the sum crosses.

The prefix sum has three levels, so no source is ever sorted in one task: size classes
within a source, hashed blocks within a class, rows within a block.

Defined results: a null text has size 0; a null source is a source of its own, ordered
last; rows with null or repeated ``doc_id`` are rows like any others; a source whose
texts are all empty has target 0 and none of its rows is taken; an empty table gives an
empty table. Extra columns are kept, whatever their names. Rows that
repeat both id and text are placed in one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudframe.llm.common import broadcast_if_small, text_or_empty, write_table

WEIGHTS = (3, 1, 2)
#: A size class is cut into about TARGET_BLOCKS hashed blocks over all rows, of LEAST to MOST rows each.
TARGET_BLOCKS, LEAST_ROWS, MOST_ROWS = 2048, 16, 100_000
OFFSET_STEPS = 1 << 20
MARKS = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _keyed(docs: DataFrame, text: str, source: str, doc_id: str) -> DataFrame:
    """The columns of ``docs`` by their places, so that no name clashes, with what the mix needs of each row."""
    return docs.select(
        *[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)],
        docs[doc_id].alias("__id"),
        docs[source].alias("__source"),
        word_count(docs[text]).alias("__size"),
        F.coalesce(F.concat(F.lit("s"), docs[source]), F.lit("n")).alias("__key"),
        F.xxhash64(docs[doc_id], text_or_empty(docs[text])).alias("__hash"),
    ).withColumn("__class", F.floor(4 * F.log2(1.0 + F.col("__size"))).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``ratio``
    times all words; a target stops at ``cap`` times its source's size and the excess is
    reshared by weight. Filling up sources in the order of cap / weight gives the level
    at which this ends. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(ratio)) * F.sum("source_size").over(everything)
    t = t.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the first source, in this order, that stays below its cap fixes the level
    t = t.withColumn("stops", F.when(F.col("most") / F.col("w") >= F.col("level"), F.col("level")))
    t = t.withColumn("final", F.first("stops", ignorenulls=True).over(everything))
    return t.select("source", "source_size", F.least("most", F.coalesce("final", F.lit(float("inf"))) * F.col("w")).alias("target"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the columns ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``, which take the place of columns of these names."""
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in MARKS]
    return _mixed(docs, **options).select(*kept, *MARKS)


def _mixed(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, ratio: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    keyed = _keyed(docs, text, source, doc_id)
    slim = write_table(keyed.select(F.col("__key").alias("key"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__class").alias("class"), F.col("__hash").alias("hash")), "mix-sizes")
    rows = slim.count()
    block_rows = min(MOST_ROWS, max(LEAST_ROWS, rows // TARGET_BLOCKS))

    classes = slim.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.first("source").alias("source"))
    classes = write_table(classes, "mix-classes")
    sources = classes.groupBy("key").agg(F.sum("s").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sources.select("source", "source_size"), weights, ratio, cap)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), "source_size", "target")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.lit(OFFSET_STEPS)) / F.lit(float(OFFSET_STEPS))
    within = Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = (
        classes.join(targets, "key")
        .withColumn("class_before", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .withColumn("blocks", F.ceil(F.col("n") / F.lit(block_rows)).cast("long"))
        .withColumn("expected", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
        .withColumn("offset", offset)
        .select("key", "class", "class_before", "blocks", "expected", "offset", "source_size", "target")
    )
    classes = write_table(classes, "mix-plan")
    n_classes = classes.count()

    salted = slim.join(broadcast_if_small(classes.select("key", "class", "blocks"), n_classes), ["key", "class"])
    blocks = salted.groupBy("key", "class", F.pmod("hash", F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("key", "class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("block_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    plan = write_table(blocks.join(classes, ["key", "class"]), "mix-blocks")
    n_blocks = plan.count()

    inner = {c: f"__p_{c}" for c in plan.columns}
    plan = plan.withColumnsRenamed(inner)
    classes = classes.select(F.col("key").alias("__c_key"), F.col("class").alias("__c_class"), F.col("blocks").alias("__c_blocks"))
    out = keyed.join(broadcast_if_small(classes, n_classes), (F.col("__key") == F.col("__c_key")) & (F.col("__class") == F.col("__c_class")))
    out = out.withColumn("__block", F.pmod("__hash", F.col("__c_blocks")))
    out = out.join(broadcast_if_small(plan, n_blocks), (F.col("__key") == F.col("__p_key")) & (F.col("__class") == F.col("__p_class")) & (F.col("__block") == F.col("__p_block")))
    in_block = Window.partitionBy("__key", "__class", "__block").orderBy("__size", "__id", "__hash")
    place = F.col("__p_class_before") + F.col("__p_block_before") + F.row_number().over(in_block)
    out = out.withColumn("__place", place)
    crossed = F.floor(F.col("__p_offset") + F.col("__p_expected") * F.col("__place")) - F.floor(F.col("__p_offset") + F.col("__p_expected") * (F.col("__place") - 1))
    # rounding can't give a document more than its expected copies rounded up
    copies = F.least(crossed, F.ceil("__p_expected")).cast("int")
    return out.select(*[f"c{i}" for i in range(len(docs.columns))], F.col("__size").alias("mix_size"), F.col("__p_source_size").alias("mix_source_size"), F.col("__p_target").alias("mix_target"), copies.alias("mix_copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, with the columns of ``docs``."""
    marked = _mixed(docs, **options).where("mix_copies > 0")
    return marked.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def mixing_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))
