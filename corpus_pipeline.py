"""The corpus pipeline: toxic texts and near duplicates out, benchmark passages out, sources mixed, token files written.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of ``documents``, further columns among them, and give an empty
table for an empty one. ``run`` writes each stage's result to the
shared folder and reads it back, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cloudframe.llm import decontaminate, minhash, mixing, token_output, toxicity
from cloudframe.llm.common import table, write_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold of toxicity.

    Null and empty texts have no toxic word and stay; rows with null or repeated ids are
    judged row by row; without labels of both classes all rows stay; no row is changed.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Texts without words are nobody's copies and stay, as do rows without an id; of rows
    that repeat id and text one stays, of those that repeat an id with other texts each,
    unless a smaller id resembles one of them.
    """
    return minhash.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of ``benchmark`` within its error budget.

    Null and empty texts stay; null and empty items are nowhere found; rows with null or
    repeated ids are judged row by row; an empty benchmark keeps all.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it: 0 to 2 times.

    Null texts have size 0, a null source is a source of its own; sources of empty texts
    only are not taken; repeated rows are rows like any others.
    """
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the token files: doc_id, start, n_tokens and ids_crc32.

    Null and empty texts are the end id alone; rows with null ids come first, repeated ids
    stand side by side in an order fixed by their texts.
    """
    return token_output.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]
#: Its stages train, link, match and encode, which SQL cannot express: a test holds each against a plain recomputation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
