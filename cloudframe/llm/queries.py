"""Queries of the corpus operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloudframe.llm import alignment, decontaminate, embedding, html_extract, language, minhash, mixing, quality, secrets, spelling, token_count, token_output, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.secrets_query,
        "op2_language_id": language.language_query,
        "op3_decontamination": decontaminate.decontamination_query,
        "op4_html_extract": html_extract.html_query,
        "op5_token_output": token_output.token_output_query,
        "op6_source_mixing": mixing.mixing_query,
        "op7_minhash_dedup": minhash.minhash_query,
        "op8_toxicity": toxicity.toxicity_query,
        "op9_embedding_dedup": embedding.embedding_query,
        "op10_token_count": token_count.token_count_query,
        "op11_spelling_variants": spelling.spelling_query,
        "op12_tokenizer_alignment": alignment.alignment_query,
        "op13_quality": quality.quality_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secrets.oracle_sql(), "op9_embedding_dedup": embedding.oracle_sql(), "op11_spelling_variants": spelling.oracle_sql()}
