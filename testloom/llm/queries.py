"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testloom.llm import centroids, chat_format, decontaminate, exact_dedup, html_extract, language_id, mixing, ngram_join, ranked_search, simhash, substring_dedup, suffix_dedup, token_counts
from testloom.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def held_out() -> F.Column:
    """Whether a document belongs to the third that nothing is learned from; no id: it doesn't."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(documents.where(~held_out()))
    return language_id.predict(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "key")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents")).drop("sig")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.perspectives(table(spark, sf_dir, "conversations"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def pipeline_after_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages two to five of the pipeline over all documents: what SQL can check."""
    from corpus_pipeline import run_after_language

    return run_after_language(spark, sf_dir)


def _pipeline_sql() -> str:
    from corpus_pipeline import AFTER_LANGUAGE_SQL

    return AFTER_LANGUAGE_SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_language_id, op3_html_extract, op4_decontaminate, op5_exact_dedup, op6_ngram_join, op7_mixing, op8_substring_dedup, op9_suffix_dedup, op10_chat_format, op11_simhash, op12_ranked_search, op13_centroids)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline, "pipeline_after_language": pipeline_after_language}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": decontaminate.ORACLE_SQL,
        "op5_exact_dedup": exact_dedup.ORACLE_SQL,
        "op6_ngram_join": ngram_join.ORACLE_SQL,
        "op7_mixing": mixing.ORACLE_SQL,
        "op8_substring_dedup": substring_dedup.ORACLE_SQL,
        "op10_chat_format": chat_format.ORACLE_SQL,
        "op12_ranked_search": ranked_search.ORACLE_SQL,
        "op13_centroids": centroids.ORACLE_SQL,
        "pipeline_after_language": _pipeline_sql(),
    }  # the pipeline's first stage is a trained model, which SQL can't express
