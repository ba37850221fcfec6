"""The registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment,
    decontamination,
    embedding_dedup,
    html_extraction,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    toxicity,
    url_filters,
)
from .common import prepare, table


def tokenizer_file(spark: SparkSession) -> str:
    """The tokenizer's file, from ``spark.facetframe.tokenizer`` or the installed public one."""
    named = spark.conf.get("spark.facetframe.tokenizer", None)
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return url_filters.judge_urls(table(spark, folder, "pages"), url_filters.rule_table(spark))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan_secrets(table(prepare(spark), folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return quality_rules.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract_pages(table(prepare(spark), folder, "pages"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(prepare(spark), folder, "documents"))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return quality_classifier.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return packing.pack(table(spark, folder, "documents"), tokenizer_file(spark))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(prepare(spark), folder, "documents"))


def piece_file(spark: SparkSession) -> str:
    """The second tokenizer's file, from ``spark.facetframe.pieces`` or the installed public one."""
    named = spark.conf.get("spark.facetframe.pieces", None)
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return alignment.align_documents(table(spark, folder, "documents"), tokenizer_file(spark), piece_file(spark))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.collapse_runs(table(prepare(spark), folder, "documents"), plant=True)


def op13_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(prepare(spark), folder, "embeddings"))


QUERIES = {
    f.__name__: f for f in (
        op1_url_filters, op2_secret_scan, op3_quality_rules, op4_benchmark_decontamination, op5_html_extraction, op6_simhash,
        op7_quality_classifier, op8_best_fit_packing, op9_toxicity, op10_sharding, op11_cross_tokenizer_alignment,
        op12_periodic_runs, op13_embedding_dedup,
    )
}
ORACLES = {
    "op1_url_filters": textwrap.dedent(url_filters.ORACLE).strip(), "op2_secret_scan": secret_scan.oracle(),
    "op13_embedding_dedup": embedding_dedup.ORACLE.strip(),
}
