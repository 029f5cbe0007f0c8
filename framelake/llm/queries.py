"""Registered queries of the text operators: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import checks, filter_audit, importance_resampling, mixing, piece_sampling, pii, quality_classifier, quality_rules, secrets, setsketch, simhash, spans, token_counts, topk_search, url_filter
from framelake.llm.common import table
from framelake.scratch import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {
    "op3_source_mixing": checks.SOURCE_MIXING, "op7_url_filter": checks.URL_FILTER, "op10_exact_topk": checks.EXACT_TOPK,
    "op11_filter_audit": checks.FILTER_AUDIT, "op12_importance_resampling": checks.IMPORTANCE_RESAMPLING,
}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    s = F.col("spans")
    return found.select(
        "doc_id", *[spans.count_of(s, k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        spans.base_sha256(s, secrets.BASE_KINDS).alias("base_sha256"), spans.joined(s).alias("spans"),
    )


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query
def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sampled_segmentations(table(spark, sf_dir, "documents"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    s = F.col("spans")
    return found.select(
        "doc_id", *[spans.count_of(s, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        spans.base_sha256(s, pii.BASE_KINDS).alias("base_sha256"), spans.joined(s).alias("spans"),
    )


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, url_filter.RULES + url_filter.BLOCKED_HOSTS)
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = checkpointed(quality_rules.text_statistics(table(spark, sf_dir, "documents")))
    rules = quality_rules.fit_rules(stats, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = checkpointed(topk_search.quantised(table(spark, sf_dir, "embeddings")))
    return topk_search.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors)


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))
