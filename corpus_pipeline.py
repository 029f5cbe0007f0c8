"""The training-text pipeline: every stage reads what its predecessor wrote, the last one's rows are the result.

Stages take and return the columns of ``documents``; the last returns sampled segmentations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import mixing, piece_sampling, pii, quality_rules, simhash
from framelake.scratch import Intermediate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules learned from ``labels``: rejected documents go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.fit_rules_on_texts(docs, labels)
    judged = quality_rules.apply_rules(quality_rules.text_statistics(docs, COLUMNS[1:]), rules)
    return judged.where("kept").select(*COLUMNS)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: one document of each component stays."""
    return simhash.first_of_each(docs).select(*COLUMNS)


def take_out_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.redacted_documents(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a document comes once per epoch taken of it."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document, checked by decoding."""
    return piece_sampling.sampled_segmentations(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", keep_first_copies),
    ("PII", take_out_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

# The learned stages and the sampled segmentations have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    A stage's table goes when its successor is written; the last one's input stays, as the result is read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = Intermediate(spark)
    for name, stage in STAGES[:-1]:
        with before:
            after = Intermediate(spark)
            docs = after.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
