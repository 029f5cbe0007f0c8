"""Shared pieces of the text operators: tables, words, Arrow maps, per-row identity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Characters that separate words: space and \t \n \v \f \r.  bytes.split() cuts at the same six.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_AT_ONCE = 256  # rows of a batch that are Python objects at one time


def rows_in(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch as Python values, a few at a time."""
    for start in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield from zip(*(c.to_pylist() for c in batch.slice(start, ROWS_AT_ONCE).columns), strict=True)


def arrow_rows(df: DataFrame, row: Callable[[], Callable[..., tuple]], inputs: list[str], schema: StructType) -> DataFrame:
    """Map every row of ``inputs`` to one row of ``schema`` in Arrow batches.

    ``row`` is called once per task and returns the function of one row, so caches and compiled
    patterns live as long as the task.  Strings arrive as str (null: None).
    """
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = row()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                made = [function(*values) for values in zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)]
                columns = [pa.array(list(v), type=f.type) for v, f in zip(zip(*made, strict=True), target, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)
        pa.default_memory_pool().release_unused()

    return df.select(*dict.fromkeys(inputs)).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for the third of the rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_ids(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """``doc_id`` and ``_label`` of about ``max_rows`` documents at most that a model may learn from.

    The bound is the documented size of the training sample: of n labelled ids those stay whose hash is
    in the first ``max_rows / n`` of its range, so the sample depends on ids alone.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    )
    parts = 1 << 20
    within = min(parts, parts * max_rows // max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < within)


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """One row of ``stats`` per document of ``training_ids``, with its ``_label``."""
    values = [c for c in stats.columns if c != "doc_id"]
    one = stats.join(F.broadcast(training_ids(labels, label, max_rows)), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct("_label", *values)).alias("_row"))
    return one.select("doc_id", "_row.*")
