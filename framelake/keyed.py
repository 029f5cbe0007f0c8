"""Skew-safe building blocks shared by the operators: global row numbers and keyed lookups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.scratch import checkpointed

def constant_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A fixed table as a local relation, so the optimizer knows its (tiny) size."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def global_index(
    df: DataFrame,
    order_by: list[str],
    out: str = "row_index",
    start: int = 0,
    rows_per_bucket: int = 1_000_000,
) -> DataFrame:
    """Number rows 0,1,2,... in the total order ``order_by`` without a single-task window.

    Rows are dealt to key ranges of about ``rows_per_bucket`` rows, sorted inside and computed once;
    a row's number is its place in its range plus the rows of the ranges before it.  The only
    broadcast table has one row per range.  ``order_by`` must be unique per row.
    """
    ranges = max(1, -(-df.count() // rows_per_bucket))
    ranged = df.repartitionByRange(ranges, *order_by).sortWithinPartitions(*order_by)
    # range number in the upper bits, place in the range in the lower 33
    placed = checkpointed(ranged.withColumn("_placed", F.monotonically_increasing_id()))
    range_of, place = F.shiftright("_placed", 33), F.col("_placed").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(range_of.alias("_range")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.withColumn("_range", range_of).join(F.broadcast(offsets), "_range")
        .withColumn(out, (place + F.col("_offset") + start).cast("long"))
        .drop("_range", "_offset", "_placed")
    )


def salted_lookup(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    weight: str,
    spread: list[str],
    how: str = "inner",
    hot_rows: int = 8_000_000,
) -> DataFrame:
    """Join ``big`` to one row per key, splitting keys that more than ``hot_rows`` rows share.

    ``weight`` (a column of ``small``) is the number of ``big`` rows of the key.  A hot key gets
    ceil(weight / hot_rows) salts; its one lookup row is repeated that often.  The broadcast list of
    hot keys has at most rows(big) / hot_rows entries by construction.
    """
    salts = F.ceil(F.col(weight) / F.lit(hot_rows)).cast("long")
    hot = small.where(F.col(weight) > hot_rows).select(*keys, salts.alias("_salts"))
    left = (
        big.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0).cast("long"))
                    .otherwise(F.pmod(F.xxhash64(*spread), F.col("_salts"))))
        .drop("_salts")
    )
    right = small.withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0).cast("long"),
                             F.when(F.col(weight) > hot_rows, salts - 1).otherwise(F.lit(0).cast("long")))),
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
