"""Streaming forms of the status operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.status import change_cells, counting_columns, latest_per_image, with_pending


def upsert_to(df: DataFrame, sink: str, checkpoint: str, **trigger):
    """Write the changed rows of every micro-batch to their own folder of ``sink``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def newest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows of an upsert table: per key the row of the latest batch."""
    values = [c for c in table.columns if c not in (*keys, "batch_id")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*")


def latest_status_stream(status_log: DataFrame) -> DataFrame:
    """Running last state per image; the state per image is one row."""
    return latest_per_image(status_log)


def pending_counts_stream(status_log: DataFrame) -> DataFrame:
    """Running submitted / finished / failed / pending counts per image that has messages."""
    counts = status_log.groupBy("image_id").agg(*counting_columns())
    has_result = (F.col("finished") + F.col("failed") > 0).cast("long")
    return with_pending(counts.withColumns({"images": F.lit(1).cast("long"), "results": has_result}))


def debounce_cells_to(changes: DataFrame, sink: str, checkpoint: str, gap_seconds: float = 0.3, **trigger):
    """Fold every micro-batch into its own ``change_cells`` folder of ``sink``.

    A stream keeps no state for it: ``quiet_changes`` over the whole table combines the folders, so open
    bursts show at any time and a change is never too late.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        change_cells(batch, gap_seconds).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return changes.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**trigger).start()
