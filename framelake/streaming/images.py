"""Incremental arrival of image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.keyed import global_index
from framelake.scratch import exists
from framelake.sources.files import manifest_columns

BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_images(spark: SparkSession, path: str, sink: str, checkpoint: str, glob: str = "*", **trigger):
    """Append new files to the manifest table ``sink``, numbered after those already there.

    Each micro-batch owns one folder of the table and one row of its ledger, the index after its last file.  A batch reads
    the row of the batch before it, so its cost does not grow with the table; a repeated batch replaces itself and gets the
    same numbers.
    """
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILES)
        .option("pathGlobFilter", glob).load(path).select(*manifest_columns())
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before, own = _next_index(session, sink, batch_id), f"{sink}/batch_id={batch_id}"
        numbered = global_index(batch, ["name", "path"], "original_index", before)
        numbered.withColumn("image_id", F.col("original_index").cast("string")).write.mode("overwrite").parquet(own)
        after = session.read.parquet(own).agg((F.count(F.lit(1)) + before).alias("next_index"))
        after.write.mode("overwrite").parquet(_ledger(sink, batch_id))

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _ledger(sink: str, batch_id: int) -> str:
    """Where a batch leaves its row; readers of the table do not see folders that begin with an underscore."""
    return f"{sink}/_ledger/batch_id={batch_id}"


def _next_index(spark: SparkSession, sink: str, batch_id: int) -> int:
    """The first index of a batch; batches of a stream are numbered through."""
    if batch_id == 0:
        return 0
    before = _ledger(sink, batch_id - 1)
    if exists(spark, before):
        return spark.read.parquet(before).first()[0]
    # a table that is older than its ledger
    return spark.read.parquet(sink).where(F.col("batch_id") < batch_id).count() if exists(spark, sink) else 0
