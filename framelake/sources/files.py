"""Image files in, prepared images out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.text import last_extension
from framelake.scratch import checkpointed


# Small files: Spark puts 32 of them into a partition, and this many partitions make a task
PARTITIONS_A_TASK = 8


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def manifest_columns() -> list[Column]:
    """Manifest of a ``binaryFile`` frame; file contents are not read for it."""
    name = file_name(F.col("path"))
    return [
        F.col("path"), name.alias("name"),
        F.when(name.contains("."), F.lower(last_extension(name))).otherwise("").alias("extension"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"),
    ]


def scan_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """List files below ``path``: path, name, extension, size and modification time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(*manifest_columns())


def scan_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decode the image files below ``path``: ``(images, errors)``; a file that cannot be decoded is reported, never fatal.

    ``images``: ``path, name, width, height, channels, data`` with interleaved BGR(A) or gray bytes.  ``path`` is
    the one ``scan_manifest`` lists and tells files with the same name apart.  A file is read and decoded once, into a table
    in the shared folder that both results read.  A task takes several of the partitions Spark makes of the files, as long as
    all cores have work: many small files would otherwise cost a task, a checkpoint file and a Python start per 32 of them.
    """
    read = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    read = read.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-read.rdd.getNumPartitions() // PARTITIONS_A_TASK)))
    # the reader escapes the path like a URL, but for the plus sign
    plain = F.regexp_replace(F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))), "^([A-Za-z0-9]+):///", "$1:/")
    read = checkpointed(read.withColumn("path", plain).withColumn("name", file_name(F.col("path"))).drop("origin", "mode"))
    images = read.where(F.col("width") > 0).select("path", "name", "width", "height", F.col("nChannels").alias("channels"), "data")
    errors = read.where(F.col("width") <= 0).select("path", "name", F.lit("cannot be decoded").alias("error"))
    return images, errors


def split_channels(images: DataFrame, id_col: str = "path") -> DataFrame:
    """Interleaved bytes -> row-major ``r, g, b, a`` arrays (opaque where there is no alpha)."""
    arrow = pa.schema([(c, pa.list_(pa.int32())) for c in ("r", "g", "b", "a")])
    id_type = images.schema[id_col].dataType.simpleString()

    def planes(data: bytes, channels: int) -> list[np.ndarray]:
        px = np.frombuffer(data, dtype=np.uint8).reshape(-1, channels)
        if channels == 1:
            px = np.repeat(px, 3, axis=1)
        alpha = px[:, 3] if px.shape[1] == 4 else np.full(len(px), 255, dtype=np.uint8)
        return [px[:, 2], px[:, 1], px[:, 0], alpha]

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            split = [planes(d, c) for d, c in zip(rows["data"].to_pylist(), rows["channels"].to_pylist(), strict=True)]
            out = rows.select([id_col, "width", "height"]).rename_columns(["image_id", "width", "height"])
            for k, c in enumerate(("r", "g", "b", "a")):
                out = out.append_column(c, pa.array([s[k].astype(np.int32) for s in split], arrow.field(c).type))
            yield from out.to_batches()

    return images.select(id_col, "width", "height", "channels", "data").mapInArrow(
        run, f"image_id {id_type}, width int, height int, r array<int>, g array<int>, b array<int>, a array<int>"
    )


def export_images(df: DataFrame, path: str, payload_col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Write images with a payload as Parquet partitioned by ``output_format``: ``(written, errors)``.

    Rows without a payload become error rows next to the export.
    """
    spark = df.sparkSession
    schema = df.schema
    df = checkpointed(df)  # planned and computed once for both outputs
    ready = F.col(payload_col).isNotNull()
    df.where(ready).write.partitionBy("output_format").parquet(f"{path}/images")
    failed = df.where(~ready).select("image_id", "file_name", F.lit("no image data").alias("error"))
    failed.write.parquet(f"{path}/errors")
    exported = spark.read.schema(schema).parquet(f"{path}/images")
    return exported, spark.read.schema(failed.schema).parquet(f"{path}/errors")
