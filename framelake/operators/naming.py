"""Search-friendly names, export names and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import text as T
from framelake.keyed import global_index


def seo_names(manifest: DataFrame, order_by: list[str], description_col: str = "description", rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``slug-1, slug-2, ...`` in image order, with original name, description and extension."""
    numbered = global_index(manifest, order_by, "_at", 1, rows_per_bucket)
    return numbered.select(
        "image_id", F.col("name").alias("original_name"),
        F.concat_ws("-", T.seo_slug(F.col(description_col)), F.col("_at").cast("string")).alias("seo_name"),
        F.col(description_col).alias("description"),
        F.coalesce(F.nullif(T.last_extension(F.col("name")), F.lit("")), F.lit("jpg")).alias("extension"),
    )


def apply_seo_names(manifest: DataFrame, seo: DataFrame) -> DataFrame:
    """Write names back by id; images without one are unchanged."""
    new = seo.select("image_id", F.col("seo_name").alias("_seo"))
    matched = F.col("_seo").isNotNull()
    return manifest.join(new, "image_id", "left").withColumns({
        "seo_name": F.coalesce("_seo", "seo_name"),
        "original_name": F.when(matched, F.col("name")).otherwise(F.col("original_name")),
    }).drop("_seo")


def export_name(manifest: DataFrame, fmt: str, order_by: list[str], rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Add ``output_format`` and ``file_name``: the search name, else base name and position."""
    numbered = global_index(manifest, order_by, "_at", 1, rows_per_bucket)
    target = F.when(F.col("background_removed"), "png").otherwise(fmt)
    plain = F.concat_ws("_", T.base_name(F.col("name")), F.col("_at").cast("string"))
    stem = F.coalesce(F.nullif(F.col("seo_name"), F.lit("")), plain)
    return numbered.withColumn("output_format", target).withColumn(
        "file_name", F.concat_ws(".", stem, F.col("output_format"))
    ).drop("_at")


def display_name(manifest: DataFrame) -> DataFrame:
    """Add ``display_name``: search name with the original's extension, else the file name."""
    ext = F.when(F.col("name").contains("."), F.lower(T.last_extension(F.col("name")))).otherwise("")
    named = F.nullif(F.col("seo_name"), F.lit("")).isNotNull()
    return manifest.withColumn("display_name", F.when(named, F.concat("seo_name", F.lit("."), ext)).otherwise(F.col("name")))


def caption_assemble(chunks: DataFrame, run: int = 1000) -> DataFrame:
    """One caption per image from ``chunks(image_id, seq, kind, text)``.

    Stream chunks are joined in order; a ``complete`` chunk replaces them, trimmed; an ``error``
    keeps what arrived.  Runs of ``run`` chunks are joined first, so a very long stream is spread
    over tasks and only its pieces meet.
    """
    streamed = F.when(F.col("kind") == "stream", F.struct("seq", "text"))
    done = F.when(F.col("kind") == "complete", F.struct("seq", "text"))
    pieces = chunks.groupBy("image_id", F.floor(F.col("seq") / run).alias("_run")).agg(
        F.array_join(F.sort_array(F.collect_list(streamed))["text"], "").alias("_piece"),
        F.max(done).alias("_done"),
        F.max(F.col("kind") == "error").alias("_failed"),
    )
    whole = pieces.groupBy("image_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("_run", "_piece")))["_piece"], "").alias("_partial"),
        F.max("_done").alias("_done"), F.max("_failed").alias("failed"),
    )
    return whole.select(
        "image_id", F.coalesce(T.trim_space(F.col("_done.text")), F.col("_partial")).alias("caption"),
        F.col("_done").isNotNull().alias("completed"), "failed",
    )
