"""Filters, projections and bookkeeping on the image manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.keyed import global_index

# fixed values: HEIC/HEIF names, mime types and file signatures (hex of the first 12 bytes)
HEIC_EXTENSIONS = (".heic", ".heif")
HEIC_MIMES = ("image/heic", "image/heif")
HEIC_SIGNATURES = ("66747970686569", "6674797068656a", "66747970686576")


def detect_heic(manifest: DataFrame) -> DataFrame:
    """Add ``is_heic``: by extension or mime, else by the signature in ``content``."""
    name = F.lower("name")
    by_name = name.endswith(HEIC_EXTENSIONS[0]) | name.endswith(HEIC_EXTENSIONS[1]) | F.col("mime").isin(*HEIC_MIMES)
    head = F.lower(F.hex(F.substring("content", 1, 12)))
    by_bytes = F.lit(False)
    for mark in HEIC_SIGNATURES:
        by_bytes = by_bytes | head.contains(mark)
    return manifest.withColumn("is_heic", F.coalesce(by_name, F.lit(False)) | F.coalesce(by_bytes, F.lit(False)))


def source_format(manifest: DataFrame) -> DataFrame:
    """Add ``original_format``: the mime part after the slash, else ``unknown``."""
    part = F.get(F.split("mime", "/"), F.lit(1))
    return manifest.withColumn("original_format", F.coalesce(F.nullif(part, F.lit("")), F.lit("unknown")))


def admit_batch(existing: DataFrame, new: DataFrame, cap: int, order_by: str = "arrival") -> DataFrame:
    """Existing images plus the first new ones, in arrival order, up to ``cap`` in total.

    The cap is the caller's rule.  ``order_by`` must be unique; rows are cut by row number, so the
    admitted ones never meet in one task, whatever the cap.
    """
    room = max(cap - existing.count(), 0)
    return existing.unionByName(global_index(new, [order_by], "_at").where(F.col("_at") < room).drop("_at"))


def assign_index(existing: DataFrame, new: DataFrame, order_by: list[str], rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Number new images after the existing ones; the id is the number as text."""
    numbered = global_index(new, order_by, "original_index", existing.count(), rows_per_bucket)
    return numbered.withColumn("image_id", F.col("original_index").cast("string"))


def split_failures(df: DataFrame, result_col: str, name_col: str = "name", reason_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with a result, and error rows whose message names the image and, where one is known, the reason."""
    failed = F.col(result_col).isNull()
    message = F.concat(F.lit("No result for "), F.col(name_col))
    if reason_col:
        message = F.concat(message, F.coalesce(F.concat(F.lit(": "), F.col(reason_col)), F.lit("")))
    return df.where(~failed), df.where(failed).drop(result_col).withColumn("error", message)


def delete_images(manifest: DataFrame, seo: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove ``ids(image_id)`` from the manifest and the name table."""
    return manifest.join(ids, "image_id", "left_anti"), seo.join(ids, "image_id", "left_anti")


def skip_processed(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Images that have no result yet."""
    return manifest.join(results.select("image_id"), "image_id", "left_anti")


def apply_settings(manifest: DataFrame, settings: dict, selected_id=None, apply_all: bool = False) -> DataFrame:
    """Stamp settings columns on all images or on the selected one; the others keep theirs."""
    chosen = F.lit(apply_all) | (F.lit(False) if selected_id is None else F.col("image_id") == F.lit(selected_id))
    return manifest.withColumns({
        c: F.when(chosen, F.lit(v).cast(manifest.schema[c].dataType)).otherwise(F.col(c)) for c, v in settings.items()
    })


def size_label(manifest: DataFrame) -> DataFrame:
    """Add ``size_label``: two-decimal KB, or MB from 1024 KB on, in exact integer arithmetic."""
    size = F.col("size_bytes").cast("long")

    def hundredths(unit: int, name: str):
        n = F.floor((size * 100 + unit // 2) / F.lit(unit))
        return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit(name))

    return manifest.withColumn("size_label", F.when(size >= 1024 * 1024, hundredths(1024 * 1024, " MB")).otherwise(hundredths(1024, " KB")))
