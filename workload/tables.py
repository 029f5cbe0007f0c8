"""Operator inputs derived from the driver tables, as DataFrames and as SQL for the checks.

Every embedding is an 8x8 image (its values shifted to 0..255), every part an image file of the
manifest, every event a status message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.numeric import clamp8
from framelake.operators.tensors import unpack_pixels

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("vec_id").alias("original_index"), "embedding"
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed images: row-major channel arrays."""
    e = F.col("e")
    places = F.sequence(F.lit(0), F.size("e") - 1)

    def channel(shift: int):
        return F.transform(places, lambda k: clamp8((e[(k + shift) % F.size(e)] + 0.5) * 255.0))

    return (
        vectors(spark, sf_dir)
        .select("image_id", F.col("embedding").cast("array<double>").alias("e"))
        .select(
            "image_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"),
            channel(0).alias("r"), channel(21).alias("g"), channel(42).alias("b"),
            F.transform(places, lambda k: F.when(k % 10 == 0, 0).otherwise(255)).alias("a"),
        )
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack_pixels(images(spark, sf_dir))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray plane ``v``: the red channel."""
    return pixels(spark, sf_dir).select("image_id", "x", "y", F.col("r").alias("v"), "width", "height")


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed images whose three channels are the red one, so that their luma is the gray plane."""
    return images(spark, sf_dir).select("image_id", "width", "height", *[F.col("r").alias(c) for c in "rgb"], "a")


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the embedding images."""
    return vectors(spark, sf_dir).select(
        "image_id", "original_index", (F.lit(SIDE) + F.col("image_id") % 3).cast("int").alias("width"),
        F.lit(SIDE).alias("height"), F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".png")).alias("name"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".png", ".webp", ".heic", ".HEIF", "")])
    mime = F.array(*[F.lit(x) for x in (
        "image/jpeg", "image/jpeg", "image/png", "image/webp", "image/heic", "image/heif", "")])
    at = (k % 7).cast("int")
    return table(spark, sf_dir, "part").select(
        k.alias("image_id"), k.alias("original_index"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k.cast("string"), F.get(ext, at)).alias("name"),
        F.get(mime, at).alias("mime"),
        (F.col("p_retailprice") * 1000).cast("long").alias("size_bytes"),
        (F.lit(200) + (k * 37) % 3000).cast("int").alias("width"),
        (F.lit(150) + (k * 53) % 2600).cast("int").alias("height"),
        (k % 5 == 0).alias("background_removed"),
        F.concat_ws(" ", "p_name", "p_brand").alias("description"),
    )


def status_log(events: DataFrame) -> DataFrame:
    """Worker messages from an events frame, batch or streaming."""
    kind = F.col("event_type")
    return events.select(
        "event_id", "ts", F.col("user_id").alias("image_id"),
        F.when(kind == "view", "loading_progress").when(kind == "click", "processing")
        .when(kind == "purchase", "extraction_complete").when(kind == "error", "error").otherwise("initializing").alias("status"),
        F.get_json_object("props", "$.k").cast("int").alias("progress"),
        F.concat(F.lit("message "), F.col("event_id").cast("string")).alias("message"),
    )


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = "^([a-z]+://[^/?#]+)([^?#]*)(?:[?]([^#]*))?"
    return table(spark, sf_dir, "pages").select(
        "page_id", *[F.regexp_extract("url", pattern, k + 1).alias(c) for k, c in enumerate(("origin", "path", "query"))]
    )


# ---- the same inputs in SQL (common table expressions) ----

SQL_PIXELS = """
img AS (SELECT vec_id AS image_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
px AS MATERIALIZED (SELECT image_id, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y,
  CAST(least(greatest(round_even((e[pos + 1] + 0.5e0) * 255e0, 0), 0), 255) AS INTEGER) AS r,
  CAST(least(greatest(round_even((e[(pos + 21) % 64 + 1] + 0.5e0) * 255e0, 0), 0), 255) AS INTEGER) AS g,
  CAST(least(greatest(round_even((e[(pos + 42) % 64 + 1] + 0.5e0) * 255e0, 0), 0), 255) AS INTEGER) AS b,
  CAST(CASE WHEN pos % 10 = 0 THEN 0 ELSE 255 END AS INTEGER) AS a
  FROM img, range(64) t(pos))"""

SQL_MANIFEST = """
mf AS (SELECT p_partkey AS image_id, p_partkey AS original_index,
  replace(p_name, ' ', '_') || '_' || p_partkey
    || ['.jpg', '.JPEG', '.png', '.webp', '.heic', '.HEIF', ''][p_partkey % 7 + 1] AS name,
  ['image/jpeg', 'image/jpeg', 'image/png', 'image/webp', 'image/heic', 'image/heif', ''][p_partkey % 7 + 1] AS mime,
  CAST(trunc(p_retailprice * 1000e0) AS BIGINT) AS size_bytes,
  CAST(200 + (p_partkey * 37) % 3000 AS INTEGER) AS width,
  CAST(150 + (p_partkey * 53) % 2600 AS INTEGER) AS height,
  p_partkey % 5 = 0 AS background_removed,
  p_name || ' ' || p_brand AS description FROM part)"""

SQL_STATUS = """
st AS (SELECT event_id, ts, user_id AS image_id,
  CASE event_type WHEN 'view' THEN 'loading_progress' WHEN 'click' THEN 'processing'
    WHEN 'purchase' THEN 'extraction_complete' WHEN 'error' THEN 'error' ELSE 'initializing' END AS status,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS progress,
  'message ' || event_id AS message FROM events)"""

SQL_VECTORS = """
vec AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)"""

SQL_URLS = r"""
up AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)([^?#]*)(?:[?]([^#]*))?', 1) AS origin,
  regexp_extract(url, '^([a-z]+://[^/?#]+)([^?#]*)(?:[?]([^#]*))?', 2) AS path,
  regexp_extract(url, '^([a-z]+://[^/?#]+)([^?#]*)(?:[?]([^#]*))?', 3) AS query FROM pages)"""


def sql_store(value: str) -> str:
    """8-bit store in SQL."""
    return f"CAST(least(greatest(round_even({value}, 0), 0), 255) AS INTEGER)"


def sql_half_up8(value: str) -> str:
    return f"CAST(least(greatest(floor(({value}) + 0.5e0), 0), 255) AS INTEGER)"
