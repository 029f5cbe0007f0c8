"""Packed images, tensors and the pixel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.numeric import clamp8


def unpack_pixels(images: DataFrame) -> DataFrame:
    """``images(image_id, width, height, r, g, b, a)`` with row-major channel arrays -> pixel table."""
    cells = F.posexplode(F.arrays_zip("r", "g", "b", "a"))
    return images.select("image_id", "width", "height", cells.alias("pos", "p")).select(
        "image_id",
        (F.col("pos") % F.col("width")).cast("int").alias("x"),
        F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"),
        *[F.col("p")[c].cast("int").alias(c) for c in ("r", "g", "b", "a")],
        F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
    )


def unpack_values(images: DataFrame) -> DataFrame:
    """Like ``unpack_pixels`` for channels of any number type, without alpha."""
    cells = F.posexplode(F.arrays_zip("r", "g", "b"))
    return images.select("image_id", "width", "height", cells.alias("pos", "p")).select(
        "image_id",
        (F.col("pos") % F.col("width")).cast("int").alias("x"),
        F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"),
        *[F.col("p")[c].alias(c) for c in ("r", "g", "b")], "width", "height",
    )


def _by_rows(pixels: DataFrame, values: list[str]) -> DataFrame:
    """One row per image with row-major arrays.

    Image lines are assembled first, so the per-image step sorts lines instead of pixels.
    """
    lines = pixels.groupBy("image_id", "width", "height", "y").agg(
        F.sort_array(F.collect_list(F.struct("x", *values))).alias("_line")
    )
    whole = lines.groupBy("image_id", "width", "height").agg(
        F.sort_array(F.collect_list(F.struct("y", "_line"))).alias("_lines")
    )
    flat = F.flatten(F.col("_lines")["_line"])
    return whole.select("image_id", "width", "height", *[flat[v].alias(v) for v in values])


def pack_pixels(pixels: DataFrame) -> DataFrame:
    """Pixel table -> one row per image with row-major channel arrays."""
    return _by_rows(pixels, ["r", "g", "b", "a"])


def to_tensor(pixels: DataFrame, gray: bool = False) -> DataFrame:
    """NCHW floats in 0..1: ``image_id, tensor STRUCT<dims ARRAY<INT>, data ARRAY<FLOAT>>``; alpha is dropped.

    The gray form takes one channel, the red one.
    """
    planes = ["r"] if gray else ["r", "g", "b"]
    unit = pixels.select(
        "image_id", "width", "height", "x", "y", *[(F.col(c) / F.lit(255.0)).cast("float").alias(c) for c in planes]
    )
    dims = F.array(F.lit(1), F.lit(len(planes)), F.col("height"), F.col("width"))
    return _by_rows(unit, planes).select("image_id", F.struct(dims.alias("dims"), F.concat(*planes).alias("data")).alias("tensor"))


def from_tensor(tensors: DataFrame) -> DataFrame:
    """NCHW floats in 0..1 -> pixel table; one channel is gray, a fourth one alpha, without it pixels are opaque."""
    channels, height, width = F.col("tensor.dims")[1], F.col("tensor.dims")[2], F.col("tensor.dims")[3]
    area, data = height * width, F.col("tensor.data")

    def plane(k: int) -> Column:
        place = F.when(channels == 1, 0).otherwise(k)
        part = F.slice(data, (area * place + 1).cast("int"), area)
        return (part if k < 3 else F.when(channels == 4, part).otherwise(F.array_repeat(F.lit(1.0).cast("float"), area))).alias("rgba"[k])

    framed = tensors.select("image_id", height.alias("height"), width.alias("width"), *[plane(k) for k in range(4)])
    cells = F.posexplode(F.arrays_zip("r", "g", "b", "a"))
    return framed.select("image_id", "width", "height", cells.alias("pos", "p")).select(
        "image_id",
        (F.col("pos") % F.col("width")).cast("int").alias("x"),
        F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"),
        *[clamp8(F.col("p")[c].cast("double") * 255.0).alias(c) for c in "rgba"], "width", "height",
    )
