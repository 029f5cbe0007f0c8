"""Resizing, masking and overlaying pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.numeric import clamp8, half_up
from framelake.keyed import salted_lookup

CHANNELS = ("r", "g", "b", "a")


def _cells_of(axis: str, size: str, target: str) -> Column:
    """Target cells one source coordinate overlaps, with the overlap in 1/(size*target) units."""
    at, n, m = F.col(axis).cast("long"), F.col(size).cast("long"), F.col(target).cast("long")
    first = F.floor(at * m / n)
    last = F.floor(((at + 1) * m - 1) / n)
    return F.transform(
        F.sequence(first, last),
        lambda t: F.struct(
            t.cast("int").alias("at"),
            (F.least((at + 1) * m, (t + 1) * n) - F.greatest(at * m, t * n)).alias("w"),
        ),
    )


def area_resize(pixels: DataFrame, plan: DataFrame) -> DataFrame:
    """Shrink to ``plan(image_id, target_w, target_h, pixel_count)`` by exact area average.

    Overlaps are integers, so sums do not depend on their order.  The aggregate combines before the
    shuffle: neighbouring pixels usually sit in one partition.
    """
    sized = salted_lookup(pixels, plan, ["image_id"], weight="pixel_count", spread=["x", "y"])
    spread = (
        sized.withColumn("_cx", F.explode(_cells_of("x", "width", "target_w")))
        .withColumn("_cy", F.explode(_cells_of("y", "height", "target_h")))
        .withColumn("_w", F.col("_cx.w") * F.col("_cy.w"))
    )
    sums = spread.groupBy("image_id", F.col("_cx.at").alias("x"), F.col("_cy.at").alias("y"), "target_w", "target_h").agg(
        *[F.sum(F.col(c) * F.col("_w")).alias(c) for c in CHANNELS], F.sum("_w").alias("_w")
    )
    return sums.select(
        "image_id", "x", "y", *[clamp8(F.col(c) / F.col("_w")).alias(c) for c in CHANNELS],
        F.col("target_w").alias("width"), F.col("target_h").alias("height"),
    )


def apply_alpha_mask(pixels: DataFrame, mask: DataFrame, images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Use mask channel 0 as alpha: ``(pixels, errors)``.

    ``mask(image_id, x, y, m)`` holds channel 0; ``images`` and ``masks`` hold ``image_id, width,
    height`` of either side.  Images without a mask, or with one of another size, become errors.
    """
    sizes = images.select("image_id", "width", "height").join(
        masks.select("image_id", F.col("width").alias("mask_w"), F.col("height").alias("mask_h")), "image_id", "left"
    )
    fits = F.coalesce((F.col("mask_w") == F.col("width")) & (F.col("mask_h") == F.col("height")), F.lit(False))
    errors = sizes.where(~fits).select("image_id", F.when(F.col("mask_w").isNull(), F.lit("no mask")).otherwise(F.concat(
        F.lit("mask is "), F.concat_ws("x", "mask_w", "mask_h"), F.lit(", image is "), F.concat_ws("x", "width", "height"),
    )).alias("error"))
    # pixels and mask meet on (image, x, y); the size test needs no join because pixels carry their
    # frame size and mask pixels are given theirs
    framed = mask.select("image_id", "x", "y", F.col("m").cast("int").alias("_m"), F.col("width").alias("_mw"), F.col("height").alias("_mh"))
    out = (
        pixels.join(framed, ["image_id", "x", "y"])
        .where((F.col("width") == F.col("_mw")) & (F.col("height") == F.col("_mh")))
        .withColumn("a", F.col("_m")).select(*pixels.columns)
    )
    return out, errors


def overlay_logo(pixels: DataFrame, logo: DataFrame, tiles: DataFrame, opacity: float) -> DataFrame:
    """Draw ``logo(lx, ly, r, g, b, a)`` at every ``tiles(image_id, x, y)`` with source-over blending.

    Tile origins are half-up rounded to the pixel grid; overlapping tiles blend in draw order (y,
    then x).  A pixel finds its tiles through grid cells of logo size: a tile touches at most four
    cells, a pixel lies in one, so nothing is matched against all tiles of its image.
    """
    given = list(pixels.columns)
    size = logo.agg((F.max("lx") + 1).alias("lw"), (F.max("ly") + 1).alias("lh")).first()
    if size["lw"] is None:
        return pixels
    lw, lh = size["lw"], size["lh"]
    placed = (
        tiles.select("image_id", half_up(F.col("x")).alias("_tx"), half_up(F.col("y")).alias("_ty"))
        .withColumn("_bx", F.explode(F.sequence(F.floor(F.col("_tx") / lw), F.floor((F.col("_tx") + lw - 1) / lw))))
        .withColumn("_by", F.explode(F.sequence(F.floor(F.col("_ty") / lh), F.floor((F.col("_ty") + lh - 1) / lh))))
    )
    stamp = logo.select("lx", "ly", *[F.col(c).alias(f"_l{c}") for c in CHANNELS])
    touched = (
        pixels.withColumn("_bx", F.floor(F.col("x") / lw)).withColumn("_by", F.floor(F.col("y") / lh))
        .join(placed, ["image_id", "_bx", "_by"])
        .where(F.col("x").between(F.col("_tx"), F.col("_tx") + lw - 1) & F.col("y").between(F.col("_ty"), F.col("_ty") + lh - 1))
        .withColumn("lx", (F.col("x") - F.col("_tx")).cast("int")).withColumn("ly", (F.col("y") - F.col("_ty")).cast("int"))
        .join(stamp, ["lx", "ly"])
        .groupBy("image_id", "x", "y")
        .agg(F.sort_array(F.collect_list(F.struct("_ty", "_tx", *[f"_l{c}" for c in CHANNELS]))).alias("_layers"))
    )

    def blend(under: Column, layer: Column) -> Column:
        top = layer["_la"] / 255.0 * F.lit(float(opacity))
        below = under["a"] / 255.0
        out = top + below * (F.lit(1.0) - top)
        mixed = [
            F.when(out == 0.0, F.lit(0)).otherwise(clamp8(
                (layer[f"_l{c}"] * top + under[c] * (below * (F.lit(1.0) - top))) / F.nullif(out, F.lit(0.0))
            )).alias(c)
            for c in ("r", "g", "b")
        ]
        return F.struct(*mixed, clamp8(out * 255.0).alias("a"))

    start = F.struct(*[F.col(c).cast("int").alias(c) for c in CHANNELS])
    drawn = pixels.join(touched, ["image_id", "x", "y"], "left").withColumn(
        "_out", F.when(F.col("_layers").isNull(), start).otherwise(F.aggregate("_layers", start, blend))
    )
    return drawn.withColumns({c: F.col("_out")[c] for c in CHANNELS}).select(*given)
