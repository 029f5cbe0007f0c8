"""Point-wise pixel operators: narrow projections on the pixel table, no shuffle.

Pixel table: ``image_id, x, y, r, g, b, a, width, height``.  The frame size is constant per image, so
it compresses to nothing and keeps border and resize rules local to a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import color
from framelake.functions.numeric import as_column, clamp8, half_up, half_up8
from framelake.keyed import salted_lookup
from framelake.operators.stencil import sharpen

CHANNELS = ("r", "g", "b")


def _flag(value) -> Column:
    return value if isinstance(value, Column) else F.lit(bool(value))


def _store(pixels: DataFrame, new: dict[str, Column], skip_transparent) -> DataFrame:
    """Replace channels, leaving transparent pixels alone when asked to."""
    keep = _flag(skip_transparent) & (F.col("a") == 0)
    return pixels.withColumns({c: F.when(keep, F.col(c)).otherwise(v) for c, v in new.items()})


def brightness_contrast(pixels: DataFrame, brightness, contrast, skip_transparent=False) -> DataFrame:
    """Brightness shift, then contrast stretch; both zero is the identity."""
    return _store(pixels, {c: color.brightness_contrast(F.col(c), brightness, contrast) for c in CHANNELS}, skip_transparent)


def hsl_adjust(pixels: DataFrame, hue, saturation, lightness, skip_transparent=False) -> DataFrame:
    """Turn the hue, scale saturation and lightness (100 = unchanged)."""
    same = (as_column(hue) == 100) & (as_column(saturation) == 100) & (as_column(lightness) == 100)
    given = list(pixels.columns)
    moved = (F.col("_h") * 360.0 + (as_column(hue) - 100.0) * 3.6) % 360.0 / 360.0
    shifted = color.with_hsl(pixels).withColumns({
        "_h": moved,
        "_s": F.least(F.col("_s") * (as_column(saturation) / 100.0), F.lit(1.0)),
        "_l": F.least(F.col("_l") * (as_column(lightness) / 100.0), F.lit(1.0)),
    }).withColumn("_h", F.when(F.col("_h") < 0.0, F.col("_h") + 1.0).otherwise(F.col("_h")))
    new = {c: F.when(same, F.col(c)).otherwise(half_up8(F.col(f"_{c}") * 255.0)) for c in CHANNELS}
    return _store(color.with_rgb(shifted), new, skip_transparent).select(*given)


def rgb_scale(pixels: DataFrame, red, green, blue, skip_transparent=False) -> DataFrame:
    """Scale each channel (1.0 = unchanged)."""
    scales = dict(zip(CHANNELS, (red, green, blue), strict=True))
    return _store(pixels, {c: clamp8(F.col(c) * as_column(s)) for c, s in scales.items()}, skip_transparent)


def linear_contrast(pixels: DataFrame, brightness, contrast) -> DataFrame:
    """Alternate brightness/contrast: v (contrast/100 + 1) + brightness, saturating."""
    gain = as_column(contrast) / 100.0 + 1.0
    return pixels.withColumns({c: clamp8(F.col(c) * gain + as_column(brightness)) for c in CHANNELS})


def hls8_adjust(pixels: DataFrame, hue, saturation, lightness) -> DataFrame:
    """Alternate hue/lightness/saturation on 8-bit HLS: hue 0..179, the others 0..255, stores truncate."""
    given = list(pixels.columns)
    turn = (as_column(hue) - 100.0) * 180.0 / 200.0

    def scaled(value: Column, factor) -> Column:
        return F.floor(F.least(F.greatest(value * (as_column(factor) / 100.0), F.lit(0.0)), F.lit(255.0))) / 255.0

    stored = color.with_hsl(pixels).withColumns({
        "_h": half_up(F.col("_h") * 180.0) % 180, "_l": half_up(F.col("_l") * 255.0), "_s": half_up(F.col("_s") * 255.0),
    })
    changed = stored.withColumns({
        "_h": F.floor((F.col("_h") + turn + 180.0) % 180.0) / 180.0,
        "_l": scaled(F.col("_l"), lightness), "_s": scaled(F.col("_s"), saturation),
    })
    return color.with_rgb(changed).withColumns({c: half_up8(F.col(f"_{c}") * 255.0) for c in CHANNELS}).select(*given)


ADJUSTMENTS = ("brightness", "contrast", "hue", "saturation", "lightness", "sharpen",
               "red_scale", "green_scale", "blue_scale")


def adjust_images(images: DataFrame, adjustments: DataFrame) -> DataFrame:
    """``adjust_pipeline`` for packed images: settings join images, not pixels; only sharpening deals pixels to tiles."""
    cells = F.posexplode(F.arrays_zip("r", "g", "b", "a"))
    settings = [c for c in adjustments.columns if c != "image_id"]
    p = images.join(adjustments, "image_id").select("image_id", "width", "height", *settings, cells.alias("_pos", "_p")).select(
        "image_id", (F.col("_pos") % F.col("width")).cast("int").alias("x"), F.floor(F.col("_pos") / F.col("width")).cast("int").alias("y"),
        *[F.col("_p")[c].cast("int").alias(c) for c in (*CHANNELS, "a")], F.col("width").cast("int").alias("width"),
        F.col("height").cast("int").alias("height"), *settings,
    )
    return _adjusted(p, ["image_id", "x", "y", *CHANNELS, "a", "width", "height"])


def adjust_pipeline(pixels: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Brightness/contrast, HSL, RGB, sharpen, in that order, with per-image settings.

    ``adjustments`` has one row per image: ``image_id``, the nine settings, ``skip_transparent`` and
    ``pixel_count`` (its number of pixels, which decides whether the lookup is salted).
    """
    given = list(pixels.columns)
    return _adjusted(salted_lookup(pixels, adjustments, ["image_id"], weight="pixel_count", spread=["x", "y"]), given)


def _adjusted(p: DataFrame, given: list[str]) -> DataFrame:
    """The four steps on pixels that carry their image's settings."""
    skip = F.col("skip_transparent")
    p = brightness_contrast(p, F.col("brightness"), F.col("contrast"), skip)
    p = hsl_adjust(p, F.col("hue"), F.col("saturation"), F.col("lightness"), skip)
    p = rgb_scale(p, F.col("red_scale"), F.col("green_scale"), F.col("blue_scale"), skip)
    return sharpen(p.select(*given, "sharpen", "skip_transparent"), F.col("sharpen"), skip).select(*given)


def to_gray(pixels: DataFrame) -> DataFrame:
    """8-bit luma as ``v``."""
    return pixels.select("image_id", "x", "y", color.luma(F.col("r"), F.col("g"), F.col("b")).alias("v"), "width", "height")


def stretch_gamma(luma: DataFrame, gamma: float = 0.7) -> DataFrame:
    """Stretch each image's values to 0..1, apply the power and scale to 0..255.

    A constant image is not stretched: its value itself goes through the power.
    """
    given = list(luma.columns)
    spans = luma.groupBy("image_id").agg(
        F.min("v").alias("_low"), F.max("v").alias("_high"), F.count(F.lit(1)).alias("_pixels")
    )
    joined = salted_lookup(luma, spans, ["image_id"], weight="_pixels", spread=["x", "y"])
    span = F.col("_high") - F.col("_low")
    unit = F.when(span > 0, (F.col("v") - F.col("_low")) / F.nullif(span, F.lit(0.0))).otherwise(F.col("v"))
    return joined.withColumn("v", half_up8(F.pow(unit, F.lit(gamma)) * 255.0)).select(*given)


def preserve_color(luma: DataFrame, pixels: DataFrame) -> DataFrame:
    """Give new luminance the colours of the original; near-black pixels become gray."""
    at = ["image_id", "x", "y"]
    joined = pixels.join(luma.select(*at, "v"), at)
    base = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
    ratio = F.least(F.greatest(F.col("v") / F.nullif(base, F.lit(0.0)), F.lit(0.2)), F.lit(2.0))
    new = {c: F.when(base > 5, half_up8(F.col(c) * ratio)).otherwise(F.col("v")) for c in CHANNELS}
    return joined.withColumns({**new, "a": F.lit(255)}).select(*pixels.columns)
