"""Colour arithmetic on 8-bit channels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.numeric import as_column, clamp8


def contrast_factor(contrast) -> Column:
    c = as_column(contrast)
    return (F.lit(259.0) * (c + 255.0)) / (F.lit(255.0) * (F.lit(259.0) - c))


def brightness_contrast(value: Column, brightness, contrast) -> Column:
    """Shift, store, stretch around 128, store: the first store already clamps and rounds."""
    shifted = clamp8(value + as_column(brightness))
    return clamp8(contrast_factor(contrast) * (shifted - 128) + 128.0)


def luma(r: Column, g: Column, b: Column) -> Column:
    """0.299 R + 0.587 G + 0.114 B, rounded half up in integer arithmetic."""
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")


# The conversions below work on helper columns.  Each step is its own projection, so a value is computed
# once per pixel and everything stays in generated code.


def with_hsl(pixels: DataFrame) -> DataFrame:
    """Add ``_h, _s, _l`` (0..1) of ``r, g, b``; on equal maxima red wins over green over blue."""
    channels = ("r", "g", "b")
    ends = pixels.withColumns({
        **{f"_{c}": F.col(c) / 255.0 for c in channels},
        "_top": F.greatest(*channels) / 255.0, "_low": F.least(*channels) / 255.0,
    })
    r, g, b = F.col("_r"), F.col("_g"), F.col("_b")
    top, low = F.col("_top"), F.col("_low")
    ends = ends.withColumns({"_span": F.nullif(top - low, F.lit(0.0)), "_l": (top + low) / 2.0})
    span, light = F.col("_span"), F.col("_l")
    gray = span.isNull()
    return ends.withColumns({
        "_s": F.when(gray, 0.0).when(light > 0.5, span / F.nullif(F.lit(2.0) - top - low, F.lit(0.0)))
        .otherwise(span / F.nullif(top + low, F.lit(0.0))),
        "_h": (
            F.when(gray, 0.0)
            .when(top == r, (g - b) / span + F.when(g < b, 6.0).otherwise(0.0))
            .when(top == g, (b - r) / span + 2.0)
            .otherwise((r - g) / span + 4.0)
        ) / 6.0,
    })


def _turned(t: Column) -> Column:
    """A hue back in 0..1."""
    return F.when(t < 0.0, t + 1.0).when(t > 1.0, t - 1.0).otherwise(t)


def with_rgb(pixels: DataFrame) -> DataFrame:
    """Add ``_r, _g, _b`` (0..1) of ``_h, _s, _l``."""
    h, s, light = F.col("_h"), F.col("_s"), F.col("_l")
    thirds = {"_r": 1 / 3, "_g": 0.0, "_b": -1 / 3}
    ready = pixels.withColumns({
        "_q": F.when(light < 0.5, light * (s + 1.0)).otherwise(light + s - light * s),
        **{c: _turned(h + F.lit(third)) for c, third in thirds.items()},
    }).withColumn("_p", light * 2.0 - F.col("_q"))
    p, q = F.col("_p"), F.col("_q")

    def channel(t: Column) -> Column:
        return (
            F.when(s == 0.0, light)
            .when(t < 1 / 6, p + (q - p) * 6.0 * t)
            .when(t < 1 / 2, q)
            .when(t < 2 / 3, p + (q - p) * (F.lit(2 / 3) - t) * 6.0)
            .otherwise(p)
        )

    return ready.withColumns({c: channel(F.col(c)) for c in thirds})
