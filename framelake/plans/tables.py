"""Fixed parameter tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.keyed import constant_table

# fixed values: resize presets (height None keeps the aspect ratio)
PRESETS = [
    {"preset_id": "web-optimized", "width": 1080, "height": None, "quality": 75},
    {"preset_id": "standard", "width": 1080, "height": None, "quality": 85},
    {"preset_id": "high-quality", "width": 1440, "height": None, "quality": 95},
    {"preset_id": "max-quality", "width": 2160, "height": None, "quality": 100},
    {"preset_id": "custom", "width": 1080, "height": None, "quality": 85},
]
PRESET_SCHEMA = pa.schema([("preset_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("quality", pa.int32())])

# fixed values: neutral adjustments
NEUTRAL = {"brightness": 0.0, "contrast": 0.0, "hue": 100.0, "saturation": 100.0, "lightness": 100.0,
           "sharpen": 0.0, "red_scale": 1.0, "green_scale": 1.0, "blue_scale": 1.0}

# fixed values: named looks; what a look leaves out stays neutral
LOOKS = {
    "vivid": {"saturation": 120, "lightness": 110, "contrast": 10},
    "sharp": {"sharpen": 1.5, "brightness": 10, "contrast": 15},
    "classic": {"red_scale": 1.1, "green_scale": 1.0, "blue_scale": 0.9, "saturation": 90, "lightness": 105},
    "clean": {"contrast": 5, "brightness": 10, "sharpen": 0.2, "saturation": 95, "lightness": 105},
    "white-bg": {"brightness": 25, "contrast": 15, "sharpen": 0.2, "saturation": 90, "lightness": 115},
    "dramatic": {"contrast": 25, "brightness": 5, "sharpen": 0.3, "saturation": 110, "lightness": 95},
    "jewelry": {"contrast": 15, "brightness": 10, "sharpen": 0.4, "red_scale": 1.05, "green_scale": 1.02,
                "blue_scale": 1.1, "saturation": 85, "lightness": 108},
    "soft-product": {"contrast": 5, "brightness": 15, "sharpen": 0, "saturation": 105, "lightness": 110,
                     "red_scale": 1.02, "green_scale": 1.02, "blue_scale": 1.0},
    "textile": {"contrast": 12, "brightness": 8, "sharpen": 0.2, "saturation": 110, "lightness": 103,
                "red_scale": 1.02, "green_scale": 1.0, "blue_scale": 0.98},
    "food": {"contrast": 18, "brightness": 5, "sharpen": 0.2, "saturation": 115, "lightness": 105,
             "red_scale": 1.05, "green_scale": 1.03, "blue_scale": 0.97},
    "furniture": {"contrast": 10, "brightness": 8, "sharpen": 0.5, "saturation": 95, "lightness": 102,
                  "red_scale": 1.03, "green_scale": 1.0, "blue_scale": 0.95},
    "transparent": {"contrast": 20, "brightness": 12, "sharpen": 0.3, "saturation": 85, "lightness": 112,
                    "red_scale": 0.98, "green_scale": 1.0, "blue_scale": 1.04},
}

# fixed values: encoder quality by stage and format; preset_wins lets a preset's quality replace it
ENCODING_RULES = [
    {"stage": "edit", "format": "jpg", "mime": "image/jpeg", "quality": 0.85, "preset_wins": True},
    {"stage": "edit", "format": "png", "mime": "image/png", "quality": 0.85, "preset_wins": True},
    {"stage": "download", "format": "jpg", "mime": "image/jpeg", "quality": 0.9, "preset_wins": False},
    {"stage": "download", "format": "webp", "mime": "image/webp", "quality": 0.8, "preset_wins": False},
    {"stage": "download", "format": "png", "mime": "image/png", "quality": 1.0, "preset_wins": False},
    {"stage": "zip", "format": "jpg", "mime": "image/jpeg", "quality": 0.9, "preset_wins": False},
    {"stage": "zip", "format": "webp", "mime": "image/webp", "quality": 0.9, "preset_wins": False},
    {"stage": "zip", "format": "png", "mime": "image/png", "quality": None, "preset_wins": False},
    {"stage": "convert", "format": "jpg", "mime": "image/jpg", "quality": 0.95, "preset_wins": True},
    {"stage": "convert", "format": "png", "mime": "image/png", "quality": 0.95, "preset_wins": True},
    {"stage": "convert", "format": "webp", "mime": "image/webp", "quality": 0.95, "preset_wins": True},
    {"stage": "convert", "format": "avif", "mime": "image/avif", "quality": 0.95, "preset_wins": True},
    {"stage": "thumbnail", "format": "png", "mime": "image/png", "quality": 1.0, "preset_wins": False},
    {"stage": "thumbnail", "format": "jpg", "mime": "image/jpeg", "quality": 0.95, "preset_wins": False},
]

# fixed values: watermark positions
WATERMARK_POSITIONS = ("topLeft", "topRight", "bottomLeft", "bottomRight", "center", "diagonal", "tile")


def presets(spark: SparkSession) -> DataFrame:
    return constant_table(spark, PRESETS, PRESET_SCHEMA)


def looks(spark: SparkSession) -> DataFrame:
    schema = pa.schema([("look", pa.string())] + [(c, pa.float64()) for c in NEUTRAL])
    rows = [{"look": name, **{c: None if c not in given else float(given[c]) for c in NEUTRAL}} for name, given in LOOKS.items()]
    return constant_table(spark, rows, schema)


def custom_preset(spark: SparkSession, width: str | None, height: str | None, quality: str | None, keep_aspect: bool) -> DataFrame:
    """The custom row from form input: unusable numbers fall back to 1080 wide, free height, quality 85."""

    def number(text: str | None) -> int | None:
        digits = (text or "").strip()
        kept = digits[: next((k for k, c in enumerate(digits) if not c.isdigit()), len(digits))]
        return int(kept) if kept and int(kept) else None

    row = {"preset_id": "custom", "width": number(width) or 1080,
           "height": None if keep_aspect else number(height), "quality": number(quality) or 85}
    return constant_table(spark, [row], PRESET_SCHEMA)


def resolve_preset(all_presets: DataFrame, custom: DataFrame, selected_id: str | None = None) -> DataFrame:
    """Preset list with the custom row replacing its namesake; optionally only the selected one."""
    merged = all_presets.join(custom.select("preset_id"), "preset_id", "left_anti").unionByName(custom)
    return merged if selected_id is None else merged.where(F.col("preset_id") == selected_id)
