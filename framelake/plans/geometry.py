"""Target sizes, paddings and watermark boxes as column expressions on the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.numeric import half_up

def _width() -> Column:
    return F.col("width")


def _height() -> Column:
    return F.col("height")


def _sized(manifest: DataFrame, w: Column, h: Column) -> DataFrame:
    return manifest.withColumns({"target_w": w.cast("int"), "target_h": h.cast("int")})


def plan_resize(manifest: DataFrame, presets: DataFrame) -> DataFrame:
    """Target size from the preset named in ``preset_id``; without one the source size."""
    p = presets.select("preset_id", F.col("width").alias("_pw"), F.col("height").alias("_ph"))
    pw, ph = F.nullif(F.col("_pw"), F.lit(0)), F.nullif(F.col("_ph"), F.lit(0))
    w = F.when(pw.isNotNull(), pw).when(ph.isNotNull(), half_up(_width() * (ph / _height()))).otherwise(_width())
    h = F.when(ph.isNotNull(), ph).when(pw.isNotNull(), half_up(_height() * (pw / _width()))).otherwise(_height())
    return _sized(manifest.join(p, "preset_id", "left"), w, h).drop("_pw", "_ph")


def plan_preview(manifest: DataFrame, max_width: int = 800) -> DataFrame:
    """Cap the width only."""
    wide = _width() > max_width
    return _sized(manifest, F.when(wide, max_width).otherwise(_width()), F.when(wide, half_up(_height() * (F.lit(float(max_width)) / _width()))).otherwise(_height()))


def plan_thumbnail(manifest: DataFrame, max_side: int = 800) -> DataFrame:
    """Cap the longer side; the aspect ratio is formed before scaling."""
    side = F.lit(float(max_side))
    wide, tall = (_width() >= _height()) & (_width() > max_side), (_height() > _width()) & (_height() > max_side)
    return _sized(
        manifest,
        F.when(wide, side).when(tall, half_up(side * (_width() / _height()))).otherwise(_width()),
        F.when(wide, half_up(side * (_height() / _width()))).when(tall, side).otherwise(_height()),
    )


def plan_bounded_1200(manifest: DataFrame, bound: int = 1200) -> DataFrame:
    """Cap landscape images by width, all others by height, rounding the other side."""
    b = F.lit(float(bound))
    wide, tall = (_width() > _height()) & (_width() > bound), _height() > bound
    return _sized(
        manifest,
        F.when(wide, b).when(tall, half_up(_width() * (b / _height()))).otherwise(_width()),
        F.when(wide, half_up(_height() * (b / _width()))).when(tall, b).otherwise(_height()),
    )


def plan_bounded_1600(manifest: DataFrame, bound: int = 1600) -> DataFrame:
    """Cap by the side that overflows more, flooring the other side."""
    b = F.lit(float(bound))
    over = (_width() > bound) | (_height() > bound)
    wide = (_width() / b) >= (_height() / b)
    return _sized(
        manifest,
        F.when(over & wide, b).when(over, F.floor(_width() / (_height() / b))).otherwise(_width()),
        F.when(over & wide, F.floor(_height() / (_width() / b))).when(over, b).otherwise(_height()),
    )


def plan_letterbox(manifest: DataFrame, target_w: int, target_h: int) -> DataFrame:
    """Fit into a box: squares fill it, portrait pads left, landscape pads top; sides stay fractional."""
    tw, th = F.lit(float(target_w)), F.lit(float(target_h))
    w = F.when(_height() > _width(), _width() / _height() * th).otherwise(tw)
    h = F.when(_width() > _height(), _height() / _width() * tw).otherwise(th)
    return manifest.withColumns({
        "box_x": F.when(_height() > _width(), F.floor((tw - w) / 2)).otherwise(F.lit(0)).cast("double"),
        "box_y": F.when(_width() > _height(), F.floor((th - h) / 2)).otherwise(F.lit(0)).cast("double"),
        "box_w": w, "box_h": h,
    })


def plan_encoding(manifest: DataFrame, rules: list[dict], stage: str, fmt: str = "jpg") -> DataFrame:
    """Output format, mime and quality of a stage, looked up in the fixed ``rules``.

    Transparent images are always png; thumbnails follow the source; conversions keep the asked
    format.  ``preset_quality`` (0-100, nullable) replaces the rule's quality where allowed.
    """
    if stage == "convert":
        target = F.lit(fmt)
    elif stage == "thumbnail":
        target = F.when(F.col("mime") == "image/png", "png").otherwise("jpg")
    else:
        target = F.when(F.col("background_removed"), "png").otherwise("jpg" if stage == "edit" else fmt)
    mime, quality = F.lit(None).cast("string"), F.lit(None).cast("double")
    for rule in rules:
        if rule["stage"] == stage:
            hit = F.col("output_format") == rule["format"]
            own = F.lit(rule["quality"]).cast("double")
            mime = F.when(hit, rule["mime"]).otherwise(mime)
            quality = F.when(hit, F.coalesce(F.col("preset_quality") / 100.0, own) if rule["preset_wins"] else own).otherwise(quality)
    return manifest.withColumn("output_format", target).withColumns({"output_mime": mime, "quality": quality})


def plan_adjustments(manifest: DataFrame, looks: DataFrame, neutral: dict[str, float]) -> DataFrame:
    """The nine adjustment columns of the look named in ``look``, neutral where it sets nothing."""
    joined = manifest.join(looks, "look", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in neutral.items()})


def _anchor(w: Column, h: Column, position: Column) -> tuple[Column, Column]:
    """Upper left corner of a w x h box; 2 % margin; bottom right unless named otherwise."""
    margin = F.least(_width(), _height()) * 0.02
    left, top = position.isin("topLeft", "bottomLeft"), position.isin("topLeft", "topRight")
    middle, free = position == "center", position.isin("diagonal", "tile")
    x = F.when(left, margin).when(middle, (_width() - w) / 2).when(free, 0.0).otherwise(_width() - w - margin)
    y = F.when(top, margin).when(middle, (_height() - h) / 2).when(free, 0.0).otherwise(_height() - h - margin)
    return x, y


def _active(manifest: DataFrame, watermarks: DataFrame, kind: str) -> DataFrame:
    return manifest.join(watermarks, "watermark_id").where(F.col("enabled") & (F.col("type") == kind))


def plan_watermark_box(manifest: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Box of a logo watermark: ``box_x, box_y, box_w, box_h`` for images that get one.

    ``watermarks``: ``watermark_id, enabled, type, position, size, logo_w, logo_h``.
    """
    aspect = F.col("logo_w") / F.col("logo_h")
    base = F.least(_width(), _height()) * (F.col("size") / 100.0)
    too_wide = base > _width() * 0.9
    w = F.when(too_wide, _width() * 0.9).otherwise(base)
    h = F.when(too_wide, _width() * 0.9 / aspect).otherwise(base / aspect)
    with_sides = _active(manifest, watermarks, "logo").where("logo_w is not null and logo_h is not null")
    too_tall = F.col("_h") > _height() * 0.9
    fitted = with_sides.withColumns({"_w": w, "_h": h}).withColumns({
        "box_w": half_up(F.when(too_tall, _height() * 0.9 * aspect).otherwise(F.col("_w"))).cast("int"),
        "box_h": half_up(F.when(too_tall, _height() * 0.9).otherwise(F.col("_h"))).cast("int"),
    })
    where = F.when(F.col("position") == "diagonal", "center").otherwise(F.col("position"))
    x, y = _anchor(F.col("box_w"), F.col("box_h"), where)
    return fitted.withColumns({"box_x": x.cast("double"), "box_y": y.cast("double")}).drop("_w", "_h")


def plan_watermark_text(manifest: DataFrame, watermarks: DataFrame, text_metrics: DataFrame) -> DataFrame:
    """Font size, anchor point, alignment and rotation of a text watermark.

    ``text_metrics(image_id, text_w, text_h)`` are measured by the caller.
    """
    texts = _active(manifest, watermarks, "text").join(text_metrics, "image_id")
    where, tw, th = F.col("position"), F.col("text_w"), F.col("text_h")
    x, y = _anchor(tw, th, where)
    align = F.when(where.isin("topLeft", "bottomLeft"), "left").when(where.isin("topRight", "bottomRight"), "right").otherwise("center")
    shift = F.when(align == "left", 0.0).when(align == "right", tw).otherwise(tw / 2)
    return texts.withColumns({
        "font_px": F.greatest(F.lit(10.0), F.least(_width(), _height()) * (F.col("size") / 100.0)),
        "text_x": F.when(where == "diagonal", _width() / 2).when(where == "tile", 0.0).otherwise(x + shift),
        "text_y": F.when(where == "diagonal", _height() / 2).when(where == "tile", 0.0).otherwise(y + th / 2),
        "align": align,
        "angle": F.when(where == "diagonal", -45.0).when(where == "tile", -30.0).otherwise(0.0),
    })


def plan_watermark_tiles(boxes: DataFrame, kind: str) -> DataFrame:
    """Tile origins ``(image_id, x, y)`` covering the canvas; a zero stride gives none.

    ``boxes``: ``image_id, width, height`` (canvas) and ``box_w, box_h``.
    """
    step_x, step_y = F.col("box_w") * 1.5, F.col("box_h") * (1.5 if kind == "logo" else 3.0)

    def origins(length: Column, step: Column) -> Column:
        last = F.ceil((length + step) / F.nullif(step, F.lit(0.0))).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda k: k * step)

    return (
        boxes.where((step_x > 0) & (step_y > 0))
        .withColumn("y", F.explode(origins(_height(), step_y)))
        .withColumn("x", F.explode(origins(_width(), step_x)))
        .select("image_id", "x", "y")
    )
