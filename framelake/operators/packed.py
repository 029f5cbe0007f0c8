"""Neighbourhood operators, measures and tensors on packed images: no pixel is shuffled.

A packed image is one row, ``image_id, width, height, r, g, b, a`` with row-major channel arrays.  The kernels
are those of the tiled pixel table, so both forms give the same values; a packed image already sits in
one row, the tiled form is for images that must not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framelake.functions.numeric import half_up, half_up8
from framelake.operators import stencil
from framelake.operators.quality import METRIC_SUMS, measures_from_sums, sums_of_planes

CHANNELS = ("r", "g", "b")
IMAGES_AT_ONCE = 64  # images decoded to planes together
Planes = dict[str, np.ndarray]


def _padded(plane: np.ndarray, radius: int, border: str) -> np.ndarray:
    """A plane with a frame of ``radius`` pixels, mirrored or (for "skip") repeated."""
    def source(size: int) -> np.ndarray:
        wanted = np.arange(-radius, size + radius)
        return stencil.mirrored(wanted, size) if border == "reflect101" else np.clip(wanted, 0, size - 1)

    return plane[np.ix_(source(plane.shape[0]), source(plane.shape[1]))]


def _map_images(images: DataFrame, compute: Callable[[Planes, dict], dict], fields: str, settings: tuple[str, ...] = ()) -> DataFrame:
    """Replace or add the columns of ``fields``: ``compute(planes, settings of the image)`` gives their flat values."""
    names = [f.split()[0] for f in fields.split(", ")]
    keep = [c for c in images.columns if c not in names]
    schema = StructType([images.schema[c] for c in keep]).simpleString()[7:-1] + ("," if keep else "") + ",".join(
        f"{f.split()[0]}:{f.split()[1]}" for f in fields.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, IMAGES_AT_ONCE):
                rows = pa.Table.from_batches([whole.slice(start, IMAGES_AT_ONCE)])
                sizes = zip(rows["height"].to_pylist(), rows["width"].to_pylist(), strict=True)
                shapes = list(sizes)
                made: dict[str, list] = {n: [] for n in names}
                given = {s: rows[s].to_pylist() for s in settings}
                columns = {c: rows[c].combine_chunks() for c in ("r", "g", "b", "a")}
                for k, shape in enumerate(shapes):
                    planes = {c: v[k].values.to_numpy(zero_copy_only=False).reshape(shape).astype(np.float64) for c, v in columns.items()}
                    for n, values in compute(planes, {s: v[k] for s, v in given.items()}).items():
                        made[n].append(values)
                out = rows.select(keep)
                for n in names:
                    out = out.append_column(n, pa.array(made[n]))
                yield from out.to_batches()

    return images.mapInArrow(run, schema)


def _stored(values: np.ndarray) -> np.ndarray:
    """8-bit store: ties to even, clamped."""
    return np.clip(np.rint(values), 0, 255).astype(np.int32).reshape(-1)


STORED = "r array<int>, g array<int>, b array<int>"


def convolve(images: DataFrame, kernel, border: str = "reflect101") -> DataFrame:
    """``r, g, b`` become arrays of (double) weighted neighbourhood sums; see ``stencil.convolve``."""
    separable = not isinstance(kernel[0], (list, tuple))
    radius = len(kernel) // 2
    apply = stencil.weighted_separable if separable else stencil.weighted

    def compute(planes: Planes, _: dict) -> Planes:
        out = {}
        for c in CHANNELS:
            summed = apply(_padded(planes[c], radius, border), kernel)
            if border == "skip":
                full = np.zeros(summed.shape, bool)
                full[radius:summed.shape[0] - radius, radius:summed.shape[1] - radius] = True
                summed = np.where(full, summed, planes[c])
            out[c] = summed.reshape(-1)
        return out

    return _map_images(images, compute, "r array<double>, g array<double>, b array<double>")


def sharpen(images: DataFrame, amount: Column | float, skip_transparent: Column | bool = False) -> DataFrame:
    """3x3 sharpening; see ``stencil.sharpen``."""
    wanted = amount if isinstance(amount, Column) else F.lit(float(amount))
    skip = skip_transparent if isinstance(skip_transparent, Column) else F.lit(skip_transparent)
    ready = images.withColumn("_s", wanted.cast("double")).withColumn("_skip", skip)
    compute = lambda planes, given: _sharpened(planes, given["_s"], given["_skip"])
    return _map_images(ready, compute, STORED, ("_s", "_skip")).select(*images.columns)


def _sharpened(planes: Planes, amount: float | None, skip: bool | None) -> Planes:
    t = min(amount or 0.0, 2.0)
    change = np.zeros(planes["r"].shape, bool)
    if t > 0:
        change[1:-1, 1:-1] = True
        if skip:
            change &= planes["a"] != 0
    out = {}
    for c in CHANNELS:
        v = _padded(planes[c], 1, "skip")
        total = v[:-2, 1:-1] * -t
        total += v[1:-1, :-2] * -t
        total += v[1:-1, 1:-1] * (1.0 + 4.0 * t)
        total += v[1:-1, 2:] * -t
        total += v[2:, 1:-1] * -t
        out[c] = np.where(change.reshape(-1), _stored(total), planes[c].reshape(-1).astype(np.int32))
    return out


ADJUSTMENTS = ("brightness", "contrast", "hue", "saturation", "lightness", "sharpen", "red_scale", "green_scale", "blue_scale")


def adjust(images: DataFrame, adjustments: DataFrame) -> DataFrame:
    """``pixels.adjust_pipeline`` on packed images: settings join images, one kernel runs the four steps."""
    settings = (*ADJUSTMENTS, "skip_transparent")
    ready = images.join(adjustments.select("image_id", *[F.col(c).alias(f"_{c}") for c in settings]), "image_id")

    def compute(planes: Planes, given: dict) -> Planes:
        s = {c: given[f"_{c}"] for c in settings}
        keep = planes["a"] == 0 if s["skip_transparent"] else np.zeros(planes["a"].shape, bool)
        now = {c: planes[c] for c in CHANNELS}

        def stored(new: Planes) -> Planes:
            return {c: np.where(keep, now[c], v) for c, v in new.items()}

        factor = (259.0 * (s["contrast"] + 255.0)) / (255.0 * (259.0 - s["contrast"]))
        now = stored({c: _clamped(factor * (_clamped(v + s["brightness"]) - 128) + 128.0) for c, v in now.items()})
        if not s["hue"] == s["saturation"] == s["lightness"] == 100:
            now = stored(_turned_hsl(now, s["hue"], s["saturation"], s["lightness"]))
        now = stored({c: _clamped(v * s[f"{n}_scale"]) for (c, v), n in zip(now.items(), ("red", "green", "blue"), strict=True)})
        return _sharpened({**now, "a": planes["a"]}, s["sharpen"], s["skip_transparent"])

    return _map_images(ready, compute, STORED, tuple(f"_{c}" for c in settings)).select(*images.columns)


def _clamped(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(values), 0.0, 255.0)


def _turned_hsl(planes: Planes, hue: float, saturation: float, lightness: float) -> Planes:
    """The steps of ``color.with_hsl`` and ``color.with_rgb`` with the settings between them, on planes."""
    r, g, b = (planes[c] / 255.0 for c in CHANNELS)
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span, light = top - low, (top + low) / 2.0
    gray = span == 0
    by = np.where(gray, 1.0, span)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(gray, 0.0, np.where(light > 0.5, span / (2.0 - top - low), span / (top + low)))
    h = np.select(
        [gray, top == r, top == g],
        [0.0, (g - b) / by + np.where(g < b, 6.0, 0.0), (b - r) / by + 2.0], (r - g) / by + 4.0,
    ) / 6.0
    h = np.fmod(h * 360.0 + (hue - 100.0) * 3.6, 360.0) / 360.0
    h = np.where(h < 0.0, h + 1.0, h)
    s, light = np.minimum(s * (saturation / 100.0), 1.0), np.minimum(light * (lightness / 100.0), 1.0)
    q = np.where(light < 0.5, light * (s + 1.0), light + s - light * s)
    p = light * 2.0 - q
    out = {}
    for c, third in zip(CHANNELS, (1 / 3, 0.0, -1 / 3), strict=True):
        t = h + third
        t = np.where(t < 0.0, t + 1.0, np.where(t > 1.0, t - 1.0, t))
        value = np.select([s == 0.0, t < 1 / 6, t < 1 / 2, t < 2 / 3], [light, p + (q - p) * 6.0 * t, q, p + (q - p) * (2 / 3 - t) * 6.0], p)
        out[c] = np.clip(np.floor(value * 255.0 + 0.5), 0.0, 255.0)
    return out


def _area_sums(plane: np.ndarray, target: int) -> np.ndarray:
    """Sums of the last axis over ``target`` equal cells; a source value weighs ``target`` where a cell holds it whole."""
    size = plane.shape[-1]
    at, part = np.divmod(np.arange(target + 1, dtype=np.int64) * size, target)
    before = np.concatenate([np.zeros((*plane.shape[:-1], 1), np.int64), np.cumsum(plane, axis=-1)], axis=-1)
    ended = np.concatenate([plane, np.zeros((*plane.shape[:-1], 1), np.int64)], axis=-1)
    return np.diff(before[..., at] * target + ended[..., at] * part, axis=-1)


def _area(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Integer area sums of a plane over ``width`` x ``height`` cells; all weights of a cell sum to the plane's size."""
    return _area_sums(np.ascontiguousarray(_area_sums(plane.astype(np.int64), width).T), height).T


ALL_STORED = f"{STORED}, a array<int>"


def area_resize(images: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """Exact area average to ``target_w`` x ``target_h``, two separable integer passes per image; see ``compose.area_resize``.

    The targets come from ``plan(image_id, target_w, target_h)`` or are columns of ``images``.
    """
    planned = images if plan is None else images.join(plan.select("image_id", "target_w", "target_h"), "image_id")

    def compute(planes: Planes, given: dict) -> Planes:
        return {c: _stored(_area(v, given["target_w"], given["target_h"]) / float(v.size)) for c, v in planes.items()}

    shrunk = _map_images(planned, compute, ALL_STORED, ("target_w", "target_h"))
    framed = shrunk.withColumns({n: F.col(t).cast(images.schema[n].dataType) for n, t in (("width", "target_w"), ("height", "target_h"))})
    return framed.select(*[c for c in images.columns if c not in ("target_w", "target_h")])


def apply_alpha_mask(images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(images, errors)``: channel 0 of ``masks(image_id, width, height, m)`` becomes alpha; one join of images and masks by id.

    Images without a mask, or with one of another size, become errors; see ``compose.apply_alpha_mask``.
    """
    joined = images.join(masks.select("image_id", F.col("width").alias("_mw"), F.col("height").alias("_mh"), F.col("m").alias("_m")), "image_id", "left")
    fits = F.coalesce((F.col("_mw") == F.col("width")) & (F.col("_mh") == F.col("height")), F.lit(False))
    done = joined.where(fits).withColumn("a", F.col("_m").cast("array<int>")).select(*images.columns)
    errors = joined.where(~fits).select("image_id", F.when(F.col("_mw").isNull(), F.lit("no mask")).otherwise(F.concat(
        F.lit("mask is "), F.concat_ws("x", "_mw", "_mh"), F.lit(", image is "), F.concat_ws("x", "width", "height"))).alias("error"))
    return done, errors


def scaled_logos(boxes: DataFrame, logos: DataFrame) -> DataFrame:
    """Every logo at every planned size, scaled once: ``logo_id, box_w, box_h, stamp STRUCT<r, g, b, a>``.

    ``boxes(logo_id, box_w, box_h)``; ``logos(logo_id, width, height, r, g, b, a)``.  Area average weighted by alpha, so
    that transparent pixels have no colour; boxes without an area are left out.
    """
    wanted = boxes.select("logo_id", "box_w", "box_h").where("box_w > 0 and box_h > 0").distinct().join(logos, "logo_id")

    def compute(planes: Planes, given: dict) -> Planes:
        w, h = given["box_w"], given["box_h"]
        alpha = _area(planes["a"], w, h)
        colour = {c: _stored(np.where(alpha == 0, 0.0, _area(planes[c] * planes["a"], w, h) / np.maximum(alpha, 1))) for c in CHANNELS}
        return {**colour, "a": _stored(alpha / float(planes["a"].size))}

    scaled = _map_images(wanted, compute, ALL_STORED, ("box_w", "box_h"))
    return scaled.select("logo_id", "box_w", "box_h", F.struct("r", "g", "b", "a").alias("stamp"))


def overlay_logo(images: DataFrame, logos: DataFrame, tiles: DataFrame, opacity: float) -> DataFrame:
    """Draw logos scaled to their planned boxes with source-over blending: ``tiles(image_id, logo_id, x, y, box_w, box_h)``.

    A logo is scaled once per distinct box size; one row per image and box size meets its image, no pixel is shuffled.
    Tile origins are half-up rounded to the pixel grid; overlapping tiles blend in draw order (y, then x).
    """
    place = F.struct(half_up(F.col("y")).cast("int").alias("y"), half_up(F.col("x")).cast("int").alias("x"))
    by_box = tiles.groupBy("image_id", "logo_id", "box_w", "box_h").agg(F.collect_list(place).alias("at"))
    stamped = by_box.join(scaled_logos(by_box, logos), ["logo_id", "box_w", "box_h"])
    per_image = stamped.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("logo_id", "box_w", "box_h", "at", "stamp"))).alias("_stamps"))

    def compute(planes: Planes, given: dict) -> Planes:
        height, width = planes["r"].shape
        out = {c: v.copy() for c, v in planes.items()}
        stamps = given["_stamps"] or []
        for y, x, k in sorted((p["y"], p["x"], k) for k, s in enumerate(stamps) for p in s["at"]):
            w, h = stamps[k]["box_w"], stamps[k]["box_h"]
            x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + w, width), min(y + h, height)
            if x0 >= x1 or y0 >= y1:
                continue
            logo = {c: np.asarray(stamps[k]["stamp"][c], float).reshape(h, w)[y0 - y:y1 - y, x0 - x:x1 - x] for c in "rgba"}
            here = (slice(y0, y1), slice(x0, x1))
            top, below = logo["a"] / 255.0 * opacity, out["a"][here] / 255.0
            whole = top + below * (1.0 - top)
            for c in CHANNELS:
                mixed = (logo[c] * top + out[c][here] * (below * (1.0 - top))) / np.where(whole == 0.0, 1.0, whole)
                out[c][here] = np.where(whole == 0.0, 0.0, _clamped(mixed))
            out["a"][here] = _clamped(whole * 255.0)
        return {c: v.astype(np.int32).reshape(-1) for c, v in out.items()}

    drawn = _map_images(images.join(per_image, "image_id", "left"), compute, ALL_STORED, ("_stamps",))
    return drawn.select(*images.columns)


def stretch_gamma(luma: DataFrame, gamma: float = 0.7) -> DataFrame:
    """``pixels.stretch_gamma`` on packed planes ``v``: the ends are those of the array, nothing is shuffled."""
    ends = luma.withColumns({"_low": F.array_min("v"), "_high": F.array_max("v")})
    span = F.col("_high") - F.col("_low")

    def stretched(v: Column) -> Column:
        unit = F.when(span > 0, (v - F.col("_low")) / F.nullif(span, F.lit(0.0))).otherwise(v)
        return half_up8(F.pow(unit, F.lit(gamma)) * 255.0)

    return ends.withColumn("v", F.transform("v", stretched)).select(*luma.columns)


def preserve_color(luma: DataFrame, images: DataFrame) -> DataFrame:
    """``pixels.preserve_color`` on packed images: luminance ``v`` and image meet by id, their arrays are zipped."""
    joined = images.join(luma.select("image_id", F.col("v").alias("_v")), "image_id").withColumn("_p", F.arrays_zip(*CHANNELS, "_v"))

    def coloured(c: str):
        def one(p: Column) -> Column:
            base = p.r * 0.299 + p.g * 0.587 + p.b * 0.114
            ratio = F.least(F.greatest(p._v / F.nullif(base, F.lit(0.0)), F.lit(0.2)), F.lit(2.0))
            return F.when(base > 5, half_up8(p[c] * ratio)).otherwise(p._v.cast("int"))

        return F.transform("_p", one)

    return joined.withColumns({**{c: coloured(c) for c in CHANNELS}, "a": F.transform("a", lambda _: F.lit(255))}).select(*images.columns)


def unsharp_mask(images: DataFrame, amount: float, sigma: float = 3.0) -> DataFrame:
    """(1 + amount) v - amount * (8-bit Gaussian blur of v)."""
    taps = stencil.gaussian_taps(sigma)

    def compute(planes: Planes, _: dict) -> Planes:
        out = {}
        for c in CHANNELS:
            blur = _stored(stencil.weighted_separable(_padded(planes[c], len(taps) // 2, "reflect101"), taps)).reshape(planes[c].shape)
            out[c] = _stored(planes[c] * (1.0 + amount) - blur * float(amount))
        return out

    return _map_images(images, compute, STORED).select(*images.columns)


def quality_kpis(images: DataFrame) -> DataFrame:
    """``image_id, resolution, sharpness, noise_level, contrast, exposure`` of every image; see ``quality.quality_kpis``."""
    def compute(planes: Planes, _: dict) -> dict:
        luma = np.floor((planes["r"] * 299 + planes["g"] * 587 + planes["b"] * 114 + 500) / 1000)
        sums = sums_of_planes(_padded(luma, 1, "reflect101"), luma)
        return dict(zip(METRIC_SUMS, map(float, sums), strict=True))

    sums = _map_images(images, compute, ", ".join(f"{n} double" for n in METRIC_SUMS))
    return measures_from_sums(sums).select(
        "image_id", F.struct("width", "height").alias("resolution"), "sharpness", "noise_level", "contrast", "exposure")


def to_tensor(images: DataFrame, gray: bool = False) -> DataFrame:
    """NCHW floats in 0..1, in generated code: the arrays are scaled and joined, row by row."""
    planes = ["r"] if gray else list(CHANNELS)
    scaled = [F.transform(c, lambda v: (v / F.lit(255.0)).cast("float")) for c in planes]
    dims = F.array(F.lit(1), F.lit(len(planes)), F.col("height").cast("int"), F.col("width").cast("int"))
    return images.select("image_id", F.struct(dims.alias("dims"), F.concat(*scaled).alias("data")).alias("tensor"))
