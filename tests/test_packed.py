"""Packed images and the pixel table give the same values, and packed images are not shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import compose, packed, pixels, quality, stencil, tensors


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k, (w, h) in enumerate([(1, 1), (1, 5), (7, 1), (2, 2), (3, 3), (9, 4), (31, 17), (40, 40)]):
        planes = [rng.integers(0, 256, w * h).tolist() for _ in range(3)] + [rng.choice([0, 255], w * h).tolist()]
        rows.append((k, w, h, *planes))
    return spark.createDataFrame(rows, "image_id long, width int, height int, r array<int>, g array<int>, b array<int>, a array<int>")


def rows_of(df, columns=("image_id", "x", "y", "r", "g", "b")):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("border", ["reflect101", "skip"])
def test_convolve(images, border):
    kernel = [[1.0, 0.0, -1.0], [2.0, 0.0, -2.0], [1.0, 0.5, -1.0]]
    p = tensors.unpack_pixels(images)
    assert rows_of(tensors.unpack_values(packed.convolve(images, kernel, border))) == rows_of(stencil.convolve(p, kernel, border, tile=8))


def test_sharpen_and_unsharp(images):
    p = tensors.unpack_pixels(images)
    amount, skip = F.when(F.col("image_id") % 2 == 0, 1.7).otherwise(0.0), F.col("image_id") % 3 == 0
    assert rows_of(tensors.unpack_pixels(packed.sharpen(images, amount, skip))) == rows_of(stencil.sharpen(p, amount, skip, tile=8))
    assert rows_of(tensors.unpack_pixels(packed.unsharp_mask(images, 0.5, 1.0))) == rows_of(stencil.unsharp_mask(p, 0.5, 1.0, tile=8))


def test_measures_and_tensors(images):
    p = tensors.unpack_pixels(images)
    columns = ["image_id", "resolution", "sharpness", "noise_level", "contrast", "exposure"]
    assert rows_of(packed.quality_kpis(images), columns) == rows_of(quality.quality_kpis(p, images, tile=8), columns)
    for gray in (False, True):
        assert rows_of(packed.to_tensor(images, gray), ["image_id", "tensor"]) == rows_of(tensors.to_tensor(p, gray), ["image_id", "tensor"])


def test_adjust(spark, images):
    names = list(pixels.ADJUSTMENTS)
    values = {"brightness": 12.0, "contrast": -8.0, "hue": 120.0, "saturation": 110.0, "lightness": 95.0, "sharpen": 0.6,
              "red_scale": 1.1, "green_scale": 0.9, "blue_scale": 1.0}
    settings = images.select("image_id", *[F.lit(values[n]).alias(n) for n in names], (F.col("image_id") % 2 == 0).alias("skip_transparent"),
                             (F.col("width") * F.col("height")).alias("pixel_count"))
    assert rows_of(pixels.adjust_images(images, settings)) == rows_of(pixels.adjust_pipeline(tensors.unpack_pixels(images), settings))


ALL = ("image_id", "x", "y", "r", "g", "b", "a")


def test_packed_adjust_equals_the_pixel_table(images):
    k = F.col("image_id")
    settings = images.select("image_id", (k * 9 - 20.0).alias("brightness"), (k * 5 - 10.0).alias("contrast"), F.when(k % 3 == 0, 100.0).otherwise(k * 20.0).alias("hue"),
                             F.when(k % 3 == 0, 100.0).otherwise(60.0 + k * 15).alias("saturation"), F.when(k % 3 == 0, 100.0).otherwise(90.0 + k * 4).alias("lightness"),
                             (k * 0.4).alias("sharpen"), (0.5 + k * 0.2).alias("red_scale"), (k * 0.0 + 0.9).alias("green_scale"), (1.5 - k * 0.1).alias("blue_scale"),
                             (k % 2 == 0).alias("skip_transparent"), (F.col("width") * F.col("height")).alias("pixel_count"))
    assert rows_of(tensors.unpack_pixels(packed.adjust(images, settings)), ALL) == rows_of(pixels.adjust_pipeline(tensors.unpack_pixels(images), settings), ALL)


def test_packed_resize_equals_the_pixel_table(images):
    plan = images.select("image_id", F.greatest(F.lit(1), F.ceil(F.col("width") * 0.4)).cast("int").alias("target_w"),
                         F.greatest(F.lit(1), F.ceil(F.col("height") * 0.7)).cast("int").alias("target_h"), (F.col("width") * F.col("height")).alias("pixel_count"))
    columns = (*ALL, "width", "height")
    assert rows_of(tensors.unpack_pixels(packed.area_resize(images, plan)), columns) == rows_of(compose.area_resize(tensors.unpack_pixels(images), plan), columns)


def test_packed_mask_gamma_and_colour_equal_the_pixel_table(images):
    p, k = tensors.unpack_pixels(images), F.col("image_id")
    masks = images.where(k != 2).select("image_id", F.col("r").alias("m"), "width", F.when(k == 5, 99).otherwise(F.col("height")).alias("height"))
    table = tensors.unpack_pixels(images.where(k != 2)).select("image_id", "x", "y", F.col("r").alias("m"), "width", F.when(k == 5, 99).otherwise(F.col("height")).alias("height"))
    done, errors = packed.apply_alpha_mask(images, masks)
    want, wrong = compose.apply_alpha_mask(p, table, images, masks)
    assert rows_of(tensors.unpack_pixels(done), ALL) == rows_of(want, ALL)
    assert sorted(map(tuple, errors.collect())) == sorted(map(tuple, wrong.collect()))
    luma = images.select("image_id", "width", "height", F.transform("g", lambda v: v / 255.0).alias("v"))
    flat = p.select("image_id", "x", "y", (F.col("g") / 255.0).alias("v"), "width", "height")
    stretched, by_table = packed.stretch_gamma(luma), pixels.stretch_gamma(flat)
    assert rows_of(stretched.select("image_id", F.posexplode("v")), ("image_id", "pos", "col")) == rows_of(
        by_table.selectExpr("image_id", "y * width + x AS pos", "v AS col"), ("image_id", "pos", "col"))
    assert rows_of(tensors.unpack_pixels(packed.preserve_color(stretched, images)), ALL) == rows_of(pixels.preserve_color(by_table, p), ALL)


def test_logo_at_its_own_size_equals_the_pixel_table(spark, images):
    logo = images.where("image_id = 3").select(F.lit("l").alias("logo_id"), "width", "height", "r", "g", "b", "a")
    tiles = images.select("image_id", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.5, 0.5), (2.0, 1.0), (-1.0, 3.4), (90.0, 0.0))])).alias("t")).select("image_id", "t.*")
    stamp = tensors.unpack_pixels(images.where("image_id = 3").select("*")).select(F.col("x").alias("lx"), F.col("y").alias("ly"), "r", "g", "b", "a")
    boxed = tiles.select("image_id", F.lit("l").alias("logo_id"), "x", "y").join(logo.select("logo_id", F.col("width").alias("box_w"), F.col("height").alias("box_h")), "logo_id")
    # the logo is scaled to its own size, so its pixels stay (those without alpha lose their colour, which nobody sees)
    assert rows_of(tensors.unpack_pixels(packed.overlay_logo(images, logo, boxed, 0.5)), ALL) == rows_of(compose.overlay_logo(tensors.unpack_pixels(images), stamp, tiles, 0.5), ALL)


def test_logo_is_scaled_once_per_box(spark, images):
    logos = spark.createDataFrame([("l", 2, 2, [10, 30, 50, 70], [0] * 4, [200, 0, 0, 0], [255, 255, 255, 0])],
                                  "logo_id string, width int, height int, r array<int>, g array<int>, b array<int>, a array<int>")
    boxes = spark.createDataFrame([("l", 1, 1), ("l", 1, 1), ("l", 4, 2), ("l", 0, 3)], "logo_id string, box_w int, box_h int")
    got = {(r.box_w, r.box_h): r.stamp for r in packed.scaled_logos(boxes, logos).collect()}
    assert set(got) == {(1, 1), (4, 2)}
    assert got[1, 1].asDict() == {"r": [30], "g": [0], "b": [67], "a": [191]}  # the clear pixel adds no colour
    assert got[4, 2].r == [10, 10, 30, 30, 50, 50, 0, 0] and got[4, 2].a == [255] * 6 + [0, 0]


def test_no_exchange(images):
    planned = images.withColumns({"target_w": F.lit(2), "target_h": F.lit(3)})
    for df in (packed.area_resize(planned), packed.stretch_gamma(images.withColumn("v", F.transform("r", lambda v: v / 255.0))),
               packed.convolve(images, [[0.0] * 3] * 3), packed.sharpen(images, 1.0), packed.unsharp_mask(images, 0.5), packed.quality_kpis(images),
               packed.to_tensor(images)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
