import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.operators import compose, pixels, quality, stencil, tensors


def frame(spark, images):
    """Pixel table of {id: array(h, w, 4)}."""
    parts = []
    for key, px in images.items():
        h, w = px.shape[:2]
        y, x = np.mgrid[:h, :w]
        cols = {"image_id": np.full(h * w, key, dtype=np.int64), "x": x.ravel(), "y": y.ravel()}
        cols |= {c: px[..., k].ravel() for k, c in enumerate("rgba")}
        cols |= {"width": np.full(h * w, w), "height": np.full(h * w, h)}
        parts.append(pa.table({n: pa.array(v, pa.int64() if n == "image_id" else pa.int32()) for n, v in cols.items()}))
    return spark.createDataFrame(pa.concat_tables(parts)).repartition(5)


def image(df, key=0, columns="rgba"):
    rows = df.where(F.col("image_id") == key).collect()
    h, w = max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1
    out = np.full((h, w, len(columns)), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = [r[c] for c in columns]
    assert len(rows) == h * w
    return out


def flat(w=10, h=10):
    px = np.tile(np.array([100, 150, 200, 255]), (h, w, 1))
    px.reshape(-1, 4)[::10, 3] = 0
    return px


def checkerboard():
    y, x = np.mgrid[:10, :10]
    v = np.where((x + y) % 2 == 0, 50, 200)
    return np.stack([v, v, v, np.full_like(v, 255)], axis=-1)


def noise(seed, h, w):
    px = np.random.default_rng(seed).integers(0, 256, (h, w, 4))
    return px


def test_brightness_only(spark):
    out = image(pixels.brightness_contrast(frame(spark, {0: flat()}), 50, 0))
    assert (out[..., :3] == [150, 200, 250]).all() and (out[..., 3] == flat()[..., 3]).all()


def test_first_store_clamps_before_contrast(spark):
    out = image(pixels.brightness_contrast(frame(spark, {0: flat()}), 80, 20))
    factor = 259 * 275 / (255 * 239)
    assert (out[0, 1, :3] == np.clip(np.rint(factor * (np.minimum([180, 230, 280], 255) - 128) + 128), 0, 255)).all()


def test_rgb_scales(spark):
    out = image(pixels.rgb_scale(frame(spark, {0: flat()}), 1.5, 0.5, 2.0))
    assert (out[..., :3] == [150, 75, 255]).all()


@pytest.mark.parametrize("change", [
    lambda p: pixels.brightness_contrast(p, 50, 20, True), lambda p: pixels.hsl_adjust(p, 150, 150, 120, True),
    lambda p: pixels.rgb_scale(p, 1.5, 0.5, 2.0, True), lambda p: stencil.sharpen(p, 1.0, True),
])
def test_transparent_pixels_stay(spark, change):
    px = flat()
    px[4, 4, :3] = 7
    out = image(change(frame(spark, {0: px})))
    clear = px[..., 3] == 0
    assert (out[clear] == px[clear]).all()


@pytest.mark.parametrize("change", [
    lambda p: pixels.brightness_contrast(p, 0, 0), lambda p: pixels.hsl_adjust(p, 100, 100, 100),
    lambda p: pixels.rgb_scale(p, 1, 1, 1), lambda p: stencil.sharpen(p, 0), lambda p: pixels.linear_contrast(p, 0, 0),
])
def test_neutral_settings_change_nothing(spark, change):
    px = noise(1, 9, 7)
    assert (image(change(frame(spark, {0: px}))) == px).all()


def test_lightness_raises_the_sum_and_hue_turns(spark):
    base = frame(spark, {0: flat()})
    assert image(pixels.hsl_adjust(base, 100, 100, 120))[..., :3].sum() > flat()[..., :3].sum()
    turned = image(pixels.hsl_adjust(base, 100 + 100 / 3, 100, 100))[0, 0, :3]  # 120 degrees
    assert turned.tolist() == [200, 100, 150]


def brute_sharpen(px, amount):
    s, out = min(amount, 2), px.astype(float).copy()
    for y in range(1, px.shape[0] - 1):
        for x in range(1, px.shape[1] - 1):
            v = px[y, x, :3] * (1 + 4 * s) - s * (px[y - 1, x, :3] + px[y + 1, x, :3] + px[y, x - 1, :3] + px[y, x + 1, :3])
            out[y, x, :3] = np.clip(np.rint(v), 0, 255)
    return out


@pytest.mark.parametrize("tile", [4, 128])
@pytest.mark.parametrize("amount", [0.5, 1.0, 3.0])
def test_sharpen_across_tiles(spark, amount, tile):
    px = noise(2, 13, 11)
    assert (image(stencil.sharpen(frame(spark, {0: px, 1: checkerboard()}), amount, tile=tile)) == brute_sharpen(px, amount)).all()


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (2, 3), (13, 9)])
def test_mirrored_borders_and_small_images(spark, shape):
    px = noise(3, *shape)
    kernel = np.arange(25.0).reshape(5, 5).tolist()
    out = image(stencil.convolve(frame(spark, {0: px}), kernel, tile=4), columns="rgb")
    at = [stencil.mirrored(np.arange(-2, n + 2), n) for n in shape]
    grown = px[np.ix_(*at)]
    want = sum(grown[dy : dy + shape[0], dx : dx + shape[1], :3] * kernel[dy][dx] for dy in range(5) for dx in range(5))
    assert np.array_equal(out, want)


def test_separable_equals_full_kernel(spark):
    taps = stencil.gaussian_taps(0.8)
    full = np.outer(taps, taps).tolist()
    df = frame(spark, {0: noise(4, 12, 10)})
    assert np.allclose(image(stencil.convolve(df, taps, tile=6), columns="rgb"), image(stencil.convolve(df, full, tile=9), columns="rgb"))


def test_kernel_wider_than_image(spark):
    assert len(stencil.gaussian_taps(3.0)) == 19
    px = np.full((5, 4, 4), 90)
    assert (image(stencil.unsharp_mask(frame(spark, {0: px}), 1.5)) == px).all()


def test_area_resize_averages(spark):
    px = noise(5, 6, 4)
    plan = spark.createDataFrame([(0, 2, 3, 24)], "image_id long, target_w int, target_h int, pixel_count long")
    out = image(compose.area_resize(frame(spark, {0: px}), plan))
    assert (out == np.rint(px.reshape(3, 2, 2, 2, 4).mean(axis=(1, 3)))).all()


def test_pack_and_tensor_round_trip(spark):
    images = {k: noise(k, 3 + k, 5) for k in range(3)}
    df = frame(spark, images)
    again = tensors.unpack_pixels(tensors.pack_pixels(df))
    back = tensors.from_tensor(tensors.to_tensor(df))
    for k, px in images.items():
        assert (image(again, k) == px).all()
        assert (image(back, k, "rgb") == px[..., :3]).all()


def test_overlapping_logos_blend_in_draw_order(spark):
    base = frame(spark, {0: np.full((4, 4, 4), 255)})
    logo = spark.createDataFrame([(0, 0, 0, 0, 0, 255)], "lx int, ly int, r int, g int, b int, a int")
    tiles = spark.createDataFrame([(0, 1.0, 1.0), (0, 1.4, 0.6)], "image_id long, x double, y double")
    out = image(compose.overlay_logo(base, logo, tiles, 0.5))
    assert out[1, 1].tolist() == [64, 64, 64, 255]  # 255 -> 128 -> 64
    assert out[0, 0].tolist() == [255] * 4


def test_stretch_of_a_constant_image(spark):
    luma = spark.createDataFrame([(0, 0, 0, 0.25, 2, 1), (0, 1, 0, 0.25, 2, 1)], "image_id long, x int, y int, v double, width int, height int")
    assert {r["v"] for r in pixels.stretch_gamma(luma).collect()} == {int(np.floor(0.25**0.7 * 255 + 0.5))}


def test_kpis_do_not_depend_on_tiles(spark):
    images = {k: noise(k, 11, 14) for k in range(3)}
    df = frame(spark, images)
    sizes = spark.createDataFrame([(k, 14, 11) for k in images], "image_id long, width int, height int")
    small = quality.quality_kpis(df, sizes, tile=4).orderBy("image_id").collect()
    whole = quality.quality_kpis(df, sizes).orderBy("image_id").collect()
    assert [r["image_id"] for r in whole] == [0, 1, 2]
    for a, b in zip(small, whole, strict=True):
        assert np.allclose(a[2:], b[2:], rtol=1e-12)
    gray = pixels.to_gray(df)
    parts = [f(gray) for f in (quality.kpi_sharpness, quality.kpi_noise, quality.kpi_contrast, quality.kpi_exposure)]
    for part, column in zip(parts, ("sharpness", "noise_level", "contrast", "exposure"), strict=True):
        got = {r["image_id"]: r[column] for r in part.collect()}
        assert all(np.isclose(got[r["image_id"]], r[column]) for r in whole)


def test_fixture_measures_known_values(spark):
    from workload import tables

    gray = tables.gray(spark, "/root/testdata/sf0.01").where("image_id < 2")
    noise_level = {r[0]: round(r[1], 4) for r in quality.kpi_noise(gray).collect()}
    sharpness = {r[0]: round(r[1], 4) for r in quality.kpi_sharpness(gray).collect()}
    assert noise_level == {0: 16.5332, 1: 15.9009} and sharpness == {0: 21728.4961, 1: 21344.3711}
