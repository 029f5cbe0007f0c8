"""Pixel, tensor and quality queries on the 8x8 images."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import packed as B
from framelake.operators import pixels as X
from framelake.operators import quality as K
from framelake.operators import tensors as N
from framelake.operators.naming import export_name
from framelake.plans import geometry as G
from framelake.plans import tables as P
from framelake.scratch import scratch_path
from framelake.sources.files import export_images
from workload import tables as D
from workload.manifest_queries import SQL_LOOK_OF, SQL_LOOKS, LOOK_NAMES, look_of
from workload.registry import query

PX = D.SQL_PIXELS
OUT = ("image_id", "x", "y", "r", "g", "b", "a")
store, half8 = D.sql_store, D.sql_half_up8


def sql_brightness(v: str, b: str, c: str) -> str:
    factor = f"(259e0 * ({c} + 255e0)) / (255e0 * (259e0 - {c}))"
    return store(f"{factor} * ({store(f'{v} + {b}')} - 128) + 128e0")


def sql_each(expr, skip: str, channels: str = "rgb") -> str:
    return ", ".join(f"CASE WHEN {skip} THEN {c} ELSE {expr(c)} END AS {c}" for c in channels)


def sql_hsl_of(src: str, out: str) -> str:
    """CTEs ``<out>_c`` with h0, s0, l0 of the pixels in ``src``."""
    return f"""{out}_a AS (SELECT *, r / 255e0 AS rr, g / 255e0 AS gg, b / 255e0 AS bb FROM {src}),
  {out}_b AS (SELECT *, greatest(rr, gg, bb) AS mx, least(rr, gg, bb) AS mn FROM {out}_a),
  {out}_c AS (SELECT *, (mx + mn) / 2 AS l0,
    CASE WHEN mx = mn THEN 0e0 WHEN (mx + mn) / 2 > 0.5e0 THEN (mx - mn) / (2e0 - mx - mn) ELSE (mx - mn) / (mx + mn) END AS s0,
    CASE WHEN mx = mn THEN 0e0 WHEN mx = rr THEN (gg - bb) / (mx - mn) + CASE WHEN gg < bb THEN 6e0 ELSE 0e0 END
      WHEN mx = gg THEN (bb - rr) / (mx - mn) + 2e0 ELSE (rr - gg) / (mx - mn) + 4e0 END / 6e0 AS h0 FROM {out}_b)"""


def sql_rgb_of(src: str, out: str, keep: str, skip: str) -> str:
    """CTEs turning h, s, l of ``src`` into channels, except where ``skip`` holds."""

    def channel(c: str, third: str) -> str:
        t = f"(CASE WHEN h + {third} < 0 THEN h + {third} + 1 WHEN h + {third} > 1 THEN h + {third} - 1 ELSE h + {third} END)"
        value = f"""CASE WHEN s = 0 THEN l WHEN {t} < 1e0/6 THEN p + (q - p) * 6 * {t} WHEN {t} < 0.5e0 THEN q
          WHEN {t} < 2e0/3 THEN p + (q - p) * (2e0/3 - {t}) * 6 ELSE p END"""
        return f"CASE WHEN {skip} THEN {c} ELSE {half8(f'({value}) * 255')} END AS {c}"

    return f"""{out}_q AS (SELECT *, CASE WHEN l < 0.5e0 THEN l * (1 + s) ELSE l + s - l * s END AS q FROM {src}),
  {out}_p AS (SELECT *, 2 * l - q AS p FROM {out}_q),
  {out} AS (SELECT {keep}, {channel('r', '1e0/3')}, {channel('g', '0e0')}, {channel('b', '-1e0/3')} FROM {out}_p)"""


def sql_hsl(src: str, out: str, hue: str, sat: str, light: str, keep: str, skip: str) -> str:
    moved = f"((h0 * 360 + ({hue} - 100) * 3.6e0) % 360e0) / 360"
    return f"""{sql_hsl_of(src, out)},
  {out}_d AS (SELECT *, CASE WHEN {moved} < 0 THEN {moved} + 1 ELSE {moved} END AS h,
    least(s0 * ({sat} / 100e0), 1e0) AS s, least(l0 * ({light} / 100e0), 1e0) AS l FROM {out}_c),
  {sql_rgb_of(f'{out}_d', out, keep, skip)}"""


def sql_sharpen(src: str, out: str, s: str, keep: str, skip: str, side: int = 8) -> str:
    def around(c: str) -> str:
        return f"""lag({c}) OVER (PARTITION BY image_id, x ORDER BY y) AS t_{c}, lead({c}) OVER (PARTITION BY image_id, x ORDER BY y) AS d_{c},
      lag({c}) OVER (PARTITION BY image_id, y ORDER BY x) AS l_{c}, lead({c}) OVER (PARTITION BY image_id, y ORDER BY x) AS r_{c}"""

    def total(c: str) -> str:
        return store(f"t_{c} * -({s}) + l_{c} * -({s}) + {c} * (1 + 4 * ({s})) + r_{c} * -({s}) + d_{c} * -({s})")

    border = f"x = 0 OR y = 0 OR x = {side - 1} OR y = {side - 1}"
    return f"""{out}_n AS (SELECT *, {around('r')}, {around('g')}, {around('b')} FROM {src}),
  {out} AS (SELECT {keep}, {sql_each(total, f'{border} OR ({s}) <= 0 OR ({skip})')} FROM {out}_n)"""


@query("unpack_pixels", f"WITH {PX} SELECT * FROM px")
def unpack_pixels(spark, sf_dir):
    return N.unpack_pixels(D.images(spark, sf_dir)).select(*OUT)


def _joined(column):
    return F.array_join(column.cast("array<string>"), ",")


@query("pack_pixels", f"""WITH {PX} SELECT image_id, {', '.join(f"string_agg({c}, ',' ORDER BY y, x) AS {c}" for c in 'rgba')} FROM px GROUP BY image_id""")
def pack_pixels(spark, sf_dir):
    packed = N.pack_pixels(D.pixels(spark, sf_dir))
    return packed.select("image_id", *[_joined(F.col(c)).alias(c) for c in "rgba"])


@query("brightness_contrast", f"WITH {PX} SELECT image_id, x, y, a, {sql_each(lambda c: sql_brightness(c, '20e0', '15e0'), 'a = 0')} FROM px")
def brightness_contrast(spark, sf_dir):
    return X.brightness_contrast(D.pixels(spark, sf_dir), 20, 15, skip_transparent=True).select(*OUT)


@query("hsl_adjust", f"WITH {PX}, {sql_hsl('px', 'o', '130', '120', '95', 'image_id, x, y, a', 'a = 0')} SELECT * FROM o")
def hsl_adjust(spark, sf_dir):
    return X.hsl_adjust(D.pixels(spark, sf_dir), 130, 120, 95, skip_transparent=True).select(*OUT)


SCALES = {"r": "1.5e0", "g": "0.5e0", "b": "2.0e0"}


@query("rgb_scale", f"WITH {PX} SELECT image_id, x, y, a, {sql_each(lambda c: store(f'{c} * {SCALES[c]}'), 'a = 0')} FROM px")
def rgb_scale(spark, sf_dir):
    return X.rgb_scale(D.pixels(spark, sf_dir), 1.5, 0.5, 2.0, skip_transparent=True).select(*OUT)


EMBOSS = ((-2.0, -1.0, 0.0), (-1.0, 1.0, 1.0), (0.0, 1.0, 2.0))
SQL_EMBOSS = "em AS (SELECT * FROM (VALUES (-1,-1,-2),(0,-1,-1),(1,-1,0),(-1,0,-1),(0,0,1),(1,0,1),(-1,1,0),(0,1,1),(1,1,2)) t(dx, dy, k))"


def sql_fold(at: str) -> str:
    return f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > 7 THEN 14 - ({at}) ELSE {at} END"


def sql_gray_filter(kernel: str, out: str) -> str:
    """Sum of v * k over the mirrored neighbourhood of a gray table ``gr``."""
    return f"""{out} AS (SELECT c.image_id, c.x, c.y, any_value(c.v) AS v, CAST(sum(n.v * k) AS DOUBLE) AS s FROM gr c CROSS JOIN {kernel} m
    JOIN gr n ON n.image_id = c.image_id AND n.x = {sql_fold('c.x + dx')} AND n.y = {sql_fold('c.y + dy')} GROUP BY c.image_id, c.x, c.y)"""


@query("convolve", f"""WITH {PX}, {SQL_EMBOSS} SELECT c.image_id, c.x, c.y, {', '.join(f'CAST(sum(n.{c} * k) AS DOUBLE) AS {c}' for c in 'rgb')}
  FROM px c CROSS JOIN em JOIN px n ON n.image_id = c.image_id AND n.x = {sql_fold('c.x + dx')} AND n.y = {sql_fold('c.y + dy')} GROUP BY ALL""")
def convolve(spark, sf_dir):
    return N.unpack_values(B.convolve(D.images(spark, sf_dir), EMBOSS)).select("image_id", "x", "y", "r", "g", "b")


@query("sharpen", f"WITH {PX}, {sql_sharpen('px', 'o', '1.5e0', 'image_id, x, y, a', 'a = 0')} SELECT * FROM o")
def sharpen(spark, sf_dir):
    return N.unpack_pixels(B.sharpen(D.images(spark, sf_dir), 1.5, skip_transparent=True)).select(*OUT)


PIPE_KEEP = "image_id, x, y, a, skip, " + ", ".join(P.NEUTRAL)
PIPE_SKIP = "skip AND a = 0"


@query("adjust_pipeline", f"""WITH {PX}, {SQL_LOOKS}, p0 AS (SELECT px.*, image_id % 5 = 0 AS skip, {', '.join(f'looks.{c}' for c in P.NEUTRAL)}
    FROM px JOIN looks ON look = {SQL_LOOK_OF}[image_id % {len(LOOK_NAMES)} + 1]),
  p1 AS (SELECT {PIPE_KEEP}, {sql_each(lambda c: sql_brightness(c, 'brightness', 'contrast'), PIPE_SKIP)} FROM p0),
  {sql_hsl('p1', 'p2', 'hue', 'saturation', 'lightness', PIPE_KEEP, f'({PIPE_SKIP}) OR (hue = 100 AND saturation = 100 AND lightness = 100)')},
  p3 AS (SELECT {PIPE_KEEP}, {sql_each(lambda c: store(f"{c} * {dict(r='red', g='green', b='blue')[c]}_scale"), PIPE_SKIP)} FROM p2),
  {sql_sharpen('p3', 'p4', 'least(sharpen, 2e0)', 'image_id, x, y, a', PIPE_SKIP)} SELECT * FROM p4""")
def adjust_pipeline(spark, sf_dir):
    settings = D.vectors(spark, sf_dir).select("image_id", look_of(F.col("image_id")).alias("look")).withColumns({
        "skip_transparent": F.col("image_id") % 5 == 0, "pixel_count": F.lit(D.SIDE * D.SIDE),
    })
    return N.unpack_pixels(B.adjust(D.images(spark, sf_dir), G.plan_adjustments(settings, P.looks(spark), P.NEUTRAL))).select(*OUT)


@query("linear_contrast", f"WITH {PX} SELECT image_id, x, y, a, {sql_each(lambda c: store(f'{c} * 1.3e0 + -12e0'), 'false')} FROM px")
def linear_contrast(spark, sf_dir):
    return X.linear_contrast(D.pixels(spark, sf_dir), -12, 30).select(*OUT)


# a Gaussian of sigma 3 over 19 places, summing to one
SQL_TAPS = "tp AS (SELECT d, exp(-(d * d) / 18e0) / sum(exp(-(d * d) / 18e0)) OVER () AS k FROM range(-9, 10) t(d))"


def sql_far_fold(at: str) -> str:
    return f"CASE WHEN (({at}) % 14 + 14) % 14 > 7 THEN 14 - (({at}) % 14 + 14) % 14 ELSE (({at}) % 14 + 14) % 14 END"


@query("unsharp_mask", f"""WITH {PX}, {SQL_TAPS},
  ac AS (SELECT c.image_id, c.x, c.y, {', '.join(f'sum(n.{c} * k) AS {c}' for c in 'rgb')} FROM px c CROSS JOIN tp
    JOIN px n ON n.image_id = c.image_id AND n.y = c.y AND n.x = {sql_far_fold('c.x + d')} GROUP BY ALL),
  bl AS (SELECT c.image_id, c.x, c.y, {', '.join(f'sum(n.{c} * k) AS s_{c}' for c in 'rgb')} FROM ac c CROSS JOIN tp
    JOIN ac n ON n.image_id = c.image_id AND n.x = c.x AND n.y = {sql_far_fold('c.y + d')} GROUP BY ALL)
  SELECT image_id, x, y, a, {', '.join(f"{store(f'{c} * 1.5e0 - ' + store(f's_{c}') + ' * 0.5e0')} AS {c}" for c in 'rgb')} FROM px JOIN bl USING (image_id, x, y)""")
def unsharp_mask(spark, sf_dir):
    return N.unpack_pixels(B.unsharp_mask(D.images(spark, sf_dir), 0.5)).select(*OUT)


@query("hls8_adjust", f"""WITH {PX}, {sql_hsl_of('px', 'o')},
  o_i AS (SELECT image_id, x, y, a, r, g, b, floor(h0 * 180 + 0.5e0) % 180 AS h8, floor(l0 * 255 + 0.5e0) AS l8, floor(s0 * 255 + 0.5e0) AS s8 FROM o_c),
  o_d AS (SELECT *, floor((h8 + (130 - 100) * 180e0 / 200 + 180) % 180) / 180e0 AS h, floor(least(greatest(l8 * 0.95e0, 0), 255)) / 255e0 AS l,
    floor(least(greatest(s8 * 1.2e0, 0), 255)) / 255e0 AS s FROM o_i),
  {sql_rgb_of('o_d', 'o', 'image_id, x, y, a', 'false')} SELECT * FROM o""")
def hls8_adjust(spark, sf_dir):
    return X.hls8_adjust(D.pixels(spark, sf_dir), 130, 120, 95).select(*OUT)


SQL_LUMA = "CAST((r * 299 + g * 587 + b * 114 + 500) // 1000 AS INTEGER)"


@query("to_gray", f"WITH {PX} SELECT image_id, x, y, {SQL_LUMA} AS v FROM px")
def to_gray(spark, sf_dir):
    return X.to_gray(D.pixels(spark, sf_dir)).select("image_id", "x", "y", "v")


@query("area_resize", f"""WITH {PX}, p AS (SELECT *, CASE WHEN image_id % 2 = 0 THEN 4 ELSE 3 END AS m FROM px),
  c AS (SELECT image_id, m, tx.i AS tx, ty.i AS ty, r, g, b, a,
    (least((x + 1) * m, (tx.i + 1) * 8) - greatest(x * m, tx.i * 8)) * (least((y + 1) * m, (ty.i + 1) * 8) - greatest(y * m, ty.i * 8)) AS w
    FROM p JOIN range(4) tx(i) ON tx.i < m AND (x + 1) * m > tx.i * 8 AND (tx.i + 1) * 8 > x * m
    JOIN range(4) ty(i) ON ty.i < m AND (y + 1) * m > ty.i * 8 AND (ty.i + 1) * 8 > y * m)
  SELECT image_id, CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, {', '.join(f"{store(f'CAST(sum({c} * w) AS DOUBLE) / sum(w)')} AS {c}" for c in 'rgba')}
  FROM c GROUP BY image_id, tx, ty""")
def area_resize(spark, sf_dir):
    side = F.when(F.col("image_id") % 2 == 0, 4).otherwise(3)
    plan = D.vectors(spark, sf_dir).select("image_id", side.alias("target_w"), side.alias("target_h"), F.lit(D.SIDE * D.SIDE).alias("pixel_count"))
    return N.unpack_pixels(B.area_resize(D.images(spark, sf_dir), plan)).select(*OUT)


# Plan, resize, adjust, pack, name, encode and export the selected images, then read the export.
@query("edit_export", f"""WITH {PX}, p AS (SELECT *, 4 AS m FROM px WHERE image_id % 4 <> 1),
  c AS (SELECT image_id, tx.i AS tx, ty.i AS ty, r, g, b, a FROM p JOIN range(4) tx(i) ON x // 2 = tx.i JOIN range(4) ty(i) ON y // 2 = ty.i),
  rs AS (SELECT image_id, CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, {', '.join(f"{store(f'CAST(sum({c}) AS DOUBLE) / 4')} AS {c}" for c in 'rgba')}
    FROM c GROUP BY image_id, tx, ty),
  {SQL_LOOKS}, p0 AS (SELECT rs.*, image_id % 5 = 0 AS skip, {', '.join(f'looks.{c}' for c in P.NEUTRAL)}
    FROM rs JOIN looks ON look = {SQL_LOOK_OF}[image_id % {len(LOOK_NAMES)} + 1]),
  p1 AS (SELECT {PIPE_KEEP}, {sql_each(lambda c: sql_brightness(c, 'brightness', 'contrast'), PIPE_SKIP)} FROM p0),
  {sql_hsl('p1', 'p2', 'hue', 'saturation', 'lightness', PIPE_KEEP, f'({PIPE_SKIP}) OR (hue = 100 AND saturation = 100 AND lightness = 100)')},
  p3 AS (SELECT {PIPE_KEEP}, {sql_each(lambda c: store(f"{c} * {dict(r='red', g='green', b='blue')[c]}_scale"), PIPE_SKIP)} FROM p2),
  {sql_sharpen('p3', 'p4', 'least(sharpen, 2e0)', 'image_id, x, y, a', PIPE_SKIP, side=4)},
  sums AS (SELECT image_id, {', '.join(f'CAST(sum({c} * (y * 4 + x + 1)) AS BIGINT) AS {c}' for c in 'rgba')} FROM p4 GROUP BY image_id),
  n AS (SELECT image_id, row_number() OVER (ORDER BY image_id) AS k FROM sums)
  SELECT image_id, 'img_' || image_id || '_' || k || CASE WHEN image_id % 5 = 0 THEN '.png' ELSE '.webp' END AS file_name,
    CASE WHEN image_id % 5 = 0 THEN 'png' ELSE 'webp' END AS output_format, CASE WHEN image_id % 5 = 0 THEN 'image/png' ELSE 'image/webp' END AS output_mime,
    CASE WHEN image_id % 5 = 0 THEN 1e0 ELSE 0.8e0 END AS quality, r, g, b, a FROM sums JOIN n USING (image_id)""")
def edit_export(spark, sf_dir):
    chosen = F.col("image_id") % 4 != 1
    side, cut = F.lit(4), F.col("image_id") % 5 == 0
    ids = D.vectors(spark, sf_dir).where(chosen).select("image_id", "original_index")
    plan = ids.select("image_id", side.alias("target_w"), side.alias("target_h"), F.lit(D.SIDE * D.SIDE).alias("pixel_count"))
    settings = ids.select("image_id", look_of(F.col("image_id")).alias("look"), cut.alias("skip_transparent"), F.lit(16).alias("pixel_count"))
    small = B.area_resize(D.images(spark, sf_dir).where(chosen), plan)
    edited = B.adjust(small, G.plan_adjustments(settings, P.looks(spark), P.NEUTRAL))
    manifest = ids.select("image_id", "original_index", cut.alias("background_removed"), F.lit(None).cast("int").alias("preset_quality"),
                          F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("name"), F.lit(None).cast("string").alias("seo_name"))
    coded = G.plan_encoding(export_name(manifest, "webp", ["original_index"]), P.ENCODING_RULES, "download", "webp")
    payload = edited.select("image_id", F.struct("r", "g", "b", "a").alias("payload"))
    rows = coded.join(payload, "image_id", "left").select("image_id", "file_name", "output_format", "output_mime", "quality", "payload")
    done, _ = export_images(rows, scratch_path(spark, "edited"))

    def weighed(c: str):
        return F.aggregate(F.transform(f"payload.{c}", lambda v, k: (v * (k + 1)).cast("long")), F.lit(0).cast("long"), lambda t, v: t + v).alias(c)

    return done.select("image_id", "file_name", "output_format", "output_mime", "quality", *[weighed(c) for c in "rgba"])


def _mask(spark, sf_dir):
    """Red channel of the next image; every 50th mask has lost its last line."""
    images = D.images(spark, sf_dir)
    short, area = F.col("image_id") % 50 == 7, D.SIDE * D.SIDE
    masks = images.select((F.col("image_id") - 1).alias("image_id"), "width", "height", F.col("r").alias("m")).withColumns({
        "height": F.when(short, D.SIDE - 1).otherwise(F.col("height")), "m": F.when(short, F.slice("m", 1, area - D.SIDE)).otherwise(F.col("m")),
    })
    return B.apply_alpha_mask(images, masks)


# one row of channel values per pair of neighbours, then one row per pixel
SQL_MASKED = f"""WITH e AS MATERIALIZED (SELECT vec_id AS image_id, list_transform(embedding, lambda v: {store('(v::DOUBLE + 0.5e0) * 255e0')}) AS v FROM embeddings),
  j AS MATERIALIZED (SELECT p.image_id, p.v, m.v AS m FROM e p JOIN e m ON m.image_id = p.image_id + 1 WHERE p.image_id % 50 <> 7)
  SELECT image_id, CAST(k % 8 AS INTEGER) AS x, CAST(k // 8 AS INTEGER) AS y, v[k + 1] AS r, v[(k + 21) % 64 + 1] AS g, v[(k + 42) % 64 + 1] AS b, m[k + 1] AS a
  FROM (SELECT *, unnest(range(64)) AS k FROM j)"""


@query("apply_alpha_mask", SQL_MASKED)
def apply_alpha_mask(spark, sf_dir):
    return N.unpack_pixels(_mask(spark, sf_dir)[0]).select(*OUT)


@query("apply_alpha_mask_errors", """SELECT vec_id AS image_id, CASE WHEN vec_id + 1 NOT IN (SELECT vec_id FROM embeddings) THEN 'no mask'
  ELSE 'mask is 8x7, image is 8x8' END AS error FROM embeddings
  WHERE vec_id % 50 = 7 OR vec_id + 1 NOT IN (SELECT vec_id FROM embeddings)""")
def apply_alpha_mask_errors(spark, sf_dir):
    return _mask(spark, sf_dir)[1]


# Four kinds of images by id: tiled logo, logo at the lower right, logo in the middle, none.  The logo is the upper left
# 3 x 2 corner of image 0; each kind plans its own size.
SQL_PLANS = """pl(kind, size, place) AS (VALUES (0, 30e0, 'tile'), (1, 50e0, 'bottomRight'), (2, 80e0, 'center')),
  bx AS (SELECT *, CAST(floor(8 * size / 100 + 0.5e0) AS INTEGER) AS w, CAST(floor(8 * size / 100 / 1.5e0 + 0.5e0) AS INTEGER) AS h FROM pl),
  ti AS MATERIALIZED (SELECT kind, w, h, CAST(floor(i * w * 1.5e0 + 0.5e0) AS INTEGER) AS tx, CAST(floor(j * h * 1.5e0 + 0.5e0) AS INTEGER) AS ty
      FROM bx, range(20) a(i), range(20) b(j) WHERE place = 'tile' AND i * w * 1.5e0 < 8 + w * 1.5e0 AND j * h * 1.5e0 < 8 + h * 1.5e0
    UNION ALL SELECT kind, w, h, CAST(floor(CASE WHEN place = 'center' THEN (8 - w) / 2e0 ELSE 8 - w - 0.16e0 END + 0.5e0) AS INTEGER),
      CAST(floor(CASE WHEN place = 'center' THEN (8 - h) / 2e0 ELSE 8 - h - 0.16e0 END + 0.5e0) AS INTEGER) FROM bx WHERE place <> 'tile'),
  lg AS MATERIALIZED (SELECT * FROM px WHERE image_id = 0 AND x < 3 AND y < 2)"""


def sql_scaled() -> str:
    """The logo at every planned size: area average, colours weighted by alpha."""
    weight = "(least((l.x + 1) * w, (u + 1) * 3) - greatest(l.x * w, u * 3)) * (least((l.y + 1) * h, (v + 1) * 2) - greatest(l.y * h, v * 2))"
    mixed = ", ".join(f"CASE WHEN sum(a * k) = 0 THEN 0 ELSE {store(f'CAST(sum({c} * a * k) AS DOUBLE) / sum(a * k)')} END AS {c}" for c in "rgb")
    return f"""wt AS (SELECT kind, w, h, u, v, l.r, l.g, l.b, l.a, {weight} AS k FROM bx, range(8) a(u), range(8) b(v), lg l
      WHERE u < w AND v < h AND (l.x + 1) * w > u * 3 AND (u + 1) * 3 > l.x * w AND (l.y + 1) * h > v * 2 AND (v + 1) * 2 > l.y * h),
  sc AS MATERIALIZED (SELECT kind, u, v, {mixed}, {store('CAST(sum(a * k) AS DOUBLE) / sum(k)')} AS a FROM wt GROUP BY kind, u, v)"""


def sql_drawn() -> str:
    """Every pixel with the one tile that covers it (tiles of a plan do not overlap)."""
    top = "(l.a / 255e0 * 0.4e0)"
    whole = f"({top} + s.a / 255e0 * (1 - {top}))"

    def mixed(c: str) -> str:
        value = f"(l.{c} * {top} + s.{c} * (s.a / 255e0 * (1 - {top}))) / nullif({whole}, 0)"
        return f"CASE WHEN l.u IS NULL THEN s.{c} WHEN {whole} = 0 THEN 0 ELSE {store(value)} END AS {c}"

    return f"""cv AS MATERIALIZED (SELECT kind, tx + u AS x, ty + v AS y, u, sc.r, sc.g, sc.b, sc.a FROM ti JOIN sc USING (kind))
  SELECT s.image_id, s.x, s.y, {', '.join(mixed(c) for c in 'rgb')}, CASE WHEN l.u IS NULL THEN s.a ELSE {store(f'{whole} * 255e0')} END AS a
  FROM px s LEFT JOIN cv l ON l.kind = s.image_id % 4 AND l.x = s.x AND l.y = s.y"""


@query("overlay_logo", f"WITH {PX}, {SQL_PLANS}, {sql_scaled()}, {sql_drawn()}")
def overlay_logo(spark, sf_dir):
    images, kind = D.images(spark, sf_dir), F.col("image_id") % 4
    part = lambda c: F.concat(F.slice(c, 1, 3), F.slice(c, D.SIDE + 1, 3)).alias(c)
    logos = images.where("image_id = 0").select(F.lit("own").alias("logo_id"), F.lit(3).alias("width"), F.lit(2).alias("height"), *[part(c) for c in "rgba"])
    watermarks = logos.select(F.col("logo_id"), F.col("width").alias("logo_w"), F.col("height").alias("logo_h"), F.explode(F.array(*[
        F.struct(F.lit(k).cast("long").alias("watermark_id"), F.lit(s).alias("size"), F.lit(p).alias("position"), F.lit(k < 3).alias("enabled"))
        for k, (s, p) in enumerate([(30.0, "tile"), (50.0, "bottomRight"), (80.0, "center"), (60.0, "center")])])).alias("w")).select(
        "logo_id", "logo_w", "logo_h", "w.*", F.lit("logo").alias("type"))
    boxes = G.plan_watermark_box(images.select("image_id", "width", "height", kind.alias("watermark_id")), watermarks)
    tiled = F.col("position") == "tile"
    tiles = G.plan_watermark_tiles(boxes.where(tiled), "logo").join(boxes.select("image_id", "logo_id", "box_w", "box_h"), "image_id")
    single = boxes.where(~tiled).select("image_id", F.col("box_x").alias("x"), F.col("box_y").alias("y"), "logo_id", "box_w", "box_h")
    return N.unpack_pixels(B.overlay_logo(images, logos, tiles.unionByName(single), 0.4)).select(*OUT)


def _stretched(spark, sf_dir):
    images = D.images(spark, sf_dir)
    model_output = images.select("image_id", "width", "height", F.transform("g", lambda v: v / 255.0).alias("v"))
    return images, B.stretch_gamma(model_output)


SQL_STRETCH = f"""lum AS (SELECT image_id, x, y, g / 255e0 AS v FROM px), sp AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM lum GROUP BY image_id),
  sg AS (SELECT image_id, x, y, {half8('pow(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE v END, 0.7e0) * 255e0')} AS v FROM lum JOIN sp USING (image_id))"""


@query("stretch_gamma", f"WITH {PX}, {SQL_STRETCH} SELECT * FROM sg")
def stretch_gamma(spark, sf_dir):
    planes = _stretched(spark, sf_dir)[1].select("image_id", "width", "height", *[F.col("v").alias(c) for c in "rgba"])
    return N.unpack_pixels(planes).select("image_id", "x", "y", F.col("r").alias("v"))


@query("preserve_color", f"""WITH {PX}, {SQL_STRETCH}, j AS (SELECT px.*, v, r * 0.299e0 + g * 0.587e0 + b * 0.114e0 AS base FROM px JOIN sg USING (image_id, x, y))
  SELECT image_id, x, y, {', '.join(f"CASE WHEN base > 5 THEN {half8(f'{c} * least(greatest(v / base, 0.2e0), 2e0)')} ELSE v END AS {c}" for c in 'rgb')},
  CAST(255 AS INTEGER) AS a FROM j""")
def preserve_color(spark, sf_dir):
    images, luma = _stretched(spark, sf_dir)
    return N.unpack_pixels(B.preserve_color(luma, images)).select(*OUT)


@query("to_tensor", f"""WITH {PX}, long AS (SELECT image_id, CAST(y * 8 + x AS INTEGER) AS pos, r AS v FROM px
    UNION ALL SELECT image_id, 64 + y * 8 + x, g FROM px UNION ALL SELECT image_id, 128 + y * 8 + x, b FROM px)
  SELECT image_id, '1,3,8,8' AS dims, pos, round(CAST(CAST(v / 255e0 AS FLOAT) AS DOUBLE), 6) AS value FROM long""")
def to_tensor(spark, sf_dir):
    tensors = B.to_tensor(D.images(spark, sf_dir))
    return tensors.select("image_id", _joined(F.col("tensor.dims")).alias("dims"), F.posexplode("tensor.data").alias("pos", "v")).select(
        "image_id", "dims", "pos", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("to_tensor_gray", f"""WITH {PX} SELECT image_id, '1,1,8,8' AS dims, CAST(y * 8 + x AS INTEGER) AS pos, round(CAST(CAST(r / 255e0 AS FLOAT) AS DOUBLE), 6) AS value FROM px""")
def to_tensor_gray(spark, sf_dir):
    tensors = B.to_tensor(D.images(spark, sf_dir), gray=True)
    return tensors.select("image_id", _joined(F.col("tensor.dims")).alias("dims"), F.posexplode("tensor.data").alias("pos", "v")).select(
        "image_id", "dims", "pos", F.round(F.col("v").cast("double"), 6).alias("value"))


@query("from_tensor", f"""WITH t AS (SELECT vec_id AS image_id, list_transform(embedding, lambda v: CAST(v::DOUBLE + 0.5e0 AS FLOAT)::DOUBLE) AS d FROM embeddings)
  SELECT image_id, CAST(i % 4 AS INTEGER) AS x, CAST(i // 4 AS INTEGER) AS y, {store('d[i + 1] * 255e0')} AS r, {store('d[i + 17] * 255e0')} AS g,
  {store('d[i + 33] * 255e0')} AS b, {store('d[i + 49] * 255e0')} AS a FROM t, range(16) k(i)""")
def from_tensor(spark, sf_dir):
    data = F.transform("embedding", lambda v: (v.cast("double") + 0.5).cast("float"))
    dims = F.array(F.lit(1), F.lit(4), F.lit(4), F.lit(4))
    tensors = D.vectors(spark, sf_dir).select("image_id", F.struct(dims.alias("dims"), data.alias("data")).alias("tensor"))
    return N.from_tensor(tensors).select(*OUT)


# ---- quality ----

SQL_KERNELS = """lap AS (SELECT * FROM (VALUES (0,-1,1),(-1,0,1),(0,0,-4),(1,0,1),(0,1,1)) t(dx, dy, k)),
  bin AS (SELECT * FROM (VALUES (-1,-1,1),(0,-1,2),(1,-1,1),(-1,0,2),(0,0,4),(1,0,2),(-1,1,1),(0,1,2),(1,1,1)) t(dx, dy, k))"""
SQL_GRAY = "gr AS (SELECT image_id, x, y, r AS v FROM px)"
SQL_NOISE = "abs(v - floor((s + 8) / 16))"


@query("kpi_sharpness", f"WITH {PX}, {SQL_GRAY}, {SQL_KERNELS}, {sql_gray_filter('lap', 'e')} SELECT image_id, round(avg(s * s) - avg(s) * avg(s), 4) AS sharpness FROM e GROUP BY image_id")
def kpi_sharpness(spark, sf_dir):
    return B.quality_kpis(D.gray_images(spark, sf_dir)).select("image_id", F.round("sharpness", 4).alias("sharpness"))


@query("kpi_noise", f"WITH {PX}, {SQL_GRAY}, {SQL_KERNELS}, {sql_gray_filter('bin', 'e')} SELECT image_id, round(stddev_pop({SQL_NOISE}), 4) AS noise_level FROM e GROUP BY image_id")
def kpi_noise(spark, sf_dir):
    return B.quality_kpis(D.gray_images(spark, sf_dir)).select("image_id", F.round("noise_level", 4).alias("noise_level"))


@query("kpi_contrast", f"WITH {PX}, {SQL_GRAY} SELECT image_id, round(stddev_pop(v), 4) AS contrast FROM gr GROUP BY image_id")
def kpi_contrast(spark, sf_dir):
    return K.kpi_contrast(D.gray(spark, sf_dir)).select("image_id", F.round("contrast", 4).alias("contrast"))


@query("kpi_exposure", f"WITH {PX}, {SQL_GRAY} SELECT image_id, round(avg(v), 4) AS exposure FROM gr GROUP BY image_id")
def kpi_exposure(spark, sf_dir):
    return K.kpi_exposure(D.gray(spark, sf_dir)).select("image_id", F.round("exposure", 4).alias("exposure"))


SQL_KPIS = f"""gr AS (SELECT image_id, x, y, {SQL_LUMA} AS v FROM px), {SQL_KERNELS}, {sql_gray_filter('lap', 'el')}, {sql_gray_filter('bin', 'eb')},
  k1 AS (SELECT image_id, avg(s * s) - avg(s) * avg(s) AS sharpness FROM el GROUP BY image_id),
  k2 AS (SELECT image_id, stddev_pop({SQL_NOISE}) AS noise_level, stddev_pop(v) AS contrast, avg(v) AS exposure FROM eb GROUP BY image_id),
  kp AS (SELECT image_id, CAST(8 + image_id % 3 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, sharpness, noise_level, contrast, exposure FROM k1 JOIN k2 USING (image_id))"""


@query("quality_kpis", f"""WITH {PX}, {SQL_KPIS} SELECT image_id, width, height, {', '.join(f'round({c}, 4) AS {c}' for c in ('sharpness', 'noise_level', 'contrast', 'exposure'))} FROM kp""")
def quality_kpis(spark, sf_dir):
    sizes = D.image_sizes(spark, sf_dir).select("image_id", F.struct("width", "height").alias("resolution"))
    kpis = B.quality_kpis(D.images(spark, sf_dir)).drop("resolution").join(sizes, "image_id")
    return kpis.select("image_id", "resolution.width", "resolution.height",
                       *[F.round(c, 4).alias(c) for c in ("sharpness", "noise_level", "contrast", "exposure")])
