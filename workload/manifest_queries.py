"""Manifest, plan and name queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import text as T
from framelake.operators import manifest as M
from framelake.operators import naming as N
from framelake.plans import geometry as G
from framelake.plans import tables as P
from workload import tables as D
from workload.registry import query

MF = D.SQL_MANIFEST

SIGNATURE = "CASE image_id % 4 WHEN 0 THEN '000000186674797068656963' WHEN 1 THEN '00000018667479706865766300' WHEN 2 THEN '89504e470d0a1a0a0000000d' ELSE 'ffd8ffe000104a4649460001' END"


@query("detect_heic", f"""WITH {MF} SELECT image_id, name,
  (lower(name) LIKE '%.heic' OR lower(name) LIKE '%.heif' OR mime IN ('image/heic', 'image/heif') OR image_id % 4 IN (0, 1)) AS is_heic FROM mf""")
def detect_heic(spark, sf_dir):
    content = F.unhex(F.expr(SIGNATURE))
    return M.detect_heic(D.manifest(spark, sf_dir).withColumn("content", content)).select("image_id", "name", "is_heic")


@query("source_format", f"""WITH {MF} SELECT image_id,
  CASE WHEN split_part(mime, '/', 2) = '' THEN 'unknown' ELSE split_part(mime, '/', 2) END AS original_format FROM mf""")
def source_format(spark, sf_dir):
    return M.source_format(D.manifest(spark, sf_dir)).select("image_id", "original_format")


def _batches(spark, sf_dir):
    m = D.manifest(spark, sf_dir).select("image_id", "original_index", "name")
    return m.where("image_id % 50 = 0"), m.where("image_id % 50 <> 0")


@query("admit_batch", f"""WITH {MF}, old AS (SELECT * FROM mf WHERE image_id % 50 = 0)
  SELECT image_id, name FROM old UNION ALL
  SELECT image_id, name FROM (SELECT *, row_number() OVER (ORDER BY original_index) AS k FROM mf WHERE image_id % 50 <> 0)
  WHERE k <= greatest(100 - (SELECT count(*) FROM old), 0)""")
def admit_batch(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    return M.admit_batch(old, new, 100, "original_index").select("image_id", "name")


@query("assign_index", f"""WITH {MF} SELECT name,
  (SELECT count(*) FROM mf WHERE image_id % 50 = 0) + row_number() OVER (ORDER BY name) - 1 AS original_index,
  CAST((SELECT count(*) FROM mf WHERE image_id % 50 = 0) + row_number() OVER (ORDER BY name) - 1 AS VARCHAR) AS image_id
  FROM mf WHERE image_id % 50 <> 0""")
def assign_index(spark, sf_dir):
    old, new = _batches(spark, sf_dir)
    return M.assign_index(old, new.drop("image_id", "original_index"), ["name"]).select("name", "original_index", "image_id")


def _results(spark, sf_dir):
    m = D.manifest(spark, sf_dir)
    return m.withColumn("result", F.when(~F.col("mime").isin("image/heif", ""), F.concat("name", F.lit(".ok"))))


@query("split_failures", f"""WITH {MF} SELECT image_id, name || '.ok' AS result, CAST(NULL AS VARCHAR) AS error
  FROM mf WHERE mime NOT IN ('image/heif', '') UNION ALL
  SELECT image_id, NULL, 'No result for ' || name || CASE WHEN mime = '' THEN '' ELSE ': ' || mime || ' cannot be read' END
  FROM mf WHERE mime IN ('image/heif', '')""")
def split_failures(spark, sf_dir):
    reason = F.when(F.col("mime") != "", F.concat("mime", F.lit(" cannot be read")))
    ok, errors = M.split_failures(_results(spark, sf_dir).withColumn("reason", reason), "result", reason_col="reason")
    text = F.lit(None).cast("string")
    return ok.select("image_id", "result", text.alias("error")).unionByName(errors.select("image_id", text.alias("result"), "error"))


@query("delete_images", f"""WITH {MF} SELECT 'manifest' AS part, image_id FROM mf WHERE image_id % 7 <> 3
  UNION ALL SELECT 'seo', image_id FROM mf WHERE image_id % 7 <> 3 AND image_id % 2 = 0""")
def delete_images(spark, sf_dir):
    m = D.manifest(spark, sf_dir)
    ids = m.where("image_id % 7 = 3").select("image_id")
    kept, seo = M.delete_images(m, m.where("image_id % 2 = 0"), ids)
    return kept.select(F.lit("manifest").alias("part"), "image_id").unionByName(seo.select(F.lit("seo").alias("part"), "image_id"))


@query("skip_processed", f"WITH {MF} SELECT image_id, name FROM mf WHERE NOT background_removed")
def skip_processed(spark, sf_dir):
    m = D.manifest(spark, sf_dir)
    return M.skip_processed(m, m.where("background_removed")).select("image_id", "name")


@query("apply_settings", f"""WITH {MF} SELECT image_id, CASE WHEN image_id = 17 THEN 'standard' ELSE 'none' END AS one_name,
  CASE WHEN image_id = 17 THEN 85 ELSE 70 END AS one_quality, 'standard' AS all_name, 85 AS all_quality FROM mf""")
def apply_settings(spark, sf_dir):
    m = D.manifest(spark, sf_dir).withColumns({"preset_name": F.lit("none"), "quality": F.lit(70)})
    settings = {"preset_name": "standard", "quality": 85}
    one = M.apply_settings(m, settings, selected_id=17).withColumnsRenamed({"preset_name": "one_name", "quality": "one_quality"})
    both = one.withColumns({"preset_name": F.lit("none"), "quality": F.lit(70)})
    done = M.apply_settings(both, settings, apply_all=True).withColumnsRenamed({"preset_name": "all_name", "quality": "all_quality"})
    return done.select("image_id", "one_name", "one_quality", "all_name", "all_quality")


@query("size_label", f"""WITH {MF}, h AS (SELECT image_id, size_bytes,
   CASE WHEN size_bytes >= 1048576 THEN (size_bytes * 100 + 524288) // 1048576 ELSE (size_bytes * 100 + 512) // 1024 END AS n FROM mf)
  SELECT image_id, (n // 100) || '.' || lpad(CAST(n % 100 AS VARCHAR), 2, '0')
    || CASE WHEN size_bytes >= 1048576 THEN ' MB' ELSE ' KB' END AS size_label FROM h""")
def size_label(spark, sf_dir):
    return M.size_label(D.manifest(spark, sf_dir)).select("image_id", "size_label")


# ---- plans ----

SQL_PRESETS = """pre AS (SELECT * FROM (VALUES ('web-optimized', 1080, NULL, 75), ('standard', 1080, NULL, 85),
  ('high-quality', 1440, NULL, 95), ('max-quality', 2160, NULL, 100), ('custom', 1200, 630, 90)) t(preset_id, width, height, quality))"""
PRESET_OF = "['web-optimized', 'standard', 'high-quality', 'max-quality', 'custom', 'none'][p_partkey % 6 + 1]"


def _with_preset(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("web-optimized", "standard", "high-quality", "max-quality", "custom", "none")])
    return D.manifest(spark, sf_dir).withColumn("preset_id", F.get(names, (F.col("image_id") % 6).cast("int")))


def _presets(spark):
    return P.resolve_preset(P.presets(spark), P.custom_preset(spark, "1200", "630px", "90", keep_aspect=False))


@query("resolve_preset", f"""WITH {SQL_PRESETS}, m AS (SELECT p_partkey, {PRESET_OF} AS preset_id FROM part)
  SELECT p_partkey AS image_id, preset_id, CAST(width AS INTEGER) AS preset_w, CAST(height AS INTEGER) AS preset_h,
  CAST(quality AS INTEGER) AS preset_quality FROM m LEFT JOIN pre USING (preset_id)""")
def resolve_preset(spark, sf_dir):
    chosen = _presets(spark).select("preset_id", F.col("width").alias("preset_w"), F.col("height").alias("preset_h"),
                                    F.col("quality").alias("preset_quality"))
    return _with_preset(spark, sf_dir).select("image_id", "preset_id").join(chosen, "preset_id", "left")


@query("plan_resize", f"""WITH {MF}, {SQL_PRESETS}, m AS (SELECT image_id, mf.width AS w, mf.height AS h, pre.width AS pw, pre.height AS ph
    FROM mf LEFT JOIN pre ON pre.preset_id = ['web-optimized', 'standard', 'high-quality', 'max-quality', 'custom', 'none'][image_id % 6 + 1])
  SELECT image_id, CAST(CASE WHEN pw IS NOT NULL THEN pw WHEN ph IS NOT NULL THEN floor(w * (ph::DOUBLE / h) + 0.5e0) ELSE w END AS INTEGER) AS target_w,
  CAST(CASE WHEN ph IS NOT NULL THEN ph WHEN pw IS NOT NULL THEN floor(h * (pw::DOUBLE / w) + 0.5e0) ELSE h END AS INTEGER) AS target_h FROM m""")
def plan_resize(spark, sf_dir):
    return G.plan_resize(_with_preset(spark, sf_dir), _presets(spark)).select("image_id", "target_w", "target_h")


@query("plan_preview", f"""WITH {MF} SELECT image_id, CAST(CASE WHEN width > 800 THEN 800 ELSE width END AS INTEGER) AS target_w,
  CAST(CASE WHEN width > 800 THEN floor(height * (800e0 / width) + 0.5e0) ELSE height END AS INTEGER) AS target_h FROM mf""")
def plan_preview(spark, sf_dir):
    return G.plan_preview(D.manifest(spark, sf_dir)).select("image_id", "target_w", "target_h")


@query("plan_thumbnail", f"""WITH {MF} SELECT image_id,
  CAST(CASE WHEN width >= height AND width > 800 THEN 800 WHEN height > width AND height > 800 THEN floor(800 * (width::DOUBLE / height) + 0.5e0) ELSE width END AS INTEGER) AS target_w,
  CAST(CASE WHEN width >= height AND width > 800 THEN floor(800 * (height::DOUBLE / width) + 0.5e0) WHEN height > width AND height > 800 THEN 800 ELSE height END AS INTEGER) AS target_h FROM mf""")
def plan_thumbnail(spark, sf_dir):
    return G.plan_thumbnail(D.manifest(spark, sf_dir)).select("image_id", "target_w", "target_h")


@query("plan_bounded_1200", f"""WITH {MF} SELECT image_id,
  CAST(CASE WHEN width > height AND width > 1200 THEN 1200 WHEN height > 1200 THEN floor(width * (1200e0 / height) + 0.5e0) ELSE width END AS INTEGER) AS target_w,
  CAST(CASE WHEN width > height AND width > 1200 THEN floor(height * (1200e0 / width) + 0.5e0) WHEN height > 1200 THEN 1200 ELSE height END AS INTEGER) AS target_h FROM mf""")
def plan_bounded_1200(spark, sf_dir):
    return G.plan_bounded_1200(D.manifest(spark, sf_dir)).select("image_id", "target_w", "target_h")


@query("plan_bounded_1600", f"""WITH {MF}, q AS (SELECT *, width / 1600e0 AS wr, height / 1600e0 AS hr, (width > 1600 OR height > 1600) AS big FROM mf)
  SELECT image_id, CAST(CASE WHEN NOT big THEN width WHEN wr >= hr THEN 1600 ELSE floor(width / hr) END AS INTEGER) AS target_w,
  CAST(CASE WHEN NOT big THEN height WHEN wr >= hr THEN floor(height / wr) ELSE 1600 END AS INTEGER) AS target_h FROM q""")
def plan_bounded_1600(spark, sf_dir):
    return G.plan_bounded_1600(D.manifest(spark, sf_dir)).select("image_id", "target_w", "target_h")


@query("plan_letterbox", f"""WITH {MF}, s AS (SELECT image_id, width AS w0, height AS h0,
    CASE WHEN height > width THEN width::DOUBLE / height * 96 ELSE 128e0 END AS nw,
    CASE WHEN width > height THEN height::DOUBLE / width * 128 ELSE 96e0 END AS nh FROM mf)
  SELECT image_id, CASE WHEN h0 > w0 THEN floor((128 - nw) / 2) ELSE 0e0 END AS box_x,
  CASE WHEN w0 > h0 THEN floor((96 - nh) / 2) ELSE 0e0 END AS box_y, round(nw, 6) AS box_w, round(nh, 6) AS box_h FROM s""")
def plan_letterbox(spark, sf_dir):
    p = G.plan_letterbox(D.manifest(spark, sf_dir), 128, 96)
    return p.select("image_id", "box_x", "box_y", F.round("box_w", 6).alias("box_w"), F.round("box_h", 6).alias("box_h"))


# every stage with every format it can be asked for
ENCODING_CASES = [("edit", "jpg"), ("download", "jpg"), ("download", "webp"), ("zip", "jpg"), ("zip", "webp"), ("convert", "jpg"), ("convert", "png"),
                  ("convert", "webp"), ("convert", "avif"), ("thumbnail", "jpg")]


@query("plan_encoding", f"""WITH {MF}, m AS (SELECT image_id, mime AS m0, background_removed AS bg, CASE WHEN image_id % 3 = 0 THEN 75 END AS pq FROM mf),
  asked(stage, asked) AS (VALUES ('edit', 'jpg'), ('download', 'jpg'), ('download', 'webp'), ('zip', 'jpg'), ('zip', 'webp'), ('convert', 'jpg'),
    ('convert', 'png'), ('convert', 'webp'), ('convert', 'avif'), ('thumbnail', 'jpg')),
  t AS (SELECT m.*, stage, asked, CASE WHEN stage = 'convert' THEN asked WHEN stage = 'thumbnail' THEN CASE WHEN m0 = 'image/png' THEN 'png' ELSE 'jpg' END
    WHEN bg THEN 'png' WHEN stage = 'edit' THEN 'jpg' ELSE asked END AS f FROM m CROSS JOIN asked)
  SELECT image_id, stage, asked, CASE WHEN f = 'jpg' AND stage <> 'convert' THEN 'image/jpeg' ELSE 'image/' || f END AS output_mime,
    CASE stage WHEN 'edit' THEN coalesce(pq / 100e0, 0.85e0) WHEN 'convert' THEN coalesce(pq / 100e0, 0.95e0)
      WHEN 'download' THEN CASE f WHEN 'jpg' THEN 0.9e0 WHEN 'webp' THEN 0.8e0 ELSE 1.0e0 END
      WHEN 'zip' THEN CASE WHEN f <> 'png' THEN 0.9e0 END
      ELSE CASE WHEN f = 'png' THEN 1.0e0 ELSE 0.95e0 END END AS quality FROM t""")
def plan_encoding(spark, sf_dir):
    m = D.manifest(spark, sf_dir).withColumn("preset_quality", F.when(F.col("image_id") % 3 == 0, 75))
    parts = [
        G.plan_encoding(m, P.ENCODING_RULES, stage, fmt).select(
            "image_id", F.lit(stage).alias("stage"), F.lit(fmt).alias("asked"), "output_mime", "quality")
        for stage, fmt in ENCODING_CASES
    ]
    return reduce(DataFrame.unionByName, parts)


LOOK_NAMES = [*P.LOOKS, "plain"]


# fixed values, written out so that a wrong constant of the library shows
SQL_LOOKS = """looks AS (SELECT * FROM (VALUES
  ('vivid', 0.0e0, 10.0e0, 100.0e0, 120.0e0, 110.0e0, 0.0e0, 1.0e0, 1.0e0, 1.0e0),
  ('sharp', 10.0e0, 15.0e0, 100.0e0, 100.0e0, 100.0e0, 1.5e0, 1.0e0, 1.0e0, 1.0e0),
  ('classic', 0.0e0, 0.0e0, 100.0e0, 90.0e0, 105.0e0, 0.0e0, 1.1e0, 1.0e0, 0.9e0),
  ('clean', 10.0e0, 5.0e0, 100.0e0, 95.0e0, 105.0e0, 0.2e0, 1.0e0, 1.0e0, 1.0e0),
  ('white-bg', 25.0e0, 15.0e0, 100.0e0, 90.0e0, 115.0e0, 0.2e0, 1.0e0, 1.0e0, 1.0e0),
  ('dramatic', 5.0e0, 25.0e0, 100.0e0, 110.0e0, 95.0e0, 0.3e0, 1.0e0, 1.0e0, 1.0e0),
  ('jewelry', 10.0e0, 15.0e0, 100.0e0, 85.0e0, 108.0e0, 0.4e0, 1.05e0, 1.02e0, 1.1e0),
  ('soft-product', 15.0e0, 5.0e0, 100.0e0, 105.0e0, 110.0e0, 0.0e0, 1.02e0, 1.02e0, 1.0e0),
  ('textile', 8.0e0, 12.0e0, 100.0e0, 110.0e0, 103.0e0, 0.2e0, 1.02e0, 1.0e0, 0.98e0),
  ('food', 5.0e0, 18.0e0, 100.0e0, 115.0e0, 105.0e0, 0.2e0, 1.05e0, 1.03e0, 0.97e0),
  ('furniture', 8.0e0, 10.0e0, 100.0e0, 95.0e0, 102.0e0, 0.5e0, 1.03e0, 1.0e0, 0.95e0),
  ('transparent', 12.0e0, 20.0e0, 100.0e0, 85.0e0, 112.0e0, 0.3e0, 0.98e0, 1.0e0, 1.04e0),
  ('plain', 0.0e0, 0.0e0, 100.0e0, 100.0e0, 100.0e0, 0.0e0, 1.0e0, 1.0e0, 1.0e0)
) t(look, brightness, contrast, hue, saturation, lightness, sharpen, red_scale, green_scale, blue_scale))"""
SQL_LOOK_OF = "[" + ", ".join(f"'{x}'" for x in LOOK_NAMES) + "]"


def look_of(key):
    return F.get(F.array(*[F.lit(x) for x in LOOK_NAMES]), (key % len(LOOK_NAMES)).cast("int"))


@query("plan_adjustments", f"""WITH {MF}, {SQL_LOOKS} SELECT image_id, look, {', '.join(P.NEUTRAL)}
  FROM mf JOIN looks ON look = {SQL_LOOK_OF}[image_id % {len(LOOK_NAMES)} + 1]""")
def plan_adjustments(spark, sf_dir):
    m = D.manifest(spark, sf_dir).withColumn("look", look_of(F.col("image_id")))
    return G.plan_adjustments(m, P.looks(spark), P.NEUTRAL).select("image_id", "look", *P.NEUTRAL)


def _watermarks(spark, kind):
    """One setting per position, plus a disabled one."""
    rows = ", ".join(f"({k}, true, '{kind}', '{p}', {10 + 12 * k}.0D, 300, 100)" for k, p in enumerate(P.WATERMARK_POSITIONS))
    return spark.sql(
        f"SELECT * FROM VALUES {rows}, (7, false, '{kind}', 'center', 10.0D, 300, 100) "
        "AS t(watermark_id, enabled, type, position, size, logo_w, logo_h)"
    )


SQL_POSITIONS = "['topLeft', 'topRight', 'bottomLeft', 'bottomRight', 'center', 'diagonal', 'tile']"
SQL_BOX = f"""wm AS (SELECT image_id, width AS cw, height AS ch, {SQL_POSITIONS}[image_id % 8 + 1] AS pos,
    least(width, height) * ((10 + 12 * (image_id % 8)) / 100e0) AS base, 3e0 AS ar FROM mf WHERE image_id % 8 < 7),
  w1 AS (SELECT *, CASE WHEN base > cw * 0.9e0 THEN cw * 0.9e0 ELSE base END AS bw,
    CASE WHEN base > cw * 0.9e0 THEN cw * 0.9e0 / ar ELSE base / ar END AS bh FROM wm),
  w2 AS (SELECT *, CAST(floor(CASE WHEN bh > ch * 0.9e0 THEN ch * 0.9e0 * ar ELSE bw END + 0.5e0) AS INTEGER) AS box_w,
    CAST(floor(CASE WHEN bh > ch * 0.9e0 THEN ch * 0.9e0 ELSE bh END + 0.5e0) AS INTEGER) AS box_h, least(cw, ch) * 0.02e0 AS mg FROM w1)"""


def _boxes(spark, sf_dir):
    m = D.manifest(spark, sf_dir).withColumn("watermark_id", (F.col("image_id") % 8).cast("int"))
    return G.plan_watermark_box(m, _watermarks(spark, "logo"))


@query("plan_watermark_box", f"""WITH {MF}, {SQL_BOX} SELECT image_id,
  round(CASE WHEN pos IN ('topLeft', 'bottomLeft') THEN mg WHEN pos IN ('center', 'diagonal') THEN (cw - box_w) / 2e0 WHEN pos = 'tile' THEN 0e0 ELSE cw - box_w - mg END, 6) AS box_x,
  round(CASE WHEN pos IN ('topLeft', 'topRight') THEN mg WHEN pos IN ('center', 'diagonal') THEN (ch - box_h) / 2e0 WHEN pos = 'tile' THEN 0e0 ELSE ch - box_h - mg END, 6) AS box_y,
  box_w, box_h FROM w2""")
def plan_watermark_box(spark, sf_dir):
    return _boxes(spark, sf_dir).select("image_id", F.round("box_x", 6).alias("box_x"), F.round("box_y", 6).alias("box_y"), "box_w", "box_h")


@query("plan_watermark_text", f"""WITH {MF}, t AS (SELECT image_id, width AS w, height AS h, {SQL_POSITIONS}[image_id % 8 + 1] AS pos,
    60 + image_id % 40 + 0.5e0 AS tw, 12e0 + image_id % 9 AS th, 10 + 12 * (image_id % 8) AS size, least(width, height) * 0.02e0 AS mg FROM mf WHERE image_id % 8 < 7)
  SELECT image_id, round(greatest(10e0, least(w, h) * (size / 100e0)), 6) AS font_px,
  round(CASE pos WHEN 'diagonal' THEN w / 2e0 WHEN 'tile' THEN 0e0 WHEN 'topLeft' THEN mg WHEN 'bottomLeft' THEN mg
    WHEN 'center' THEN (w - tw) / 2 + tw / 2 ELSE w - tw - mg + tw END, 6) AS text_x,
  round(CASE pos WHEN 'diagonal' THEN h / 2e0 WHEN 'tile' THEN 0e0 WHEN 'topLeft' THEN mg + th / 2 WHEN 'topRight' THEN mg + th / 2
    WHEN 'center' THEN (h - th) / 2 + th / 2 ELSE h - th - mg + th / 2 END, 6) AS text_y,
  CASE WHEN pos IN ('topLeft', 'bottomLeft') THEN 'left' WHEN pos IN ('topRight', 'bottomRight') THEN 'right' ELSE 'center' END AS align,
  CASE pos WHEN 'diagonal' THEN -45e0 WHEN 'tile' THEN -30e0 ELSE 0e0 END AS angle FROM t""")
def plan_watermark_text(spark, sf_dir):
    m = D.manifest(spark, sf_dir).withColumn("watermark_id", (F.col("image_id") % 8).cast("int"))
    metrics = m.select("image_id", (F.col("image_id") % 40 + 60.5).alias("text_w"), (F.col("image_id") % 9 + 12.0).alias("text_h"))
    planned = G.plan_watermark_text(m, _watermarks(spark, "text"), metrics)
    return planned.select("image_id", *[F.round(c, 6).alias(c) for c in ("font_px", "text_x", "text_y")], "align", "angle")


@query("plan_watermark_tiles", f"""WITH {MF}, {SQL_BOX}, s AS (SELECT image_id, cw, ch, box_w * 1.5e0 AS sx, box_h * 1.5e0 AS sy FROM w2 WHERE pos = 'tile' AND box_w > 0 AND box_h > 0)
  SELECT image_id, xs.i * sx AS x, ys.i * sy AS y FROM s,
  LATERAL (SELECT unnest(range(CAST(ceil((cw + sx) / sx) AS BIGINT))) AS i) xs, LATERAL (SELECT unnest(range(CAST(ceil((ch + sy) / sy) AS BIGINT))) AS i) ys""")
def plan_watermark_tiles(spark, sf_dir):
    return G.plan_watermark_tiles(_boxes(spark, sf_dir).where("position = 'tile'"), "logo")


# ---- names ----

SPACE_RE = r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SPACE_IN = SPACE_RE[1:-1]


def _sql_slug(text: str) -> str:
    plain = f"regexp_replace(lower({text}), '[^a-z0-9{SPACE_IN}-]', '', 'g')"
    trimmed = f"regexp_replace({plain}, '^{SPACE_RE}+|{SPACE_RE}+$', '', 'g')"
    cut = f"substr(regexp_replace({trimmed}, '{SPACE_RE}+', '-', 'g'), 1, 50)"
    return f"coalesce(nullif({cut}, ''), 'image')"


@query("seo_slug", f"SELECT doc_id, {_sql_slug('text')} AS slug FROM documents")
def seo_slug(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", T.seo_slug(F.col("text")).alias("slug"))


SQL_SEO = f"""sn AS (SELECT image_id, name AS original_name, {_sql_slug('description')} || '-' || row_number() OVER (ORDER BY original_index) AS seo_name,
  description, coalesce(nullif(regexp_extract(name, '[^.]*$'), ''), 'jpg') AS extension FROM mf)"""


def _seo(spark, sf_dir):
    return N.seo_names(D.manifest(spark, sf_dir), ["original_index"])


@query("seo_names", f"WITH {MF}, {SQL_SEO} SELECT * FROM sn")
def seo_names(spark, sf_dir):
    return _seo(spark, sf_dir)


@query("apply_seo_names", f"""WITH {MF}, {SQL_SEO} SELECT mf.image_id, CASE WHEN mf.image_id % 3 = 0 THEN sn.seo_name END AS seo_name,
  CASE WHEN mf.image_id % 3 = 0 THEN mf.name END AS original_name FROM mf JOIN sn USING (image_id)""")
def apply_seo_names(spark, sf_dir):
    text = F.lit(None).cast("string")
    m = D.manifest(spark, sf_dir).withColumns({"seo_name": text, "original_name": text})
    named = N.apply_seo_names(m, _seo(spark, sf_dir).where("image_id % 3 = 0"))
    return named.select("image_id", "seo_name", "original_name")


def _plain(text: str) -> str:
    out = f"translate(lower({text}), '{T.ACCENTED}', '{T.PLAIN}')"
    for letter, pair in T.LIGATURES.items():
        out = f"replace({out}, '{letter}', '{pair}')"
    kept = f"regexp_replace({out}, '[^a-z0-9_~{SPACE_IN}-]', '', 'g')"
    trimmed = f"regexp_replace({kept}, '^{SPACE_RE}+|{SPACE_RE}+$', '', 'g')"
    return f"substr(regexp_replace({trimmed}, '[{SPACE_IN}-]+', '-', 'g'), 1, 70)"


@query("caption_slug", f"SELECT doc_id, {_plain('text')} AS slug FROM documents")
def caption_slug(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", T.caption_slug(F.col("text")).alias("slug"))


@query("rename_format", f"""WITH {MF} SELECT image_id, regexp_replace(name, '\\.(jpg|jpeg|png|webp)$', '.webp', 'i') AS download_name,
  regexp_replace(name, '\\.(heic|heif)$', '.png', 'i') AS heic_name, regexp_replace(name, '\\.[^.]*$', '') || '.avif' AS converted_name FROM mf""")
def rename_format(spark, sf_dir):
    name = F.col("name")
    return D.manifest(spark, sf_dir).select(
        "image_id", T.rename_format(name, "webp").alias("download_name"), T.rename_format(name, "png", "heic").alias("heic_name"),
        T.rename_format(name, "avif", "convert").alias("converted_name"),
    )


def _half_named(spark, sf_dir):
    m = D.manifest(spark, sf_dir)
    return m.withColumn("seo_name", F.when(F.col("image_id") % 2 == 0, F.concat(F.lit("seo-"), F.col("image_id").cast("string"))))


@query("export_name", f"""WITH {MF}, e AS (SELECT *, CASE WHEN background_removed THEN 'png' ELSE 'webp' END AS output_format,
    row_number() OVER (ORDER BY original_index) AS k FROM mf)
  SELECT image_id, output_format, CASE WHEN image_id % 2 = 0 THEN 'seo-' || image_id ELSE regexp_replace(name, '\\.[^/.]+$', '') || '_' || k END
    || '.' || output_format AS file_name FROM e""")
def export_name(spark, sf_dir):
    return N.export_name(_half_named(spark, sf_dir), "webp", ["original_index"]).select("image_id", "output_format", "file_name")


@query("display_name", f"""WITH {MF} SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'seo-' || image_id || '.' ||
  CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '[^.]*$')) ELSE '' END ELSE name END AS display_name FROM mf""")
def display_name(spark, sf_dir):
    return N.display_name(_half_named(spark, sf_dir)).select("image_id", "display_name")


@query("caption_assemble", f"""WITH c AS (SELECT conv_id AS image_id, turn AS seq, CASE role WHEN 'user' THEN 'stream' WHEN 'assistant' THEN 'complete' ELSE 'error' END AS kind, text FROM conversations),
  g AS (SELECT image_id, coalesce(string_agg(text, '' ORDER BY seq) FILTER (kind = 'stream'), '') AS streamed,
    arg_max(text, seq) FILTER (kind = 'complete' AND image_id % 3 <> 0) AS done, coalesce(bool_or(kind = 'error'), false) AS failed FROM c GROUP BY image_id)
  SELECT image_id, coalesce(regexp_replace(done, '^{SPACE_RE}+|{SPACE_RE}+$', '', 'g'), streamed) AS caption, done IS NOT NULL AS completed, failed FROM g""")
def caption_assemble(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "stream").when(F.col("role") == "assistant", "complete").otherwise("error")
    chunks = D.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), F.col("turn").alias("seq"), kind.alias("kind"), "text")
    # every third caption never completes, so its partial text is kept
    arrived = chunks.where((F.col("kind") != "complete") | (F.col("image_id") % 3 != 0))
    lost = chunks.where((F.col("kind") == "complete") & (F.col("image_id") % 3 == 0)).withColumns({"kind": F.lit("dropped"), "text": F.lit("")})
    return N.caption_assemble(arrived.unionByName(lost))


@query("caption_default", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS p, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '' END AS d,
    CASE WHEN doc_id % 5 <> 0 THEN '  ' || lang || ' ' END AS s FROM documents)
  SELECT doc_id, coalesce(nullif(p, ''), 'Describe this image in detail.') AS prompt,
  regexp_replace(coalesce(nullif(d, ''), nullif(s, ''), ''), '^{SPACE_RE}+|{SPACE_RE}+$', '', 'g') AS caption FROM d""")
def caption_default(spark, sf_dir):
    k = F.col("doc_id")
    prompt, caption = T.caption_default(
        F.when(k % 2 == 0, F.col("source")).otherwise(""),
        F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, ""),
        F.when(k % 5 != 0, F.concat(F.lit("  "), "lang", F.lit(" "))),
    )
    return D.table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"), caption.alias("caption"))
