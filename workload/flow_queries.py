"""Status, sitemap, inference, file and streaming queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framelake.operators import inference as I
from framelake.operators import sitemap as M
from framelake.operators import status as S
from framelake.operators.naming import export_name as with_export_name
from framelake.operators.tensors import unpack_pixels
from framelake.scratch import scratch_path
from framelake.sources import files as A
from framelake.streaming import images as RI
from framelake.streaming import status as RS
from workload import tables as D
from workload.png_files import PNG_BYTES, image_files
from workload.registry import query

ST, MF, UP = D.SQL_STATUS, D.SQL_MANIFEST, D.SQL_URLS
HOUR = 3600


def _log(spark, sf_dir):
    return D.status_log(D.table(spark, sf_dir, "events"))


def _users(spark, sf_dir):
    """Images that may have messages: twice as many ids as have any."""
    log = _log(spark, sf_dir).select("image_id")
    return log.unionByName(log.select((F.col("image_id") + 1_000_000).alias("image_id"))).distinct()


SQL_LATEST = """ls AS (SELECT image_id, arg_max(status, (ts, event_id)) AS status, arg_max(progress, (ts, event_id)) AS progress,
  arg_max(message, (ts, event_id)) FILTER (status = 'error') AS last_error FROM st GROUP BY image_id)"""


@query("latest_status", f"""WITH {ST}, {SQL_LATEST} SELECT image_id, status, progress, last_error FROM ls
  UNION ALL SELECT DISTINCT image_id + 1000000, 'idle', CAST(0 AS INTEGER), NULL FROM st""")
def latest_status(spark, sf_dir):
    return S.latest_status(_users(spark, sf_dir), _log(spark, sf_dir))


SQL_COUNTS = """SELECT {by}count(*) FILTER (status = 'processing') AS submitted, count(*) FILTER (status = 'extraction_complete') AS finished,
  count(*) FILTER (status = 'error') AS failed FROM st {group}"""
SQL_PENDING = """*, submitted - finished - failed AS pending,
  images > 0 AND submitted - finished - failed = 0 AND results = images AS ready"""
# every image with messages, and as many without
SQL_IMAGES = "us AS (SELECT DISTINCT image_id FROM st UNION SELECT image_id + 1000000 FROM st)"


@query("pending_counts", f"""WITH {ST}, {SQL_IMAGES}, c AS ({SQL_COUNTS.format(by='', group='')}),
  n AS (SELECT *, (SELECT count(*) FROM us) AS images,
    (SELECT count(DISTINCT image_id) FROM st WHERE status IN ('extraction_complete', 'error')) AS results FROM c) SELECT {SQL_PENDING} FROM n""")
def pending_counts(spark, sf_dir):
    return S.pending_counts(_log(spark, sf_dir), _users(spark, sf_dir))


SQL_COUNTS_BY = SQL_COUNTS.format(by="image_id, ", group="GROUP BY image_id")


SQL_ONE = "*, CAST(1 AS BIGINT) AS images, CAST(CASE WHEN finished + failed > 0 THEN 1 ELSE 0 END AS BIGINT) AS results"


@query("pending_counts_by_image", f"""WITH {ST}, {SQL_IMAGES}, c AS ({SQL_COUNTS_BY}),
  a AS (SELECT image_id, coalesce(submitted, 0) AS submitted, coalesce(finished, 0) AS finished, coalesce(failed, 0) AS failed FROM us LEFT JOIN c USING (image_id)),
  n AS (SELECT {SQL_ONE} FROM a) SELECT {SQL_PENDING} FROM n""")
def pending_counts_by_image(spark, sf_dir):
    return S.pending_counts(_log(spark, sf_dir), _users(spark, sf_dir), ["image_id"])


@query("progress_percent", f"""WITH {MF}, s AS (SELECT image_id, row_number() OVER (ORDER BY original_index) - 1 AS i, count(*) OVER () AS n FROM mf)
  SELECT image_id, CAST(floor(i::DOUBLE / n * 100 + 0.5e0) AS INTEGER) AS percent,
  CAST(floor(i::DOUBLE / (n * (n - 1) / 2e0) * 100 + 0.5e0) AS INTEGER) AS pair_percent FROM s""")
def progress_percent(spark, sf_dir):
    m = D.manifest(spark, sf_dir).select("image_id", "original_index")
    n = m.count()
    done = S.progress_percent(m, ["original_index"])
    return done.select("image_id", "percent", S.percent(F.col("original_index"), S.pair_total(F.lit(n))).alias("pair_percent"))


@query("progress_milestones", f"WITH {ST} SELECT event_id, image_id, status, progress FROM st WHERE status <> 'loading_progress' OR progress % 20 = 0")
def progress_milestones(spark, sf_dir):
    return S.progress_milestones(_log(spark, sf_dir)).select("event_id", "image_id", "status", "progress")


def _changes(events):
    return events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("setting"), "value")


SQL_LAST = """nx AS (SELECT user_id AS key, event_id, ts, event_type AS setting, value,
    lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events),
  kept AS (SELECT * FROM nx WHERE next_ts IS NULL OR epoch_us(next_ts) - epoch_us(ts) >= 3600000000)"""


@query("debounce_changes", f"WITH {SQL_LAST} SELECT key, event_id, setting, value FROM kept")
def debounce_changes(spark, sf_dir):
    return S.debounce_changes(_changes(D.table(spark, sf_dir, "events")), HOUR).select("key", "event_id", "setting", "value")


def _requests(spark, sf_dir):
    """60 requests over 20 image sets: each of 40 requests twice in a row, then two sets in turn."""
    k, j = F.col("p_partkey"), F.col("request_id")
    of_set = F.when(j < 40, F.floor(j / 2) % 20).otherwise(j % 2)
    which = spark.range(60).withColumnRenamed("id", "request_id").withColumn("image_set", of_set)
    return D.table(spark, sf_dir, "part").withColumn("image_set", k % 20).join(F.broadcast(which), "image_set").select(
        "request_id", F.concat(F.lit("opacity="), (k % 5).cast("string")).alias("settings"), k.alias("pos"), k.alias("image_id"))


@query("apply_once", """WITH w AS (SELECT j AS request_id, CASE WHEN j < 40 THEN (j // 2) % 20 ELSE j % 2 END AS s FROM range(60) t(j)),
  r AS (SELECT request_id, 'opacity=' || (p_partkey % 5) AS settings, md5(p_partkey || '|' || p_partkey) AS h FROM part JOIN w ON p_partkey % 20 = s),
  f AS (SELECT request_id, settings, count(*) AS images, bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS a, bit_xor(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS b,
    sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS c FROM r GROUP BY ALL),
  g AS (SELECT request_id, settings, images, sha256(concat_ws('|', settings, images, a, b, c)) AS signature FROM f),
  o AS (SELECT *, coalesce(lag(signature) OVER (ORDER BY request_id), (SELECT signature FROM g WHERE request_id = 0)) AS before FROM g)
  SELECT request_id, settings, images, signature FROM o WHERE signature <> before""")
def apply_once(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    ledger = S.request_signatures(requests.where("request_id < 2 or request_id = 8")).select(
        "signature", F.when(F.col("request_id") == 8, 1).otherwise(2).alias("applied_at"))
    return S.apply_once(requests, ledger)


@query("pageview_url", f"WITH {UP} SELECT page_id, origin || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url FROM up")
def pageview_url(spark, sf_dir):
    return S.pageview_url(D.url_parts(spark, sf_dir)).select("page_id", "url")


# ---- sitemap: page paths, plus the root and some excluded paths per page ----

LOCALE_LIST = "['en', 'de', 'nl', 'fr', 'pl', 'cs', 'ru', 'uk']"
SQL_PATHS = f"""{UP}, pt AS (SELECT page_id, CASE page_id % 10 WHEN 0 THEN '/' WHEN 1 THEN '/api/' || page_id WHEN 2 THEN '/404' WHEN 3 THEN '/server-sitemap-' || page_id
    ELSE path END AS path FROM up),
  ps AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS seg FROM pt),
  lc AS (SELECT *, coalesce(list_contains({LOCALE_LIST}, seg[1]), false) AS hit FROM ps)"""
SQL_ADMITTED = "path NOT LIKE '/api/%' AND path NOT LIKE '/\\_next/%' ESCAPE '\\' AND path NOT LIKE '/404%' AND path NOT LIKE '/500%' AND path NOT LIKE '/server-sitemap%'"
SITE, STAMP = "https://images.example.org", "2024-01-31T00:00:00.000Z"


def _paths(spark, sf_dir):
    k, tag = F.col("page_id") % 10, F.col("page_id").cast("string")
    return D.url_parts(spark, sf_dir).select("page_id", (
        F.when(k == 0, "/").when(k == 1, F.concat(F.lit("/api/"), tag)).when(k == 2, "/404")
        .when(k == 3, F.concat(F.lit("/server-sitemap-"), tag)).otherwise(F.col("path"))
    ).alias("path"))


@query("split_locale", f"""WITH {SQL_PATHS} SELECT page_id, CASE WHEN hit THEN seg[1] ELSE 'en' END AS locale,
  '/' || coalesce(array_to_string(CASE WHEN hit THEN seg[2:] ELSE seg END, '/'), '') AS base_path FROM lc""")
def split_locale(spark, sf_dir):
    return M.split_locale(_paths(spark, sf_dir)).select("page_id", "locale", "base_path")


@query("sitemap_filter", f"WITH {SQL_PATHS} SELECT page_id, path FROM pt WHERE {SQL_ADMITTED}")
def sitemap_filter(spark, sf_dir):
    return M.sitemap_filter(_paths(spark, sf_dir))


@query("sitemap_entries", f"""WITH {SQL_PATHS} SELECT path AS loc, 'weekly' AS changefreq, CASE WHEN path = '/' THEN 1e0 ELSE 0.7e0 END AS priority, '{STAMP}' AS lastmod,
  CASE WHEN hit OR path = '/' THEN array_to_string(list_transform({LOCALE_LIST}, lambda l: l || '={SITE}/' || l || CASE WHEN path = '/' THEN '' ELSE '/' || coalesce(array_to_string(seg[2:], '/'), '') END), ' ') END AS alternates
  FROM lc WHERE {SQL_ADMITTED}""")
def sitemap_entries(spark, sf_dir):
    entries = M.sitemap_entries(_paths(spark, sf_dir), SITE, STAMP)
    flat = F.array_join(F.transform("alternate_refs", lambda r: F.concat_ws("=", r["hreflang"], r["href"])), " ")
    return entries.withColumn("alternates", flat).drop("alternate_refs")


@query("sitemap_alternates", f"""WITH {SQL_PATHS} SELECT path AS loc, l AS hreflang, '{SITE}/' || l || CASE WHEN path = '/' THEN '' ELSE '/' || coalesce(array_to_string(seg[2:], '/'), '') END AS href
  FROM lc, unnest({LOCALE_LIST}) t(l) WHERE (hit OR path = '/') AND {SQL_ADMITTED}""")
def sitemap_alternates(spark, sf_dir):
    return M.sitemap_alternates(_paths(spark, sf_dir), SITE)


@query("sitemap_chunks", """WITH u AS (SELECT 'item-' || doc_id AS loc FROM documents)
  SELECT loc, (row_number() OVER (ORDER BY loc) - 1) // 300 AS chunk FROM u""")
def sitemap_chunks(spark, sf_dir):
    entries = D.table(spark, sf_dir, "documents").select(F.concat(F.lit("item-"), F.col("doc_id").cast("string")).alias("loc"))
    return M.sitemap_chunks(entries, size=300)


# ---- inference with a stand-in model: mean and largest value of a vector; some images fail ----


def _stub():
    def model(rows):
        matrix = np.array(rows["embedding"].to_pylist(), dtype=np.float64)
        bad = [i for i in rows["image_id"].to_pylist() if i % 97 == 5]
        if bad:
            raise ValueError(f"cannot read image {bad[0]}")
        return {"mean": matrix.mean(axis=1), "peak": matrix.argmax(axis=1).astype(np.int32)}

    return model


def _broken():
    raise RuntimeError("no such device")


SQL_STUB = f"""WITH {D.SQL_VECTORS} SELECT vec_id AS image_id, CASE WHEN vec_id % 97 <> 5 THEN round(list_sum(e) / 64, 6) END AS mean,
  CASE WHEN vec_id % 97 <> 5 THEN CAST(list_position(e, list_max(e)) - 1 AS INTEGER) END AS peak,
  CASE WHEN vec_id % 97 = 5 THEN 'cannot read image ' || vec_id END AS error"""
STUB_SCHEMA = "mean double, peak int"


@query("batch_infer", f"{SQL_STUB} FROM vec")
def batch_infer(spark, sf_dir):
    scored = I.batch_infer(D.vectors(spark, sf_dir).select("image_id", "embedding"), _stub, STUB_SCHEMA)
    return scored.withColumn("mean", F.round("mean", 6))


@query("infer_with_fallback", f"{SQL_STUB}, 'cpu' AS variant FROM vec")
def infer_with_fallback(spark, sf_dir):
    rows = D.vectors(spark, sf_dir).select("image_id", "embedding")
    scored = I.infer_with_fallback(rows, [("gpu", _broken), ("cpu", _stub)], STUB_SCHEMA)
    return scored.withColumn("mean", F.round("mean", 6))


# ---- files ----

SQL_FILES = f"""SELECT vec_id || '.png' AS name, 'png' AS extension, CAST({PNG_BYTES} AS BIGINT) AS size_bytes FROM embeddings
  UNION ALL SELECT 'broken_' || vec_id || '.jpg', 'jpg', CAST(12 AS BIGINT) FROM embeddings WHERE vec_id % 50 = 0"""


@query("scan_manifest", SQL_FILES)
def scan_manifest(spark, sf_dir):
    return A.scan_manifest(spark, image_files(spark, sf_dir)).select("name", "extension", "size_bytes")


@query("scan_images", f"""WITH {D.SQL_PIXELS} SELECT image_id || '.png' AS name, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, CAST(NULL AS VARCHAR) AS error,
  {', '.join(f'CAST(sum({c} * (y * 8 + x + 1)) AS BIGINT) AS {c}' for c in 'rgba')} FROM px GROUP BY image_id
  UNION ALL SELECT 'broken_' || vec_id || '.jpg', NULL, NULL, 'cannot be decoded', NULL, NULL, NULL, NULL FROM embeddings WHERE vec_id % 50 = 0""")
def scan_images(spark, sf_dir):
    """Decoded pixels, summed with their position so that order and channel mix-ups show."""
    images, errors = A.scan_images(spark, image_files(spark, sf_dir))
    p = unpack_pixels(A.split_channels(images, "name"))
    place = F.col("y") * F.col("width") + F.col("x") + 1
    sums = p.groupBy(F.col("image_id").alias("name"), "width", "height").agg(*[F.sum(F.col(c) * place).alias(c) for c in "rgba"])
    return sums.withColumn("error", F.lit(None).cast("string")).unionByName(errors.drop("path"), allowMissingColumns=True)


@query("export_images", f"""WITH {D.SQL_PIXELS}, n AS (SELECT vec_id AS image_id, 'img_' || vec_id || '_' || row_number() OVER (ORDER BY vec_id) || CASE WHEN vec_id % 5 = 0 THEN '.png' ELSE '.jpg' END AS file_name,
    CASE WHEN vec_id % 5 = 0 THEN 'png' ELSE 'jpg' END AS output_format FROM embeddings),
  b AS (SELECT image_id, CAST(sum(r * (y * 8 + x + 1)) AS BIGINT) AS red FROM px GROUP BY image_id)
  SELECT image_id, file_name, CASE WHEN image_id % 13 <> 0 THEN output_format END AS output_format, CASE WHEN image_id % 13 <> 0 THEN red END AS red,
  CASE WHEN image_id % 13 = 0 THEN 'no image data' END AS error FROM n JOIN b USING (image_id)""")
def export_images(spark, sf_dir):
    named = D.vectors(spark, sf_dir).select(
        "image_id", "original_index", (F.col("image_id") % 5 == 0).alias("background_removed"),
        F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".webp")).alias("name"), F.lit(None).cast("string").alias("seo_name"),
    )
    payload = D.images(spark, sf_dir).where("image_id % 13 <> 0").select("image_id", F.struct("width", "height", "r", "g", "b", "a").alias("payload"))
    rows = with_export_name(named, "jpg", ["original_index"]).join(payload, "image_id", "left").select("image_id", "file_name", "output_format", "payload")
    done, errors = A.export_images(rows, scratch_path(spark, "export"))
    weighted = F.aggregate(F.transform("payload.r", lambda v, k: (v * (k + 1)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return done.select("image_id", "file_name", "output_format", weighted.alias("red")).unionByName(errors, allowMissingColumns=True)


# ---- streaming ----


def _event_stream(spark, sf_dir):
    schema = D.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")


def _drain(running):
    """Let a stream over the available input finish."""
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


@query("stream_images", """SELECT name, row_number() OVER (ORDER BY name) - 1 AS original_index, CAST(row_number() OVER (ORDER BY name) - 1 AS VARCHAR) AS image_id
  FROM (SELECT vec_id || '.png' AS name FROM embeddings)""")
def stream_images(spark, sf_dir):
    sink = scratch_path(spark, "arrivals")
    _drain(RI.stream_images(spark, image_files(spark, sf_dir), sink, scratch_path(spark, "progress"), glob="*.png", availableNow=True))
    return spark.read.parquet(sink).select("name", "original_index", "image_id")


@query("latest_status_stream", f"WITH {ST}, {SQL_LATEST} SELECT image_id, status, progress, last_error FROM ls")
def latest_status_stream(spark, sf_dir):
    sink = scratch_path(spark, "status")
    current = RS.latest_status_stream(D.status_log(_event_stream(spark, sf_dir)))
    _drain(RS.upsert_to(current, sink, scratch_path(spark, "progress"), availableNow=True))
    return RS.newest(spark.read.parquet(sink), ["image_id"])


@query("pending_counts_stream", f"WITH {ST}, c AS ({SQL_COUNTS_BY}), n AS (SELECT {SQL_ONE} FROM c) SELECT {SQL_PENDING} FROM n")
def pending_counts_stream(spark, sf_dir):
    sink = scratch_path(spark, "pending")
    counts = RS.pending_counts_stream(D.status_log(_event_stream(spark, sf_dir)))
    _drain(RS.upsert_to(counts, sink, scratch_path(spark, "progress"), availableNow=True))
    return RS.newest(spark.read.parquet(sink), ["image_id"])


@query("debounce_changes_stream", f"WITH {SQL_LAST} SELECT key, event_id, setting, value FROM kept")
def debounce_changes_stream(spark, sf_dir):
    sink = scratch_path(spark, "debounced")
    changes = _changes(_event_stream(spark, sf_dir))
    _drain(RS.debounce_cells_to(changes, sink, scratch_path(spark, "progress"), HOUR, availableNow=True))
    return S.quiet_changes(spark.read.parquet(sink).drop("batch_id"), HOUR).select("key", "event_id", "setting", "value")
