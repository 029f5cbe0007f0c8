import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import text as T
from framelake.operators import inference, manifest, naming, sitemap, status
from framelake.plans import geometry, tables


def sizes(spark, plan, pairs, **kw):
    df = spark.createDataFrame([(k, w, h) for k, (w, h) in enumerate(pairs)], "image_id int, width int, height int")
    return [(r["target_w"], r["target_h"]) for r in plan(df, **kw).orderBy("image_id").collect()]


@pytest.mark.parametrize("plan,given,wanted", [
    (geometry.plan_preview, [(1600, 1000), (800, 3000), (1001, 333)], [(800, 500), (800, 3000), (800, 266)]),
    (geometry.plan_thumbnail, [(1600, 1000), (1000, 1600), (900, 900), (100, 50)], [(800, 500), (500, 800), (800, 800), (100, 50)]),
    (geometry.plan_bounded_1200, [(2400, 1000), (1000, 2400), (1300, 1300), (1200, 1200)], [(1200, 500), (500, 1200), (1200, 1200), (1200, 1200)]),
    (geometry.plan_bounded_1600, [(3200, 1001), (1001, 3200), (1600, 1600)], [(1600, 500), (500, 1600), (1600, 1600)]),
])
def test_size_rules(spark, plan, given, wanted):
    assert sizes(spark, plan, given) == wanted


def test_presets_and_custom_form(spark):
    bad = tables.custom_preset(spark, "abc", "0", None, keep_aspect=False).first()
    assert (bad["width"], bad["height"], bad["quality"]) == (1080, None, 85)
    merged = tables.resolve_preset(tables.presets(spark), tables.custom_preset(spark, "640", "480", "70", False))
    assert merged.count() == 5 and merged.where("preset_id = 'custom'").first()["width"] == 640
    assert tables.looks(spark).count() == 12


def test_zero_stride_gives_no_tiles(spark):
    boxes = spark.createDataFrame([(1, 100, 50, 0, 10), (2, 100, 50, 40, 20)], "image_id int, width int, height int, box_w int, box_h int")
    tiles = geometry.plan_watermark_tiles(boxes, "logo").collect()
    assert {r["image_id"] for r in tiles} == {2}
    assert {r["x"] for r in tiles} == {0.0, 60.0, 120.0} and {r["y"] for r in tiles} == {0.0, 30.0, 60.0}


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,slug", [
    ("Red  Shoe, size 42!", "red-shoe-size-42"), ("--a - b--", "--a---b--"), ("   ", "image"), ("ÄÖ", "image"), ("", "image"),
    ("King İ", "king-i"), ("x" * 60, "x" * 50), ("tab\t nbsp", "tab-nbsp"),
])
def test_seo_slug(spark, text, slug):
    assert one(spark, text, T.seo_slug) == slug


@pytest.mark.parametrize("text,slug", [
    ("Étoile -- über Straße.", "etoile-uber-strasse"), ("  ŁÓDŹ & co ", "lodz-co"), ("Œuvre Æther", "oeuvre-aether"), ("a" * 80, "a" * 70),
])
def test_caption_slug(spark, text, slug):
    assert one(spark, text, T.caption_slug) == slug


def test_accent_map_is_aligned():
    assert len(T.ACCENTED) == len(T.PLAIN) == len(T.ACCENTED.upper()) and len(T.UPPER) == len(T.LOWER)


@pytest.mark.parametrize("size,label", [(0, "0.00 KB"), (1024, "1.00 KB"), (1048575, "1024.00 KB"), (1048576, "1.00 MB"), (1546, "1.51 KB")])
def test_size_label(spark, size, label):
    df = spark.createDataFrame([(size,)], "size_bytes long")
    assert manifest.size_label(df).first()["size_label"] == label


def test_heic_by_name_mime_and_bytes(spark):
    rows = [("a.HEIC", "", None), ("b", "image/heif", None), ("c", "", bytes.fromhex("000000186674797068656963")),
            ("d.png", "image/png", b"\x89PNG"), ("e", None, None)]
    df = spark.createDataFrame(rows, "name string, mime string, content binary")
    assert [r["is_heic"] for r in manifest.detect_heic(df).collect()] == [True, True, True, False, False]


def test_admit_batch_respects_the_cap(spark):
    old, new = spark.range(98).withColumnRenamed("id", "arrival"), spark.range(200, 210).withColumnRenamed("id", "arrival")
    assert manifest.admit_batch(old, new, 100).count() == 100
    assert manifest.admit_batch(spark.range(120).withColumnRenamed("id", "arrival"), new, 100).count() == 120


def test_caption_runs_keep_order(spark):
    chunks = [(1, k, "stream", f"{k} ") for k in range(25)] + [(2, 0, "stream", "x"), (2, 1, "complete", " done "), (3, 0, "stream", "part"), (3, 1, "error", "e")]
    df = spark.createDataFrame(chunks, "image_id int, seq int, kind string, text string").repartition(6)
    out = {r["image_id"]: (r["caption"], r["completed"], r["failed"]) for r in naming.caption_assemble(df, run=4).collect()}
    assert out == {1: ("".join(f"{k} " for k in range(25)), False, False), 2: ("done", True, False), 3: ("part", False, True)}


@pytest.mark.parametrize("seed", range(3))
def test_debounce_equals_neighbour_gaps(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(k), int(t), e) for e, (k, t) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 20_000, 200)))]
    df = spark.createDataFrame(rows, "key int, ms long, event_id int").select("key", F.timestamp_millis("ms").alias("ts"), "event_id", "ms")
    got = {r["event_id"] for r in status.debounce_changes(df, 0.3).collect()}
    wanted = set()
    for key in range(3):
        mine = sorted((t, e) for k, t, e in rows if k == key)
        wanted |= {e for (t, e), nxt in zip(mine, [*mine[1:], None]) if nxt is None or nxt[0] - t >= 300}
    assert got == wanted


def test_signature_depends_on_order_and_settings(spark):
    rows = [("a", "s", 0, 7), ("a", "s", 1, 8), ("b", "s", 0, 8), ("b", "s", 1, 7), ("c", "z", 0, 7), ("c", "z", 1, 8), ("d", "s", 0, 7), ("d", "s", 1, 8)]
    df = spark.createDataFrame(rows, "request_id string, settings string, pos int, image_id int")
    sig = {r["request_id"]: r["signature"] for r in status.request_signatures(df).collect()}
    assert sig["a"] == sig["d"] and len(set(sig.values())) == 3
    ledger = status.request_signatures(df.where("request_id = 'a'")).withColumn("applied_at", F.lit(1))
    assert {r["request_id"] for r in status.apply_once(df, ledger).collect()} == {"b", "c", "d"}


def test_repeated_rows_change_the_signature_and_only_the_last_one_blocks(spark):
    rows = [("1", "s", 0, 7), ("1", "s", 0, 7), ("2", "s", 0, 8), ("2", "s", 0, 8), ("3", "s", 0, 7), ("3", "s", 0, 7), ("4", "s", 0, 7), ("4", "s", 0, 7)]
    df = spark.createDataFrame(rows, "request_id string, settings string, pos int, image_id int")
    empty = spark.createDataFrame([], "signature string, applied_at int")
    assert {r["request_id"] for r in status.apply_once(df, empty).collect()} == {"1", "2", "3"}
    applied = status.request_signatures(df).where("request_id in ('1', '2')").withColumn("applied_at", F.col("request_id"))
    assert {r["request_id"] for r in status.apply_once(df.where("request_id > '2'"), applied).collect()} == {"3"}
    last = applied.where("request_id = '1'")
    assert status.apply_once(df.where("request_id > '2'"), last).collect() == []


def test_readiness_needs_images_and_all_results(spark):
    log = "event_id int, ts timestamp, image_id int, status string, progress int, message string"
    rows = [(1, None, 1, "processing", 0, ""), (2, None, 1, "extraction_complete", 0, ""), (3, None, 2, "processing", 0, ""), (4, None, 2, "error", 0, "")]
    df, ids = spark.createDataFrame(rows, log), lambda *k: spark.createDataFrame([(x,) for x in k], "image_id int")
    ready = lambda d, m: status.pending_counts(d, m).first()["ready"]
    assert ready(df, ids(1, 2)) and not ready(df, ids(1, 2, 3)) and not ready(df.where("event_id < 4"), ids(1, 2))
    assert not ready(df, ids()) and not ready(df.limit(0), ids(1)) and ready(df, ids(1))


def test_percent_rounds_half_up(spark):
    df = spark.createDataFrame([(1, 200), (3, 200), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(status.percent(F.col("a"), F.col("b"))).collect()] == [1, 2, 0]


def test_pair_total_of_more_images_than_an_int_squared_holds(spark):
    df = spark.createDataFrame([(46_340,), (46_341,), (100_000,), (2_000_000_000,)], "n int")
    wanted = [n * (n - 1) / 2 for n in (46_340, 46_341, 100_000, 2_000_000_000)]
    assert [r[0] for r in df.select(status.pair_total(F.col("n"))).collect()] == wanted
    assert spark.range(1).select(status.percent(F.lit(2_500_000_000), status.pair_total(F.lit(100_000)))).first()[0] == 50


def test_sitemap_root_and_static_paths(spark):
    df = spark.createDataFrame([("/",), ("/de/a/b",), ("/logo.svg",), ("/api/x",), ("/es/a",)], "path string")
    rows = {r["loc"]: r for r in sitemap.sitemap_entries(df, "https://s", "now").collect()}
    assert set(rows) == {"/", "/de/a/b", "/logo.svg", "/es/a"}
    assert rows["/"]["priority"] == 1.0 and rows["/"]["alternate_refs"][0]["href"] == "https://s/en"
    assert rows["/de/a/b"]["alternate_refs"][1]["href"] == "https://s/de/a/b" and rows["/logo.svg"]["alternate_refs"] is None
    split = {r["path"]: (r["locale"], r["base_path"]) for r in sitemap.split_locale(df).collect()}
    assert split["/de/a/b"] == ("de", "/a/b") and split["/es/a"] == ("en", "/es/a") and split["/"] == ("en", "/")


def test_inference_when_no_variant_loads(spark):
    def broken():
        raise RuntimeError("no device")

    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "image_id long, v double")
    rows = inference.infer_with_fallback(df, [("gpu", broken), ("cpu", broken)], "y double").collect()
    assert {r["error"] for r in rows} == {"gpu: no device; cpu: no device"} and all(r["variant"] is None and r["y"] is None for r in rows)


def test_one_bad_row_does_not_fail_the_batch(spark):
    def factory():
        def model(rows):
            values = rows["v"].to_pylist()
            if 0.0 in values:
                raise ZeroDivisionError("zero")
            return {"y": [1 / v for v in values]}
        return model

    df = spark.createDataFrame([(k, float(k)) for k in range(4)], "image_id long, v double").coalesce(1)
    rows = {r["image_id"]: (r["y"], r["error"]) for r in inference.batch_infer(df, factory, "y double").collect()}
    assert rows == {0: (None, "zero"), 1: (1.0, None), 2: (0.5, None), 3: (1 / 3, None)}
