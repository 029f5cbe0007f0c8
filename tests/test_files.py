"""Nested folders, error rows, model caches and intermediate tables."""

import os

import pytest
from pyspark.sql import functions as F

from framelake import scratch
from framelake.keyed import global_index
from framelake.operators import grouping, inference, manifest, tensors
from framelake.sources import files
from framelake.streaming.images import stream_images
from workload.png_files import png


def test_images_and_errors_are_the_manifest(spark, tmp_path):
    (tmp_path / "s b" / "ü").mkdir(parents=True)
    for name in ("a+b.png", "s b/c d.png", "s b/ü/é%20.png", "s b/ü/a+b.png"):
        (tmp_path / name).write_bytes(png(2, 1, b"\1\2\3\4\5\6\7\10"))
    (tmp_path / "s b" / "bad.jpg").write_bytes(b"xx")
    listed = {r.path: r.name for r in files.scan_manifest(spark, str(tmp_path)).collect()}
    images, errors = files.scan_images(spark, str(tmp_path))
    good = {r.path: r.name for r in images.collect()}
    bad = {r.path: r.name for r in errors.collect()}
    assert len(good) == 4 and list(bad.values()) == ["bad.jpg"] and {**good, **bad} == listed
    split = files.split_channels(images).collect()
    assert {r.image_id for r in split} == set(good) and all(list(r.r) == [1, 5] and list(r.a) == [4, 8] for r in split)


def test_files_are_decoded_once(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.png").write_bytes(png(2, 1, b"\1\2\3\4\5\6\7\10"))
    (tmp_path / "bad.png").write_bytes(b"xx")
    images, errors = files.scan_images(spark, str(tmp_path))
    for path in tmp_path.iterdir():
        path.unlink()  # neither result reads the files again
    assert images.count() == 3 and [r.name for r in errors.collect()] == ["bad.png"]


def test_many_small_files_share_a_task(spark, tmp_path):
    count = 64 * 32 * spark.sparkContext.defaultParallelism // 8
    for k in range(count):
        (tmp_path / f"{k}.png").write_bytes(png(1, 1, bytes([k % 256, 2, 3, 4])))
    images, errors = files.scan_images(spark, str(tmp_path))
    assert images.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    found = {r.name: r.data[2] for r in images.select("name", "data").collect()}
    assert found == {f"{k}.png": k % 256 for k in range(count)} and errors.isEmpty()


def test_arrivals_are_numbered_through_and_repeat_alike(spark, tmp_path):
    source, sink, progress = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "progress")
    source.mkdir()

    def arrive(*names):
        for name in names:
            (source / name).write_bytes(png(1, 1, b"\1\2\3\4"))
        stream_images(spark, str(source), sink, progress, glob="*.png", availableNow=True).awaitTermination()
        return {r.name: r.original_index for r in spark.read.parquet(sink).collect()}

    assert arrive("b.png", "a.png") == {"a.png": 0, "b.png": 1}
    second = arrive("0.png", "c.png", "z.png")
    assert second == {"a.png": 0, "b.png": 1, "0.png": 2, "c.png": 3, "z.png": 4}
    ledger = {int(p.split("=")[1]): spark.read.parquet(f"{sink}/_ledger/{p}").first()[0] for p in os.listdir(f"{sink}/_ledger")}
    assert sorted(ledger.values()) == [2, 5] and arrive("m.png")["m.png"] == 5
    # the last batch is done again: it reads the ledger of the one before and replaces itself
    last = max(ledger) + 1
    (tmp_path / "progress" / "commits" / str(last)).unlink()
    (tmp_path / "progress" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    assert arrive("n.png") == {**second, "m.png": 5, "n.png": 6}


def test_error_rows_carry_their_reason(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", None, "too large"), ("c", None, None)], "name string, result string, why string")
    ok, errors = manifest.split_failures(df, "result", reason_col="why")
    assert [r.name for r in ok.collect()] == ["a"]
    assert {r.name: r.error for r in errors.collect()} == {"b": "No result for b: too large", "c": "No result for c"}


def test_output_without_a_value_is_an_error(spark):
    def factory():
        return lambda rows: {"y": [None if v < 0 else v for v in rows["v"].to_pylist()]}

    df = spark.createDataFrame([(1, 2.0), (2, -1.0)], "image_id long, v double")
    rows = {r["image_id"]: (r["y"], r["error"]) for r in inference.batch_infer(df, factory, "y double").collect()}
    assert rows == {1: (2.0, None), 2: (None, inference.NO_VALUE)}


def test_a_worker_holds_the_models_of_one_call(spark):
    def factory():
        import sys

        return lambda rows: {"held": [len([k for k in vars(sys.modules["_loaded_models"]) if not k.startswith("__")])] * rows.num_rows}

    df = spark.range(8).withColumnRenamed("id", "image_id").repartition(2)
    for _ in range(3):
        held = [r["held"] for r in inference.batch_infer(df, factory, "held int").collect()]
        # the model is asked while its own entry is being used, so one is the most there is
        assert max(held) <= 1


def test_tensor_channels(spark):
    data = [k / 255 for k in (10, 20, 30, 40)]
    rows = [(c, [1, c, 1, 4 // c], data) for c in (1, 4)]
    df = spark.createDataFrame(rows, "image_id int, dims array<int>, data array<float>").select("image_id", F.struct("dims", "data").alias("tensor"))
    got = {(r.image_id, r.x): (r.r, r.g, r.b, r.a) for r in tensors.from_tensor(df).collect()}
    assert got == {(1, 0): (10, 10, 10, 255), (1, 1): (20, 20, 20, 255), (1, 2): (30, 30, 30, 255), (1, 3): (40, 40, 40, 255), (4, 0): (10, 20, 30, 40)}


def test_steps_leave_nothing_behind(spark):
    root = scratch.scratch_root(spark)
    before = {n for n in os.listdir(root) if n.startswith("framelake-")}
    vectors = spark.createDataFrame([(k, [float(k % 3), 1.0, 0.5]) for k in range(30)], "original_index long, embedding array<float>")
    grouping.group_embeddings(vectors, "cosine", 0.999).collect()
    with pytest.raises(ZeroDivisionError), scratch.Intermediate(spark) as steps:
        steps.write(vectors, "lost")
        raise ZeroDivisionError
    assert {n for n in os.listdir(root) if n.startswith("framelake-")} == before


def test_row_numbers_over_many_ranges_and_ties_in_the_first_key(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("a"), F.hash("id").alias("b"), "id")
    got = [(r.a, r.b, r["at"]) for r in global_index(df, ["a", "b", "id"], "at", rows_per_bucket=7).orderBy("at").collect()]
    assert [x[2] for x in got] == list(range(5000)) and [x[:2] for x in got] == sorted(x[:2] for x in got)
