from pyspark.sql import functions as F

from framelake.keyed import global_index, salted_lookup


def test_global_index_in_ranges_equals_sorted_order(spark):
    rows = [(f"n{(k * 7919) % 1000:04d}", k) for k in range(1000)]
    df = spark.createDataFrame(rows, "name string, k int").repartition(7)
    out = global_index(df, ["name", "k"], "at", start=5, rows_per_bucket=90).orderBy("at").collect()
    assert [r["at"] for r in out] == list(range(5, 1005))
    assert [r["name"] for r in out] == sorted(n for n, _ in rows)


def test_global_index_small_and_empty(spark):
    df = spark.range(5).withColumn("o", -F.col("id"))
    assert [r["id"] for r in global_index(df, ["o"], "at").orderBy("at").collect()] == [4, 3, 2, 1, 0]
    assert global_index(df.where("id < 0"), ["o"], "at").count() == 0


def test_global_index_with_a_key_prefix_shared_by_most_rows(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
    out = global_index(df, ["a", "b"], "at", rows_per_bucket=100).orderBy("at").collect()
    assert [r["at"] for r in out] == list(range(2000))
    assert [(r["a"], r["b"]) for r in out] == sorted((r["a"], r["b"]) for r in out)


def test_salted_lookup_with_a_hot_key(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    out = salted_lookup(big, small, ["k"], weight="n", spread=["id"], hot_rows=100)
    assert out.columns == ["k", "id", "n"]
    assert out.count() == 3000
    assert out.where("k = 0").agg(F.min("n"), F.max("n"), F.countDistinct("id")).first() == (2000, 2000, 2000)
    kept = salted_lookup(big, small.where("k <> 5000 and k % 2 = 0"), ["k"], "n", ["id"], how="left", hot_rows=100)
    assert kept.count() == 3000 and kept.where("n is null").count() == 500
