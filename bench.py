"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

HEADLINE = [
    "rank_groups", "group_duplicates", "similarity_join", "knn_graph", "regroup_sweep", "select_keepers",
    "adjust_pipeline", "convolve", "sharpen", "unsharp_mask", "hsl_adjust", "area_resize", "overlay_logo",
    "quality_kpis", "to_tensor", "pack_pixels", "seo_slug", "caption_slug", "export_name", "plan_encoding",
    "plan_watermark_tiles", "latest_status", "debounce_changes", "apply_once", "sitemap_alternates", "batch_infer",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("image-corpus-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from workload import QUERIES

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    run("sharpen")  # start the JVM and the Python workers
    times = {name: round(median(run(name) for _ in range(3)), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline queries, total of median wall times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
