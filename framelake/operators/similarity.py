"""Similarity joins, nearest neighbours and embedding preparation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import vectors as V
from framelake.keyed import constant_table
from framelake.operators import cells
from framelake.scratch import checkpointed

# fixed values: threshold range, default, slider step and direction of each algorithm
SIMILARITY_CONFIG = [
    {"algorithm": "cosine", "min_threshold": 0.1, "max_threshold": 0.99, "default_threshold": 0.98,
     "step": 0.01, "lower_is_better": False},
    {"algorithm": "euclidean", "min_threshold": 0.1, "max_threshold": 50.0, "default_threshold": 10.0,
     "step": 0.1, "lower_is_better": True},
    {"algorithm": "manhattan", "min_threshold": 1.0, "max_threshold": 500.0, "default_threshold": 100.0,
     "step": 1.0, "lower_is_better": True},
]
DEFAULT_THRESHOLDS = {row["algorithm"]: row["default_threshold"] for row in SIMILARITY_CONFIG}


def similarity_config(spark: SparkSession) -> DataFrame:
    """The algorithm table; choosing an algorithm resets the threshold to its default."""
    schema = pa.schema([("algorithm", pa.string()), ("min_threshold", pa.float64()), ("max_threshold", pa.float64()),
                        ("default_threshold", pa.float64()), ("step", pa.float64()), ("lower_is_better", pa.bool_())])
    return constant_table(spark, SIMILARITY_CONFIG, schema)


def valid_vectors(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return embeddings.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")
    )


def similarity_join(
    embeddings: DataFrame,
    algorithm: str = "cosine",
    threshold: float | None = None,
    probes: DataFrame | None = None,
    id_col: str = "original_index",
    vec_col: str = "embedding",
    **layout,
) -> DataFrame:
    """All pairs ``(i, j, score)`` with i < j that are strictly inside the threshold.

    ``probes`` restricts j to a subset (new arrivals).  Null embeddings take no part.
    """
    cells.check_algorithm(algorithm)
    threshold = DEFAULT_THRESHOLDS[algorithm] if threshold is None else threshold
    data = valid_vectors(embeddings, id_col, vec_col)
    asked = data if probes is None else valid_vectors(probes, id_col, vec_col)
    plan = cells.plan_cells(data, algorithm, **layout)
    radius, kernel, schema = cells.metric_radius(algorithm, threshold), cells.pair_kernel(algorithm, threshold), "i long, j long, score double"
    if probes is None:
        return cells.cell_self_join(data, plan, radius, kernel, schema)
    return cells.cell_join(data, asked, plan, radius, kernel, schema)


def neighbour_count(rows: int) -> int:
    """Neighbours per vertex for a corpus of ``rows`` vectors."""
    return min(15, max(2, rows // 3))


def knn_graph(
    embeddings: DataFrame,
    k: int | None = None,
    id_col: str = "original_index",
    vec_col: str = "embedding",
    **layout,
) -> DataFrame:
    """Exact k nearest neighbours by cosine: ``(i, j, rank, score)``; all-zero vectors have none.

    Round one searches the home cell only, which bounds the k-th distance of every row; round two
    visits just the other cells that bound cannot exclude, returns only matches that reach the bound, and keeps
    the first round's rows.
    """
    data = valid_vectors(embeddings, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    k = neighbour_count(data.count()) if k is None else k
    plan = cells.plan_cells(data, "cosine", **layout)
    kernel, schema = cells.nearest_kernel(k), "i long, j long, score double"
    order = Window.partitionBy("i").orderBy(F.col("score").desc(), "j")

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = cells.cell_self_join(data, plan, None, kernel, schema)
    if plan.pivots is not None:
        found = checkpointed(best(found).drop("rank"))
        bound = found.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
        reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(2.0 - 2.0 * F.col("worst"), F.lit(0.0))) + 1e-6)
        asked = data.join(bound, data.id == bound.i, "left").select(
            "id", "vec", F.coalesce(reach, F.lit(float("inf"))).alias("radius"),
            F.coalesce(F.when(F.col("n") >= k, F.col("worst")), F.lit(float("-inf"))).alias("floor"),
        )
        found = found.unionByName(cells.cell_join(data, asked, plan, float("inf"), kernel, schema, "away"))
    return best(found).select("i", "j", "rank", "score")


def extract_cls(features: DataFrame, dim: int = 768, tokens: int = 197, vec_col: str = "features") -> tuple[DataFrame, DataFrame]:
    """First ``dim`` values of a full token matrix, a pooled vector as is; other lengths are errors."""
    size = F.size(vec_col)
    fits = size.isin(dim, dim * tokens)
    good = features.where(fits).withColumn("embedding", F.slice(vec_col, 1, dim)).drop(vec_col)
    bad = features.where(~F.coalesce(fits, F.lit(False))).withColumn(
        "error", F.concat(F.lit(f"expected {dim} values, got "), F.coalesce(size, F.lit(-1)).cast("string"))
    ).drop(vec_col)
    return good, bad


def mean_pool_normalize(token_vectors: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Mean over an image's token vectors, scaled to unit length."""
    pooled = token_vectors.withColumn("embedding", V.mean_pool(F.col(tokens_col))).drop(tokens_col)
    return pooled.withColumn("embedding", V.l2_normalize(F.col("embedding")))


def embedding_norm(embeddings: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Add the L2 norm of every embedding."""
    return embeddings.withColumn("norm", V.norm(V.as_double(F.col(vec_col))))
