"""Two-dimensional view of an embedding corpus and its plot attributes."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import vectors as V

# fixed values: colours of duplicate sets, in order
PALETTE = ("#ff6b6b", "#4ecdc4", "#45b7d1", "#f9ca24", "#6c5ce7", "#a55eea", "#26de81", "#fd79a8", "#00b894", "#e17055")
SINGLE_COLOR, SINGLE_SIZE, SET_SIZE = "#000000", 8.0, 10.0
MIN_POINTS = 3
MARGIN = 1.2


def project_2d(embeddings: DataFrame, id_col: str = "image_id", vec_col: str = "embedding") -> DataFrame:
    """First two principal components per image; needs at least three vectors.

    The sign is fixed so that the largest loading of a component is positive.
    """
    valid = embeddings.where(F.col(vec_col).isNotNull())
    points = valid.select(id_col, V.as_double(F.col(vec_col)).alias("_v"))
    if len(points.select(id_col).take(MIN_POINTS)) < MIN_POINTS:
        return points.select(id_col, F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).where(F.lit(False))
    fitted = PCA(k=2, inputCol="_f", outputCol="_p").fit(points.select(array_to_vector("_v").alias("_f")))
    loadings = fitted.pc.toArray()  # dimensions x 2
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), [0, 1]])

    def along(k: int):
        return V.dot(F.col("_v"), F.array(*[F.lit(float(w)) for w in loadings[:, k]]))

    return points.select(id_col, along(0).alias("x"), along(1).alias("y"))


def plot_attributes(points: DataFrame, ranked: DataFrame, id_col: str = "image_id") -> DataFrame:
    """Colour and size per point: duplicate sets by rank, unique images black and smaller."""
    colours = F.array(*[F.lit(c) for c in PALETTE])
    at = F.pmod(F.col("group_rank") - 1, F.lit(len(PALETTE))).cast("int")
    joined = points.join(ranked.select(id_col, "group_rank", "is_duplicate"), id_col, "left")
    in_set = F.coalesce("is_duplicate", F.lit(False))
    return joined.withColumns({
        "color": F.when(in_set, F.get(colours, at)).otherwise(SINGLE_COLOR),
        "size": F.when(in_set, SET_SIZE).otherwise(SINGLE_SIZE),
    }).drop("group_rank", "is_duplicate")


def plot_viewport(points: DataFrame) -> DataFrame:
    """Square view around all points, a fifth larger than the wider span."""
    box = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    half = F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")) * MARGIN / 2
    cx, cy = (F.col("lo_x") + F.col("hi_x")) / 2, (F.col("lo_y") + F.col("hi_y")) / 2
    return box.select((cx - half).alias("left"), (cx + half).alias("right"), (cy + half).alias("top"), (cy - half).alias("bottom"))
