"""Image-quality measures and the choice of the best image of a group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import stencil
from framelake.operators.pixels import to_gray
from framelake.scratch import checkpointed

# measure -> True when smaller is better
METRICS = {"sharpness": False, "noise_level": True, "contrast": False, "exposure": False, "resolution": False}


# n, then sum and sum of squares of the gray values, of their Laplacian and of their noise: integers, so any order adds up
METRIC_SUMS = ("n", "v1", "v2", "e1", "e2", "d1", "d2")


def sums_of_planes(padded: np.ndarray, own: np.ndarray, place=slice(None)) -> list:
    """``METRIC_SUMS`` of the pixels ``own``, which lie at ``place`` in the plane without its frame of one pixel."""
    edge = stencil.weighted(padded, stencil.LAPLACIAN)[place]
    blur = np.floor((stencil.weighted(padded, stencil.BINOMIAL3)[place] + 8.0) / 16.0)  # 8 bit: sixteenths, half up
    noise = np.abs(own - blur)
    return [own.size] + [s for x in (own, edge, noise) for s in (x.sum(), (x * x).sum())]


def measures_from_sums(total: DataFrame) -> DataFrame:
    """The measures of rows that carry ``METRIC_SUMS``."""
    def variance(first: str, second: str) -> Column:
        mean = F.col(first) / F.col("n")
        return F.greatest(F.col(second) / F.col("n") - mean * mean, F.lit(0.0))

    return total.withColumns({
        "sharpness": variance("e1", "e2"), "noise_level": F.sqrt(variance("d1", "d2")),
        "contrast": F.sqrt(variance("v1", "v2")), "exposure": F.col("v1") / F.col("n"),
    }).drop(*METRIC_SUMS)


def _measures_of_tiles(gray: DataFrame, tile: int) -> DataFrame:
    """All measures of a gray pixel table: each tile is reduced to seven sums."""
    def sums_of(padded, place):
        return sums_of_planes(padded["v"], padded["v"][1:-1, 1:-1][place], place)

    sums = stencil.tile_sums(gray, ["v"], 1, "reflect101", sums_of, list(METRIC_SUMS), tile)
    return measures_from_sums(sums.groupBy("image_id").agg(*[F.sum(n).alias(n) for n in METRIC_SUMS]))


def kpi_sharpness(gray: DataFrame, tile: int = stencil.TILE) -> DataFrame:
    """Population variance of the Laplacian, from its exact integer sums."""
    return _measures_of_tiles(gray, tile).select("image_id", "sharpness")


def kpi_noise(gray: DataFrame, tile: int = stencil.TILE) -> DataFrame:
    """Population standard deviation of the difference to a 3x3 Gaussian blur."""
    return _measures_of_tiles(gray, tile).select("image_id", "noise_level")


def kpi_contrast(gray: DataFrame) -> DataFrame:
    """Population standard deviation of the gray values."""
    return gray.groupBy("image_id").agg(F.stddev_pop("v").alias("contrast"))


def kpi_exposure(gray: DataFrame) -> DataFrame:
    """Mean gray value."""
    return gray.groupBy("image_id").agg(F.avg("v").alias("exposure"))


def quality_kpis(pixels: DataFrame, manifest: DataFrame, tile: int = stencil.TILE) -> DataFrame:
    """All measures with the resolution, in one pass over a pixel table.  Images without pixels have no row."""
    sizes = manifest.select("image_id", F.struct("width", "height").alias("resolution"))
    return _measures_of_tiles(to_gray(pixels), tile).join(sizes, "image_id").select(
        "image_id", "resolution", "sharpness", "noise_level", "contrast", "exposure"
    )


def _with_resolution(kpis: DataFrame) -> DataFrame:
    area = F.col("resolution.width").cast("long") * F.col("resolution.height")
    return kpis.withColumn("resolution", area).select("image_id", *METRICS)


def _members_with_kpis(groups: DataFrame, kpis: DataFrame) -> DataFrame:
    """Group members with their (possibly missing) measures; both sides are unique per image."""
    return groups.select("image_id", "original_index", "leader_index").join(
        _with_resolution(kpis).withColumn("_has", F.lit(True)), "image_id", "left"
    )


def best_flags(groups: DataFrame, kpis: DataFrame) -> DataFrame:
    """Five booleans per member: first image of its group with the best value of each measure.

    Winners come from a combining aggregate per group and go back to members by image id, so the
    size of a group never matters.
    """
    members = _members_with_kpis(groups, kpis)

    def first_best(metric: str, lower: bool) -> Column:
        rank = F.col(metric).cast("double") if lower else -F.col(metric).cast("double")
        return F.min(F.when(F.col(metric).isNotNull(), F.struct(rank.alias("v"), "original_index", "image_id")))["image_id"]

    winners = members.groupBy("leader_index").agg(*[first_best(m, low).alias(m) for m, low in METRICS.items()])
    named = winners.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("image_id")) for m in METRICS])).alias("w"))
    flags = named.where(F.col("w.image_id").isNotNull()).groupBy(F.col("w.image_id").alias("image_id")).agg(
        *[F.max(F.col("w.metric") == m).alias(f"best_{m}") for m in METRICS]
    )
    return groups.join(flags, "image_id", "left").withColumns(
        {f"best_{m}": F.coalesce(f"best_{m}", F.lit(False)) for m in METRICS}
    )


def best_in_group(groups: DataFrame, kpis: DataFrame, require_all: bool = True) -> DataFrame:
    """Best image per group: resolution, sharpness, least noise, contrast, exposure, then index.

    With ``require_all`` only groups whose members all have measures are judged; otherwise the
    members that have some compete.
    """
    members = _members_with_kpis(groups, kpis)
    order = F.struct(
        (-F.col("resolution")).alias("k1"), (-F.col("sharpness")).alias("k2"), F.col("noise_level").alias("k3"),
        (-F.col("contrast")).alias("k4"), (-F.col("exposure")).alias("k5"), F.col("original_index").alias("k6"), "image_id",
    )
    judged = members.groupBy("leader_index").agg(
        F.min(F.when(F.col("_has"), order))["image_id"].alias("image_id"),
        (F.count("_has") == F.count(F.lit(1))).alias("_all"),
    )
    keep = F.col("image_id").isNotNull() & (F.col("_all") if require_all else F.lit(True))
    return judged.where(keep).select("leader_index", "image_id")


def select_keepers(ranked: DataFrame, kpis: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images to export: every unique image and the best of each set; sets without measures warn.

    ``ranked`` is the output of ``rank_groups`` with ``image_id``.
    """
    sets = ranked.where("is_duplicate")
    best = checkpointed(best_in_group(sets, kpis, require_all=False))  # used twice, measured once
    chosen = ranked.where(~F.col("is_duplicate")).select("image_id").unionByName(best.select("image_id"))
    leaders = sets.where(F.col("original_index") == F.col("leader_index")).select("leader_index", "group_size")
    warnings = leaders.join(best, "leader_index", "left_anti").select(
        "leader_index", "group_size", F.lit("no measured image: set omitted").alias("warning")
    )
    return manifest.join(chosen, "image_id", "left_semi"), warnings
