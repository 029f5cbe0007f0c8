"""Locale-aware sitemap tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.keyed import global_index

# fixed values
LOCALES = ("en", "de", "nl", "fr", "pl", "cs", "ru", "uk")
DEFAULT_LOCALE = "en"
EXCLUDED_PREFIXES = ("/api/", "/_next/", "/404", "/500", "/server-sitemap")
CHANGE_FREQUENCY = "weekly"
PAGE_PRIORITY, ROOT_PRIORITY = 0.7, 1.0
ENTRIES_PER_FILE = 5000


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def _localised(path: Column, locales) -> Column:
    return F.coalesce(F.get(_parts(path), F.lit(0)).isin(*locales), F.lit(False))


def split_locale(urls: DataFrame, locales=LOCALES, default: str = DEFAULT_LOCALE) -> DataFrame:
    """Add ``locale`` (first path part, else the default) and ``base_path`` (the rest)."""
    parts, hit = _parts(F.col("path")), _localised(F.col("path"), locales)
    rest = F.when(hit, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    return urls.withColumns({
        "locale": F.when(hit, F.get(parts, F.lit(0))).otherwise(default),
        "base_path": F.concat(F.lit("/"), F.array_join(rest, "/")),
    })


def sitemap_filter(paths: DataFrame, prefixes=EXCLUDED_PREFIXES) -> DataFrame:
    """Drop paths that do not belong in a sitemap."""
    keep = F.lit(True)
    for prefix in prefixes:
        keep = keep & ~F.col("path").startswith(prefix)
    return paths.where(keep)


def _alternates(site: str, locales) -> Column:
    """Language variants of localised pages and of the root; none for other paths."""
    parts = _parts(F.col("path"))
    rest = F.when(F.col("path") == "/", F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), "/")))
    variants = F.transform(
        F.array(*[F.lit(x) for x in locales]),
        lambda loc: F.struct(F.concat(F.lit(f"{site}/"), loc, rest).alias("href"), loc.alias("hreflang")),
    )
    return F.when(_localised(F.col("path"), locales) | (F.col("path") == "/"), variants)


def sitemap_entries(paths: DataFrame, site: str, lastmod: str, locales=LOCALES) -> DataFrame:
    """``loc, changefreq, priority, lastmod, alternate_refs`` for every admitted path."""
    return sitemap_filter(paths).select(
        F.col("path").alias("loc"), F.lit(CHANGE_FREQUENCY).alias("changefreq"),
        F.when(F.col("path") == "/", ROOT_PRIORITY).otherwise(PAGE_PRIORITY).alias("priority"),
        F.lit(lastmod).alias("lastmod"), _alternates(site, locales).alias("alternate_refs"),
    )


def sitemap_alternates(paths: DataFrame, site: str, locales=LOCALES) -> DataFrame:
    """One row per page and language: ``loc, hreflang, href``."""
    return sitemap_filter(paths).select(
        F.col("path").alias("loc"), F.explode(_alternates(site, locales)).alias("ref")
    ).select("loc", "ref.hreflang", "ref.href")


def sitemap_chunks(sitemap: DataFrame, size: int = ENTRIES_PER_FILE, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Add ``chunk``: the number of the output file, ``size`` entries each, in ``loc`` order."""
    numbered = global_index(sitemap, ["loc"], "_at", 0, rows_per_bucket)
    return numbered.withColumn("chunk", F.floor(F.col("_at") / size)).drop("_at")
