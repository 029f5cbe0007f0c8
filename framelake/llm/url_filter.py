"""URL filter: host-suffix and path-prefix expressions against hashed rules.

A rule is a host and a path prefix.  Every distinct (host, path) is expanded into the expressions that
could be a rule: its host suffixes times its path prefixes, of the shapes (labels, path length) that
some rule has.  Expressions meet the rules in an equi-join on a short prefix of their SHA-256, the full
digest confirms, and the longest rule of the first list that fits decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HASH_PREFIX = 8  # hexadecimal digits: four bytes
BROADCAST_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str
    list_no: int = 0  # lists are asked in this order


# Fixed rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
# Asked where no fixed rule fits: hosts that are blocked as a whole.
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(Rule("block", f"{name}.example.{top}", "", 1) for name in BLOCKED_NAMES for top in ("com", "net", "org"))
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """Rules as a table: ``verdict, host, path, list_no``."""
    rows = pa.table({
        "verdict": [r.verdict for r in rules], "host": [r.host for r in rules], "path": [r.path for r in rules],
        "list_no": pa.array([r.list_no for r in rules], pa.int32()),
    }, schema=pa.schema([("verdict", pa.string()), ("host", pa.string()), ("path", pa.string()), ("list_no", pa.int32())]))
    return spark.createDataFrame(rows)


def hashed(expression: Column) -> tuple[Column, Column]:
    digest = F.sha2(expression.cast("binary"), 256)
    return F.substring(digest, 1, HASH_PREFIX).alias("_short"), digest.alias("_digest")


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict``: one row per page row.

    ``rule`` names the fitting rule of list 0, else null; the verdict is that rule's, else the one of the
    next list that fits, else ``default``.  Null urls have an empty host and path, which no rule fits.
    Rules with equal host and path: the lower list, then ``block`` first.  Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    shapes = rules.select(F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("chars")).distinct().collect()
    labels = F.split("host", "\\.")
    suffix = {n: F.array_join(F.slice(labels, -n, n), ".") for n in sorted({s.labels for s in shapes})}
    candidates = F.filter(F.array(*[
        F.when((F.size(labels) >= s.labels) & (F.length("path") >= s.chars), F.concat(suffix[s.labels], F.substring("path", 1, s.chars)))
        for s in sorted(shapes)
    ]), lambda x: x.isNotNull()) if shapes else F.array().cast("array<string>")
    expressions = judged.where(F.col("host") != "").select("host", "path").distinct().select(
        "host", "path", F.explode(candidates).alias("_expression"))
    expressions = expressions.select("host", "path", *hashed(F.col("_expression")))
    name = F.concat("host", "path")
    listed = rules.select(*hashed(name), name.alias("_rule"), F.col("verdict").alias("_verdict"), "list_no")
    if rules.count() <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    fits = expressions.alias("x").join(listed.alias("r"), (F.col("x._short") == F.col("r._short")) & (F.col("x._digest") == F.col("r._digest")))
    order = F.struct(-F.col("list_no"), F.length("_rule"), F.col("_verdict") == "block")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("_rule", "_verdict", "list_no"), order).alias("_best"))
    return judged.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.when(F.col("_best.list_no") == 0, F.col("_best._rule")).alias("rule"),
        F.coalesce("_best._verdict", F.lit(default)).alias("verdict"),
    )
