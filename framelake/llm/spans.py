"""Digest columns of span arrays (kind, start, end), shared by the scanners' queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s.kind.isin(*kinds))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def base_sha256(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.sha2(joined(of_kinds(spans, kinds)).cast("binary"), 256)
