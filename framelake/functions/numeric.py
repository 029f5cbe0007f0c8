"""Rounding rules of 8-bit pixel stores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value) -> Column:
    """Literal or column, as a double column."""
    return value if isinstance(value, Column) else F.lit(float(value))


def clamp8(value: Column) -> Column:
    """Store into an 8-bit cell: round ties to even, then clamp to 0..255."""
    return F.least(F.greatest(F.rint(value), F.lit(0.0)), F.lit(255.0)).cast("int")


def half_up(value: Column) -> Column:
    """Round half towards +infinity (the rule of browser ``Math.round``)."""
    return F.floor(value + F.lit(0.5))


def half_up8(value: Column) -> Column:
    """Half-up rounding followed by the 0..255 clamp."""
    return F.least(F.greatest(half_up(value), F.lit(0)), F.lit(255)).cast("int")
