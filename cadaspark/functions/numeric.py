"""Small numeric helpers shared by the rule and geometry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(col: Column, digits: int = 0) -> Column:
    """Round half up by floor arithmetic.

    Stays in primitive doubles, so it remains inside generated code; ``F.round`` on a double
    goes through BigDecimal for every row.
    """
    scale = F.lit(float(10**digits))
    return F.floor(col * scale + F.lit(0.5)).cast("double") / scale


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high)))


def fixed(col: Column, digits: int) -> Column:
    """Render a number with a fixed count of decimals, e.g. ``1234.50``; null stays null."""
    return F.when(col.isNotNull(), F.format_string(f"%.{digits}f", rnd(col, digits)))
