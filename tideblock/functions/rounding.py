"""Exchange rounding: five significant digits and a cap on decimals for prices, fixed decimals for sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the venue.
SIGNIFICANT_DIGITS = 5
MAX_DECIMALS = 6


def round_price(px: Column, max_decimals: int = MAX_DECIMALS) -> Column:
    """Half-up, from exact decimal comparisons: one branch per first digit's place that limits the decimals."""
    value = px.cast("decimal(38,18)")
    size, whole = F.abs(value), "decimal(38,18)"
    out = F.when(value == 0, value)
    lowest = SIGNIFICANT_DIGITS - max_decimals
    for exponent in range(19, lowest - 1, -1):
        at_least = size >= F.lit(f"1e{exponent}").cast(whole)
        out = out.when(at_least, F.round(value, SIGNIFICANT_DIGITS - 1 - exponent).cast(whole))
    return out.otherwise(F.round(value, max_decimals).cast(whole))


def round_size(size: Column, decimals: int) -> Column:
    return F.round(size.cast("decimal(38,18)"), decimals)
