"""Exact decimal rounding and text of doubles.

Spark rounds the shortest decimal form half up; the published sentences round
the exact binary value, ties to even. The two differ only when the shortest
form sits on a tie, which is decided here without error: the double is split
into two halves whose products with a small integer are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1


def scaled_integer(value: Column, digits: int) -> Column:
    """Magnitude of ``value`` times ``10**digits``, correctly rounded, as a long."""
    x = F.abs(value.cast("double"))
    twice = float(2 * 10**digits)
    big = x * F.lit(_SPLITTER)
    high = big - (big - x)
    low = x - high
    nearest = F.rint(x * F.lit(twice))
    excess = (high * F.lit(twice) - nearest) + low * F.lit(twice)
    half = F.floor(nearest / 2)
    up = (excess > 0) | ((excess == 0) & (half % 2 == 1))
    odd = (nearest % 2) == 1
    return F.when(odd & up, half + 1).otherwise(half).cast("long")


def fixed_decimals(value: Column, digits: int, signed: bool = False) -> Column:
    """Text with ``digits`` decimals, optionally always signed."""
    magnitude = (scaled_integer(value, digits).cast("decimal(25,0)") / F.lit(10**digits)).cast(f"decimal(25,{digits})")
    negative = (value < 0) | (value.cast("string") == "-0.0")
    sign = F.when(negative, F.lit("-")).otherwise(F.lit("+" if signed else ""))
    return F.concat(sign, magnitude.cast("string"))


def round_exact(value: Column, digits: int) -> Column:
    magnitude = scaled_integer(value, digits) / F.lit(float(10**digits))
    return F.when(value < 0, -magnitude).otherwise(magnitude)
