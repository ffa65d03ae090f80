"""Rounding that decides on the exact binary value.

Spark rounds the shortest decimal form of a double, so 0.93445 (stored slightly
below) goes up.  Confidences are means of rounded numbers and often end in such a
five; rounding them on their exact value keeps thresholds and ties as expected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.regex import let

SPLIT = 134217729.0  # 2**27 + 1, halves the bits of a double


def rounded(value: Column, places: int = 4) -> Column:
    """``value`` to ``places`` decimals, correctly rounded, ties to even.

    ``value * scale`` is a rounded product; its exact error comes from multiplying the
    two halves of ``value`` apart, and decides where the product alone cannot.
    """
    return let(value.cast("double"), lambda v: _decided(v, places))


def rounded_column(name: str, places: int = 4) -> Column:
    """The same of a column that is there already: nothing to bind, so it compiles with its projection."""
    return _decided(F.col(name).cast("double"), places)


def _decided(v: Column, places: int) -> Column:
    scale = float(10**places)
    product = v * scale
    high = v * SPLIT - (v * SPLIT - v)
    error = (high * scale - product) + (v - high) * scale
    low = F.floor(product).cast("double")
    rest = product - low
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (low % 2 != 0))))
    return F.when(up, low + 1.0).otherwise(low) / scale
