"""DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, array: Column | str, alias: str, *keep: str) -> DataFrame:
    """One row per element.

    A plain ``explode`` makes the optimizer add ``size(array) > 0`` below the projection
    that computes the array, so the whole expression would be worked out twice or
    more.  An outer explode with the empty rows dropped afterwards does it once.
    """
    return df.select(*keep, F.explode_outer(array).alias(alias)).filter(F.col(alias).isNotNull())


def bound(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with one more column that is worked out once per row, whatever asks for it later.

    A filter on a plain column is moved below the projection that computes it, with the whole
    expression in place of the column, and computes it again; one on a generated column stays above.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
