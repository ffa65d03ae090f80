"""Verhoeff checksum as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.catalogs import VERHOEFF_D, VERHOEFF_P


def _table(rows: list[list[int]]) -> Column:
    return F.expr("array(" + ", ".join(str(n) for row in rows for n in row) + ")")


def verhoeff_valid(digits: Column) -> Column:
    """Whether a string of ASCII digits ends in its right check digit."""
    steps = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.struct((i % 8).alias("place"), d.try_cast("int").alias("digit")),
    )
    rest = F.aggregate(
        steps,
        F.lit(0),
        lambda c, s: F.element_at(
            _table(VERHOEFF_D),
            (c * 10 + F.element_at(_table(VERHOEFF_P), s["place"] * 10 + s["digit"] + 1) + 1).cast("int"),
        ),
    )
    return F.when(digits.rlike("^[0-9]+$"), rest == 0).otherwise(False)
