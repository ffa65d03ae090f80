"""Writing records of processing activities as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.catalogs import ROPA_COLUMNS


def ropa_sheet(ropa: DataFrame) -> DataFrame:
    """The record with its 31 headers in sheet order, A to AE."""
    return ropa.select(*[F.col(key).alias(header) for key, _, header, _, _ in ROPA_COLUMNS])


def write_ropa(ropa: DataFrame, inventory: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the sheet and the personal-data inventory below ``path`` (csv, parquet or json)."""
    if fmt not in ("csv", "parquet", "json"):
        raise ValueError(f"unknown format: {fmt}")
    options = {"header": "true", "escape": '"', "multiLine": "true"} if fmt == "csv" else {}
    ropa_sheet(ropa).write.mode("overwrite").format(fmt).options(**options).save(f"{path}/fiduciary_ropa")
    inventory.write.mode("overwrite").format(fmt).options(**options).save(f"{path}/personal_data_inventory")
