"""Comparing a new scan with the corrections a baseline expects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAYLOAD = "corrections_expected array<string>"


def corrections_expected(store: DataFrame) -> DataFrame:
    """Rule ids a baseline's payload expects to be corrected, in order."""
    parsed = store.select("id", "user_id", "file_name", F.from_json("payload", PAYLOAD).alias("p"))
    return parsed.select(
        "id", "user_id", "file_name", F.posexplode("p.corrections_expected").alias("position", "rule_id")
    )


def verify_corrections(
    expected: DataFrame, violations: DataFrame, scope: list[str] | None = None
) -> DataFrame:
    """Whether each expected correction is gone from the new scan; else its first finding.

    A violation counts under its rule, or its section if it has no rule.  Violations are
    reduced to one row per key (and ``scope`` columns, such as a session) before the join.
    """
    scope = scope or []
    key = F.coalesce("rule_id", "act_section")
    order = F.struct("screen_id", "rule_order") if "rule_order" in violations.columns else F.col("screen_id")
    first = violations.groupBy(*scope, key.alias("rule_id")).agg(F.min_by("finding", order).alias("finding"))
    return expected.join(first.withColumn("_found", F.lit(True)), [*scope, "rule_id"], "left").select(
        *expected.columns,
        F.when(F.col("_found"), "still_present").otherwise("corrected").alias("status"),
        "finding",
    )


def correction_summary(verified: DataFrame) -> DataFrame:
    """Corrections per baseline and status."""
    return verified.groupBy("id", "status").agg(F.count("*").alias("corrections"))
