"""Verdicts: inconclusive conditions, overall severity, one row per screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.catalogs import RULE_SCREENS, SEVERITIES, screen_dim
from veilscan.functions.text import words
from veilscan.operators.rules import RISKS, applicable, features_of, violations_column


def reasons_column() -> Column:
    """Why a screen cannot be judged, from its feature row."""
    card = F.col("partial_card_digits")
    return F.array_compact(
        F.array(
            F.when(
                F.col("screen_confidence") == "low",
                "Screen type could not be determined with confidence from OCR text alone.",
            ),
            F.when(
                F.col("avg_confidence") < 0.4,
                F.concat(
                    F.lit("Average OCR confidence is very low ("),
                    F.format_number("avg_confidence", 2),
                    F.lit("); PII detection may be unreliable."),
                ),
            ),
            F.when(
                card.isNotNull(),
                F.concat(
                    F.lit("Card number partially visible ("), card.cast("string"),
                    F.lit(" digits); masking compliance cannot be confirmed."),
                ),
            ),
        )
    )


def inconclusive_reasons(features: DataFrame) -> DataFrame:
    return features.select("screen_id", reasons_column().alias("notes"))


def verdict_column(violation_count: Column, reason_count: Column) -> Column:
    return (
        F.when(violation_count > 0, "YES").when(reason_count > 0, "INCONCLUSIVE").otherwise("NO")
    )


def severity_column(severities: Column) -> Column:
    """Worst of an array of severities; NULL when empty."""
    return F.get(F.filter(words(SEVERITIES), lambda s: F.array_contains(severities, s)), F.lit(0))


def overall_severity(violations: DataFrame) -> DataFrame:
    rank = F.array_position(words(SEVERITIES), F.col("severity"))
    return violations.groupBy("screen_id").agg(F.min_by("severity", rank).alias("overall_severity"))


def risk_counts(entities: DataFrame) -> DataFrame:
    """Entities per risk; the risk None is not counted."""
    return entities.groupBy("screen_id").agg(
        *[F.count_if(F.col("risk") == r).alias(f"risk_{r.lower()}") for r in RISKS]
    )


def rules_evaluated() -> Column:
    return F.array_compact(F.array(*[F.when(applicable(r), r) for r, _ in RULE_SCREENS]))


def verdict_rows(features: DataFrame) -> DataFrame:
    """One row per screen from its features; no join and no shuffle."""
    keep = [c for c in ("session_id", "uploaded_at") if c in features.columns]
    staged = features.select(
        "screen_id", *keep, "primary_screen_type", "screen_types", "screen_confidence",
        "document_type", "present", "avg_confidence", "total_entities", "mean_confidence",
        *[f"risk_{r.lower()}" for r in RISKS],
        rules_evaluated().alias("rules_evaluated"),
        violations_column().alias("violations"),
        reasons_column().alias("notes"),
    )
    dim = F.broadcast(screen_dim(features.sparkSession).withColumnRenamed("screen_type", "primary_screen_type"))
    return (
        staged.withColumn("verdict", verdict_column(F.size("violations"), F.size("notes")))
        .withColumn(
            "overall_severity", severity_column(F.transform("violations", lambda v: v["severity"]))
        )
        .join(dim, "primary_screen_type", "left")
    )


def evaluate_screens(screens: DataFrame, entities: DataFrame) -> DataFrame:
    """Verdict of every screen from its text and entities."""
    return verdict_rows(features_of(screens, entities))
