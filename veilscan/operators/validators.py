"""Validation columns on match and entity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.numbers import rounded
from veilscan.catalogs import AADHAAR_KEYWORDS, ACCOUNT_KEYWORDS, BANKING_KEYWORDS
from veilscan.functions.verhoeff import verhoeff_valid
from veilscan.operators.context import context_has, context_words, has_transaction_context
from veilscan.sources.screens import DEVANAGARI_DIGITS

AADHAAR = "AADHAAR_UNMASKED"


def aadhaar_columns(value: Column, ctx: Column) -> dict[str, Column]:
    """Format, checksum, context and confidence of a 12-digit candidate."""
    digits = F.translate(
        F.regexp_replace(value, r"[\s\x1c-\x1f\x85\p{Z}\-]", ""), DEVANAGARI_DIGITS, "0123456789"
    )
    format_valid = digits.rlike("^[0-9]{12}$")
    starts_valid = format_valid & ~F.substring(digits, 1, 1).isin("0", "1")
    repeated = format_valid & digits.rlike(r"^(\d)\1*$")
    checksum = F.when(format_valid, verhoeff_valid(digits)).otherwise(False)
    supported = context_has(ctx, AADHAAR_KEYWORDS)
    banking = context_has(ctx, BANKING_KEYWORDS)

    def points(condition, amount):
        return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))

    total = (
        F.lit(0.0) + points(format_valid, 0.30) + points(starts_valid, 0.10)
        + points(checksum, 0.45) + points(supported, 0.15) - points(banking, 0.45)
        - points(repeated, 0.30)
    )
    return {
        "aadhaar_format_valid": format_valid,
        "aadhaar_starts_valid": starts_valid,
        "aadhaar_checksum_valid": checksum,
        "aadhaar_repeated": repeated,
        "aadhaar_context": supported,
        "aadhaar_banking_context": banking,
        "aadhaar_confidence": rounded(F.greatest(F.lit(0.0), F.least(F.lit(0.99), total)), 4),
        "aadhaar_valid": format_valid & starts_valid & checksum & ~repeated,
    }


def with_aadhaar_validation(matches: DataFrame) -> DataFrame:
    """Validation of Aadhaar candidates; NULL for other types.  Needs ``value`` and ``ctx``."""
    is_aadhaar = F.col("pii_type") == AADHAAR
    columns = aadhaar_columns(F.col("value"), F.col("ctx"))
    return matches.select("*", *[F.when(is_aadhaar, c).alias(n) for n, c in columns.items()])


def with_candidate_confidence(matches: DataFrame) -> DataFrame:
    """Evidence confidence: Aadhaar validated, numbers in payment context capped.

    Needs ``with_aadhaar_validation`` and ``is_layout``.
    """
    kind, own = F.col("pii_type"), F.col("confidence")
    payment = has_transaction_context(F.col("ctx"))
    aadhaar = F.when(
        payment & ~F.col("aadhaar_context"), F.least(F.col("aadhaar_confidence"), F.lit(0.18))
    ).otherwise(F.col("aadhaar_confidence"))
    judged = (
        F.when(kind == AADHAAR, aadhaar)
        .when((kind == "BANK_ACCOUNT") & payment, F.least(own, F.lit(0.25)))
        .otherwise(own)
    )
    floored = F.when(F.col("is_layout"), F.greatest(judged, own)).otherwise(judged)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(0.99), floored))
    return matches.withColumn("evidence_confidence", rounded(clamped, 4))


def masking_ok(pii_type: Column, value: Column) -> Column:
    """Whether a value is hidden the way its type requires; NULL for types without a rule."""
    plain = F.regexp_replace(value, r"[\s\x1c-\x1f\x85\p{Z}\-]", "")
    length = F.length(plain)
    card = (length >= 12) & F.substring(plain, 1, 1).rlike("^[Xx*]")
    account = (F.length(value) >= 6) & value.rlike("^[Xx*]")
    return (
        F.when(pii_type.isin("AADHAAR_UNMASKED", "AADHAAR_MASKED"), plain.rlike("^[Xx*]{8}"))
        .when(pii_type.isin("CREDIT_DEBIT_CARD", "MASKED_CARD"), card)
        .when(pii_type == "BANK_ACCOUNT", account)
    )


def with_masking_status(entities: DataFrame) -> DataFrame:
    return entities.withColumn("masking_ok", masking_ok(F.col("pii_type"), F.col("value")))


def with_account_hits(matches: DataFrame) -> DataFrame:
    """Account words around a match, in list order.  Needs ``ctx``."""
    return matches.withColumn("account_hits", context_words(F.col("ctx"), ACCOUNT_KEYWORDS))


def redacted(value: Column) -> Column:
    """First two and last two characters; short values become stars."""
    return F.when(F.length(value) <= 4, F.repeat(F.lit("*"), F.length(value))).otherwise(
        F.concat(F.substring(value, 1, 2), F.lit("***"), F.substring(value, -2, 2))
    )


def with_redacted_value(entities: DataFrame) -> DataFrame:
    return entities.withColumn("redacted_value", redacted(F.col("value")))
