"""Scores, flags, findings and the tables exchanged with an external analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions.numbers import rounded
from veilscan.catalogs import (
    DOCUMENT_SENSITIVITY,
    FINDING_PENALTY,
    RISK_WEIGHT,
    SENSITIVE_DOCUMENTS,
)
from veilscan.functions.tables import explode_rows
from veilscan.functions.text import quoted
from veilscan.operators.validators import masking_ok


def _lookup(table: dict[str, int], key: Column, default: int) -> Column:
    pairs = ", ".join(f"{quoted(k)}, {v}" for k, v in table.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), key), F.lit(default))


def risk_level(score: Column) -> Column:
    return F.when(score >= 85, "Low").when(score >= 70, "Medium").when(score >= 45, "High").otherwise("Critical")


def readiness(score: Column) -> Column:
    return (
        F.when(score >= 85, "Ready").when(score >= 70, "Mostly Ready")
        .when(score >= 45, "Needs Remediation").otherwise("Not Ready")
    )


def combined_risk(entities: DataFrame, findings: DataFrame, document_types: DataFrame) -> DataFrame:
    """Score of every screen of ``document_types`` from findings, entities and sensitivity."""
    exposed = ~F.col("masked") & F.col("risk").isin("Critical", "High")
    per_entity = entities.groupBy("screen_id").agg(F.count_if(exposed).alias("unmasked_high_risk"))
    penalty = _lookup(FINDING_PENALTY, F.upper("severity"), 2)
    per_finding = findings.groupBy("screen_id").agg(
        F.sum(F.when(F.col("severity") == "None", 0).otherwise(penalty)).alias("finding_penalty"),
        F.count("*").alias("finding_count"),
    )
    joined = (
        document_types.join(per_entity, "screen_id", "left").join(per_finding, "screen_id", "left")
        .fillna(0, ["unmasked_high_risk", "finding_penalty", "finding_count"])
        .withColumn("document_sensitivity", _lookup(DOCUMENT_SENSITIVITY, F.col("document_type"), 3))
    )
    raw = (
        F.lit(100) - F.col("finding_penalty") - F.col("unmasked_high_risk") * 3
        - F.col("document_sensitivity")
    )
    scored = joined.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), raw)))
    return scored.select(
        "screen_id", "score", risk_level(F.col("score")).alias("severity"),
        readiness(F.col("score")).alias("readiness"), "finding_count", "document_sensitivity",
        "unmasked_high_risk",
    )


def compliance_score(entities: DataFrame) -> DataFrame:
    """100 less a weight per entity; masked entities count a quarter."""
    weight = _lookup(RISK_WEIGHT, F.col("risk"), 0)
    cost = F.when(F.col("masked"), weight * 0.25).otherwise(weight * 1.0)
    return entities.groupBy("screen_id").agg(
        F.greatest(F.lit(0), F.lit(100) - F.floor(F.sum(cost)).cast("int")).alias("score"),
        F.count("*").alias("total_entities"),
    )


def compliance_grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 55, "C")
        .when(score >= 35, "D").otherwise("F")
    )


def risk_breakdown(entities: DataFrame) -> DataFrame:
    """Entities per risk, the risk None included."""
    return entities.groupBy("screen_id").agg(
        *[F.count_if(F.col("risk") == r).alias(f"by_risk_{r.lower()}") for r in RISK_WEIGHT]
    )


def compliance_report(entities: DataFrame) -> DataFrame:
    """Score, grade, counts and number of flags of every screen with entities."""
    weight = _lookup(RISK_WEIGHT, F.col("risk"), 0)
    cost = F.when(F.col("masked"), weight * 0.25).otherwise(weight * 1.0)
    flagged = entities.withColumn("_flags", F.size(flags_column()))
    grouped = flagged.groupBy("screen_id").agg(
        F.greatest(F.lit(0), F.lit(100) - F.floor(F.sum(cost)).cast("int")).alias("score"),
        F.count("*").alias("total_entities"),
        F.sum("_flags").alias("flag_count"),
        *[F.count_if(F.col("risk") == r).alias(f"by_risk_{r.lower()}") for r in RISK_WEIGHT],
    )
    return grouped.withColumn("grade", compliance_grade(F.col("score")))


def flags_column() -> Column:
    """Messages one entity gives rise to."""
    kind, value = F.col("pii_type"), F.col("value")
    shown = ~F.coalesce(masking_ok(kind, value), F.lit(False))

    def flag(condition, *parts):
        return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    return F.array_compact(
        F.array(
            flag(kind == "AADHAAR_UNMASKED",
                 "⚠ DPDP Violation: Aadhaar number fully visible — must display only last 4 digits ('",
                 value, "')."),
            flag((kind == "CREDIT_DEBIT_CARD") & shown,
                 "⚠ DPDP Violation: Full credit/debit card number exposed — must mask first 12 digits ('",
                 value, "')."),
            flag((kind == "BANK_ACCOUNT") & shown,
                 "⚠ DPDP Violation: Bank account number '", value, "' should show only last 4 digits."),
            flag(kind == "_KW_PASSWORD",
                 "⚠ DPDP Violation: Document contains a password reference — credentials must never "
                 "appear in unencrypted documents."),
            flag((kind == "PAN") & ~F.col("masked"),
                 "ℹ DPDP Guidance: PAN number '", value, "' is fully visible. Consider masking first 5 "
                 "characters for non-essential contexts."),
            flag(kind == "PHONE_IN",
                 "ℹ DPDP Guidance: Phone number '", value, "' detected. Ensure consent exists for its "
                 "collection and storage."),
            flag(kind == "ACCOUNT_BALANCE",
                 "ℹ DPDP Guidance: Account balance detected. Financial data requires strict access "
                 "controls."),
            flag(kind == "TRANSACTION_HISTORY",
                 "⚠ DPDP Violation: Transaction history detected. This represents highly sensitive "
                 "financial activity."),
        )
    )


def compliance_flags(entities: DataFrame) -> DataFrame:
    rows = entities.select("screen_id", "pii_type", "value", flags_column().alias("flags"))
    return explode_rows(rows, "flags", "flag", "screen_id", "pii_type", "value")


IDENTIFIER_TYPES = ["AADHAAR_UNMASKED", "CREDIT_DEBIT_CARD", "BANK_ACCOUNT", "PAN"]
ACTIVITY_TYPES = ["ACCOUNT_BALANCE", "TRANSACTION_HISTORY"]
MASK_ADVICE = "Mask sensitive identifiers except the minimum digits required for the user task."
LIMIT_ADVICE = "Limit balance and transaction visibility to screens with a clear business purpose."


def heuristic_findings(entities: DataFrame) -> DataFrame:
    """Findings for exposed identifiers and financial activity, one row each."""
    kind = F.col("pii_type")
    exposed = entities.filter(~F.col("masked") & F.col("risk").isin("Critical", "High"))
    identifier = kind.isin(IDENTIFIER_TYPES)
    rows = exposed.filter(identifier | kind.isin(ACTIVITY_TYPES))
    return rows.select(
        "screen_id",
        "entity_rank",
        F.concat(
            "display_type", F.when(identifier, " appears overexposed").otherwise(" is visible")
        ).alias("issue"),
        F.when(identifier & (F.col("risk") == "Critical"), "Critical").otherwise("High").alias("severity"),
        F.col("value").alias("supporting_text"),
        "confidence",
        F.col("display_type").alias("related_entity"),
        F.when(identifier, "Masking Compliance").otherwise("Financial Privacy").alias("category"),
        F.when(identifier, MASK_ADVICE).otherwise(LIMIT_ADVICE).alias("recommendation"),
    )


def heuristic_summary(findings: DataFrame, document_types: DataFrame) -> DataFrame:
    """Highest severity, sensitivity and number of recommendations of every screen."""
    grouped = findings.groupBy("screen_id").agg(
        F.max((F.col("severity") == "Critical").cast("int")).alias("critical"),
        F.count("*").alias("finding_count"),
        F.count_distinct("recommendation").alias("recommendation_count"),
    )
    joined = document_types.join(grouped, "screen_id", "left").fillna(0, ["finding_count", "recommendation_count"])
    overall = F.when(F.col("critical") == 1, "Critical").when(F.col("critical") == 0, "High").otherwise("Low")
    return joined.select(
        "screen_id",
        overall.alias("overall_risk"),
        F.when(F.col("document_type").isin(SENSITIVE_DOCUMENTS), "High").otherwise(overall).alias("screen_sensitivity"),
        (F.col("finding_count") > 0).alias("excessive_data_exposure"),
        "finding_count",
        "recommendation_count",
    )


ANALYSIS_JSON = """
    document_type string, ai_summary string, overall_risk string, screen_sensitivity string,
    violations_found string,
    purpose_limitation struct<assessment:string,excessive_data_exposure:boolean>,
    violation_details array<struct<act_section:string,section_title:string,
        pii_involved:array<string>,finding:string,severity:string,confidence:string,
        category:string,penalty_reference:string>>,
    recommendations array<string>, observations array<string>, limitations array<string>
"""


def json_body(raw: Column) -> Column:
    """The JSON object inside a reply that may carry thinking, fences or prose."""
    plain = F.trim(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    fenced = F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?m)^```(?:json)?\s*", ""), r"(?m)```\s*$", ""))
    return F.when(F.get_json_object(plain, "$").isNotNull(), plain).otherwise(
        F.regexp_extract(fenced, r"(?s)\{.*\}", 0)
    )


#: Limits that a report with little room may ask for: characters of each text, entries of each list.
REPORT_LIMITS = {
    "act_section": 50, "section_title": 100, "pii_involved": 8, "finding": 300, "category": 80,
    "penalty_reference": 100, "ai_summary": 600, "purpose_assessment": 600, "violation_details": 20,
    "recommendations": 12, "recommendation": 300, "observations": 12, "observation": 300,
    "limitations": 8, "limitation": 200,
}


def _level(text: Column, default: Column) -> Column:
    level = F.upper(F.trim(text))
    return F.when(level.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), level).otherwise(default)


def normalise_analysis(
    json_df: DataFrame, column: str = "payload", limits: dict[str, int] | None = None
) -> DataFrame:
    """External analysis documents in checked form, whole; ``limits`` (such as ``REPORT_LIMITS``) cut them."""
    d = F.col("d")

    def _cut(text, name, default=""):
        text = F.coalesce(text, F.lit(default))
        return F.substring(text, 1, limits[name]) if name in (limits or {}) else text

    def _first(items, name):
        return F.slice(items, 1, limits[name]) if name in (limits or {}) else items

    parsed = json_df.select("screen_id", F.from_json(json_body(F.col(column)), ANALYSIS_JSON).alias("d"))

    def detail(v):
        score = F.coalesce(v["confidence"].try_cast("double"), F.lit(0.7))
        return F.struct(
            _cut(v["act_section"], "act_section").alias("act_section"),
            _cut(v["section_title"], "section_title").alias("section_title"),
            _first(F.coalesce(v["pii_involved"], F.array().cast("array<string>")), "pii_involved").alias("pii_involved"),
            _cut(v["finding"], "finding").alias("finding"),
            _level(v["severity"], F.lit("LOW")).alias("severity"),
            rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("confidence"),
            _cut(v["category"], "category").alias("category"),
            _cut(v["penalty_reference"], "penalty_reference").alias("penalty_reference"),
        )

    def texts(name):
        items = F.coalesce(d[name], F.array().cast("array<string>"))
        return F.transform(_first(items, name), lambda t: _cut(t, name.removesuffix("s"))).alias(name)

    listed = F.coalesce(d["violation_details"], F.from_json(F.lit("[]"), "array<struct<act_section:string,section_title:string,pii_involved:array<string>,finding:string,severity:string,confidence:string,category:string,penalty_reference:string>>"))
    details = F.transform(F.filter(_first(listed, "violation_details"), lambda v: v.isNotNull()), detail)
    overall = _level(d["overall_risk"], F.lit("LOW"))
    stated = F.upper(F.trim(F.coalesce(d["violations_found"], F.lit("NO"))))
    return parsed.select(
        "screen_id",
        d["document_type"].alias("document_type"),
        _cut(d["ai_summary"], "ai_summary", "AI analysis completed.").alias("ai_summary"),
        overall.alias("overall_risk"),
        _level(d["screen_sensitivity"], overall).alias("screen_sensitivity"),
        F.when(stated.isin("YES", "NO", "INCONCLUSIVE"), stated)
        .otherwise(F.when(F.size(listed) > 0, "YES").otherwise("NO")).alias("violations_found"),
        _cut(d["purpose_limitation"]["assessment"], "purpose_assessment").alias("purpose_assessment"),
        F.coalesce(d["purpose_limitation"]["excessive_data_exposure"], F.lit(False)).alias("excessive_data_exposure"),
        details.alias("violation_details"),
        texts("recommendations"),
        texts("observations"),
        texts("limitations"),
    )


def transaction_summary(entities: DataFrame) -> DataFrame:
    """Financial entities of every screen that has any."""
    kind = F.col("pii_type")
    financial = entities.filter(kind.startswith("TRANSACTION") | (F.col("category") == "Financial Data"))
    return financial.groupBy("screen_id").agg(
        F.count("*").alias("transaction_entity_count"),
        F.bool_or(kind == "TRANSACTION_HISTORY").alias("transaction_history_detected"),
        F.count_if(kind == "TRANSACTION_REFERENCE").alias("transaction_references_detected"),
        F.array_join(F.array_sort(F.collect_set("display_type")), "|").alias("financial_exposure_types"),
    )


def text_excerpt(text: Column, max_chars: int) -> Column:
    note = "\n[truncated]" if max_chars <= 5000 else "\n[OCR text truncated for analysis prompt]"
    return F.when(F.length(text) <= max_chars, text).otherwise(
        F.concat(F.substring(text, 1, max_chars), F.lit(note))
    )


def evidence_export(
    screens: DataFrame, entities: DataFrame, candidates: DataFrame, max_chars: int | None = None,
    max_entities: int | None = None, max_lines: int | None = None, max_candidates: int | None = None,
    max_types: int | None = None,
) -> DataFrame:
    """One JSON evidence document per screen for an external analysis; whole unless limits are given."""

    def within(items, most):
        return F.slice(items, 1, most) if most else F.col(items) if isinstance(items, str) else items

    ranked = entities.filter(F.col("entity_rank") <= max_entities) if max_entities else entities
    top_entities = ranked.groupBy("screen_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("entity_rank").alias("id"), F.col("display_type").alias("type"),
                    F.col("pii_type").alias("raw_type"), "category", "risk", "masked", "confidence",
                    F.col("value").alias("supporting_text"),
                )
            )
        ).alias("entities")
    )
    place = Window.partitionBy("screen_id").orderBy(F.col("best_confidence").desc(), "first_ord")
    top_candidates = (
        candidates.select(
            "screen_id", F.row_number().over(place).alias("candidate_id"), "value",
            within("candidate_types", max_types).alias("candidate_types"),
        )
        .filter(F.col("candidate_id") <= max_candidates if max_candidates else F.lit(True))
        .groupBy("screen_id")
        .agg(F.array_sort(F.collect_list(F.struct("candidate_id", "value", "candidate_types"))).alias("candidates"))
    )
    lines = F.transform(
        within(F.split("full_text", "\n", -1), max_lines),
        lambda t, i: F.struct(i.alias("line_index"), t.alias("text")),
    )
    document = F.struct(
        F.struct(
            F.col("avg_confidence"), (text_excerpt(F.col("full_text"), max_chars) if max_chars else F.col("full_text")).alias("full_text"),
            lines.alias("lines"),
        ).alias("ocr"),
        F.col("entities").alias("detected_pii_entities"),
        F.col("candidates").alias("candidate_entities"),
    )
    joined = screens.select("screen_id", "avg_confidence", "full_text").join(
        top_entities, "screen_id", "left"
    ).join(top_candidates, "screen_id", "left")
    return joined.select("screen_id", F.to_json(document).alias("evidence")).select(
        "screen_id", "evidence",
        F.greatest(F.lit(1), F.ceil(F.length("evidence") / 4)).cast("long").alias("token_estimate"),
    )


def scan_confidence(verdicts: DataFrame, analysis_succeeded: Column | bool = False) -> DataFrame:
    """Overall confidence in percent over the signals a screen has."""
    succeeded = analysis_succeeded if isinstance(analysis_succeeded, Column) else F.lit(analysis_succeeded)
    signals = [
        (F.col("avg_confidence"), 0.40),
        (F.when(F.col("total_entities") > 0, F.col("mean_confidence")), 0.30),
        (F.when(F.size("violations") > 0, F.lit(0.7)).when(succeeded, F.lit(0.85)), 0.20),
        (
            F.when(
                F.size("rules_evaluated") > 0,
                F.least(F.lit(1.0), F.size("rules_evaluated") / F.lit(26.0)),
            ),
            0.10,
        ),
    ]
    score, weight = F.lit(0.0), F.lit(0.0)
    for value, share in signals:
        score = score + F.coalesce(value * share, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), F.lit(share)).otherwise(F.lit(0.0))
    percent = F.floor(score / weight * 100 + 0.5).cast("int")
    return verdicts.select("screen_id", F.when(weight > 0, percent).alias("scan_confidence"))


def entities_by_category(entities: DataFrame) -> DataFrame:
    """Entities per screen and category, worst risk first."""
    rank = (
        F.when(F.col("risk") == "Critical", 0).when(F.col("risk") == "High", 1)
        .when(F.col("risk") == "Medium", 2).when(F.col("risk") == "Low", 3).otherwise(4)
    )
    grouped = entities.groupBy("screen_id", "category").agg(
        F.count("*").alias("entity_count"), F.min(rank).alias("worst_rank"),
        F.min("entity_rank").alias("first_rank"),
    )
    place = Window.partitionBy("screen_id").orderBy("worst_rank", "first_rank")
    return grouped.select(
        "screen_id", "category", "entity_count", "worst_rank",
        F.row_number().over(place).alias("category_order"),
    )
