"""The twenty-nine rules.

A rule is a condition on one wide row per screen (``rule_features``) and what it
reports.  Applicable rules are those whose screens meet the screen's types.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.catalogs import (
    DEFAULT_PENALTY,
    ENTITY_PARAMETERS,
    RULE_SCREENS,
    RULE_WORDS,
    rule_dim,
    section_dim,
)
from veilscan.functions.tables import explode_rows
from veilscan.functions.text import words
from veilscan.operators.classify import class_columns, document_type_of, screen_types_of
from veilscan.operators.inventory import present_column, text_facts

DASHBOARD_IDS = ["FIN-01", "ID-01", "ID-14", "ID-13", "KYC-01", "KYC-02", "FIN-07"]
DASHBOARD_TYPES = [t for t, ids in ENTITY_PARAMETERS if set(ids) & set(DASHBOARD_IDS)]
CONFLICT_TYPES = ["PHONE_IN", "EMAIL", "ACCOUNT_HOLDER_NAME", "BANK_ACCOUNT"]
CARD_TYPES = ["CREDIT_DEBIT_CARD", "MASKED_CARD"]
RISKS = ["Critical", "High", "Medium", "Low"]


def visible_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"[^\p{Nd}]", ""))


def entity_facts(entities: DataFrame) -> DataFrame:
    """What the rules need to know of a screen's entities, one row per screen with any."""
    kind, value, rank = F.col("pii_type"), F.col("value"), F.col("entity_rank")
    open_ = ~F.col("masked")
    ids = {t: pids for t, pids in ENTITY_PARAMETERS}
    mapped = F.lit(None).cast("array<string>")
    for t, pids in ids.items():
        mapped = F.when(kind == t, words(pids)).otherwise(mapped)
    digits = visible_digits(value)
    partial_card = kind.isin(CARD_TYPES) & (digits > 4) & (digits < 16)
    with_ids = entities.withColumn("_ids", mapped)
    return with_ids.groupBy("screen_id").agg(
        F.count("*").alias("total_entities"),
        F.array_distinct(F.flatten(F.collect_set("_ids"))).alias("entity_ids"),
        F.collect_set(F.when(open_, kind)).alias("open_types"),
        F.count_if(open_ & kind.isin(DASHBOARD_TYPES)).alias("open_dashboard"),
        F.min_by(value, F.when(open_ & (kind == "AADHAAR_UNMASKED"), rank)).alias("first_aadhaar"),
        F.min_by(value, F.when(open_ & (kind == "BANK_ACCOUNT"), rank)).alias("first_account"),
        F.min_by(digits, F.when(partial_card, rank)).alias("partial_card_digits"),
        *[
            F.struct(
                F.min(F.when(kind == t, rank)).alias("first_rank"),
                F.lit(t).alias("pii_type"),
                F.array_sort(F.collect_set(F.when(kind == t, value))).alias("values"),
            ).alias(f"values_{t}")
            for t in CONFLICT_TYPES
        ],
        *[F.count_if(F.col("risk") == r).alias(f"risk_{r.lower()}") for r in RISKS],
        F.avg("confidence").alias("mean_confidence"),
    )


def rule_features(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """One wide row per screen: text facts, entity facts, present ids, screen class.

    ``facts`` is the result of ``text_facts``.
    """
    joined = facts.join(entity_facts(entities), "screen_id", "left")
    zero_counts = ["total_entities", "open_dashboard", *[f"risk_{r.lower()}" for r in RISKS]]
    ranked = screen_types_of(F.col("hits"))
    return (
        joined.fillna(0, zero_counts)
        .withColumn("open_types", F.coalesce("open_types", F.array().cast("array<string>")))
        .withColumn("present", present_column(F.col("entity_ids"), F.col("signals")))
        .withColumn("_ranked", ranked)
        .select("*", *[c.alias(n) for n, c in class_columns(F.col("_ranked")).items()])
        .withColumn("document_type", document_type_of(F.col("hits")))
        .drop("_ranked", "entity_ids")
    )


# -- conditions ---------------------------------------------------------------
def present_of(*ids: str) -> Column:
    """Those of ``ids`` that are present, in the order given."""
    return F.filter(words(list(ids)), lambda i: F.array_contains("present", i))


def any_present(*ids: str) -> Column:
    return F.arrays_overlap("present", words(list(ids)))


def says(name: str) -> Column:
    """Whether the text holds one of the rule's words."""
    return F.arrays_overlap("hits", words(RULE_WORDS[name]))


def shown_open(pii_type: str) -> Column:
    return F.array_contains("open_types", pii_type)


def conflict() -> Column:
    """First entity type, in entity order, with more than one value; NULL if none."""
    several = F.filter(
        F.array(*[F.col(f"values_{t}") for t in CONFLICT_TYPES]), lambda v: F.size(v["values"]) > 1
    )
    return F.array_min(several)


def conflict_ids(c: Column) -> Column:
    ids = {t: pids for t, pids in ENTITY_PARAMETERS}
    chosen = F.lit(None).cast("array<string>")
    for t in CONFLICT_TYPES:
        chosen = F.when(c["pii_type"] == t, words(ids[t])).otherwise(chosen)
    return chosen


@dataclass(frozen=True)
class Rule:
    rule_id: str
    section: str
    severity: str
    fires: Callable[[], Column]
    involved: Callable[[], Column]
    finding: Callable[[], Column]


def _rule(rule_id, section, severity, fires, involved, finding) -> Rule:
    """``involved`` may be a list of ids, ``finding`` a plain text."""
    ids = involved if callable(involved) else (lambda: words(involved))
    text = finding if callable(finding) else (lambda: F.lit(finding))
    return Rule(rule_id, section, severity, fires, ids, text)


RULES = [
    _rule("RULE-DM-01", "Section 6(1)", "HIGH",
          lambda: (F.size(present_of(*DASHBOARD_IDS)) > 3) & (F.col("open_dashboard") > 3),
          lambda: F.array_sort(present_of(*DASHBOARD_IDS)),
          lambda: F.concat(
              F.lit("Dashboard displays "), F.size(present_of(*DASHBOARD_IDS)).cast("string"),
              F.lit(" unmasked PII fields simultaneously, exceeding data minimisation limits."))),
    _rule("RULE-DM-02", "Section 6(1)", "CRITICAL",
          lambda: shown_open("CREDIT_DEBIT_CARD") | F.col("shows_cvv"), ["FIN-02"],
          lambda: F.when(
              shown_open("CREDIT_DEBIT_CARD"),
              "Full 16-digit card number visible unmasked on card info screen.",
          ).otherwise("CVV value appears visible on card info screen.")),
    _rule("RULE-DM-03", "Section 6(1)", "CRITICAL",
          lambda: F.col("first_aadhaar").isNotNull(), ["KYC-02"],
          lambda: F.concat(
              F.lit("Full Aadhaar number '"), F.col("first_aadhaar"),
              F.lit("' displayed unmasked; must show only last 4 digits."))),
    _rule("RULE-DM-04", "Section 6(1)", "MEDIUM",
          lambda: any_present("KYC-01", "KYC-02", "ID-04", "ID-07", "FIN-01"),
          lambda: present_of("KYC-01", "KYC-02", "ID-04", "ID-07", "FIN-01"),
          "Recharge screen shows data beyond mobile number and amount."),
    _rule("RULE-DM-05", "Section 6(1)", "HIGH",
          lambda: any_present("FIN-09", "FIN-11", "FIN-10"),
          lambda: present_of("FIN-09", "FIN-11", "FIN-10"),
          "Income/CTC/tax data visible on non-loan screen."),
    _rule("RULE-DM-06", "Section 6(1)", "HIGH",
          lambda: any_present("ID-17", "ID-18", "ID-20", "CHD-04"),
          lambda: present_of("ID-17", "ID-18", "ID-20", "CHD-04"),
          "Sensitive attributes (religion/caste/disability) visible on profile screen without "
          "lawful purpose."),
    _rule("RULE-CN-01", "Section 5(1)", "CRITICAL",
          lambda: ~says("cn01_consent"),
          lambda: F.when(any_present("KYC-01", "KYC-02", "KYC-03"),
                         present_of("KYC-01", "KYC-02", "KYC-03")).otherwise(words(["KYC-02"])),
          "KYC/onboarding screen collects PII but no consent notice is visible."),
    _rule("RULE-CN-02", "Section 5(1)(i)", "HIGH", lambda: ~says("cn02_purpose"), [],
          "Consent banner lacks a purpose statement describing what data will be used for."),
    _rule("RULE-CN-03", "Section 5(1)(ii)", "HIGH", lambda: ~says("cn03_withdrawal"), [],
          "Consent banner does not mention consent withdrawal rights."),
    _rule("RULE-CN-04", "Section 6(1)", "HIGH", lambda: says("cn04_blanket"), [],
          "Blanket consent clause detected without specifying data or purpose."),
    _rule("RULE-CN-05", "Section 6(1)", "MEDIUM", lambda: says("cn05_excess"), [],
          "Consent requested for data beyond transaction necessity (contacts/location/camera)."),
    _rule("RULE-CN-06", "Section 6", "HIGH",
          lambda: any_present("ID-01", "ID-14", "FIN-01", "FIN-07") & ~says("cn06_optout"),
          lambda: present_of("ID-01", "ID-14", "FIN-01", "FIN-07"),
          "PII visible alongside third-party content with no opt-out control."),
    _rule("RULE-SEC-01", "Section 8(5)", "CRITICAL", lambda: shown_open("_KW_PASSWORD"),
          ["ONL-02"], "Password or credential visible in plaintext."),
    _rule("RULE-SEC-02", "Section 8(5)", "HIGH",
          lambda: F.col("first_account").isNotNull(), ["FIN-01"],
          lambda: F.concat(F.lit("Full account number '"), F.col("first_account"),
                           F.lit("' unmasked in transaction history."))),
    _rule("RULE-SEC-03", "Section 8(5)", "CRITICAL",
          lambda: says("sec03_debug") | any_present("ONL-03", "ONL-04"),
          lambda: F.when(any_present("ONL-03", "ONL-04"), words(["ONL-03", "ONL-04"])).otherwise(words([])),
          "Internal system data or debug info exposed on user-facing screen."),
    _rule("RULE-SEC-04", "Section 8(5)", "HIGH", lambda: F.col("shows_otp"), [],
          "OTP or authentication token visible in plaintext after auth step."),
    _rule("RULE-SEC-05", "Section 8(5)", "CRITICAL",
          lambda: any_present("BIO-01", "BIO-02") & ~says("sec05_indicator"),
          ["BIO-01", "BIO-02"],
          "Biometric capture detected without explicit on-screen indicator."),
    _rule("RULE-RET-01", "Section 8(7)", "MEDIUM",
          lambda: any_present("KYC-01", "KYC-02", "KYC-03", "KYC-04", "KYC-05"),
          lambda: present_of("KYC-01", "KYC-02", "KYC-03", "KYC-04", "KYC-05"),
          "KYC document data visible in transaction history with no current purpose."),
    _rule("RULE-RET-02", "Section 8(7)", "MEDIUM",
          lambda: says("ret02_closed") & any_present("FIN-01", "ID-01", "ID-07", "FIN-07"),
          lambda: present_of("FIN-01", "ID-01", "ID-07", "FIN-07"),
          "Full PII for closed/dormant account still visible without masking."),
    _rule("RULE-CHD-01", "Section 9(1)", "CRITICAL",
          lambda: any_present("CHD-01", "CHD-02") & ~says("chd01_guardian"), ["CHD-01"],
          "Minor account detected without visible guardian consent indicator."),
    _rule("RULE-CHD-02", "Section 9(3)", "CRITICAL",
          lambda: any_present("CHD-01", "CHD-02"), ["CHD-01"],
          "Third-party offer/ad content visible on a minor's account screen."),
    _rule("RULE-CHD-03", "Section 9(3)", "CRITICAL",
          lambda: any_present("CHD-01", "CHD-02") & says("chd03_tracking"), ["CHD-01"],
          "Behavioural tracking indicator detected on child account screen."),
    _rule("RULE-TP-01", "Section 4", "HIGH",
          lambda: any_present("ID-01", "ID-14", "FIN-07", "FIN-08"),
          lambda: present_of("ID-01", "ID-14", "FIN-07", "FIN-08"),
          "Customer PII embedded within or adjacent to third-party promotional content."),
    _rule("RULE-TP-02", "Section 5(1)", "HIGH",
          lambda: any_present("ID-01") & ~says("tp02_disclosure"), ["ID-01"],
          "Customer name referenced alongside third-party brand with no data sharing disclosure."),
    _rule("RULE-SEN-01", "Section 4", "HIGH",
          lambda: any_present("ID-17", "ID-18", "ID-20"),
          lambda: present_of("ID-17", "ID-18", "ID-20"),
          "Religion/caste data visible on standard banking screen without lawful purpose."),
    _rule("RULE-SEN-02", "Section 6(1)", "CRITICAL",
          lambda: any_present("BIO-01", "BIO-02"), ["BIO-01", "BIO-02"],
          "Biometric data displayed on unrelated banking screen."),
    _rule("RULE-SEN-03", "Section 5(1)", "CRITICAL",
          lambda: any_present("BIO-01", "BIO-02", "OTH-02") & ~says("sen03_consent"),
          ["BIO-01", "OTH-02"],
          "Video KYC collects biometric data without visible consent statement."),
    _rule("RULE-GR-01", "Section 8(10)", "LOW",
          lambda: (F.size("present") >= 3) & ~says("gr01_grievance"), [],
          "PII-heavy screen lacks DPO contact or grievance redressal link."),
    _rule("RULE-ACC-01", "Section 8(3)", "MEDIUM",
          lambda: conflict().isNotNull(), lambda: conflict_ids(conflict()),
          lambda: F.concat(
              F.lit("Conflicting "), conflict()["pii_type"], F.lit(" values on same screen: "),
              F.array_join(conflict()["values"], ", "), F.lit("."))),
]
RULE_BY_ID = {r.rule_id: r for r in RULES}
RULE_ORDER = {rule_id: i for i, (rule_id, _) in enumerate(RULE_SCREENS)}


def applicable(rule_id: str) -> Column:
    return F.arrays_overlap("screen_types", words(dict(RULE_SCREENS)[rule_id]))


def violation_struct(rule: Rule) -> Column:
    return F.when(
        applicable(rule.rule_id) & rule.fires(),
        F.struct(
            F.lit(RULE_ORDER[rule.rule_id]).alias("rule_order"),
            F.lit(rule.rule_id).alias("rule_id"),
            rule.involved().alias("pii_involved"),
            F.lit(rule.section).alias("act_section"),
            rule.finding().alias("finding"),
            F.lit(rule.severity).alias("severity"),
        ),
    )


def violations_column(rules: list[Rule] | None = None) -> Column:
    """Violations of one screen in matrix order, from its feature row."""
    return F.array_compact(F.array(*[violation_struct(r) for r in rules or RULES]))


def evaluate_rules(features: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per screen and violated rule."""
    keep = ["screen_id", *[c for c in ("session_id",) if c in features.columns]]
    found = features.select(*keep, violations_column(rules).alias("vs"))
    return explode_rows(found, "vs", "v", *keep).select(*keep, "v.*")


def evaluate_rule(features: DataFrame, rule_id: str) -> DataFrame:
    return evaluate_rules(features, [RULE_BY_ID[rule_id]])


def applicable_rules(screen_types: DataFrame) -> DataFrame:
    """Rules that apply to each screen, in matrix order.

    ``screen_types``: ``screen_id, screen_type``, one row per type of a screen.
    """
    dim = F.broadcast(rule_dim(screen_types.sparkSession))
    return screen_types.join(dim, "screen_type").select("screen_id", "rule_order", "rule_id").distinct()


def violation_details(violations: DataFrame) -> DataFrame:
    """Section title and penalty of each violation."""
    dim = F.broadcast(section_dim(violations.sparkSession))
    return violations.join(dim, "act_section", "left").select(
        *violations.columns,
        F.coalesce("section_title", F.lit("")).alias("section_title"),
        F.coalesce("penalty", F.lit(DEFAULT_PENALTY)).alias("penalty_reference"),
    )


def merge_findings(violations: DataFrame, external: DataFrame) -> DataFrame:
    """Deterministic violations plus external ones of sections not already reported."""
    known = violations.select("screen_id", "act_section").distinct()
    new = external.join(known, ["screen_id", "act_section"], "left_anti")
    return violations.withColumn("origin", F.lit("rules")).unionByName(
        new.withColumn("origin", F.lit("external")), allowMissingColumns=True
    )


def features_of(screens: DataFrame, entities: DataFrame) -> DataFrame:
    """Feature rows straight from screens and entities."""
    return rule_features(text_facts(screens), entities)
