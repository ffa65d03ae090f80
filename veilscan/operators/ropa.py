"""Records of processing activities: many screens of a session become one record.

Everything a record needs is an aggregate that combines before the shuffle (bit
masks, flags, latest value), so a session may hold any share of the screens.  The
joined text of a session is never built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.catalogs import (
    DEFAULT_SOURCE,
    ROPA_APP_DEFAULT,
    ROPA_APP_FOUND,
    ROPA_COLUMNS,
    ROPA_CONSENT_WORDS,
    ROPA_DATA_CATEGORIES,
    ROPA_GROUND_LAW,
    ROPA_GROUND_SERVICE,
    ROPA_INFERRED_KEYS,
    ROPA_KEYS,
    ROPA_LAW_WORDS,
    ROPA_RIGHTS,
    ROPA_SAFEGUARDS,
    ROPA_SCAN_KEYS,
    SCREEN_DEPARTMENTS,
    SCREEN_SOURCES,
    ropa_field_dim,
)
from veilscan.functions.regex import let
from veilscan.functions.text import quoted, words
from veilscan.operators.inventory import (
    APP_NAME_SPLITS,
    PARAMETER_IDS,
    app_name_columns,
    inventory_rows,
    with_keywords,
)

ID_ORDER = sorted(PARAMETER_IDS)
# Screens of one session with ids in the same range of this size form a bucket.
BUCKET = 65536


# -- application name ---------------------------------------------------------
def app_name_facts(screens: DataFrame) -> DataFrame:
    """Per screen: whether it names the application, and which halves of a name it ends or starts with."""
    return with_keywords(screens).select(
        "screen_id", "session_id", *[c.alias(n) for n, c in app_name_columns().items()]
    )


def split_names(facts: DataFrame) -> DataFrame:
    """Sessions whose application name is split over neighbouring screens.

    Neighbours are found inside buckets of screen ids, then once more among the
    first and last two screens of each bucket, so no task sorts a whole session.
    """
    first_split = [1 << i for i, (a, b) in enumerate(APP_NAME_SPLITS) if len(a) == 1 and len(b) == 2]
    last_split = [1 << i for i, (a, b) in enumerate(APP_NAME_SPLITS) if len(a) == 2 and len(b) == 1]
    first_mask, last_mask = sum(first_split), sum(last_split)

    def meets(one, two, cut):
        direct = one["tail"].bitwiseAND(F.col("head")) != 0
        through = (
            one["is_middle"]
            & (two["tail"].bitwiseAND(F.lit(first_mask)) != 0)
            & (F.col("head").bitwiseAND(F.lit(last_mask)) != 0)
        )
        return (direct & ~cut) | (through & ~cut & ~F.coalesce(one["cut"], F.lit(False)))

    shown = facts.filter(~F.col("is_blank")).withColumn(
        "_bucket", F.floor(F.col("screen_id") / BUCKET)
    )
    inner = Window.partitionBy("session_id", "_bucket").orderBy("screen_id")
    whole = Window.partitionBy("session_id", "_bucket")
    state = F.struct("tail", "is_middle", F.lit(False).alias("cut"))
    inside = shown.withColumn(
        "_met", meets(F.lag(state, 1).over(inner), F.lag(state, 2).over(inner), F.lit(False))
    ).withColumn("_nth", F.row_number().over(inner)).withColumn("_count", F.count("*").over(whole))
    edges = inside.filter((F.col("_nth") <= 2) | (F.col("_nth") > F.col("_count") - 2))
    # Between the second and the second-last screen of a long bucket others are missing.
    gap = (F.col("_count") > 4) & (F.col("_nth") == F.col("_count") - 1)
    outer = Window.partitionBy("session_id").orderBy("screen_id")
    cut_state = F.struct("tail", "is_middle", F.col("_cut").alias("cut"))
    across = edges.withColumn("_cut", gap).withColumn(
        "_met", meets(F.lag(cut_state, 1).over(outer), F.lag(cut_state, 2).over(outer), F.col("_cut"))
    )
    met = inside.select("session_id", "_met").unionByName(across.select("session_id", "_met"))
    return met.filter(F.coalesce("_met", F.lit(False))).select("session_id").distinct()


def app_names(facts: DataFrame) -> DataFrame:
    """Application name per session, from the columns of ``app_name_columns``."""
    named = facts.groupBy("session_id").agg(F.bool_or("names_app").alias("named"))
    split = split_names(facts).withColumn("_split", F.lit(True))
    found = F.col("named") | F.coalesce("_split", F.lit(False))
    return named.join(split, "session_id", "left").select(
        "session_id", F.when(found, ROPA_APP_FOUND).otherwise(ROPA_APP_DEFAULT).alias("application_name")
    )


# -- merge --------------------------------------------------------------------
def _id_mask(ids: Column) -> Column:
    pairs = ", ".join(f"struct('{p}' AS p, {1 << i}L AS b)" for i, p in enumerate(ID_ORDER))
    held = let(ids, lambda own: F.filter(F.expr(f"array({pairs})"), lambda x: F.array_contains(own, x["p"])))
    return F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["b"]))


def _mask_ids(mask: Column) -> Column:
    pairs = ", ".join(f"struct('{p}' AS p, {1 << i}L AS b)" for i, p in enumerate(ID_ORDER))
    held = F.filter(F.expr(f"array({pairs})"), lambda x: mask.bitwiseAND(x["b"]) != 0)
    return F.transform(held, lambda x: x["p"])


def merge_scans(
    facts: DataFrame, verdicts: DataFrame, analysis: DataFrame | None = None
) -> DataFrame:
    """One row per session: present ids, words said, latest screen label and analysis texts.

    ``facts``: rows of ``scan_text``; ``verdicts``: rows of ``verdict_rows`` (with
    ``session_id``); ``analysis``: ``screen_id, ai_summary, purpose_assessment``.
    """

    def says(ws):
        return F.arrays_overlap("hits", words(ws)).cast("int")

    text = facts.select(
        "screen_id", says(ROPA_CONSENT_WORDS).alias("consent_words"), says(ROPA_LAW_WORDS).alias("law_words")
    )
    joined = verdicts.select(
        "screen_id", "session_id", "screen_label", "total_entities",
        _id_mask(F.col("present")).alias("mask"),
        F.size("violations").alias("violation_count"),
        F.exists("violations", lambda v: v["rule_id"] == "RULE-CHD-03").alias("tracks_children"),
    ).join(text, "screen_id")
    if analysis is not None:
        joined = joined.join(analysis.select("screen_id", "ai_summary", "purpose_assessment"), "screen_id", "left")
    else:
        joined = joined.withColumns(
            {"ai_summary": F.lit(None).cast("string"), "purpose_assessment": F.lit(None).cast("string")}
        )

    def latest(name):
        return F.max_by(name, F.when(F.col(name) != "", F.col("screen_id")))

    merged = joined.groupBy("session_id").agg(
        F.count("*").alias("screens"),
        F.sum("total_entities").alias("entities"),
        F.sum("violation_count").alias("violations"),
        F.bit_or("mask").alias("mask"),
        (F.max("consent_words") > 0).alias("says_consent"),
        (F.max("law_words") > 0).alias("says_law"),
        F.bool_or("tracks_children").alias("tracks_children"),
        latest("screen_label").alias("screen_label"),
        latest("ai_summary").alias("ai_summary"),
        latest("purpose_assessment").alias("ai_purpose"),
    )
    return (
        merged.withColumn("present", _mask_ids(F.col("mask")))
        .drop("mask")
        .join(app_names(facts), "session_id")
    )


def _session_present(*ids: str) -> Column:
    return F.arrays_overlap("present", words(list(ids)))


def deterministic_fields() -> dict[str, Column]:
    """Fields that follow from the scan alone."""
    names = ", ".join(f"{quoted(p)}, {quoted(c.split(' (')[0])}" for p, c in ROPA_DATA_CATEGORIES)
    categories = F.array_sort(
        F.array_distinct(
            F.array_compact(F.transform("present", lambda p: F.try_element_at(F.expr(f"map({names})"), p)))
        )
    )
    grounds = (
        F.when(F.col("says_consent"), "Consent").when(F.col("says_law"), ROPA_GROUND_LAW)
        .otherwise(ROPA_GROUND_SERVICE)
    )
    return {
        "application_name": F.col("application_name"),
        "data_principal_cats": F.when(
            _session_present("CHD-01", "CHD-02"), "Customer, Minor/Child"
        ).otherwise("Customer"),
        "includes_children": F.when(
            _session_present("CHD-01", "CHD-02", "CHD-03", "CHD-04"), "Minors"
        ).otherwise("Not Applicable"),
        "child_tracking": F.when(F.col("tracks_children"), "Yes").otherwise("No"),
        "personal_data_cats": F.when(F.size(categories) == 0, "General Personal Data").otherwise(
            F.array_join(categories, ", ")
        ),
        "grounds": grounds,
        "consent_type": F.when(F.col("says_consent"), "Digital").otherwise(""),
        "dpia_applicable": F.when(
            _session_present("BIO-01", "BIO-02", "CHD-01", "CHD-02"), "Yes"
        ).otherwise("No"),
    }


def _by_screen(table: dict[str, str], default: str) -> Column:
    base = F.trim(F.substring_index("screen_label", "(", 1))
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), base), F.lit(default))


def inferred_fields() -> dict[str, Column]:
    """Fields inferred from the latest screen, the analysis and the process context."""

    def given(name):
        return F.when(F.col(name) != "", F.col(name))

    base = F.trim(F.substring_index("screen_label", "(", 1))
    process = F.coalesce(given("ctx_process"), base, F.lit(""))
    told = F.when(process != "", process).otherwise("banking services")
    described = F.concat(
        F.lit("The "), process, F.lit(" process within "), F.col("application_name"),
        F.lit(" handles personal data including "), F.col("personal_data_cats"),
        F.lit(". Data is collected digitally through the mobile banking application."),
    )
    return {
        "department": F.coalesce(given("ctx_department"), _by_screen(SCREEN_DEPARTMENTS, "")),
        "process": process,
        "purpose": F.coalesce(
            given("ai_purpose"), given("ctx_purpose"),
            F.concat(F.lit("Processing personal data for "), told),
        ),
        "description": F.coalesce(
            F.when(F.col("ai_summary") != "", F.col("ai_summary")),
            F.when(process != "", described), F.lit(""),
        ),
        "data_source": _by_screen(SCREEN_SOURCES, DEFAULT_SOURCE),
    }


CONSTANT_FIELDS = {
    "automated_decisions": "No",
    "data_principal_rights": ROPA_RIGHTS,
    "third_party_safeguards": ROPA_SAFEGUARDS,
    "transfer_outside": "No",
    "storage_format": "Digital",
}


def ropa_entry(merged: DataFrame, process_context: DataFrame | None = None, serial: int = 1) -> DataFrame:
    """The 31 fields of each session.

    ``process_context``: ``session_id, department, process_type, purpose``.
    """
    if process_context is not None:
        context = process_context.select(
            "session_id", F.col("department").alias("ctx_department"),
            F.col("process_type").alias("ctx_process"), F.col("purpose").alias("ctx_purpose"),
        )
        merged = merged.join(context, "session_id", "left")
    else:
        merged = merged.withColumns(
            {c: F.lit(None).cast("string") for c in ("ctx_department", "ctx_process", "ctx_purpose")}
        )
    first = merged.withColumns(deterministic_fields())
    second = first.withColumns(inferred_fields())
    filled = {"serial": F.lit(str(serial)), **{k: F.lit(v) for k, v in CONSTANT_FIELDS.items()}}
    have = set(second.columns) | set(filled)
    return second.withColumns(filled).select(
        "session_id", *[F.col(k) if k in have else F.lit("").alias(k) for k in ROPA_KEYS]
    )


def ropa_fields(ropa: DataFrame) -> DataFrame:
    """Records in long form: one row per session and field, with its source."""
    scan, inferred = words(ROPA_SCAN_KEYS), words(ROPA_INFERRED_KEYS)
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in ROPA_KEYS])
    rows = ropa.select("session_id", F.explode(pairs).alias("f")).select("session_id", "f.field", "f.value")
    has = F.col("value") != ""
    source = (
        F.when(F.col("field") == "serial", "system")
        .when(F.array_contains(scan, F.col("field")) & has, "scan")
        .when(F.array_contains(inferred, F.col("field")) & has, "ai")
        .otherwise("manual")
    )
    return rows.withColumn("source", source)


def ropa_source_map(ropa: DataFrame) -> DataFrame:
    return ropa_fields(ropa).select("session_id", "field", "source")


def edit_fields(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits (``session_id, field, value``); an edited field is from then on manual."""
    renamed = edits.select("session_id", "field", F.col("value").alias("_new"))
    edited = F.col("_new").isNotNull()
    return fields.join(renamed, ["session_id", "field"], "left").select(
        "session_id", "field",
        F.when(edited, F.col("_new")).otherwise(F.col("value")).alias("value"),
        F.when(edited, "manual").otherwise(F.col("source")).alias("source"),
    )


def ropa_warnings(ropa: DataFrame) -> DataFrame:
    """Warnings of each record: required fields left empty, fields that do not fit together."""
    by_key = {c[0]: c for c in ROPA_COLUMNS}

    def warning(condition, field, header, section, message):
        return F.when(
            condition,
            F.struct(
                F.lit(field).alias("field"), F.lit(header).alias("header"),
                F.lit(section).alias("section"), F.lit(message).alias("message"),
            ),
        )

    listed = [
        warning(F.col(k) == "", k, header, section, f"{header} is required but empty.")
        for k, _, header, section, required in ROPA_COLUMNS if required
    ]
    listed.append(
        warning((F.col("grounds") == "Consent") & (F.col("consent_type") == ""), "consent_type",
                "Consent type", "Process Details",
                "Consent ground selected but consent type not specified.")
    )
    for k in ("transfer_country", "transfer_purpose", "transfer_safeguards"):
        header = by_key[k][2]
        listed.append(
            warning((F.col("transfer_outside") == "Yes") & (F.col(k) == ""), k, header, "Data Transfer",
                    f"Data transfer is 'Yes' but {header} is empty.")
        )
    listed.append(
        warning((F.col("includes_children") != "Not Applicable") & (F.col("child_tracking") == ""),
                "child_tracking", "Child tracking", "Process Details",
                "Children are involved but child tracking field is empty.")
    )
    found = ropa.select("session_id", F.array_compact(F.array(*listed)).alias("ws"))
    return found.select("session_id", F.explode("ws").alias("w")).select(
        "session_id", "w.*", F.lit("warning").alias("severity")
    )


def ropa_validation(ropa: DataFrame) -> DataFrame:
    """Filled fields, total, completion percentage and number of warnings per record."""
    filled = sum((F.when(F.col(k) != "", 1).otherwise(0) for k in ROPA_KEYS[1:]), F.lit(1))
    counted = ropa.select("session_id", filled.alias("filled_count"), F.lit(len(ROPA_KEYS)).alias("total_count"))
    warned = ropa_warnings(ropa).groupBy("session_id").agg(F.count("*").alias("warning_count"))
    return counted.join(warned, "session_id", "left").select(
        "session_id", "filled_count", "total_count",
        F.round(F.col("filled_count") / F.col("total_count") * 100).cast("int").alias("completion_pct"),
        F.coalesce("warning_count", F.lit(0)).alias("warning_count"),
    )


def ropa_section_fill(ropa: DataFrame) -> DataFrame:
    """Filled and total fields per session and section."""
    dim = F.broadcast(ropa_field_dim(ropa.sparkSession).select("field", "section"))
    return ropa_fields(ropa).join(dim, "field").groupBy("session_id", "section").agg(
        F.count_if(F.col("value") != "").alias("filled"), F.count("*").alias("total")
    )


def ropa_source_counts(ropa: DataFrame) -> DataFrame:
    """Fields per session and source."""
    return ropa_fields(ropa).groupBy("session_id", "source").agg(F.count("*").alias("fields"))


def session_inventory(merged: DataFrame) -> DataFrame:
    """All fifty parameters of each session."""
    return inventory_rows(merged.withColumnRenamed("session_id", "screen_id")).withColumnRenamed(
        "screen_id", "session_id"
    )


def exposure_rollup(entities: DataFrame, screens: DataFrame, rollup: bool = False) -> DataFrame:
    """Entities, distinct values and screens per session, category and risk.

    Distinct values and screens are first reduced on (key, value), which spreads a hot
    session; ``rollup`` adds the subtotals.
    """
    joined = entities.join(screens.select("screen_id", "session_id"), "screen_id")
    keys = ["session_id", "category", "risk"]
    grouped = joined.rollup(*keys) if rollup else joined.groupBy(*keys)
    return grouped.agg(
        F.count("*").alias("entity_count"),
        F.count_distinct("value").alias("distinct_values"),
        F.count_distinct("screen_id").alias("screen_count"),
    )


def violation_rollup(violations: DataFrame) -> DataFrame:
    """Violations and screens per session and rule."""
    return violations.groupBy("session_id", "rule_id", "severity").agg(
        F.count("*").alias("violation_count"), F.count_distinct("screen_id").alias("screen_count")
    )
