"""From raw matches to final entities: evidence, candidates, decisions, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions.numbers import rounded
from veilscan.catalogs import (
    ACCOUNT_KEYWORDS,
    DECISION_TYPE_ALIASES,
    DECISION_TYPES,
    DEFAULT_CATEGORY,
    DEFAULT_RISK,
    IGNORED_DECISIONS,
    MASKED_TYPES,
    entity_dim,
)
from veilscan.functions.regex import let
from veilscan.functions.tables import explode_rows
from veilscan.functions.text import compact_value, keyword_hits, normalised_value, quoted, strip, words
from veilscan.operators.context import (
    CONTEXT_RULES,
    STAGE_BALANCE,
    STAGE_CUSTOMER,
    STAGE_LAYOUT,
    clean_context_rows,
    context_has,
    has_transaction_context,
    scan_columns,
)
from veilscan.operators.detectors import (
    DETECTOR_RULES,
    DETECTORS,
    MATCH_COLUMNS,
    match_rows,
    suppress_overlaps,
    with_guards,
)
from veilscan.operators.inventory import ALL_KEYWORDS, app_name_columns, fact_columns
from veilscan.operators.validators import with_aadhaar_validation, with_candidate_confidence

LAYOUT_COLUMNS = ["spatial_confidence", "validation_confidence"]
RAW_COLUMNS = [*MATCH_COLUMNS, "ctx", "ocr_confidence", "is_layout", *LAYOUT_COLUMNS]


def scan_text(screens: DataFrame, context: bool = False) -> DataFrame:
    """The one pass over the text: a narrow row per screen with matches and facts.

    ``screens`` may carry ``line_conf`` (per line: sum of block confidences, number of
    blocks); otherwise a line's confidence is that of its screen.  With ``context`` the row
    also keeps ``near_lines``: the lines that a match touches and those next to them, each once.
    """
    line_conf = F.col("line_conf") if "line_conf" in screens.columns else None
    keep = [c for c in screens.columns if c not in ("full_text", "line_conf")]
    # The guards' keyword search also finds the catalogue's, unless folding changed the text.
    guarded = with_guards(screens, ALL_KEYWORDS)
    hits = F.when(F.col("_fold") == F.col("_lower"), F.col("_words")).otherwise(
        keyword_hits(F.col("_lower"), ALL_KEYWORDS)
    )
    columns = {
        "hits": F.col("hits"),
        **scan_columns([*DETECTOR_RULES, *CONTEXT_RULES], line_conf=line_conf, hits=F.col("hits")),
        **fact_columns(),
        **app_name_columns(),
    }
    guarded = guarded.withColumn("hits", hits)
    if not context:
        return guarded.select(*keep, *[c.alias(n) for n, c in columns.items()])
    told = guarded.select(*keep, *[c.alias(n) for n, c in columns.items()], "full_text")
    return told.withColumn("near_lines", near_lines(F.col("full_text"), F.col("found"))).drop("full_text")


def near_lines(text: Column, found: Column, window: int = 1) -> Column:
    """``line_index, text`` of the lines that spans touch, ``window`` more on either side, in order."""

    def around(lines):
        last = F.size(lines) - 1
        wanted = F.flatten(
            F.transform(
                found,
                lambda c: F.flatten(
                    F.transform(
                        c["spans"],
                        lambda s: F.sequence(F.greatest(s["line"] - window, F.lit(0)), F.least(s["last_line"] + window, last)),
                    )
                ),
            )
        )
        at = F.array_sort(F.array_distinct(wanted))
        return F.transform(at, lambda i: F.struct(i.alias("line_index"), F.get(lines, i).alias("text")))

    return let(F.split(text, "\n", -1), around)


def scanned_matches(scanned: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """Raw matches of scanned screens: overlap rule, clean-up of contextual ones, layout.

    One shuffle by screen serves all of it and everything after.
    """
    rows = match_rows(scanned, "avg_confidence", surroundings=("ctx", "near"))
    measured = rounded(F.coalesce("near", "avg_confidence"), 4)
    rows = rows.withColumn("ocr_confidence", measured).drop("near", "avg_confidence")
    return combine_layout(clean_context_rows(suppress_overlaps(rows.repartition("screen_id"))), layout)


def raw_matches(screens: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """Every raw match of every screen with its context; one pass over the text."""
    return scanned_matches(scan_text(screens), layout)


def combine_layout(found: DataFrame, layout: DataFrame | None) -> DataFrame:
    """Add layout matches, which replace two of the text rules on their screens."""
    flat = found.select(
        "screen_id", *MATCH_COLUMNS, "ctx", "ocr_confidence", F.lit(False).alias("is_layout"),
        *[F.lit(None).cast("double").alias(c) for c in LAYOUT_COLUMNS],
    )
    if layout is None:
        return flat
    own = layout.select("screen_id", *RAW_COLUMNS, *[c for c in ("place",) if c in layout.columns])
    both = flat.unionByName(own, allowMissingColumns=True)
    # A text match of a type the layout already has on this screen gives way.
    has_layout = F.max(F.col("is_layout").cast("int")).over(
        Window.partitionBy("screen_id", "pii_type")
    )
    text_rule = F.col("ord.stage").isin(STAGE_BALANCE, STAGE_CUSTOMER)
    return (
        both.withColumn("_has_layout", has_layout)
        .filter(~(text_rule & (F.col("_has_layout") == 1)))
        .drop("_has_layout")
    )


def evidence(raw: DataFrame) -> DataFrame:
    """Raw matches with validation, evidence confidence and grouping key."""
    checked = with_candidate_confidence(with_aadhaar_validation(raw))
    keyed = checked.withColumn("value_key", normalised_value(F.col("value")))
    return keyed.filter(F.col("value_key") != "")


def candidates(ev: DataFrame) -> DataFrame:
    """One row per screen and value; ``evidence`` is the best of each type, best first, ``matches`` everything there is.

    Resolution asks for the best of a type only; a plan that leaves ``matches`` aside does not gather them,
    so there a value repeated at will leaves one entry per type.
    """
    item = F.struct(
        (-F.col("evidence_confidence")).alias("negative"),
        "ord", "pii_type", "source_rule", "ocr_confidence", "is_layout",
        F.col("spatial_confidence").alias("spatial"),
        F.col("validation_confidence").alias("validation"),
        "aadhaar_valid", "aadhaar_checksum_valid", "start", "end", "line", "last_line", "value",
        *[c for c in ("place",) if c in ev.columns],
    )
    per_type = ev.groupBy("screen_id", "value_key", "pii_type").agg(
        F.min(item).alias("item"), F.min(F.struct("ord", "value")).alias("first"), F.count("*").alias("n"),
        F.collect_list(item).alias("items"),
    )
    grouped = per_type.groupBy("screen_id", "value_key").agg(
        F.min("first").alias("first"),
        F.array_sort(F.collect_list("item")).alias("evidence"),
        F.sum("n").alias("evidence_count"),
        F.array_sort(F.flatten(F.collect_list("items"))).alias("matches"),
    )
    best = F.element_at("evidence", 1)
    return grouped.select(
        "screen_id", "value_key",
        F.col("first.value").alias("value"), F.col("first.ord").alias("first_ord"),
        "evidence", "evidence_count", "matches",
        F.transform("evidence", lambda e: e["pii_type"]).alias("candidate_types"),
        best["pii_type"].alias("best_type"),
        (-best["negative"]).alias("best_confidence"),
        best["aadhaar_valid"].alias("best_aadhaar_valid"),
    )


def candidate_stats(ev: DataFrame) -> DataFrame:
    """Per screen: detector matches, contextual matches, distinct values."""
    is_detector = F.col("ord.stage") < len(DETECTORS)
    per_value = ev.groupBy("screen_id", "value_key").agg(
        F.count_if(is_detector).alias("regex"), F.count_if(~is_detector).alias("context")
    )
    return per_value.groupBy("screen_id").agg(
        F.sum("regex").alias("regex_matches"),
        F.sum("context").alias("context_matches"),
        F.count("*").alias("candidate_values"),
    )


def decision_type(name: Column) -> Column:
    """Type name of an external decision, aliases resolved."""
    key = F.btrim(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9_]+", "_"), F.lit("_"))
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in DECISION_TYPE_ALIASES.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), key), key)


def usable_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions keyed by value; blank and ignored ones dropped, the last per value wins.

    ``decisions``: ``screen_id, value, final_type, confidence, reasoning`` and optionally
    ``position`` (order within the screen).  Equal positions are told apart by the whole decision.
    """
    if "position" not in decisions.columns:
        decisions = decisions.withColumn("position", F.lit(0))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    named = decisions.select(
        "screen_id",
        strip(F.col("value")).alias("value"),
        decision_type(F.col("final_type")).alias("final_type"),
        rounded(confidence, 4).alias("confidence"),
        "reasoning",
        "position",
    ).filter((F.col("value") != "") & (F.col("final_type") != "") & ~F.col("final_type").isin(IGNORED_DECISIONS))
    return named.groupBy("screen_id", normalised_value(F.col("value")).alias("value_key")).agg(
        F.max_by(
            F.struct("value", "final_type", "confidence", "reasoning"),
            F.struct("position", "confidence", "final_type", "value", "reasoning"),
        ).alias("decision")
    ).select("screen_id", "value_key", "decision.*")


DECISION_JSON = (
    "entity_classifications array<struct<value:string,final_type:string,confidence:string,reasoning:string>>"
)


def normalise_decisions(
    json_df: DataFrame, column: str = "payload", max_items: int | None = None, max_reasoning: int | None = None
) -> DataFrame:
    """Decisions from JSON documents, types checked; ``max_items`` per screen and length of the reasoning on request."""
    parsed = json_df.select("screen_id", F.from_json(column, DECISION_JSON).alias("d"))
    items = F.transform(
        F.slice("d.entity_classifications", 1, max_items) if max_items else F.col("d.entity_classifications"),
        lambda e, i: F.struct(i.alias("position"), e.alias("e")),
    )
    rows = explode_rows(parsed.select("screen_id", items.alias("items")), "items", "x", "screen_id")
    reasoning = F.coalesce(F.col("x.e.reasoning"), F.lit(""))
    kind = F.upper(F.coalesce(F.col("x.e.final_type"), F.lit("IGNORE")))
    score = F.coalesce(F.col("x.e.confidence").try_cast("double"), F.lit(0.0))
    return rows.select(
        "screen_id",
        "x.position",
        strip(F.coalesce(F.col("x.e.value"), F.lit(""))).alias("value"),
        F.when(kind.isin(DECISION_TYPES), kind).otherwise("IGNORE").alias("final_type"),
        rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("confidence"),
        (F.substring(reasoning, 1, max_reasoning) if max_reasoning else reasoning).alias("reasoning"),
    )


FALLBACK_REASON = (
    "AI semantic resolver unavailable; selected highest-confidence deterministic candidate evidence."
)


def fallback_decisions(cands: DataFrame) -> DataFrame:
    """Decisions when no external ones exist: the best type, an invalid Aadhaar ignored."""
    bad = (F.col("best_type") == "AADHAAR_UNMASKED") & ~F.col("best_aadhaar_valid")
    return cands.select(
        "screen_id",
        "value_key",
        "value",
        F.when(bad, "IGNORE").otherwise(F.col("best_type")).alias("final_type"),
        rounded(
            F.when(bad, F.least("best_confidence", F.lit(0.2))).otherwise(F.col("best_confidence")), 4
        ).alias("confidence"),
        F.lit(FALLBACK_REASON).alias("reasoning"),
    )


def fused_confidence(ai: Column, deterministic: Column, ocr: Column, layout: Column) -> Column:
    """Weighted mean of the signals there are, at most .99, four places."""
    zero = F.lit(0.0)
    w_ai = F.when(ai > 0, F.lit(0.45)).otherwise(zero)
    w_layout = F.when(layout > 0, F.lit(0.15)).otherwise(zero)
    total = w_ai + F.lit(0.25) + F.lit(0.15) + w_layout
    score = (ai * w_ai + deterministic * 0.25 + ocr * 0.15 + layout * w_layout) / total
    return rounded(F.greatest(zero, F.least(F.lit(0.99), score)), 4)


def _resolved(joined: DataFrame) -> DataFrame:
    """Entities from candidates with (possibly NULL) ``d_type``, ``d_confidence``, ``d_value``, ``d_reasoning``.

    ``origin`` tells what an entity rests on: the evidence of its type and the reasoning of its decision.
    """
    evidence_fields = joined.schema["evidence"].dataType.elementType.fieldNames()
    decided = F.col("d_type").isNotNull()
    final = F.coalesce("d_type", "best_type")
    typed = F.coalesce(
        F.get(F.filter("evidence", lambda e: e["pii_type"] == F.col("raw_type")), F.lit(0)),
        F.element_at("evidence", 1),
    )
    layout = F.when(
        F.col("typed.is_layout"),
        F.greatest(F.coalesce("typed.spatial", F.lit(0.0)), F.coalesce("typed.validation", F.lit(0.0))),
    ).otherwise(0.0)
    scored = (
        joined.withColumn("raw_type", final)
        .withColumn("typed", typed)
        .withColumn(
            "fused",
            fused_confidence(
                F.coalesce("d_confidence", F.lit(0.0)), -F.col("typed.negative"),
                F.col("typed.ocr_confidence"), layout,
            ),
        )
    )
    floor = F.when(F.col("raw_type") == "TRANSACTION_REFERENCE", 0.45).when(decided, 0.35).otherwise(0.50)
    kept = scored.filter(F.col("fused") >= floor)
    rank = F.row_number().over(
        Window.partitionBy("screen_id").orderBy(F.col("best_confidence").desc(), F.col("first_ord"))
    )
    entities = kept.select(
        "screen_id",
        rank.alias("entity_rank"),
        F.col("raw_type").alias("pii_type"),
        F.coalesce(F.when(F.col("d_value") != "", F.col("d_value")), F.col("value")).alias("value"),
        F.col("fused").alias("confidence"),
        F.col("raw_type").isin(MASKED_TYPES).alias("masked"),
        F.when(decided, "HybridAIResolution").otherwise("CandidateResolutionFallback").alias("source_rule"),
        F.col("typed.aadhaar_checksum_valid").alias("aadhaar_checksum_valid"),
        F.col("typed.start").alias("start"),
        F.col("typed.end").alias("end"),
        F.col("typed.line").alias("line"),
        F.col("typed.last_line").alias("last_line"),
        F.struct(
            F.col("typed.ord.stage").alias("stage"), F.col("typed.pii_type").alias("pii_type"),
            F.col("typed.value").alias("value"), F.col("typed.source_rule").alias("source_rule"),
            F.when(decided, F.coalesce("d_reasoning", F.lit(""))).alias("reasoning"), "candidate_types",
            *([F.col("typed.place").alias("place")] if "place" in evidence_fields else []),
        ).alias("origin"),
    )
    return with_catalogue(entities)


def resolve_entities(cands: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Final entities; ``decisions`` override the deterministic type of their value."""
    if decisions is None:
        joined = cands.select(
            "*", F.lit(None).cast("string").alias("d_type"),
            F.lit(None).cast("double").alias("d_confidence"), F.lit(None).cast("string").alias("d_value"),
            F.lit(None).cast("string").alias("d_reasoning"),
        )
    else:
        usable = usable_decisions(decisions).select(
            "screen_id", "value_key", F.col("final_type").alias("d_type"),
            F.col("confidence").alias("d_confidence"), F.col("value").alias("d_value"),
            F.col("reasoning").alias("d_reasoning"),
        )
        joined = cands.join(usable, ["screen_id", "value_key"], "left")
    return _resolved(joined)


def resolve_with_fallback(cands: DataFrame) -> DataFrame:
    """The same as resolving with ``fallback_decisions``, without the self-join."""
    bad = (F.col("best_type") == "AADHAAR_UNMASKED") & ~F.col("best_aadhaar_valid")
    return _resolved(
        cands.select(
            "*",
            F.when(~F.coalesce(bad, F.lit(False)), F.col("best_type")).alias("d_type"),
            F.when(~F.coalesce(bad, F.lit(False)), rounded(F.col("best_confidence"), 4)).alias("d_confidence"),
            F.col("value").alias("d_value"),
            F.lit(FALLBACK_REASON).alias("d_reasoning"),
        )
    )


def with_catalogue(entities: DataFrame, rules_only: bool = False) -> DataFrame:
    """Category, risk and display name of every entity."""
    dim = F.broadcast(entity_dim(entities.sparkSession, rules_only))
    return entities.join(dim, "pii_type", "left").select(
        *entities.columns,
        F.coalesce("category", F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce("risk", F.lit(DEFAULT_RISK)).alias("risk"),
        F.coalesce("display_type", "pii_type").alias("display_type"),
    )


# -- rules-only route ---------------------------------------------------------
def with_overlap(rows: DataFrame, probe: Column, build: Column, name: str) -> DataFrame:
    """``name``: whether a probe row's span overlaps any build row's span of its screen.

    Build spans enter at their start, probe spans ask at their end; among the build
    spans that entered before, one overlaps if the furthest end lies past the start.
    A sort per screen instead of a join of all pairs.
    """
    at = F.when(build, F.col("start")).otherwise(F.col("end"))
    order = Window.partitionBy("screen_id").orderBy("_at", F.col("_build").cast("int"))
    reach = F.max(F.when(F.col("_build"), F.col("end"))).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_build", F.coalesce(build, F.lit(False)))
        .withColumn("_at", at)
        .withColumn("_reach", reach)
        .withColumn(name, probe & F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)))
        .drop("_build", "_at", "_reach")
    )


def priority_rules(raw: DataFrame) -> DataFrame:
    """Which detector matches survive next to the contextual ones, and with what confidence.

    Returns all surviving matches; ``final_order`` puts layout first, then detectors,
    then the other contextual matches.
    """
    kind = F.col("pii_type")
    detector = F.col("ord.stage") < len(DETECTORS)
    txn = ~detector & (kind == "TRANSACTION_REFERENCE")
    checked = with_overlap(with_aadhaar_validation(raw), detector, txn, "on_reference")
    payment = has_transaction_context(F.col("ctx"))
    aadhaar_named = context_has(F.col("ctx"), ["aadhaar", "aadhar"])
    unmasked_ok = (
        ~F.col("on_reference")
        & (~payment | F.col("aadhaar_context"))
        & F.col("aadhaar_valid")
        & (F.col("aadhaar_confidence") >= 0.75)
    )
    masked_ok = ~F.col("on_reference") & ~(payment & ~aadhaar_named)
    first = checked.filter(
        ~detector
        | F.when(kind == "AADHAAR_UNMASKED", unmasked_ok).when(kind == "AADHAAR_MASKED", masked_ok).otherwise(True)
    )
    aadhaar = detector & kind.isin("AADHAAR_UNMASKED", "AADHAAR_MASKED")
    account = detector & (kind == "BANK_ACCOUNT")
    second = with_overlap(first, account, aadhaar, "on_aadhaar")
    account_words = context_has(F.col("ctx"), ACCOUNT_KEYWORDS)
    account_ok = (
        ~F.col("on_reference") & ~F.col("on_aadhaar") & (account_words | (F.length("value") != 12))
    )
    kept = second.filter(~account | account_ok)
    confidence = (
        F.when(detector & (kind == "AADHAAR_UNMASKED"), F.col("aadhaar_confidence"))
        .when(account & account_words, F.least(F.lit(0.90), F.col("confidence") + 0.12))
        .otherwise(F.col("confidence"))
    )
    source = F.when(
        detector & (kind == "AADHAAR_UNMASKED"), "Regex+AadhaarValidation"
    ).otherwise(F.col("source_rule"))
    order = F.when(F.col("is_layout"), 0).when(detector, 1).otherwise(2)
    return kept.select(
        "screen_id", order.alias("final_order"), "ord", "pii_type", "value", "start", "end",
        confidence.alias("confidence"), "masked", source.alias("source_rule"), "line", "last_line",
        F.col("aadhaar_checksum_valid"), *LAYOUT_COLUMNS,
    )


def deterministic_entities(raw: DataFrame) -> DataFrame:
    """Entities of the rules-only route: one per type and value, first in final order."""
    survivors = priority_rules(raw)
    same = Window.partitionBy("screen_id", "pii_type", compact_value(F.col("value"))).orderBy(
        "final_order", "ord"
    )
    rank = F.row_number().over(Window.partitionBy("screen_id").orderBy("final_order", "ord"))
    entities = (
        survivors.withColumn("_nth", F.row_number().over(same))
        .filter(F.col("_nth") == 1)
        .select(
            "screen_id", rank.alias("entity_rank"), "pii_type", "value",
            rounded(F.col("confidence"), 4).alias("confidence"), "masked", "source_rule",
            "aadhaar_checksum_valid", "start", "end", "line", "last_line", *LAYOUT_COLUMNS,
        )
    )
    return with_catalogue(entities, rules_only=True)
