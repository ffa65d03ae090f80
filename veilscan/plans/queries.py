"""The registered queries: one per operator, each over whole tables.

Text operators run over all documents and all derived banking screens (``corpus``),
layout operators over one derived block layout per customer (``statement_blocks``).
Results are flat so that they can be compared with SQL.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan import catalogs as c
from veilscan.functions.numbers import rounded
from veilscan.functions.regex import find_spans
from veilscan.functions.tables import explode_rows
from veilscan.operators import (
    classify,
    context,
    detectors,
    inventory,
    layout,
    provenance,
    regression,
    resolve,
    ropa,
    rules,
    scoring,
    structure,
    validators,
    verdict,
)
from veilscan.plans import oracle as o
from veilscan.plans.scan import Stages, audit, audit_blocks
from veilscan.sources import baselines, derived, ropa_sink, screens
from veilscan.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, deps: str = ""):
    """Register a query, and its SQL if it has one."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = o.compose(sql, deps) if deps else sql
        return function

    return register


# -- shared inputs ----------------------------------------------------------------
def corpus(spark, sf):
    return derived.corpus(spark, sf)


def raw_matches(spark, sf):
    return resolve.raw_matches(corpus(spark, sf))


def candidate_rows(spark, sf):
    return resolve.candidates(resolve.evidence(raw_matches(spark, sf)))


def entities(spark, sf):
    return resolve.resolve_with_fallback(candidate_rows(spark, sf))


def audited(spark, sf):
    return audit(corpus(spark, sf), folder=spark.conf.get("spark.checkpoint.dir", None))


def blocks(spark, sf):
    return screens.read_blocks(derived.statement_blocks(spark, sf))


def lines(spark, sf):
    return structure.line_table(blocks(spark, sf))


def sql_span(df: DataFrame, *extra: str) -> DataFrame:
    """Spans as the SQL names them."""
    return df.select("screen_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "value", *extra)


# -- sources and sinks ---------------------------------------------------------------
def _screens_sql(table: str, key: str, text: str) -> str:
    return f"SELECT {key} AS screen_id, md5({text}) AS text_md5, length({text}) AS text_length FROM {table}"


def _digest(df):
    return df.select("screen_id", F.md5(F.col("full_text").cast("binary")).alias("text_md5"), F.length("full_text").cast("long").alias("text_length"))


@query("src_1_read_documents", f"SELECT screen_id, session_id, user_id, md5(full_text) AS text_md5, length(full_text) AS text_length FROM docs", "docs")
def _(spark, sf):
    read = screens.read_screens(spark, f"{sf}/documents.parquet", "documents")
    return read.select("screen_id", "session_id", "user_id", F.md5(F.col("full_text").cast("binary")).alias("text_md5"),
                       F.length("full_text").cast("long").alias("text_length"))


_TAGS = o.canonical(
    "replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, "
    "'(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), "
    "'(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|nav|title|br)\\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'), "
    "'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
)


@query("src_1_read_pages", _screens_sql(f"(SELECT page_id, {_TAGS} AS txt FROM pages)", "page_id", "txt"))
def _(spark, sf):
    return _digest(screens.read_screens(spark, f"{sf}/pages.parquet", "pages"))


@query("src_1_read_conversations", _screens_sql(
    f"(SELECT conv_id, {o.canonical('txt')} AS txt FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS txt FROM conversations GROUP BY conv_id))",
    "conv_id", "txt"))
def _(spark, sf):
    return _digest(screens.read_screens(spark, f"{sf}/conversations.parquet", "conversations"))


def _raw_blocks(spark, sf):
    """Blocks as a recogniser leaves them: Devanagari digits, misread rupee signs, broken records."""
    k = F.col("screen_id")
    raw = derived.statement_blocks(spark, sf)
    text = F.when(k % 17 == 0, F.translate("text", "0123456789", screens.DEVANAGARI_DIGITS)).otherwise(F.col("text"))
    text = F.when(k % 3 == 0, F.regexp_replace(text, "^Rs ", "..== ")).otherwise(text)
    return raw.select(
        "screen_id", "block_index", text.alias("text"),
        F.when((k + F.col("block_index")) % 19 != 0, F.col("confidence") + 0.000049).alias("confidence"), "bbox",
    )


@query("src_2_read_blocks", f"""SELECT screen_id, block_index, {o.r4('confidence + 0.000049')} AS confidence, x1, y1,
    trim(CASE WHEN screen_id % 3 = 0 THEN regexp_replace(regexp_replace(text, '^Rs ', '..== '), '(^|\\s)(\\.+={{1,2}}|={{1,2}})\\s*([0-9])', ' ₹ \\3', 'g') ELSE text END) AS text
    FROM blk0 WHERE text IS NOT NULL AND (screen_id + block_index) % 19 <> 0""", "blk0")
def _(spark, sf):
    read = structure.with_geometry(screens.read_blocks(_raw_blocks(spark, sf)))
    return read.select("screen_id", F.col("block_index").cast("long").alias("block_index"), "confidence", "x1", "y1", "text")


@query("src_3_scoped_listing", "SELECT screen_id, filename, uploaded_at FROM corpus WHERE user_id = 'user7'", "corpus")
def _(spark, sf):
    return screens.scoped_listing(corpus(spark, sf), "user7").select("screen_id", "filename", "uploaded_at")


ASOF = dt.datetime(2024, 1, 1, 10, 0, 0)
_LIMIT = "TIMESTAMP '2024-01-01 09:45:00'"


@query("src_4_retention_filter", f"SELECT screen_id, uploaded_at FROM corpus WHERE NOT uploaded_at < {_LIMIT}", "corpus")
def _(spark, sf):
    kept, _deleted = screens.retention_filter(corpus(spark, sf), ASOF)
    return kept.select("screen_id", "uploaded_at")


@query("src_4_retention_deleted", f"SELECT count(*) AS deleted_count FROM corpus WHERE uploaded_at < {_LIMIT}", "corpus")
def _(spark, sf):
    return screens.retention_filter(corpus(spark, sf), ASOF)[1]


@query("src_5_purge_scanned", "SELECT screen_id, filename FROM corpus WHERE screen_id NOT IN (SELECT doc_id * 2 FROM labels)", "corpus")
def _(spark, sf):
    scanned = spark.read.parquet(f"{sf}/labels.parquet").select((F.col("doc_id") * 2).alias("screen_id"))
    return screens.purge_scanned(corpus(spark, sf), scanned).select("screen_id", "filename")


@query("src_6_avg_confidence", f"SELECT screen_id, coalesce({o.r4('CAST(sum(CAST(confidence AS DECIMAL(10,4))) AS DOUBLE) / count(confidence)')}, 0.0) AS avg_confidence FROM scr LEFT JOIN blk USING (screen_id) GROUP BY screen_id", "scr blk")
def _(spark, sf):
    return screens.avg_confidence(blocks(spark, sf), corpus(spark, sf))


def _stored(spark, sf):
    """A baseline store with a baseline for every third customer."""
    facts = derived.customer_facts(spark, sf)
    rule = F.element_at(
        F.expr(o_rules()), (F.col("k") % len(c.RULE_SCREENS) + 1).cast("int")
    )
    return facts.select(
        F.col("k").alias("id"), F.concat(F.lit("user"), (F.col("k") % 50).cast("string")).alias("user_id"),
        F.concat(F.lit("base "), (F.col("k") % 97).cast("string")).alias("file_name"),
        F.timestamp_seconds(F.lit(screens.EPOCH_2024) + F.col("k") * 60).alias("created_at"),
        F.to_json(F.struct(F.array(rule, F.lit("RULE-XX-99")).alias("corrections_expected"))).alias("payload"),
    )


def o_rules() -> str:
    return "array(" + ", ".join(f"'{r}'" for r, _ in c.RULE_SCREENS) + ")"


_RULES_LIST = o.lst([r for r, _ in c.RULE_SCREENS])
o.part("stored", "facts", f"""SELECT k AS id, concat('user', k % 50) AS user_id, concat('base ', k % 97) AS file_name,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(k) AS created_at, {_RULES_LIST}[k % {len(c.RULE_SCREENS)} + 1] AS rule_id FROM facts""")


@query("snk_1_save_baseline", """SELECT id, status FROM (SELECT n.id, CASE WHEN trim(n.file_name) = '' THEN 'blank name'
    WHEN e.user_id IS NOT NULL OR row_number() OVER (PARTITION BY n.user_id, trim(n.file_name) ORDER BY n.id) > 1 THEN 'name taken' ELSE 'accepted' END AS status
    FROM (SELECT id + 1000000 AS id, user_id, CASE WHEN id % 5 = 0 THEN '  ' ELSE ' ' || file_name || ' ' END AS file_name FROM stored WHERE id % 3 <> 0) n
    LEFT JOIN (SELECT DISTINCT user_id, file_name FROM stored WHERE id % 3 = 0) e ON e.user_id = n.user_id AND e.file_name = trim(n.file_name))""", "stored")
def _(spark, sf):
    stored = _stored(spark, sf)
    new = stored.filter(F.col("id") % 3 != 0).withColumn(
        "file_name", F.when(F.col("id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "file_name", F.lit(" ")))
    ).withColumn("id", F.col("id") + 1000000)
    return baselines.judge_new(stored.filter(F.col("id") % 3 == 0), new).select("id", "status")


@query("snk_2_list_baselines", "SELECT id, file_name, created_at FROM stored WHERE user_id = 'user7'", "stored")
def _(spark, sf):
    return baselines.list_baselines(_stored(spark, sf), "user7")


@query("snk_3_load_baseline", "SELECT id, 200 AS status, file_name, rule_id || ',RULE-XX-99' AS corrections FROM stored WHERE id = 57", "stored")
def _(spark, sf):
    loaded = baselines.load_baseline(_stored(spark, sf), 57, "user7")
    return loaded.select("id", "status", "file_name", F.array_join("payload.corrections_expected", ",").alias("corrections"))


@query("snk_4_delete_baseline", "SELECT id, file_name FROM stored WHERE NOT (user_id = 'user7' AND id % 2 = 1)", "stored")
def _(spark, sf):
    stored = _stored(spark, sf)
    removed = stored.filter((F.col("user_id") == "user7") & (F.col("id") % 2 == 1)).select("id")
    return baselines.without_deleted(stored, removed).select("id", "file_name")


# -- detectors --------------------------------------------------------------------------
def _register_detectors():
    for i, kind in enumerate(c.DETECTOR_TYPES):
        name = f"pat_{i + 1:02d}_{kind.strip('_').lower()}"

        @query(name, f"SELECT screen_id, s, e, value FROM det_{i}", f"det_{i}")
        def _(spark, sf, kind=kind):
            return sql_span(detectors.detect(corpus(spark, sf), kind))


_register_detectors()


@query("pat_span_find_spans", f"SELECT screen_id, s, e, value FROM ({o.spans_sql('[0-9]+[a-z]*', False)})", "scr")
def _(spark, sf):
    found = corpus(spark, sf).select("screen_id", find_spans(F.col("full_text"), r"[0-9]+[a-z]*").alias("spans"))
    return sql_span(explode_rows(found, "spans", "m", "screen_id").select("screen_id", "m.*"))


@query("pat_all_detect_all", f"SELECT screen_id, s, e, value, pii_type, confidence, masked FROM {o.ALL_DETECTED}", o.ALL_DETECTED)
def _(spark, sf):
    return sql_span(detectors.detect_all(corpus(spark, sf)), "pii_type", "confidence", "masked")


# -- context ------------------------------------------------------------------------------
def _register_context():
    kinds = [
        ("ctx_01_account_balance", context.STAGE_BALANCE, "ctx_balance"),
        ("ctx_02_customer_id", context.STAGE_CUSTOMER, "ctx_customer"),
        ("ctx_03_reference_upi_path", context.STAGE_UPI_PATH, "ctx_path"),
        ("ctx_04_reference_labelled", context.STAGE_LABELLED, "ctx_label"),
        ("ctx_08_transaction_history", context.STAGE_HISTORY, "ctx_history"),
        ("ctx_09_holder_name", context.STAGE_NAME, "ctx_name"),
        ("ctx_10_transaction_amount", context.STAGE_AMOUNT, "ctx_amount"),
    ]
    for name, stage, source in kinds:

        @query(name, f"SELECT screen_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, value FROM {source}", source)
        def _(spark, sf, stage=stage):
            return sql_span(context.text_context(corpus(spark, sf), [stage]))

    for name, rule in [("ctx_05_reference_upi_chain", 0), ("ctx_06_reference_line_label", 1), ("ctx_07_reference_row_number", 2)]:

        @query(name, f"SELECT screen_id, s, e, value FROM ctx_lines WHERE rule = {rule}", "ctx_lines")
        def _(spark, sf, rule=rule):
            found = context.text_context(corpus(spark, sf), [context.STAGE_LINE_REF])
            return sql_span(found.filter(F.col("ord.rule") == rule))


_register_context()


@query("ctx_11_transaction_keywords", "SELECT screen_id, array_to_string(list_filter(" + o.lst(sorted(c.TRANSACTION_KEYWORDS)) + ", lambda w: contains(low, w)), ',') AS keywords FROM scr", "scr")
def _(spark, sf):
    return corpus(spark, sf).select(
        "screen_id", F.array_join(context.transaction_keyword_hits(F.col("full_text")), ",").alias("keywords")
    )


@query("ctx_12_contextual_union", "SELECT screen_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, value, pii_type, confidence FROM ctx_all", "ctx_all")
def _(spark, sf):
    return sql_span(context.contextual_entities(corpus(spark, sf)), "pii_type", "confidence")


# -- validators -----------------------------------------------------------------------------
@query("val_1_aadhaar_validation", "SELECT screen_id, s, e, value, fmt, starts, chk, a_ctx, b_ctx, a_conf, a_valid FROM val2 WHERE pii_type = 'AADHAAR_UNMASKED'", "val2")
def _(spark, sf):
    checked = validators.with_aadhaar_validation(raw_matches(spark, sf)).filter(F.col("pii_type") == "AADHAAR_UNMASKED")
    return sql_span(
        checked.withColumnsRenamed({
            "aadhaar_format_valid": "fmt", "aadhaar_starts_valid": "starts", "aadhaar_checksum_valid": "chk",
            "aadhaar_context": "a_ctx", "aadhaar_banking_context": "b_ctx", "aadhaar_confidence": "a_conf", "aadhaar_valid": "a_valid",
        }), "fmt", "starts", "chk", "a_ctx", "b_ctx", "a_conf", "a_valid",
    )


@query("val_2_candidate_confidence", "SELECT screen_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, value, pii_type, econf FROM ev WHERE vkey <> ''", "ev")
def _(spark, sf):
    return sql_span(resolve.evidence(raw_matches(spark, sf)).withColumnRenamed("evidence_confidence", "econf"), "pii_type", "econf")


_PLAIN = "regexp_replace(value, '[\\s\\-]', '', 'g')"


@query("val_3_masking_status", f"""SELECT screen_id, pii_type, value, CASE
    WHEN pii_type IN ('AADHAAR_UNMASKED', 'AADHAAR_MASKED') THEN regexp_matches({_PLAIN}, '^[Xx*]{{8}}')
    WHEN pii_type IN ('CREDIT_DEBIT_CARD', 'MASKED_CARD') THEN length({_PLAIN}) >= 12 AND regexp_matches({_PLAIN}, '^[Xx*]')
    WHEN pii_type = 'BANK_ACCOUNT' THEN length(value) >= 6 AND regexp_matches(value, '^[Xx*]') END AS masking_ok FROM ent""", "ent")
def _(spark, sf):
    return validators.with_masking_status(entities(spark, sf)).select("screen_id", "pii_type", "value", "masking_ok")


@query("val_4_account_hits", "SELECT screen_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, value, array_to_string(list_filter(" + o.lst(c.ACCOUNT_KEYWORDS) + ", lambda w: contains(lctx, w)), ',') AS account_hits FROM raw WHERE pii_type = 'BANK_ACCOUNT'", "raw")
def _(spark, sf):
    hit = validators.with_account_hits(raw_matches(spark, sf).filter(F.col("pii_type") == "BANK_ACCOUNT"))
    return sql_span(hit.withColumn("account_hits", F.array_join("account_hits", ",")), "account_hits")


@query("val_5_redacted_value", "SELECT screen_id, pii_type, CASE WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE left(value, 2) || '***' || right(value, 2) END AS redacted_value FROM ent", "ent")
def _(spark, sf):
    return validators.with_redacted_value(entities(spark, sf)).select("screen_id", "pii_type", "redacted_value")


# -- structure --------------------------------------------------------------------------------
@query("lay_1_block_geometry", "SELECT screen_id, CAST(block_index AS BIGINT) AS block_index, x1, y1, x2, y2, cx, cy, width, height FROM blk", "blk")
def _(spark, sf):
    return structure.with_geometry(blocks(spark, sf)).select(
        "screen_id", F.col("block_index").cast("long").alias("block_index"), "x1", "y1", "x2", "y2", "cx", "cy", "width", "height"
    )


@query("lay_2_group_lines", "SELECT screen_id, CAST(ln AS BIGINT) AS line_index, string_agg(block_index::VARCHAR, ',' ORDER BY pos) AS block_indices FROM mem GROUP BY screen_id, ln", "mem")
def _(spark, sf):
    return structure.group_lines(blocks(spark, sf)).select(
        "screen_id", F.col("line_index").cast("long").alias("line_index"), F.array_join("block_indices", ",").alias("block_indices")
    )


@query("lay_3_line_text", "SELECT screen_id, text FROM bline", "bline")
def _(spark, sf):
    return lines(spark, sf).select("screen_id", "text")


@query("lay_4_line_table", "SELECT screen_id, CAST(line_index AS BIGINT) AS line_index, text, s, s + length(text) AS e, x1, y1, x2, y2, avg_confidence FROM bline", "bline")
def _(spark, sf):
    return lines(spark, sf).select(
        "screen_id", F.col("line_index").cast("long").alias("line_index"), "text", F.col("start").cast("long").alias("s"),
        F.col("end").cast("long").alias("e"), "x1", "y1", "x2", "y2", "avg_confidence",
    )


@query("lay_5_line_context", "SELECT screen_id, CAST(line_index AS BIGINT) AS line_index, md5(ctx) AS context_md5 FROM ctxlines", "ctxlines")
def _(spark, sf):
    told = structure.with_line_context(structure.text_line_table(corpus(spark, sf)))
    return told.select("screen_id", F.col("line_index").cast("long").alias("line_index"), F.md5(F.col("context_text").cast("binary")).alias("context_md5"))


@query("lay_6_cluster_columns")
def _(spark, sf):
    return structure.cluster_columns(blocks(spark, sf)).withColumn("block_indices", F.array_join("block_indices", ","))


@query("lay_7_row_cells")
def _(spark, sf):
    return structure.row_cells(lines(spark, sf), structure.cluster_columns(blocks(spark, sf)))


@query("lay_8_span_to_lines", "SELECT screen_id, pii_type, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, md5(ctx) AS context_md5, CAST(l1 AS BIGINT) AS first_line, CAST(l2 AS BIGINT) AS final_line FROM (" + o.with_ctx(f"SELECT * FROM {o.ALL_DETECTED}") + ")", f"{o.ALL_DETECTED} lines")
def _(spark, sf):
    found = detectors.detect_all(corpus(spark, sf))
    near = structure.span_to_lines(found, structure.text_line_table(corpus(spark, sf)))
    return near.select(
        "screen_id", "pii_type", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"),
        F.md5(F.col("context_text").cast("binary")).alias("context_md5"),
        F.col("first_line").cast("long").alias("first_line"), F.col("final_line").cast("long").alias("final_line"),
    )


_KEY = "lower(regexp_replace({0}, '[\\s,\\-]+', '', 'g'))"


@query("lay_9_match_to_blocks", f"""SELECT screen_id, pii_type, value, string_agg(block_index::VARCHAR, ',' ORDER BY block_index) AS block_indices FROM layent l JOIN blk b USING (screen_id)
    WHERE contains({_KEY.format('b.text')}, {_KEY.format('l.value')}) OR contains({_KEY.format('l.value')}, {_KEY.format('b.text')}) GROUP BY ALL""", "layent blk")
def _(spark, sf):
    found = layout_matches(spark, sf).select("screen_id", "pii_type", "value")
    return structure.match_to_blocks(found, blocks(spark, sf)).select(
        "screen_id", "pii_type", "value", F.array_join("block_indices", ",").alias("block_indices")
    )


# -- layout -------------------------------------------------------------------------------------
def layout_matches(spark, sf):
    table = lines(spark, sf)
    return layout.layout_entities(table, structure.structured_screens(table))


@query("assoc_01_summary_boundary", "SELECT screen_id, boundary_y FROM bound", "bound")
def _(spark, sf):
    return layout.summary_boundary(lines(spark, sf))


_SEG = "screen_id, CAST(line_index AS BIGINT) AS line_index, CAST(first AS BIGINT) AS first, CAST(size AS BIGINT) AS size, text, x1, y1, x2, y2, confidence"


def _seg(df, *extra):
    cols = [F.col(n).cast("long").alias(n) for n in ("line_index", "first", "size")]
    return df.select("screen_id", *cols, "text", "x1", "y1", "x2", "y2", "confidence", *extra)


@query("assoc_02_label_candidates", f"SELECT {_SEG}, entity_type FROM lab", "lab")
def _(spark, sf):
    return _seg(layout.label_candidates(lines(spark, sf)), "entity_type")


@query("assoc_03_value_segments", f"SELECT {_SEG} FROM vseg", "vseg")
def _(spark, sf):
    return _seg(layout.value_segments(lines(spark, sf)))


def _pairs(spark, sf):
    return layout.score_pairs(layout.block_runs(lines(spark, sf)))


_PAIR = "screen_id, label, CAST(l_line AS BIGINT) AS l_line, seg_text, CAST(s_line AS BIGINT) AS s_line, CAST(s_first AS BIGINT) AS s_first, CAST(s_size AS BIGINT) AS s_size"


def _pair(df, *extra):
    return df.select(
        "screen_id", F.col("l.text").alias("label"), F.col("l.line_index").cast("long").alias("l_line"), F.col("s.text").alias("seg_text"),
        F.col("s.line_index").cast("long").alias("s_line"), F.col("s.first").cast("long").alias("s_first"), F.col("s.size").cast("long").alias("s_size"), *extra,
    )


@query("assoc_04_entity_value", f"SELECT {_PAIR}, value FROM pair WHERE raw_spatial > 0", "pair")
def _(spark, sf):
    return _pair(_pairs(spark, sf).filter(F.col("spatial") > 0), "value")


@query("assoc_05_validate_value", f"SELECT {_PAIR}, validation FROM pair WHERE raw_spatial > 0 AND entity_type <> 'ACCOUNT_HOLDER_NAME'", "pair")
def _(spark, sf):
    return _pair(_pairs(spark, sf).filter((F.col("spatial") > 0) & (F.col("l.entity_type") != "ACCOUNT_HOLDER_NAME")), "validation")


@query("assoc_06_spatial_score", f"SELECT {_PAIR}, spatial FROM pair WHERE raw_spatial > 0", "pair")
def _(spark, sf):
    return _pair(_pairs(spark, sf).filter(F.col("spatial") > 0), "spatial")


@query("assoc_07_score_pairs", f"SELECT {_PAIR}, value, combined FROM pair WHERE accepted", "pair")
def _(spark, sf):
    return _pair(_pairs(spark, sf).filter("accepted"), "value", "combined")


@query("assoc_08_best_value_per_label", f"SELECT {_PAIR}, value, combined FROM bestpair", "bestpair")
def _(spark, sf):
    return _pair(layout.best_value_per_label(_pairs(spark, sf)), "value", "combined")


@query("assoc_09_span_of_value", """SELECT screen_id, value, CAST(CASE WHEN instr(line_text, value) > 0 THEN line_start + instr(line_text, value) - 1 WHEN instr(line_text, seg_text) > 0 THEN line_start + instr(line_text, seg_text) - 1
      + CASE WHEN instr(seg_text, value) > 0 THEN instr(seg_text, value) - 1 ELSE 0 END ELSE -1 END AS BIGINT) AS s FROM bestpair""", "bestpair")
def _(spark, sf):
    table = lines(spark, sf)
    best = layout.best_value_per_label(layout.score_pairs(layout.block_runs(table)))
    return layout.span_of_value(best, structure.structured_screens(table)).select("screen_id", "value", F.col("start").cast("long").alias("s"))


@query("assoc_10_infer_holder_name", f"SELECT {_PAIR}, upper(seg_text) AS value, combined FROM holder", "holder")
def _(spark, sf):
    return _pair(layout.infer_holder_name(_pairs(spark, sf)), "value", "combined")


@query("assoc_11_layout_entities", "SELECT screen_id, pii_type, value, combined AS confidence FROM layent", "layent")
def _(spark, sf):
    return layout_matches(spark, sf).select("screen_id", "pii_type", "value", "confidence")


@query("assoc_12_layout_decisions", """SELECT l.screen_id, l.entity_type, l.text AS label, CAST(sn AS BIGINT) AS candidate_count, b.value AS selected_value, b.combined AS selected_confidence
    FROM lab l JOIN (SELECT screen_id, count(*) AS sn FROM vseg GROUP BY screen_id) USING (screen_id)
    LEFT JOIN bestpair b ON b.screen_id = l.screen_id AND b.l_line = l.line_index AND b.l_first = l.first AND b.l_size = l.size""", "lab vseg bestpair")
def _(spark, sf):
    return layout.layout_decisions(lines(spark, sf)).select(
        "screen_id", "entity_type", "label", F.col("candidate_count").cast("long").alias("candidate_count"), "selected_value", "selected_confidence"
    )


# -- classification --------------------------------------------------------------------------------
@query("cls_1_document_type", "SELECT screen_id, document_type FROM doctype", "doctype")
def _(spark, sf):
    return classify.document_type(corpus(spark, sf))


@query("cls_2_screen_type_hits", "SELECT screen_id, screen_type, hits FROM sthits", "sthits")
def _(spark, sf):
    return classify.screen_type_hits(corpus(spark, sf)).select("screen_id", "screen_type", "hits")


@query("cls_3_screen_class", f"SELECT screen_id, screen_types, primary_screen_type, screen_confidence, screen_label, legacy_document_type FROM sclass JOIN {o.LABELS} USING (primary_screen_type)", "sclass")
def _(spark, sf):
    table = corpus(spark, sf)
    classed = classify.screen_class(classify.screen_type_hits(table), table)
    return classed.select(
        "screen_id", F.array_join("screen_types", ",").alias("screen_types"), "primary_screen_type", "screen_confidence", "screen_label", "legacy_document_type"
    )


# -- resolution ------------------------------------------------------------------------------------
def _placed(df: DataFrame) -> list:
    """What the SQL of located rows compares."""
    return [
        F.md5(F.col("context_text").cast("binary")).alias("context_md5"), F.array_min("line_indices").cast("long").alias("first_line"),
        F.array_max("line_indices").cast("long").alias("final_line"), "reason", "document_type",
    ]


@query("res_1_evidence", f"""SELECT screen_id, pii_type, vkey, econf, ocr AS ocr_confidence, {o.PLACED}, {o.REASON} AS reason, document_type
    FROM ev x JOIN doctype USING (screen_id) WHERE vkey <> ''""", "ev lines doctype")
def _(spark, sf):
    stages = Stages(spark.conf.get("spark.checkpoint.dir", None))
    scanned = stages.keep(resolve.scan_text(corpus(spark, sf), context=True), "scanned")
    found = resolve.evidence(resolve.scanned_matches(scanned))
    located = provenance.with_provenance(found, provenance.scanned_lines(scanned), provenance.scanned_types(scanned))
    return located.select(
        "screen_id", "pii_type", F.col("value_key").alias("vkey"), F.col("evidence_confidence").alias("econf"), "ocr_confidence", *_placed(located)
    )


@query("res_2_candidates", """
SELECT screen_id, vkey, cand.value, b.pii_type AS best_type, best_conf AS best_confidence, n AS evidence_count, types AS candidate_types, evidence
FROM cand JOIN best b USING (screen_id, vkey) JOIN (
  SELECT screen_id, vkey, string_agg(concat(pii_type, ' ', s, '-', e, ' ', value), chr(10) ORDER BY econf DESC, ord) AS evidence
  FROM ev WHERE vkey <> '' GROUP BY screen_id, vkey) USING (screen_id, vkey) JOIN (
  SELECT screen_id, vkey, string_agg(pii_type, ',' ORDER BY top DESC, first_ord) AS types FROM (
    SELECT screen_id, vkey, pii_type, max(econf) AS top, arg_min(ord, (-econf, ord)) AS first_ord
    FROM ev WHERE vkey <> '' GROUP BY screen_id, vkey, pii_type)
  GROUP BY screen_id, vkey) USING (screen_id, vkey)
""", "cand best ev")
def _(spark, sf):
    told = F.transform("matches", lambda m: F.concat(m["pii_type"], F.lit(" "), m["start"], F.lit("-"), m["end"], F.lit(" "), m["value"]))
    return candidate_rows(spark, sf).select(
        "screen_id", F.col("value_key").alias("vkey"), "value", "best_type", "best_confidence",
        F.size("matches").cast("long").alias("evidence_count"), F.array_join("candidate_types", ",").alias("candidate_types"),
        F.array_join(told, "\n").alias("evidence"),
    )


@query("res_3_candidate_stats", "SELECT screen_id, CAST(sum(regex_n) AS BIGINT) AS regex_matches, CAST(sum(context_n) AS BIGINT) AS context_matches, count(*) AS candidate_values FROM cand GROUP BY screen_id", "cand")
def _(spark, sf):
    return resolve.candidate_stats(resolve.evidence(raw_matches(spark, sf)))


def _decision_json(spark, sf):
    """Decision documents, one per banking screen with an account number: an alias, an ignored and a bad entry."""
    facts = derived.customer_facts(spark, sf)
    items = F.array(
        F.struct(F.concat(F.lit("041"), "nine").alias("value"), F.lit("account_number").alias("final_type"), F.lit("0.93").alias("confidence"), F.lit("label").alias("reasoning")),
        F.struct(F.concat(F.lit(" 041"), "nine").alias("value"), F.lit("BANK_ACCOUNT").alias("final_type"), ((F.col("k") % 13) / 10).cast("string").alias("confidence"), F.lit("second").alias("reasoning")),
        F.struct(F.lit("RAVI KUMAR").alias("value"), F.lit("ACCOUNT_HOLDER_NAME").alias("final_type"), F.lit("high").alias("confidence"), F.lit("name").alias("reasoning")),
        F.struct(F.lit("cust@okaxis").alias("value"), F.lit("IGNORE").alias("final_type"), F.lit("0.5").alias("confidence"), F.lit("").alias("reasoning")),
    )
    return facts.select((F.col("k") * 2 + 1).alias("screen_id"), F.to_json(F.struct(items.alias("entity_classifications"))).alias("payload"))


o.part("dec", "facts", """SELECT k * 2 + 1 AS screen_id, '041' || nine AS value, 'BANK_ACCOUNT' AS final_type, least(1.0::DOUBLE, (k % 13)::DOUBLE / 10) AS confidence FROM facts
    UNION ALL SELECT k * 2 + 1, 'RAVI KUMAR', 'ACCOUNT_HOLDER_NAME', 0.0 FROM facts""")


@query("res_4_normalise_decisions", "SELECT screen_id, value, final_type, confidence FROM dec", "dec")
def _(spark, sf):
    used = resolve.usable_decisions(resolve.normalise_decisions(_decision_json(spark, sf)))
    return used.select("screen_id", "value", "final_type", "confidence")


@query("res_5_fallback_decisions", f"""SELECT screen_id, vkey, CASE WHEN {o.BAD_AADHAAR} THEN 'IGNORE' ELSE b.pii_type END AS final_type,
    CASE WHEN {o.BAD_AADHAAR} THEN least(econf, 0.2::DOUBLE) ELSE econf END AS confidence FROM best b WHERE true""", "best")
def _(spark, sf):
    return resolve.fallback_decisions(candidate_rows(spark, sf)).select("screen_id", F.col("value_key").alias("vkey"), "final_type", "confidence")


@query("res_6_fused_confidence", f"SELECT screen_id, vkey, {o.fused('0.0::DOUBLE', 'econf', 'ocr')} AS without_decision, {o.fused('0.8::DOUBLE', 'econf', 'ocr')} AS with_decision FROM best", "best")
def _(spark, sf):
    first = F.element_at("evidence", 1)
    fused = lambda ai: resolve.fused_confidence(F.lit(ai), F.col("best_confidence"), first["ocr_confidence"], F.lit(0.0))
    return candidate_rows(spark, sf).select(
        "screen_id", F.col("value_key").alias("vkey"), fused(0.0).alias("without_decision"), fused(0.8).alias("with_decision")
    )


@query("res_7_resolve_entities", """SELECT screen_id, entity_rank, pii_type, value, confidence, masked, category, risk, display_type,
    CASE WHEN decided THEN 'HybridAIResolution' ELSE 'CandidateResolutionFallback' END AS source_rule FROM ent""", "ent")
def _(spark, sf):
    return entities(spark, sf).select(
        "screen_id", F.col("entity_rank").cast("long").alias("entity_rank"), "pii_type", "value", "confidence", "masked", "category", "risk", "display_type", "source_rule"
    )


@query("res_7_entity_provenance", f"""SELECT screen_id, entity_rank, pii_type, value, {o.PLACED}, document_type,
    CASE WHEN decided THEN {o.q(resolve.FALLBACK_REASON)} ELSE reason END AS reason FROM ent
    JOIN (SELECT screen_id, vkey, ctx, l1, l2, {o.REASON} AS reason FROM bestev x) USING (screen_id, vkey) JOIN doctype USING (screen_id)""", "ent bestev lines doctype")
def _(spark, sf):
    located = audit(corpus(spark, sf), folder=spark.conf.get("spark.checkpoint.dir", None), context=True).located()
    return located.select("screen_id", F.col("entity_rank").cast("long").alias("entity_rank"), "pii_type", "value", *_placed(located))


@query("res_7_resolve_without_decisions", "SELECT screen_id, pii_type, value, confidence FROM ent_plain", "ent_plain")
def _(spark, sf):
    return resolve.resolve_entities(candidate_rows(spark, sf)).select("screen_id", "pii_type", "value", "confidence")


@query("res_7_resolve_with_decisions", f"""SELECT * FROM (SELECT screen_id, coalesce(d.final_type, b.pii_type) AS pii_type, coalesce(d.value, cand.value) AS value,
      {o.fused('coalesce(d.confidence, 0.0::DOUBLE)', 'coalesce(t.econf, b.econf)', 'coalesce(t.ocr, b.ocr)')} AS confidence, d.value IS NOT NULL AS decided
    FROM cand JOIN best b USING (screen_id, vkey) LEFT JOIN (SELECT *, lower(regexp_replace(value, '[\\s,\\-]+', '', 'g')) AS vkey FROM dec) d USING (screen_id, vkey)
    LEFT JOIN (SELECT screen_id, vkey, pii_type AS tt, max(econf) AS econf, any_value(ocr) AS ocr FROM ev GROUP BY ALL) t ON t.screen_id = cand.screen_id AND t.vkey = cand.vkey AND t.tt = coalesce(d.final_type, b.pii_type))
    WHERE confidence >= CASE WHEN pii_type = 'TRANSACTION_REFERENCE' THEN 0.45 WHEN decided THEN 0.35 ELSE 0.50 END""", "cand best dec ev")
def _(spark, sf):
    decisions = resolve.normalise_decisions(_decision_json(spark, sf))
    resolved = resolve.resolve_entities(candidate_rows(spark, sf), decisions)
    return resolved.select("screen_id", "pii_type", "value", "confidence", (F.col("source_rule") == "HybridAIResolution").alias("decided"))


@query("res_8_priority_rules", "SELECT screen_id, pii_type, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, value, conf AS confidence FROM (SELECT * REPLACE (" + o.r4("conf") + " AS conf) FROM det3)", "det3")
def _(spark, sf):
    kept = resolve.priority_rules(raw_matches(spark, sf))
    return sql_span(kept.withColumn("confidence", rounded(F.col("confidence"))), "pii_type", "confidence")


@query("res_9_deterministic_entities", "SELECT screen_id, pii_type, value, confidence, masked, category, risk FROM dent", "dent")
def _(spark, sf):
    return resolve.deterministic_entities(raw_matches(spark, sf)).select("screen_id", "pii_type", "value", "confidence", "masked", "category", "risk")


@query("res_10_entity_catalogue", f"SELECT screen_id, pii_type, value, category, risk, display_type FROM {o.ALL_DETECTED} JOIN {o.CATALOGUE} USING (pii_type)", o.ALL_DETECTED)
def _(spark, sf):
    found = detectors.detect_all(corpus(spark, sf)).select("screen_id", "pii_type", "value")
    return resolve.with_catalogue(found)


@query("res_exposure_by_type", f"SELECT pii_type, risk, count(*) AS matches, count(DISTINCT screen_id) AS screens FROM {o.ALL_DETECTED} JOIN {o.CATALOGUE} USING (pii_type) GROUP BY pii_type, risk", o.ALL_DETECTED)
def exposure_by_type(spark, sf):
    found = resolve.with_catalogue(detectors.detect_all(corpus(spark, sf)).select("screen_id", "pii_type"))
    return found.groupBy("pii_type", "risk").agg(F.count("*").alias("matches"), F.count_distinct("screen_id").alias("screens"))


# -- inventory ----------------------------------------------------------------------------------------
@query("inv_1_entity_pii_ids", "SELECT screen_id, pii_id FROM entids", "entids")
def _(spark, sf):
    return inventory.entity_pii_ids(entities(spark, sf))


@query("inv_2_text_signals", "SELECT screen_id, pii_id FROM sigids", "sigids")
def _(spark, sf):
    return inventory.text_signals(corpus(spark, sf))


@query("inv_3_pii_inventory", "SELECT screen_id, pii_id, status FROM inv", "inv")
def _(spark, sf):
    return inventory.pii_inventory(entities(spark, sf), corpus(spark, sf))


@query("inv_4_present_ids", f"SELECT screen_id, pii_id, pii_name, pii_group FROM present JOIN {o.PARAMS} USING (pii_id)", "present")
def _(spark, sf):
    return inventory.present_ids(inventory.pii_inventory(entities(spark, sf), corpus(spark, sf)))


_SHEET = "(VALUES " + ", ".join(f"({o.q(a)}, {o.q(b)}, {o.q(p)})" for a, b, p in c.PERSONAL_DATA_SHEET) + ") AS sh(pii_id, category, parameter)"


@query("inv_5_personal_data_inventory", f"SELECT screen_id, pii_id, category, parameter, 'Yes' AS response, 'Digital' AS mode_collection, 'Digital' AS mode_processing FROM present JOIN {_SHEET} USING (pii_id)", "present")
def _(spark, sf):
    return inventory.personal_data_inventory(inventory.pii_inventory(entities(spark, sf), corpus(spark, sf)))


# -- rules ------------------------------------------------------------------------------------------
def features(spark, sf):
    return audited(spark, sf).features


def _viol(df):
    return df.select("screen_id", "session_id", F.col("rule_order").cast("int").alias("rule_order"), "rule_id",
                     F.array_join("pii_involved", ",").alias("pii_involved"), "act_section", "severity")


def _register_rules():
    for i, rule in enumerate(rules.RULES):
        part = f"r_{rule.rule_id.lower().replace('-', '_')}"
        short = rule.rule_id.removeprefix("RULE-").lower().replace("-", "_")

        @query(f"rul_{i + 1:02d}_{short}", f"SELECT * FROM {part}", part)
        def _(spark, sf, rule_id=rule.rule_id):
            return _viol(rules.evaluate_rule(features(spark, sf), rule_id))


_register_rules()


@query("rul_evaluate_all", "SELECT * FROM viol", "viol")
def _(spark, sf):
    return _viol(rules.evaluate_rules(features(spark, sf)))


# -- verdicts ---------------------------------------------------------------------------------------
@query("ver_1_applicable_rules", "SELECT screen_id, rule_order, rule_id FROM apprules", "apprules")
def _(spark, sf):
    types = features(spark, sf).select("screen_id", F.explode("screen_types").alias("screen_type"))
    return rules.applicable_rules(types)


@query("ver_2_inconclusive_reasons", "SELECT screen_id, CAST(reasons AS BIGINT) AS reasons FROM verd", "verd")
def _(spark, sf):
    return verdict.inconclusive_reasons(features(spark, sf)).select("screen_id", F.size("notes").cast("long").alias("reasons"))


@query("ver_3_verdict", "SELECT verdict, count(*) AS screens FROM verd GROUP BY verdict", "verd")
def _(spark, sf):
    return audited(spark, sf).verdicts.groupBy("verdict").agg(F.count("*").alias("screens"))


@query("ver_4_overall_severity", "SELECT screen_id, overall_severity FROM vagg", "vagg")
def _(spark, sf):
    return verdict.overall_severity(audited(spark, sf).violations)


@query("ver_5_risk_counts", "SELECT screen_id, rc AS risk_critical, rh AS risk_high, rm AS risk_medium, rl AS risk_low FROM efacts", "efacts")
def _(spark, sf):
    return verdict.risk_counts(entities(spark, sf))


@query("ver_6_evaluate_screens", """SELECT screen_id, screen_label, verdict, overall_severity, violations, rules_n AS rules_evaluated, total_entities,
    rc AS risk_critical, rh AS risk_high, rm AS risk_medium, rl AS risk_low, document_type FROM verd""", "verd")
def _(spark, sf):
    v = audited(spark, sf).verdicts
    return v.select(
        "screen_id", "screen_label", "verdict", "overall_severity", F.size("violations").cast("long").alias("violations"),
        F.size("rules_evaluated").cast("long").alias("rules_evaluated"), "total_entities", "risk_critical", "risk_high", "risk_medium", "risk_low", "document_type",
    )


@query("ver_7_violation_details", f"SELECT screen_id, rule_id, act_section, section_title, penalty_reference FROM viol JOIN {o.SECTIONS} USING (act_section)", "viol")
def _(spark, sf):
    return rules.violation_details(audited(spark, sf).violations).select("screen_id", "rule_id", "act_section", "section_title", "penalty_reference")


@query("ver_8_merge_findings", """SELECT screen_id, act_section, 'rules' AS origin FROM viol UNION ALL
    SELECT screen_id, 'Section 8(5)', 'external' FROM scr WHERE screen_id NOT IN (SELECT screen_id FROM viol WHERE act_section = 'Section 8(5)')""", "viol scr")
def _(spark, sf):
    external = corpus(spark, sf).select("screen_id", F.lit("Section 8(5)").alias("act_section"))
    merged = rules.merge_findings(audited(spark, sf).violations.select("screen_id", "act_section"), external)
    return merged.select("screen_id", "act_section", "origin")


# -- scores -----------------------------------------------------------------------------------------
_SENS = "CASE document_type " + " ".join(f"WHEN {o.q(k)} THEN {v}" for k, v in c.DOCUMENT_SENSITIVITY.items()) + " ELSE 3 END"
o.part("risk", "doctype ent find", f"""SELECT screen_id, CAST(greatest(0, least(100, 100 - coalesce(pen, 0) - coalesce(unm, 0) * 3 - {_SENS})) AS BIGINT) AS score,
    coalesce(fc, 0) AS finding_count, coalesce(unm, 0) AS unmasked_high_risk FROM doctype
    LEFT JOIN (SELECT screen_id, sum(CASE severity WHEN 'Critical' THEN 18 ELSE 10 END) AS pen, count(*) AS fc FROM find GROUP BY screen_id) USING (screen_id)
    LEFT JOIN (SELECT screen_id, count(*) AS unm FROM ent WHERE NOT masked AND risk IN ('Critical', 'High') GROUP BY screen_id) USING (screen_id)""")
_LEVEL = "CASE WHEN score >= 85 THEN {} WHEN score >= 70 THEN {} WHEN score >= 45 THEN {} ELSE {} END"


def _risk(spark, sf):
    found = entities(spark, sf)
    return scoring.combined_risk(found, scoring.heuristic_findings(found), classify.document_type(corpus(spark, sf)))


@query("sco_01_combined_risk", "SELECT screen_id, score, finding_count, unmasked_high_risk FROM risk", "risk")
def _(spark, sf):
    return _risk(spark, sf).select("screen_id", "score", "finding_count", "unmasked_high_risk")


@query("sco_02_risk_level", "SELECT screen_id, " + _LEVEL.format("'Low'", "'Medium'", "'High'", "'Critical'") + " AS severity, "
       + _LEVEL.format("'Ready'", "'Mostly Ready'", "'Needs Remediation'", "'Not Ready'") + " AS readiness FROM risk", "risk")
def _(spark, sf):
    return _risk(spark, sf).select("screen_id", "severity", "readiness")


_SCORE = f"greatest(0, 100 - CAST(floor(sum(CASE WHEN masked THEN {o.WEIGHT} * 0.25 ELSE {o.WEIGHT} END)) AS INT))"


@query("sco_03_compliance_score", f"SELECT screen_id, {_SCORE} AS score, count(*) AS total_entities FROM ent GROUP BY screen_id", "ent")
def _(spark, sf):
    return scoring.compliance_score(entities(spark, sf))


@query("sco_04_compliance_grade", f"SELECT screen_id, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS grade FROM (SELECT screen_id, {_SCORE} AS score FROM ent GROUP BY screen_id)", "ent")
def _(spark, sf):
    return scoring.compliance_score(entities(spark, sf)).select("screen_id", scoring.compliance_grade(F.col("score")).alias("grade"))


_BYRISK = ", ".join(f"count(*) FILTER (WHERE risk = '{r}') AS by_risk_{r.lower()}" for r in c.RISK_WEIGHT)


@query("sco_05_risk_breakdown", f"SELECT screen_id, {_BYRISK} FROM ent GROUP BY screen_id", "ent")
def _(spark, sf):
    return scoring.risk_breakdown(entities(spark, sf))


_SHOWN = f"NOT (length({_PLAIN}) >= 12 AND regexp_matches({_PLAIN}, '^[Xx*]'))"
_FLAGGED = f"""(pii_type IN ('AADHAAR_UNMASKED', '_KW_PASSWORD', 'PHONE_IN', 'ACCOUNT_BALANCE', 'TRANSACTION_HISTORY') OR (pii_type = 'PAN' AND NOT masked)
    OR (pii_type = 'CREDIT_DEBIT_CARD' AND {_SHOWN}) OR (pii_type = 'BANK_ACCOUNT' AND NOT (length(value) >= 6 AND regexp_matches(value, '^[Xx*]'))))"""


@query("sco_06_compliance_flags", f"SELECT screen_id, pii_type, value FROM ent WHERE {_FLAGGED}", "ent")
def _(spark, sf):
    return scoring.compliance_flags(entities(spark, sf)).select("screen_id", "pii_type", "value")


@query("sco_07_compliance_report", f"SELECT screen_id, {_SCORE} AS score, count(*) AS total_entities, count(*) FILTER (WHERE {_FLAGGED}) AS flag_count, {_BYRISK} FROM ent GROUP BY screen_id", "ent")
def _(spark, sf):
    report = scoring.compliance_report(entities(spark, sf)).drop("grade")
    return report.withColumn("flag_count", F.col("flag_count").cast("long"))


@query("sco_08_heuristic_findings", """SELECT screen_id, CAST(entity_rank AS BIGINT) AS entity_rank, display_type || CASE category WHEN 'Masking Compliance' THEN ' appears overexposed' ELSE ' is visible' END AS issue,
    severity, value AS supporting_text, confidence, category FROM find""", "find")
def _(spark, sf):
    return scoring.heuristic_findings(entities(spark, sf)).select(
        "screen_id", F.col("entity_rank").cast("long").alias("entity_rank"), "issue", "severity", "supporting_text", "confidence", "category"
    )


@query("sco_08_heuristic_summary", f"""SELECT screen_id, overall AS overall_risk, CASE WHEN document_type IN {o.inlist(c.SENSITIVE_DOCUMENTS)} THEN 'High' ELSE overall END AS screen_sensitivity, coalesce(n, 0) AS finding_count
    FROM (SELECT screen_id, document_type, n, CASE WHEN crit > 0 THEN 'Critical' WHEN n > 0 THEN 'High' ELSE 'Low' END AS overall FROM doctype
      LEFT JOIN (SELECT screen_id, count(*) AS n, count(*) FILTER (WHERE severity = 'Critical') AS crit FROM find GROUP BY screen_id) USING (screen_id))""", "doctype find")
def _(spark, sf):
    found = scoring.heuristic_findings(entities(spark, sf))
    return scoring.heuristic_summary(found, classify.document_type(corpus(spark, sf))).select("screen_id", "overall_risk", "screen_sensitivity", "finding_count")


def _analysis_json(spark, sf):
    """External analysis replies, one per customer: some fenced, some with thinking, some with odd levels."""
    facts = derived.customer_facts(spark, sf)
    k = F.col("k")
    detail = F.struct(
        F.concat(F.lit("Section "), (k % 9).cast("string")).alias("act_section"), F.lit("t").alias("section_title"),
        F.repeat(F.lit("x"), (k % 400).cast("int")).alias("finding"),
        F.when(k % 4 == 0, "severe").otherwise("high").alias("severity"), ((k % 14) / 10).cast("string").alias("confidence"),
    )
    count = (k % 25).cast("int")
    body = F.to_json(
        F.struct(
            F.when(k % 3 == 0, "extreme").otherwise(" medium ").alias("overall_risk"),
            F.lit("perhaps").alias("violations_found"),
            F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: detail)).alias("violation_details"),
            F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.repeat(F.lit("r"), 310)).alias("recommendations"),
        )
    )
    reply = (
        F.when(k % 3 == 0, F.concat(F.lit("<think>a {b}</think>\n"), body))
        .when(k % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here it is: "), body))
    )
    return facts.select((k * 2 + 1).alias("screen_id"), reply.alias("payload"))


@query("sco_09_normalise_analysis", """SELECT screen_id, CASE WHEN k % 3 = 0 THEN 'LOW' ELSE 'MEDIUM' END AS overall_risk, CASE WHEN k % 25 > 0 THEN 'YES' ELSE 'NO' END AS violations_found,
    (k % 25)::BIGINT AS findings, CASE WHEN k % 25 > 0 THEN CASE WHEN k % 4 = 0 THEN 'LOW' ELSE 'HIGH' END END AS first_severity,
    CASE WHEN k % 25 > 0 THEN least(1.0::DOUBLE, (k % 14)::DOUBLE / 10) END AS first_confidence, CASE WHEN k % 25 > 0 THEN k % 400 END AS finding_length,
    15::BIGINT AS recommendations, 310::BIGINT AS recommendation_length FROM (SELECT k * 2 + 1 AS screen_id, k FROM facts)""", "facts")
def _(spark, sf):
    done = scoring.normalise_analysis(_analysis_json(spark, sf))
    first = F.get("violation_details", F.lit(0))
    return done.select(
        "screen_id", "overall_risk", "violations_found", F.size("violation_details").cast("long").alias("findings"), first["severity"].alias("first_severity"),
        first["confidence"].alias("first_confidence"), F.length(first["finding"]).cast("long").alias("finding_length"),
        F.size("recommendations").cast("long").alias("recommendations"), F.length(F.get("recommendations", F.lit(0))).cast("long").alias("recommendation_length"),
    )


@query("sco_10_evidence_export")
def _(spark, sf):
    table = corpus(spark, sf)
    cands = resolve.candidates(resolve.evidence(resolve.raw_matches(table)))
    return scoring.evidence_export(table, resolve.resolve_with_fallback(cands), cands)


@query("sco_11_transaction_summary", """SELECT screen_id, count(*) AS transaction_entity_count, bool_or(pii_type = 'TRANSACTION_HISTORY') AS transaction_history_detected,
    count(*) FILTER (WHERE pii_type = 'TRANSACTION_REFERENCE') AS transaction_references_detected, string_agg(DISTINCT display_type, '|' ORDER BY display_type) AS financial_exposure_types
    FROM ent WHERE starts_with(pii_type, 'TRANSACTION') OR category = 'Financial Data' GROUP BY screen_id""", "ent")
def _(spark, sf):
    return scoring.transaction_summary(entities(spark, sf))


@query("sco_12_scan_confidence", """SELECT screen_id, CAST(floor((avg_confidence * 0.40::DOUBLE + coalesce(CASE WHEN total_entities > 0 THEN mean_confidence END * 0.30::DOUBLE, 0) + CASE WHEN violations > 0 THEN 0.7::DOUBLE * 0.20::DOUBLE ELSE 0 END
      + CASE WHEN rules_n > 0 THEN least(1.0::DOUBLE, rules_n / 26.0::DOUBLE) * 0.10::DOUBLE ELSE 0 END)
    / (0.40::DOUBLE + CASE WHEN total_entities > 0 THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN violations > 0 THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN rules_n > 0 THEN 0.10::DOUBLE ELSE 0 END) * 100 + 0.5) AS INT) AS scan_confidence FROM verd""", "verd")
def _(spark, sf):
    return scoring.scan_confidence(audited(spark, sf).verdicts)


_RANK = "CASE risk WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END"


@query("sco_13_entities_by_category", f"""SELECT *, row_number() OVER (PARTITION BY screen_id ORDER BY worst_rank, first_rank) AS category_order FROM (
    SELECT screen_id, category, count(*) AS entity_count, min({_RANK}) AS worst_rank, min(entity_rank) AS first_rank FROM ent GROUP BY screen_id, category)""", "ent")
def _(spark, sf):
    table = scoring.entities_by_category(entities(spark, sf))
    first = entities(spark, sf).groupBy("screen_id", "category").agg(F.min("entity_rank").cast("long").alias("first_rank"))
    return table.join(first, ["screen_id", "category"]).withColumn("category_order", F.col("category_order").cast("long"))


# -- records of processing ------------------------------------------------------------------------------
def merged(spark, sf):
    done = audited(spark, sf)
    return ropa.merge_scans(done.scanned, done.verdicts)


def ropa_table(spark, sf):
    return ropa.ropa_entry(merged(spark, sf))


@query("rop_1_merge_scans", "SELECT session_id, screens, entities, violations, says_consent, says_law, tracks AS tracks_children, screen_label, array_to_string(list_sort(coalesce(ids, [])), ',') AS present FROM merged", "merged")
def _(spark, sf):
    return merged(spark, sf).select(
        "session_id", "screens", "entities", F.col("violations").cast("long").alias("violations"), "says_consent", "says_law", "tracks_children", "screen_label",
        F.array_join("present", ",").alias("present"),
    )


_DETF = ["application_name", "data_principal_cats", "includes_children", "child_tracking", "personal_data_cats", "grounds", "consent_type", "dpia_applicable"]


@query("rop_2_deterministic_fields", f"SELECT session_id, {', '.join(_DETF)} FROM ropa", "ropa")
def _(spark, sf):
    return ropa_table(spark, sf).select("session_id", *_DETF)


@query("rop_3_inferred_fields", f"SELECT session_id, '' AS department, process, purpose, description, {o.q(c.DEFAULT_SOURCE)} AS data_source FROM ropa", "ropa")
def _(spark, sf):
    return ropa_table(spark, sf).select("session_id", "department", "process", "purpose", "description", "data_source")


_EXPR = {
    "serial": "'1'", "department": "''", "data_source": o.q(c.DEFAULT_SOURCE), "automated_decisions": "'No'",
    "data_principal_rights": "replace(" + o.q(c.ROPA_RIGHTS.replace("\n", "|")) + ", '|', chr(10))",
    "third_party_safeguards": "replace(" + o.q(c.ROPA_SAFEGUARDS.replace("\n", "|")) + ", '|', chr(10))",
    "transfer_outside": "'No'", "storage_format": "'Digital'",
}
_HAVE = {"process", "purpose", "description", *_DETF}
_FULL = ", ".join(f"{k if k in _HAVE else _EXPR.get(k, chr(39) * 2)} AS {k}" for k in c.ROPA_KEYS)
o.part("ropa_full", "ropa", f"SELECT session_id, {_FULL} FROM ropa")
_LONG = " UNION ALL ".join(f"SELECT session_id, '{k}' AS field, {k} AS value FROM ropa_full" for k in c.ROPA_KEYS)
o.part("ropa_long", "ropa_full", f"""SELECT *, CASE WHEN field = 'serial' THEN 'system' WHEN field IN {o.inlist(c.ROPA_SCAN_KEYS)} AND value <> '' THEN 'scan'
    WHEN field IN {o.inlist(c.ROPA_INFERRED_KEYS)} AND value <> '' THEN 'ai' ELSE 'manual' END AS source FROM ({_LONG})""")


@query("rop_4_ropa_entry", f"SELECT session_id, {', '.join(c.ROPA_KEYS)} FROM ropa_full", "ropa_full")
def _(spark, sf):
    return ropa_table(spark, sf)


@query("rop_5_source_map", "SELECT session_id, field, source FROM ropa_long", "ropa_long")
def _(spark, sf):
    return ropa.ropa_source_map(ropa_table(spark, sf))


_REQ = [k for k, _, _, _, required in c.ROPA_COLUMNS if required]


@query("rop_6_validation", f"""SELECT session_id, count(*) FILTER (WHERE value <> '') AS filled_count, count(*) AS total_count,
    CAST(round(count(*) FILTER (WHERE value <> '') * 100.0 / count(*)) AS BIGINT) AS completion_pct, count(*) FILTER (WHERE value = '' AND field IN {o.inlist(_REQ)}) AS warning_count FROM ropa_long GROUP BY session_id""", "ropa_long")
def _(spark, sf):
    checked = ropa.ropa_validation(ropa_table(spark, sf))
    return checked.select("session_id", *[F.col(n).cast("long").alias(n) for n in ("filled_count", "total_count", "completion_pct", "warning_count")])


_SECT = "(VALUES " + ", ".join(f"({o.q(k)}, {o.q(s)})" for k, _, _, s, _ in c.ROPA_COLUMNS) + ") AS sc(field, section)"


@query("rop_7_section_fill", f"SELECT session_id, section, count(*) FILTER (WHERE value <> '') AS filled, count(*) AS total FROM ropa_long JOIN {_SECT} USING (field) GROUP BY session_id, section", "ropa_long")
def _(spark, sf):
    return ropa.ropa_section_fill(ropa_table(spark, sf))


@query("rop_7_source_counts", "SELECT session_id, source, count(*) AS fields FROM ropa_long GROUP BY session_id, source", "ropa_long")
def _(spark, sf):
    return ropa.ropa_source_counts(ropa_table(spark, sf))


@query("rop_8_exposure_rollup", """SELECT session_id, category, risk, count(*) AS entity_count, count(DISTINCT value) AS distinct_values, count(DISTINCT screen_id) AS screen_count
    FROM ent JOIN (SELECT screen_id, session_id FROM scr) USING (screen_id) GROUP BY ROLLUP (session_id, category, risk)""", "ent scr")
def _(spark, sf):
    return ropa.exposure_rollup(entities(spark, sf), corpus(spark, sf), rollup=True)


@query("rop_8_violation_rollup", "SELECT session_id, rule_id, severity, count(*) AS violation_count, count(DISTINCT screen_id) AS screen_count FROM viol GROUP BY session_id, rule_id, severity", "viol")
def _(spark, sf):
    return ropa.violation_rollup(audited(spark, sf).violations)


_HEADERS = ", ".join(f"{k} AS \"{h}\"" for k, _, h, _, _ in c.ROPA_COLUMNS)


@query("snk_5_ropa_sheet", f"SELECT {_HEADERS} FROM ropa_full", "ropa_full")
def _(spark, sf):
    return ropa_sink.ropa_sheet(ropa_table(spark, sf))


# -- regression -------------------------------------------------------------------------------------------
o.part("expected", "stored", "SELECT id, 0 AS position, rule_id FROM stored UNION ALL SELECT id, 1, 'RULE-XX-99' FROM stored")
o.part("verified", "expected viol", "SELECT id, position, rule_id, CASE WHEN rule_id IN (SELECT rule_id FROM viol) THEN 'still_present' ELSE 'corrected' END AS status FROM expected")


@query("reg_1_corrections_expected", "SELECT id, position, rule_id FROM expected", "expected")
def _(spark, sf):
    return regression.corrections_expected(_stored(spark, sf)).select("id", "position", "rule_id")


@query("reg_2_verify_corrections", "SELECT id, position, rule_id, status FROM verified", "verified")
def _(spark, sf):
    expected = regression.corrections_expected(_stored(spark, sf))
    return regression.verify_corrections(expected, audited(spark, sf).violations).select("id", "position", "rule_id", "status")


@query("reg_3_correction_summary", "SELECT id, status, count(*) AS corrections FROM verified GROUP BY id, status", "verified")
def _(spark, sf):
    expected = regression.corrections_expected(_stored(spark, sf))
    return regression.correction_summary(regression.verify_corrections(expected, audited(spark, sf).violations))


# -- streams: the stateless and deduplicating parts on tables ------------------------------------------------
@query("str_2_capture_dedup", "SELECT screen_id, md5(full_text) AS capture_hash FROM (SELECT *, row_number() OVER (PARTITION BY user_id, full_text ORDER BY uploaded_at, screen_id) AS n FROM corpus) WHERE n = 1", "corpus")
def _(spark, sf):
    kept = streams.stream_dedup(corpus(spark, sf))
    return streams.with_capture_hash(kept).select("screen_id", "capture_hash")


# -- the audit over pages and conversations -----------------------------------------------------------------
def _corpus_sql(key: str, texts: str) -> str:
    return (f"SELECT {key} AS screen_id, 0::BIGINT AS session_id, concat('user', {key} % 50) AS user_id, concat('screen_', {key}) AS filename, "
            f"TIMESTAMP '2024-01-01 00:00:00' + to_minutes({key}) AS uploaded_at, txt AS full_text, 1.0::DOUBLE AS avg_confidence FROM ({texts})")


_CORPORA = {
    "pages": _corpus_sql("page_id", f"SELECT page_id, {_TAGS} AS txt FROM pages"),
    "conversations": _corpus_sql("conv_id", f"""SELECT conv_id, {o.canonical('txt')} AS txt FROM (
        SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS txt FROM conversations GROUP BY conv_id)"""),
}


def _register_corpora():
    def entity_rows(kind):
        def run(spark, sf):
            found = resolve.raw_matches(screens.read_screens(spark, f"{sf}/{kind}.parquet", kind))
            return resolve.resolve_with_fallback(resolve.candidates(resolve.evidence(found))).select(
                "screen_id", F.col("entity_rank").cast("long").alias("entity_rank"), "pii_type", "value", "confidence", "masked", "risk")
        return run

    def verdict_of(kind):
        def run(spark, sf):
            done = audit(screens.read_screens(spark, f"{sf}/{kind}.parquet", kind), folder=spark.conf.get("spark.checkpoint.dir", None))
            return done.verdicts.select(
                "screen_id", "screen_label", "verdict", "overall_severity", F.size("violations").cast("long").alias("violations"), "total_entities", "document_type")
        return run

    for kind, corpus_sql in _CORPORA.items():
        ORACLES[f"res_7_resolve_{kind}"] = o.compose("SELECT screen_id, entity_rank, pii_type, value, confidence, masked, risk FROM ent", "ent", corpus_sql)
        QUERIES[f"res_7_resolve_{kind}"] = entity_rows(kind)
        ORACLES[f"ver_6_evaluate_{kind}"] = o.compose(
            "SELECT screen_id, screen_label, verdict, overall_severity, violations, total_entities, document_type FROM verd", "verd", corpus_sql)
        QUERIES[f"ver_6_evaluate_{kind}"] = verdict_of(kind)


_register_corpora()


# -- the block route: blocks to lines, layout matches in place of two text rules, the whole audit -------------
def _block_audit(spark, sf):
    owners = derived.banking_screens(spark, sf).withColumn("screen_id", ((F.col("screen_id") - 1) / 2).cast("long"))
    return audit_blocks(blocks(spark, sf), owners, folder=spark.conf.get("spark.checkpoint.dir", None))


@query("res_7_resolve_blocks")
def _(spark, sf):
    return _block_audit(spark, sf).entities.select("screen_id", F.col("entity_rank").cast("long").alias("entity_rank"), "pii_type", "value", "confidence", "masked", "source_rule")


@query("ver_6_evaluate_blocks")
def _(spark, sf):
    return _block_audit(spark, sf).verdicts.select(
        "screen_id", "screen_label", "verdict", "overall_severity", F.size("violations").cast("long").alias("violations"), "total_entities", "document_type")
