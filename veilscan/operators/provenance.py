"""Where a match or an entity stands in its screen, and why it was made.

Everything is looked up by line: a match knows its first and last line, so spans meet lines by
equality on screen and line, and a screen with many matches is spread over tasks.  Matches of the
same lines share one row until the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.catalogs import (
    AMOUNT_REASON,
    BALANCE_REASON,
    CUSTOMER_REASON,
    DATE_AMOUNT_ROW_PATTERN,
    DETECTOR_REASON,
    DETECTORS,
    HISTORY_REASON,
    LABELLED_REASON,
    LINE_REF_REASON,
    NAME_REASON,
    ROW_KEYWORD,
    UPI_PATH_REASON,
)
from veilscan.functions.regex import matches
from veilscan.functions.tables import explode_rows
from veilscan.functions.text import filled, strip
from veilscan.operators.classify import document_type_of
from veilscan.operators.context import (
    STAGE_AMOUNT,
    STAGE_BALANCE,
    STAGE_CUSTOMER,
    STAGE_HISTORY,
    STAGE_LABELLED,
    STAGE_NAME,
    STAGE_UPI_PATH,
    transaction_keyword_hits,
)
from veilscan.operators.detectors import STAGE_LINE_REF

STAGE_REASONS = [
    (STAGE_BALANCE, BALANCE_REASON), (STAGE_CUSTOMER, CUSTOMER_REASON), (STAGE_UPI_PATH, UPI_PATH_REASON),
    (STAGE_LABELLED, LABELLED_REASON), (STAGE_HISTORY, HISTORY_REASON), (STAGE_NAME, NAME_REASON),
    (STAGE_AMOUNT, AMOUNT_REASON),
]
BOX = ["x1", "y1", "x2", "y2"]


def scanned_lines(scanned: DataFrame) -> DataFrame:
    """``screen_id, line_index, text`` of the lines around matches; ``scanned`` is ``scan_text`` with ``context``."""
    return explode_rows(scanned, "near_lines", "n", "screen_id").select("screen_id", "n.line_index", "n.text")


def scanned_types(scanned: DataFrame) -> DataFrame:
    """``screen_id, document_type`` from the keywords that the scan has found."""
    return scanned.select("screen_id", document_type_of(F.col("hits")).alias("document_type"))


def line_contexts(spans: DataFrame, lines: DataFrame, window: int = 1) -> DataFrame:
    """Context of every pair of first and last line that ``spans`` have.

    ``context_text`` and ``block_indices`` take in ``window`` more lines on either side, ``line_indices`` and
    the box only the touched lines; ``row_text`` is the first of them.  Without boxes in ``lines`` blocks and
    box are NULL.
    """
    key = ["screen_id", "line", "last_line"]
    pairs = spans.select(*key).filter(F.col("line").isNotNull()).distinct()
    wanted = pairs.select(
        *key, F.explode(F.sequence(F.greatest(F.col("line") - window, F.lit(0)), F.col("last_line") + window)).alias("line_index")
    )
    boxed = "block_indices" in lines.columns
    extra = ["block_indices", *BOX] if boxed else []
    near = wanted.join(
        lines.select("screen_id", F.col("line_index").cast("int").alias("line_index"), "text", *extra), ["screen_id", "line_index"]
    )
    touched = F.col("line_index").between(F.col("line"), F.col("last_line"))
    texts = F.array_sort(F.collect_list(F.struct("line_index", "text")))
    own = F.when(touched, F.col("line_index"))
    box = [F.min(F.when(touched, F.col(c))) for c in BOX[:2]] + [F.max(F.when(touched, F.col(c))) for c in BOX[2:]]
    blocks = F.array_sort(F.array_distinct(F.flatten(F.collect_list("block_indices")))) if boxed else None
    return near.groupBy(*key).agg(
        F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("context_text"),
        F.array_sort(F.collect_list(own)).alias("line_indices"),
        F.max(F.when(F.col("line_index") == F.col("line"), F.col("text"))).alias("row_text"),
        (blocks if boxed else F.lit(None).cast("array<int>")).alias("block_indices"),
        *[(c if boxed else F.lit(None).cast("double")).alias(n) for c, n in zip(box if boxed else BOX, BOX)],
    )


def line_reference_reason(value: Column, context_text: Column, row_text: Column, max_row: int | None = None) -> Column:
    """Reason of a reference found line by line; ``max_row`` shortens longer rows to that many characters."""
    held = transaction_keyword_hits(context_text)
    in_row = matches(context_text, DATE_AMOUNT_ROW_PATTERN, True)
    keywords = F.when(in_row, F.array_sort(F.array_union(held, F.array(F.lit(ROW_KEYWORD))))).otherwise(held)
    row = strip(row_text)
    if max_row:
        row = F.when(F.length(row) > max_row, F.concat(F.substring(row, 1, max_row - 3), F.lit("..."))).otherwise(row)
    return filled(LINE_REF_REASON, value, F.array_join(keywords, ", "), row)


def match_reason(
    stage: Column, pii_type: Column, value: Column, context_text: Column, row_text: Column, max_row: int | None = None
) -> Column:
    """Why a detector or a contextual rule made a match."""
    reason = F.when(stage < len(DETECTORS), filled(DETECTOR_REASON, pii_type))
    for number, text in STAGE_REASONS:
        reason = reason.when(stage == number, text)
    return reason.when(stage == STAGE_LINE_REF, line_reference_reason(value, context_text, row_text, max_row))


def with_provenance(
    rows: DataFrame, lines: DataFrame, documents: DataFrame | None = None, max_row: int | None = None
) -> DataFrame:
    """``rows`` (evidence or entities) with context, lines, blocks, box, label, reason and document type.

    Rows need ``screen_id, line, last_line``; entities bring ``origin``, evidence ``ord, pii_type, value`` and,
    for layout matches, ``place``.  What a layout match says of itself goes before the lines of its span.
    A decision's reasoning goes before the reason of its evidence.  Rows whose lines are unknown keep an
    empty context and no lines; ``documents`` has a ``document_type`` per screen, NULL where it lacks one.
    """
    entity = "origin" in rows.columns
    fields = rows.schema["origin"].dataType.fieldNames() if entity else rows.columns
    of = (lambda f: F.col(f"_r.origin.{f}")) if entity else (lambda f: F.col(f"_r.{f}"))
    stage = of("stage") if entity else F.col("_r.ord.stage")
    payload = rows.select("screen_id", "line", "last_line", F.struct(*rows.columns).alias("_r"))
    joined = payload.join(line_contexts(rows, lines), ["screen_id", "line", "last_line"], "left")
    if documents is not None:
        joined = joined.join(documents.select("screen_id", "document_type"), "screen_id", "left")
    placed = "place" in fields
    from_place = lambda f, other: F.coalesce(of("place")[f], other) if placed else other
    missing = lambda kind: F.lit(None).cast(kind)
    made = match_reason(stage, of("pii_type"), of("value"), F.col("context_text"), F.col("row_text"), max_row)
    reason = from_place("reason", made)
    if entity:
        reason = F.coalesce(of("reasoning"), reason)
    no_lines = F.array().cast("array<int>")
    return joined.select(
        *[F.col(f"_r.{c}").alias(c) for c in rows.columns if c not in ("origin", "place")],
        from_place("context_text", F.coalesce("context_text", F.lit(""))).alias("context_text"),
        from_place("line_indices", F.coalesce("line_indices", no_lines)).cast("array<int>").alias("line_indices"),
        from_place("value_block_indices", F.col("block_indices")).cast("array<int>").alias("block_indices"),
        *[from_place(c, F.col(c)).alias(c) for c in BOX],
        (of("place")["label"] if placed else missing("string")).alias("label"),
        (of("place")["relation"] if placed else missing("string")).alias("layout_relation"),
        (of("place")["label_block_indices"] if placed else missing("array<int>")).cast("array<int>").alias("label_block_indices"),
        reason.alias("reason"),
        (F.col("document_type") if documents is not None else missing("string")).alias("document_type"),
        *([of("candidate_types").alias("source_evidence")] if entity else []),
    )
