"""Where entities stand and why they were made, against a plain reading of the lines."""

import pytest
from helpers import block_table, text_screens
from pyspark.sql import functions as F
from test_scenarios import SCREENS

from veilscan.operators import layout, provenance, resolve, structure
from veilscan.plans.scan import audit, audit_blocks


def plain_context(lines, start, end):
    """``lines``: (start, end, text, blocks, box) of a screen in order."""
    touched = [i for i, line in enumerate(lines) if start < line[1] and end > line[0]]
    if not touched:
        return "", [], [], None
    chosen = lines[max(0, touched[0] - 1) : touched[-1] + 2]
    boxes = [lines[i][4] for i in touched]
    box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
    return "\n".join(x[2] for x in chosen), touched, sorted({b for x in chosen for b in x[3]}), box


@pytest.fixture(scope="module")
def done(spark):
    owners = text_screens(spark, {i: "" for i in SCREENS}).drop("full_text", "avg_confidence")
    return audit_blocks(block_table(spark, SCREENS), owners, folder=spark.conf.get("spark.checkpoint.dir"))


def test_block_route(done):
    table = {}
    for r in done.lines.orderBy("screen_id", "line_index").collect():
        table.setdefault(r.screen_id, []).append((r.start, r.end, r.text, r.block_indices, (r.x1, r.y1, r.x2, r.y2)))
    found = done.located().collect()
    assert len(found) == done.entities.count() and {r.label for r in found} > {None, "Customer ID"}
    for r in found:
        if r.label is None:
            got = r.context_text, r.line_indices, r.block_indices, (r.x1, r.y1, r.x2, r.y2)
            assert got == plain_context(table[r.screen_id], r.start, r.end), r
        assert r.reason and r.document_type and r.pii_type in r.source_evidence


def test_layout_match_tells_its_label(done):
    found = {(r.screen_id, r.value): r for r in done.located().collect()}
    row = found[(1, "KX4471902")]
    assert (row.label, row.layout_relation) == ("Customer ID", "same-row value to the right of label")
    assert row.block_indices == [1] and row.label_block_indices == [0] and (row.x1, row.y1, row.x2, row.y2) == (162, 61, 257, 81)
    assert row.context_text == "Customer ID KX4471902\nCustomer ID KX4471902" and row.line_indices == [0]
    below = found[(2, "QT8800417")]
    assert below.layout_relation == "nearest vertically aligned value below label" and below.line_indices == [0, 1]


def test_reasons_of_layout_evidence(spark):
    named = [("Account Number", 50, 100, 180, 120), ("99120345678001", 200, 100, 320, 120), ("MEENA IYER", 50, 160, 152, 180)]
    lines = structure.line_table(block_table(spark, {1: SCREENS[1], 2: SCREENS[2], 9: named}))
    screens = structure.structured_screens(lines)
    scanned = resolve.scan_text(screens)
    found = resolve.evidence(resolve.scanned_matches(scanned, layout.layout_entities(lines, screens)))
    rows = {(r.screen_id, r.pii_type, r.value): r.reason for r in provenance.with_provenance(found, lines).orderBy(F.col("is_layout")).collect()}
    assert rows[(1, "CUSTOMER_ID", "KX4471902")] == (
        "Layout label-value association: Customer ID -> KX4471902 "
        "(same-row value to the right of label; alphanumeric customer identifier with digits)")
    assert rows[(9, "ACCOUNT_HOLDER_NAME", "MEENA IYER")].startswith("Layout inference: Account Holder Name -> MEENA IYER (Inferred")
    assert rows[(1, "ACCOUNT_HOLDER_NAME", "MEENA IYER")] == "Line segment matches ALL CAPS name heuristics."
    assert rows[(2, "TRANSACTION_REFERENCE", "510477230981")].startswith("Detected banking transaction reference '510477230981' with context keywords [")


def test_rejected_pairs_say_why(spark):
    pairs = layout.score_pairs(layout.block_runs(structure.line_table(block_table(spark, {1: SCREENS[1]})))).collect()
    reasons = {(p.l.text, p.s.text): p.rejection_reasons for p in pairs}
    assert reasons[("Customer ID", "KX4471902")] == [] and reasons[("IFSC", "LOWER")][0] == "IFSC validation failed"
    # A segment that holds the label's own block is rejected on both counts.
    own = {k: v for k, v in reasons.items() if k[0] == "IFSC" and k[1].startswith("IFSC ")}
    assert own and all("same OCR block as label" in v for v in own.values())


def test_texts_with_odd_lines(spark):
    long = "\n".join(f"line {i} mail jo{i}@example.com" for i in range(3_000))
    texts = {1: "", 2: "\n\nPAN ABCDE1234F\n\n", 3: "PAN ABCDE1234F", 4: long, 5: "a\nUTR 987654321012 paid\nb", 6: None}
    result = audit(text_screens(spark, texts), folder=spark.conf.get("spark.checkpoint.dir"), context=True)
    rows = result.located()
    found = {}
    for r in rows.collect():
        found.setdefault(r.screen_id, []).append(r)
    assert set(found) == {2, 3, 4, 5} and len(found[4]) == 3_000
    assert (found[2][0].context_text, found[2][0].line_indices, found[2][0].block_indices) == ("\nPAN ABCDE1234F\n", [2], None)
    assert (found[3][0].context_text, found[3][0].line_indices) == ("PAN ABCDE1234F", [0])
    lines = long.split("\n")
    for r in found[4]:
        (i,) = r.line_indices
        assert r.context_text == "\n".join(lines[max(0, i - 1) : i + 2])
    assert rows.columns.count("value") == 1 and result.scanned.columns.count("near_lines") == 1
    result.drop()


def test_external_reasoning_goes_first(spark):
    screens = text_screens(spark, {1: "PAN ABCDE1234F", 2: "PAN ABCDE1234G"})
    decisions = spark.createDataFrame([(1, "ABCDE1234F", "PAN", 0.9, "as printed on the card")],
                                      "screen_id long, value string, final_type string, confidence double, reasoning string")
    reasons = {r.screen_id: r.reason for r in audit(screens, decisions, context=True).located().collect()}
    assert reasons == {1: "as printed on the card", 2: "Matched standard PAN pattern"}


def test_without_lines_it_says_so(spark):
    with pytest.raises(ValueError, match="context=True"):
        audit(text_screens(spark, {1: "x"})).located()


def test_rows_shortened_on_request(spark):
    long = spark.range(1).select(provenance.line_reference_reason(F.lit("v"), F.lit("utr"), F.repeat(F.lit("x"), F.lit(200)), 160).alias("r")).first().r
    assert long.endswith("OCR row: " + "x" * 157 + "...") and "[utr]" in long


def test_unknown_lines_and_empty_tables(spark):
    rows = spark.createDataFrame(
        [(1, None, None, (3, 0), "PAN", "v"), (1, 0, 0, (0, 0), None, None)],
        "screen_id long, line int, last_line int, ord struct<stage:int,start:int>, pii_type string, value string")
    lines = spark.createDataFrame([(1, 0, "only")], "screen_id long, line_index int, text string")
    found = provenance.with_provenance(rows, lines).orderBy("line").collect()
    assert [(r.context_text, r.line_indices, r.reason) for r in found] == [("", [], "Matched standard PAN pattern"), ("only", [0], "Matched standard  pattern")]
    assert provenance.with_provenance(rows.where("false"), lines).collect() == []
    assert provenance.with_provenance(rows, lines.where("false")).count() == 2
