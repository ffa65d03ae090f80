"""Screens given as blocks, from blocks to entities; layouts, names and numbers are made up here."""

import pytest
from helpers import block_table, text_screens
from pyspark.sql import functions as F

from veilscan.functions.verhoeff import verhoeff_valid
from veilscan.operators import layout, resolve, structure
from veilscan.plans.scan import audit_blocks

# A form: every value close to the right of its label; a remark below it in small print.
FORM = [
    ("Customer ID", 50, 60, 150, 80), ("KX4471902", 162, 61, 257, 81),
    ("Acct No", 50, 160, 118, 180), ("99120345678001", 130, 160, 262, 180),
    ("IFSC", 50, 260, 92, 280), ("WXYZ0471100", 104, 260, 214, 280),
    ("Branch", 50, 360, 110, 380), ("LOWER", 122, 360, 178, 380), ("MARKET", 185, 360, 252, 380),
    ("Ledger Balance", 50, 460, 168, 480), ("Rs 6,205.18", 180, 460, 278, 480),
    ("MEENA", 50, 560, 108, 580), ("IYER", 115, 560, 152, 580),
    ("kept for your records", 50, 660, 205, 672),
]
# Cards side by side: values stand below their labels.
CARDS = [
    ("Account Balance", 30, 30, 155, 50), ("Cust ID", 420, 30, 485, 50),
    ("Rs 411.09", 30, 58, 110, 78), ("QT8800417", 420, 58, 505, 78),
    ("Transaction History", 200, 150, 352, 172),
    ("03-Mar-25", 30, 220, 108, 239), ("NEFT", 140, 220, 180, 239), ("/", 183, 220, 188, 239), ("HDFC", 191, 220, 233, 239),
    ("/", 236, 220, 241, 239), ("510477230981", 244, 220, 350, 239), ("/RENT", 353, 220, 400, 239), ("-Rs 900", 560, 220, 620, 239),
]
ROW = [("14-Feb-25", 20, 15, 101, 33), ("UPI/UTIB/234567890124/GREEN GROCER/", 120, 15, 480, 33), ("-Rs 260", 600, 15, 660, 33)]
SCREENS = {
    1: FORM,
    2: CARDS,
    3: ROW,
    4: [("Aadhaar", 15, 22, 80, 42), ("234567890124", 95, 22, 214, 42)],
    5: [("700100200302", 15, 22, 134, 42)],
    6: [(f"row{i}", 10 + 40 * (i % 7), 4 * i, 45 + 40 * (i % 7), 4 * i + 12) for i in range(60)],
}


@pytest.fixture(scope="module")
def tables(spark):
    blocks = block_table(spark, SCREENS)
    lines = structure.line_table(blocks).persist()
    screens = structure.structured_screens(lines)
    raw = resolve.raw_matches(screens, layout.layout_entities(lines, screens)).persist()
    cands = resolve.candidates(resolve.evidence(raw)).persist()
    return {"blocks": blocks, "lines": lines, "raw": raw, "cands": cands, "entities": resolve.deterministic_entities(raw).collect()}


def values(tables, screen, kind):
    found = [e for e in tables["entities"] if e.screen_id == screen and e.pii_type == kind]
    return [e.value for e in sorted(found, key=lambda e: e.entity_rank)]


@pytest.mark.parametrize(("screen", "kind", "value"), [
    (1, "CUSTOMER_ID", "KX4471902"), (1, "BANK_ACCOUNT", "99120345678001"), (1, "IFSC", "WXYZ0471100"),
    (1, "ACCOUNT_BALANCE", "6205.18"), (2, "CUSTOMER_ID", "QT8800417"),
    (2, "ACCOUNT_BALANCE", "411.09"), (2, "TRANSACTION_REFERENCE", "510477230981"), (3, "TRANSACTION_REFERENCE", "234567890124"),
    (4, "AADHAAR_UNMASKED", "234567890124"),
])
def test_values_found(tables, screen, kind, value):
    assert value in values(tables, screen, kind)


def test_values_kept_apart(tables):
    assert not {"MEENA", "MEENA IYER", "LOWER MARKET"} & set(values(tables, 1, "CUSTOMER_ID"))
    assert values(tables, 3, "AADHAAR_UNMASKED") == [] and values(tables, 5, "AADHAAR_UNMASKED") == []
    mapped = [e for e in tables["entities"] if e.screen_id == 1 and e.value == "KX4471902"]
    assert mapped[0].source_rule == "LayoutMapping" and mapped[0].confidence >= 0.85


def test_one_value_in_two_readings(tables):
    row = tables["cands"].filter("screen_id = 3 AND value = '234567890124'").first()
    best = {e.pii_type: -e.negative for e in reversed(row.evidence)}
    assert best["TRANSACTION_REFERENCE"] > best["AADHAAR_UNMASKED"]


def test_external_decision_wins(spark, tables):
    decisions = spark.createDataFrame(
        [(3, "234567890124", "TRANSACTION_REFERENCE", 0.9, "a payment row")],
        "screen_id long, value string, final_type string, confidence double, reasoning string")
    found = [e for e in resolve.resolve_entities(tables["cands"], decisions).collect() if e.screen_id == 3 and e.value == "234567890124"]
    assert [(e.pii_type, e.source_rule) for e in found] == [("TRANSACTION_REFERENCE", "HybridAIResolution")]


def test_fallback_equals_joined_fallback_decisions(tables):
    cands, columns = tables["cands"], ["screen_id", "entity_rank", "pii_type", "value", "confidence", "source_rule"]
    joined = resolve.resolve_entities(cands, resolve.fallback_decisions(cands)).select(*columns)
    inline = resolve.resolve_with_fallback(cands).select(*columns)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, inline.collect()))


def test_cells_have_columns(tables):
    for screen, blocks in ((1, FORM), (2, CARDS)):
        columns = structure.cluster_columns(tables["blocks"].filter(F.col("screen_id") == screen))
        cells = structure.row_cells(tables["lines"].filter(F.col("screen_id") == screen), columns).collect()
        assert columns.count() >= 2 and len(cells) == len(blocks) and all(c.column_index is not None for c in cells)


def test_narrow_blocks_make_one_chain(tables):
    row = tables["raw"].filter("screen_id = 2 AND value = '510477230981'")
    assert "NEFT/HDFC/510477230981/RENT" in structure.span_to_lines(row, tables["lines"]).first().context_text


def test_dense_run_follows_the_running_mean(tables):
    # A block joins the line while it is within the threshold of the mean of the line's centres so far.
    heights, centre = 12.0, [4 * i + 6.0 for i in range(60)]
    reach, lines = max(10.0, heights * 0.65), [[centre[0]]]
    for c in centre[1:]:
        if abs(c - sum(lines[-1]) / len(lines[-1])) <= reach:
            lines[-1].append(c)
        else:
            lines.append([c])
    got = tables["lines"].filter("screen_id = 6").orderBy("line_index").collect()
    assert [len(r.block_indices) for r in got] == [len(x) for x in lines]


def test_layout_decisions_list_what_was_rejected(tables):
    row = layout.layout_decisions(tables["lines"].filter("screen_id = 1")).filter("entity_type = 'CUSTOMER_ID'").first()
    assert row.selected_value == "KX4471902" and row.candidate_count > 1
    assert any(x.rejected for x in row.candidates)


def test_verhoeff(spark):
    listed = {"234567890124": True, "700100200301": True, "700100200302": False, "222222222222": False}
    table = spark.createDataFrame([(v,) for v in listed], "v string")
    assert {r.v: r.ok for r in table.select("v", verhoeff_valid(F.col("v")).alias("ok")).collect()} == listed


def test_block_route_end_to_end(spark, tables):
    owners = text_screens(spark, {i: "" for i in SCREENS}).drop("full_text", "avg_confidence")
    done = audit_blocks(tables["blocks"], owners, folder=spark.conf.get("spark.checkpoint.dir"))
    found = {(e.screen_id, e.value): e for e in done.entities.collect()}
    assert found[(1, "KX4471902")].pii_type == "CUSTOMER_ID" and found[(2, "510477230981")].pii_type == "TRANSACTION_REFERENCE"
    assert done.verdicts.count() == len(SCREENS)
    done.drop()


def test_segments_are_valued_once_for_every_type(tables):
    runs = layout.block_runs(tables["lines"])
    seg = layout.is_segment()
    both = layout.with_fits(runs)
    for number, kind in enumerate(layout.LABEL_TYPES):
        value = layout.entity_value(F.lit(kind), F.col("text"))
        validation = layout.rounded(layout.validation_confidence(F.lit(kind), value, F.col("text"), F.col("line_text")), 4)
        found = F.col(f"fits.{layout._form_of(kind)}")
        wrong = both.filter(seg & (~value.eqNullSafe(found) | ~validation.eqNullSafe(F.col("fits.validations")[number])))
        assert wrong.count() == 0, kind
    assert both.filter(seg).count() > 0 and both.filter(~seg & F.col("fits").isNotNull()).count() == 0


def test_labels_of_runs_are_looked_up_once(tables):
    found = layout.block_runs(tables["lines"]).filter(layout.is_label() | layout.is_segment())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("accountholdername") == 1
