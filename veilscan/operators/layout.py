"""Label and value association on the layout.

Labels are short runs of blocks whose text is a known alias, values other short
runs nearby.  Page height is cut into bands; a label only ever meets the segments
of a band both touch, so the work stays in proportion to the page.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions.numbers import rounded, rounded_column
from veilscan.catalogs import (
    ALIAS_TO_TYPE,
    ASSOCIATION_REASON,
    BELOW_RELATION,
    BESIDE_RELATION,
    FAR_RELATION,
    INFERENCE_REASON,
    INFERRED_LABEL,
    INFERRED_MAPPING,
    INFERRED_RELATION,
    NAME_FORBIDDEN_TOKENS,
    NAME_MASK_REASON,
    NAME_WORD_REASON,
    NUMERIC_CUSTOMER_REASON,
    SAME_BLOCK_RELATION,
    SUMMARY_STOP_LABELS,
    TRANSACTION_KEYWORDS,
    VALUE_REASONS,
)
from veilscan.functions.regex import let
from veilscan.functions.tables import bound, explode_rows
from veilscan.functions.text import clean_spaces, contains_any, filled, label_key, normalised_value, quoted, words
from veilscan.operators.context import STAGE_LAYOUT, only_masking, text_bits

AMOUNT_IN_TEXT = r"(?iu)(?:rs\.?|inr|₹)?\s*([0-9][0-9,]*\.\p{Nd}{2})"
# Height of a band in pixels; any positive value gives the same result.
BAND = 128.0
LABEL_TYPES = sorted(set(ALIAS_TO_TYPE.values()))


def alias_type(text: Column) -> Column:
    """Entity type a text is a label of, or NULL."""
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in ALIAS_TO_TYPE.items())
    return F.try_element_at(F.expr(f"map({pairs})"), label_key(text))


def summary_boundary(lines: DataFrame) -> DataFrame:
    """Top of the first line that starts a list of transactions."""
    stop = label_key(F.col("text")).isin(SUMMARY_STOP_LABELS)
    return lines.filter(stop).groupBy("screen_id").agg(F.min_by("y1", "line_index").alias("boundary_y"))


def summary_lines(lines: DataFrame) -> DataFrame:
    """Lines above the boundary of their screen."""
    stop = label_key(F.col("text")).isin(SUMMARY_STOP_LABELS)
    whole = Window.partitionBy("screen_id")
    boundary = F.min_by(F.col("y1"), F.when(stop, F.col("line_index"))).over(whole)
    return (
        lines.withColumn("boundary_y", boundary)
        .filter(F.col("boundary_y").isNull() | (F.col("cy") < F.col("boundary_y")))
        .drop("boundary_y")
    )


def block_runs(lines: DataFrame, longest: int = 5) -> DataFrame:
    """Runs of up to ``longest`` neighbouring blocks of each line above the boundary.

    ``entity_type`` is set for runs that read like a label.
    """
    lines = summary_lines(lines)
    n = F.size("members")
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda s: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(longest), n - s + 1)),
                lambda size: F.struct(
                    s.alias("first"), size.alias("size"), F.slice("members", s, size).alias("bs")
                ),
            ),
        )
    )
    rows = explode_rows(
        lines.select("screen_id", "line_index", F.col("text").alias("line_text"),
                     F.col("start").alias("line_start"), runs.alias("runs")),
        "runs", "r", "screen_id", "line_index", "line_text", "line_start",
    )

    # Bounds first, rounding in a second projection: both then compile.
    total = F.aggregate("r.bs.confidence", F.lit(0.0), lambda a, c: a + c)
    bounds = rows.select(
        "screen_id", "line_index", "line_text", "line_start", "r.first", "r.size",
        F.col("r.bs.text").alias("_texts"),
        F.col("r.bs.block_index").alias("block_indices"),
        F.array_min("r.bs.x1").alias("x1"), F.array_min("r.bs.y1").alias("y1"),
        F.array_max("r.bs.x2").alias("x2"), F.array_max("r.bs.y2").alias("y2"),
        (total / F.size("r.bs")).alias("confidence"),
    )
    boxed = bounds.select(
        "screen_id", "line_index", "line_text", "line_start", "first", "size", "_texts", "block_indices",
        *[rounded_column(c, 1).alias(c) for c in ("x1", "y1", "x2", "y2")],
        rounded_column("confidence").alias("confidence"),
    )
    # What is asked for labels or segments asks for both of these; each is worked out once.
    named = bound(bound(boxed, clean_spaces(F.array_join("_texts", " ")), "text"), alias_type(F.col("text")), "entity_type")
    return named.select(
        "screen_id", "line_index", "line_text", "line_start", "first", "size", "text", "block_indices",
        "x1", "y1", "x2", "y2", "confidence",
        ((F.col("x1") + F.col("x2")) / 2).alias("cx"),
        ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
        F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")).alias("width"),
        F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")).alias("height"),
        "entity_type",
    )


def is_label() -> Column:
    """Labels are at most three blocks long."""
    return F.col("entity_type").isNotNull() & (F.col("size") <= 3)


def is_segment() -> Column:
    return F.col("entity_type").isNull() & (F.col("text") != "")


def label_candidates(lines: DataFrame) -> DataFrame:
    return block_runs(lines, 3).filter(is_label())


def value_segments(lines: DataFrame) -> DataFrame:
    return block_runs(lines).filter(is_segment()).drop("entity_type")


# -- values -------------------------------------------------------------------
def entity_value(entity_type: Column, text: Column) -> Column:
    """Value of a segment for a type: ids alphanumeric, accounts digits, balances amounts."""
    amount = F.regexp_extract(text, AMOUNT_IN_TEXT, 1)
    found = F.when(amount != "", F.replace(amount, F.lit(","), F.lit(""))).otherwise(text)
    balance = F.when(found.rlike("^(22|33|77)"), F.substring(found, 2, 2147483647)).otherwise(found)
    return (
        F.when(entity_type.isin("CUSTOMER_ID", "IFSC"), F.regexp_replace(F.upper(text), "[^A-Z0-9]", ""))
        .when(entity_type == "BANK_ACCOUNT", F.regexp_replace(text, r"[^\p{Nd}]", ""))
        .when(entity_type == "ACCOUNT_BALANCE", balance)
        .otherwise(F.upper(text))
    )


def _valid_name(value: Column) -> Column:
    return (
        ~F.arrays_overlap(F.split(value, r"\s+"), words(NAME_FORBIDDEN_TOKENS))
        & ~only_masking(value)
        & value.rlike(r"^[A-Z][A-Z .'-]*(?:\s+[A-Z][A-Z .'-]*)+$")
    )


def validation_confidence(entity_type: Column, value: Column, text: Column, line_text: Column) -> Column:
    """How well a value fits its type; 0 when it does not."""
    customer = value.rlike("^[A-Z0-9]{5,15}$") & value.rlike("[0-9]")
    account = value.rlike(r"^\p{Nd}{9,18}$") & ~contains_any(F.lower(line_text), TRANSACTION_KEYWORDS)
    place = (F.contains(value, F.lit(",")) & ~F.rtrim(value).endswith(",")) | (F.size(F.split(value, r"\s+")) >= 3)
    branch = value.rlike("^[A-Z][A-Z ,.'-]+$") & (F.length(value) >= 6) & place
    score = (
        F.when(entity_type == "CUSTOMER_ID",
               F.when(customer, F.when(value.rlike("[A-Z]"), 0.98).otherwise(0.78)))
        .when(entity_type == "BANK_ACCOUNT", F.when(account, 0.97))
        .when(entity_type == "IFSC", F.when(value.rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), 0.99))
        .when(entity_type == "ACCOUNT_BALANCE", F.when(text.rlike(AMOUNT_IN_TEXT), 0.95))
        .when(entity_type == "ACCOUNT_HOLDER_NAME", F.when(_valid_name(value), 0.94))
        .when(entity_type == "BRANCH_NAME", F.when(branch, 0.92))
    )
    return F.coalesce(score, F.lit(0.0)).cast("double")


def validation_reason(entity_type: Column, value: Column, validation: Column) -> Column:
    """What ``validation_confidence`` saw in a value."""
    name = F.when(F.arrays_overlap(F.split(value, r"\s+"), words(NAME_FORBIDDEN_TOKENS)), NAME_WORD_REASON).when(
        only_masking(value), NAME_MASK_REASON
    )
    reason = F.when((entity_type == "CUSTOMER_ID") & (validation > 0) & ~value.rlike("[A-Z]"), NUMERIC_CUSTOMER_REASON)
    for kind, fits, fails in VALUE_REASONS:
        failed = F.coalesce(name, F.lit(fails)) if kind == "ACCOUNT_HOLDER_NAME" else F.lit(fails)
        reason = reason.when(entity_type == kind, F.when(validation > 0, fits).otherwise(failed))
    return reason


def _relations(label, seg) -> tuple[Column, Column, Column]:
    """Whether two runs share a block, stand in a row, or stand one below the other."""
    shared = F.arrays_overlap(label("block_indices"), seg("block_indices"))
    same_row = F.abs(seg("cy") - label("cy")) <= F.greatest(label("height"), seg("height")) * 0.75
    right = seg("x1") >= label("x2") - 2
    gap = F.greatest(F.lit(0.0), seg("y1") - label("y2"))
    dx = F.abs(seg("x1") - label("x1"))
    overlap = F.greatest(
        F.lit(0.0), F.least(label("x2"), seg("x2")) - F.greatest(label("x1"), seg("x1"))
    )
    ratio = overlap / F.greatest(F.lit(1.0), F.least(label("width"), seg("width")))
    aligned = (
        (ratio >= 0.25)
        | (dx <= F.greatest(F.lit(55.0), label("width") * 0.65))
        | (F.abs(seg("cx") - label("cx")) <= F.greatest(F.lit(75.0), label("width")))
    )
    below = (seg("cy") > label("cy")) & (gap <= F.greatest(F.lit(110.0), label("height") * 5))
    return shared, same_row & right, below & aligned


def spatial_confidence(label, seg) -> Column:
    """How well a segment sits right of or below a label; 0 when it does not."""
    shared, in_row, under_it = _relations(label, seg)
    gap = F.greatest(F.lit(0.0), seg("y1") - label("y2"))
    dx = F.abs(seg("x1") - label("x1"))
    beside = F.lit(0.88) - F.least(F.greatest(F.lit(0.0), seg("x1") - label("x2")) / 350.0, F.lit(0.45))
    under = F.lit(0.94) - F.least(gap / 180.0, F.lit(0.40)) - F.least(dx / 500.0, F.lit(0.15))
    # Most pairs are far apart; only near ones are asked whether they share a block.
    return (
        F.when(~(in_row | under_it), 0.0)
        .when(shared, 0.0)
        .when(in_row, F.greatest(F.lit(0.2), beside))
        .when(under_it, F.greatest(F.lit(0.25), under))
        .otherwise(0.0)
    )


def spatial_reason(label, seg) -> Column:
    """How a segment stands to a label."""
    shared, in_row, under_it = _relations(label, seg)
    return (
        F.when(shared, SAME_BLOCK_RELATION)
        .when(in_row, BESIDE_RELATION)
        .when(under_it, BELOW_RELATION)
        .otherwise(FAR_RELATION)
    )


def combined(extraction: Column, spatial: Column, validation: Column) -> Column:
    total = extraction * 0.25 + spatial * 0.35 + validation * 0.40
    both = (validation > 0) & (spatial > 0)
    return rounded(F.least(F.lit(0.99), F.when(both, total).otherwise(0.0)), 4)


def _bands(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / BAND), F.floor(high / BAND))


def neighbour_pairs(runs: DataFrame) -> DataFrame:
    """Labels with the segments near enough to be their value: structs ``l`` and ``s``.

    A label reaches from its own row down to the furthest accepted gap, a segment over
    the rows it may share.  Two that can match overlap, so they meet in a band; the
    lowest common band reports the pair once.  Labels and segments come from the same
    rows, so the meeting is a window over the band, not a self-join.
    """
    label = is_label()
    own_row = F.col("height") * 0.75
    reach = F.greatest(F.lit(140.0), F.col("height") * 5)
    low = F.floor((F.col("cy") - own_row) / BAND)
    high = F.floor(
        F.when(label, F.greatest(F.col("y2") + reach, F.col("cy") + own_row)).otherwise(
            F.col("cy") + own_row
        )
        / BAND
    )
    fields = [c for c in runs.columns if c != "screen_id"]
    banded = runs.filter(label | is_segment()).select(
        "screen_id", label.alias("_label"), F.struct(*fields).alias("s"), low.alias("_first"),
        F.explode(F.sequence(low, high)).alias("_band"),
    )
    here = Window.partitionBy("screen_id", "_band")
    labels = F.collect_list(F.when(F.col("_label"), F.struct("_first", F.col("s").alias("l")))).over(here)
    met = banded.withColumn("_labels", labels).filter(~F.col("_label"))
    rows = explode_rows(met, "_labels", "m", "screen_id", "s", "_first", "_band")
    return rows.filter(F.col("_band") == F.greatest("_first", "m._first")).select(
        "screen_id", F.col("m.l").alias("l"), "s"
    )


def score_pairs(runs: DataFrame) -> DataFrame:
    """Value, validation, spatial and combined confidence of every neighbouring pair."""
    label, seg = (lambda f: F.col(f"l.{f}")), (lambda f: F.col(f"s.{f}"))
    valued = neighbour_pairs(runs).withColumn("value", entity_value(label("entity_type"), seg("text")))
    scored = valued.select(
        "*",
        rounded(validation_confidence(label("entity_type"), F.col("value"), seg("text"), seg("line_text")), 4)
        .alias("validation"),
        spatial_confidence(label, seg).alias("_spatial"),
    )
    return scored.select(
        "screen_id", "l", "s", "value", "validation",
        rounded(F.col("_spatial"), 4).alias("spatial"),
        combined(seg("confidence"), F.col("_spatial"), F.col("validation")).alias("combined"),
        ((F.col("_spatial") > 0) & (F.col("validation") > 0)).alias("accepted"),
        F.array_compact(
            F.array(
                F.when(
                    F.col("validation") <= 0,
                    validation_reason(label("entity_type"), F.col("value"), F.col("validation")),
                ),
                F.when(F.col("_spatial") <= 0, spatial_reason(label, seg)),
            )
        ).alias("rejection_reasons"),
    )


def _pick(pairs: DataFrame, *picks: tuple[Column, Column]) -> DataFrame:
    """Picked pairs of each label, one aggregation for all of them.

    A pick is a condition and an aggregate over the pairs that meet it.  Pairs that meet none
    are dropped before they are sorted by label; a label without picked pairs leaves no row.
    """
    wanted = reduce(or_, [condition for condition, _ in picks])
    key = [F.col("l.line_index").alias("_k1"), F.col("l.first").alias("_k2"), F.col("l.size").alias("_k3")]
    picked = F.array_compact(F.array(*[pick for _, pick in picks]))
    grouped = pairs.filter(wanted).groupBy("screen_id", *key).agg(picked.alias("picked"))
    return explode_rows(grouped, "picked", "p", "screen_id").select("screen_id", "p.*")


def _picked_struct(value: Column, validation, spatial, score: Column, inferred: bool) -> Column:
    return F.struct(
        "l", "s", value.alias("value"), validation.cast("double").alias("validation"),
        spatial.cast("double").alias("spatial"), score.alias("combined"),
        F.lit(inferred).alias("inferred"),
    )


def _best_value() -> tuple[Column, Column]:
    """The best accepted pair; ties go to the earlier segment."""
    order = F.struct(
        F.col("combined"), F.col("spatial"), F.col("validation"),
        (-F.col("s.line_index")).alias("a"), (-F.col("s.first")).alias("b"), (-F.col("s.size")).alias("c"),
    )
    pair = _picked_struct(F.col("value"), F.col("validation"), F.col("spatial"), F.col("combined"), False)
    return F.col("accepted"), F.max_by(pair, F.when(F.col("accepted"), order))


def _holder_name() -> tuple[Column, Column]:
    """The first valid name below an account-number label."""
    name = F.upper("s.text")
    fits = (
        (F.col("l.entity_type") == "BANK_ACCOUNT")
        & (F.col("s.cy") > F.col("l.cy"))
        & (F.col("s.y1") - F.col("l.y2") <= 140)
        & (F.col("s.x1") >= F.col("l.x1") - 50)
        & (F.col("s.x1") <= F.col("l.x2") + 450)
        & _valid_name(name)
    )
    order = F.struct(
        F.col("s.y1"), F.abs(F.col("s.x1") - F.col("l.x1")).alias("dx"), F.col("s.line_index"),
        F.col("s.first"), F.col("s.size"),
    )
    score = rounded(
        F.least(F.lit(0.99), F.col("s.confidence") * 0.25 + F.lit(0.85) * 0.35 + F.lit(0.94) * 0.40), 4
    )
    pair = _picked_struct(name, F.lit(0.94), F.lit(0.85), score, True)
    return fits, F.min_by(pair, F.when(fits, order))


def best_value_per_label(pairs: DataFrame) -> DataFrame:
    return _pick(pairs, _best_value())


def infer_holder_name(pairs: DataFrame) -> DataFrame:
    return _pick(pairs, _holder_name())


def span_of_value(picked: DataFrame, screens: DataFrame) -> DataFrame:
    """Offsets of a picked value: in its line, through its segment, in the text, at the line."""
    joined = picked.join(screens.select("screen_id", "full_text"), "screen_id", "left")
    line, seg, value = F.col("s.line_text"), F.col("s.text"), F.col("value")
    in_line, seg_at, in_seg = F.instr(line, value), F.instr(line, seg), F.instr(seg, value)
    in_text = F.instr(F.col("full_text"), value)
    base = F.col("s.line_start")
    start = (
        F.when(in_line > 0, base + in_line - 1)
        .when((seg_at > 0) & (in_seg > 0), base + seg_at - 1 + in_seg - 1)
        .when(seg_at > 0, base + seg_at - 1)
        .when(in_text > 0, in_text - 1)
        .otherwise(base)
    )
    length = F.when((in_line <= 0) & (seg_at > 0) & (in_seg <= 0), F.length(seg)).otherwise(F.length(value))
    return (
        joined.withColumn("start", start.cast("int"))
        .withColumn("end", (start + length).cast("int"))
        .drop("full_text")
    )


def place_of_value() -> Column:
    """Where a picked value and its label stand, and why they go together."""
    label, seg = (lambda f: F.col(f"l.{f}")), (lambda f: F.col(f"s.{f}"))
    relation = F.when(F.col("inferred"), INFERRED_RELATION).otherwise(spatial_reason(label, seg))
    name = F.when(F.col("inferred"), INFERRED_LABEL).otherwise(label("text"))
    form = validation_reason(label("entity_type"), F.col("value"), F.col("validation"))
    return F.struct(
        name.alias("label"), relation.alias("relation"),
        F.when(F.col("inferred"), filled(INFERENCE_REASON, name, F.col("value"), F.lit(INFERRED_MAPPING)))
        .otherwise(filled(ASSOCIATION_REASON, name, F.col("value"), F.concat(relation, F.lit("; "), form)))
        .alias("reason"),
        F.array_sort(F.array_distinct(F.array(label("line_index"), seg("line_index")))).alias("line_indices"),
        F.concat(label("line_text"), F.lit("\n"), seg("line_text")).alias("context_text"),
        label("block_indices").alias("label_block_indices"), seg("block_indices").alias("value_block_indices"),
        *[seg(c).alias(c) for c in ("x1", "y1", "x2", "y2")],
    )


def layout_entities(lines: DataFrame, screens: DataFrame) -> DataFrame:
    """Layout matches in the common match shape, best first, one per type and value; ``place`` says where and why."""
    found = _pick(score_pairs(block_runs(lines)), _best_value(), _holder_name())
    placed = span_of_value(found, screens)
    kind = F.when(F.col("inferred"), "ACCOUNT_HOLDER_NAME").otherwise(F.col("l.entity_type"))
    order = [
        F.col("combined").desc(), F.col("l.line_index"), F.col("l.first"), F.col("l.size"), F.col("inferred"),
    ]
    same = Window.partitionBy("screen_id", "pii_type", normalised_value(F.col("value"))).orderBy(*order)
    rank = Window.partitionBy("screen_id").orderBy(*order)
    once = (
        placed.withColumn("pii_type", kind)
        .withColumn("_nth", F.row_number().over(same))
        .filter(F.col("_nth") == 1)
        .withColumn("_rank", F.row_number().over(rank).cast("int"))
    )
    return once.select(
        "screen_id",
        F.struct(
            F.lit(STAGE_LAYOUT).alias("stage"), F.col("_rank").alias("line"), F.lit(0).alias("rule"),
            F.col("start").alias("start"),
        ).alias("ord"),
        "pii_type", "value", "start", "end", F.col("combined").alias("confidence"),
        F.lit(False).alias("masked"), F.lit("LayoutMapping").alias("source_rule"),
        F.col("s.line_index").alias("line"), F.col("s.line_index").alias("last_line"),
        text_bits(F.col("l.line_text")).bitwiseOR(text_bits(F.col("s.line_text"))).alias("ctx"),
        F.col("s.confidence").alias("ocr_confidence"), F.lit(True).alias("is_layout"),
        F.col("spatial").alias("spatial_confidence"), F.col("validation").alias("validation_confidence"),
        F.col("l.text").alias("label"), F.col("s.block_indices").alias("value_block_indices"),
        place_of_value().alias("place"),
    )


def _forms(text: Column) -> dict[str, Column]:
    """The forms that ``entity_value`` gives a text, each under the first type that has it."""
    first = {"alphanumeric": "CUSTOMER_ID", "digits": "BANK_ACCOUNT", "amount": "ACCOUNT_BALANCE", "upper": "ACCOUNT_HOLDER_NAME"}
    return {name: entity_value(F.lit(kind), text) for name, kind in first.items()}


def _form_of(kind):
    """What picks the form of a type: ``entity_value`` without working it out again."""
    if isinstance(kind, str):
        return {"CUSTOMER_ID": "alphanumeric", "IFSC": "alphanumeric", "BANK_ACCOUNT": "digits", "ACCOUNT_BALANCE": "amount"}.get(kind, "upper")
    return lambda forms: (
        F.when(kind.isin("CUSTOMER_ID", "IFSC"), forms["alphanumeric"])
        .when(kind == "BANK_ACCOUNT", forms["digits"])
        .when(kind == "ACCOUNT_BALANCE", forms["amount"])
        .otherwise(forms["upper"])
    )


def with_fits(runs: DataFrame) -> DataFrame:
    """Runs with ``fits``: the value and validation of a segment for every type, worked out once per segment.

    Runs are rows here, so this compiles; what compares segments with labels only looks it up.
    """
    segment = is_segment()
    forms = runs.select("*", *[F.when(segment, v).alias(f"_{n}") for n, v in _forms(F.col("text")).items()])
    checked = forms.select(
        "*",
        *[
            validation_confidence(F.lit(t), F.col(f"_{_form_of(t)}"), F.col("text"), F.col("line_text")).alias(f"_{t}")
            for t in LABEL_TYPES
        ],
    )
    names = list(_forms(F.col("text")))
    fits = F.struct(
        *[F.col(f"_{n}").alias(n) for n in names],
        F.array(*[rounded_column(f"_{t}") for t in LABEL_TYPES]).alias("validations"),
    )
    return checked.select(*runs.columns, F.when(segment, fits).alias("fits"))


def layout_decisions(lines: DataFrame, top: int | None = None) -> DataFrame:
    """Per label: number of candidates, the ranked ones (all, or the ``top``), and the selected one.

    A report of everything considered, so a label is scored against all segments of
    its screen; they travel as one array and no row is made per pair.
    """
    runs = block_runs(lines)
    label_fields = [c for c in runs.columns if c != "screen_id"]
    fields = ["text", "block_indices", "x1", "y1", "x2", "y2", "cx", "cy", "width", "height", "confidence", "fits"]
    order = F.struct("line_index", "first", "size", F.struct(*fields).alias("s"))
    own = F.struct(*label_fields)
    # Labels and segments of a screen come from one reading of its lines.
    per_screen = with_fits(runs.filter(is_label() | is_segment())).groupBy("screen_id").agg(
        F.collect_list(F.when(is_label(), own)).alias("labels"),
        F.sort_array(F.collect_list(F.when(is_segment(), order))).alias("segs"),
    )
    known = F.when(F.col("screen_id").isNotNull(), F.col("segs")).alias("segs")
    joined = explode_rows(per_screen, "labels", "l", "screen_id", known)
    label = lambda f: F.col(f"l.{f}")
    place = F.array_position(words(LABEL_TYPES), label("entity_type")).cast("int")

    def scored(o, i, kind):
        s = o["s"]
        validation = F.element_at(s["fits"]["validations"], kind)

        def entry(spatial):
            accepted = (validation > 0) & (spatial > 0)
            total = F.when(accepted, combined(s["confidence"], spatial, validation)).otherwise(0.0)
            return F.struct(
                (~accepted).alias("rejected"),
                (-total).alias("negative_combined"),
                (-F.when(spatial > 0, rounded(spatial, 4)).otherwise(0.0)).alias("negative_spatial"),
                (-validation).alias("negative_validation"),
                i.alias("position"),
                s["text"].alias("candidate_text"),
                _form_of(label("entity_type"))(s["fits"]).alias("value"),
            )

        # Bound, so that it is worked out once per segment.
        return let(spatial_confidence(label, lambda f: s[f]), entry)

    segs = F.coalesce("segs", F.slice("segs", 1, 0))
    ranked = F.sort_array(let(place, lambda kind: F.transform(segs, lambda o, i: scored(o, i, kind))))
    staged = joined.select(
        "screen_id", label("entity_type").alias("entity_type"), label("text").alias("label"),
        label("line_index").alias("label_line"), label("first").alias("label_first"),
        label("size").alias("label_size"), ranked.alias("ranked"),
    )
    best = F.element_at("ranked", 1)
    return staged.select(
        "screen_id", "entity_type", "label", "label_line", "label_first", "label_size",
        F.size("ranked").alias("candidate_count"),
        (F.slice("ranked", 1, top) if top else F.col("ranked")).alias("candidates"),
        F.when(~best["rejected"], best["value"]).alias("selected_value"),
        F.when(~best["rejected"], -best["negative_combined"]).alias("selected_confidence"),
    )
