"""Matches that need surrounding words: balances, customer ids, references, names, amounts.

A screen's lines are the newline-separated pieces of its text.  What a rule asks
about the neighbourhood of a match is "does the line before, this line or the next
contain one of these words", so every line gets one bit per word and a match gets
the union of the bits around it.  No text is copied per match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.catalogs import (
    AADHAAR_KEYWORDS,
    ACCOUNT_KEYWORDS,
    AMOUNT_PATTERN,
    BALANCE_PATTERN,
    BANKING_KEYWORDS,
    CAPITAL_NAME_PATTERN,
    CUSTOMER_ID_PATTERN,
    DATE_AMOUNT_ROW_PATTERN,
    DATED_LINE_PATTERN,
    HISTORY_DOCUMENT_TYPES,
    LABELLED_REF_PATTERN,
    LINE_REF_PATTERN,
    LONG_NUMBER_PATTERN,
    NAME_FORBIDDEN_TOKENS,
    NAME_STOP_PHRASES,
    TRANSACTION_KEYWORDS,
    UPI_CHAIN_PATTERN,
    UPI_PATH_PATTERN,
)
from veilscan.functions.regex import let, matches
from veilscan.functions.text import keyword_hits, quoted, strip, words
from veilscan.operators.classify import DOCUMENT_KEYWORDS, document_type_of
from veilscan.operators.detectors import (
    MATCH_COLUMNS,
    STAGE_LINE_REF,
    MatchRule,
    found_spans,
    found_struct,
    match_rows,
    with_guards,
)

CONTEXT_WORDS = list(dict.fromkeys([*BANKING_KEYWORDS, *AADHAAR_KEYWORDS, *ACCOUNT_KEYWORDS]))
ROW_BIT = len(CONTEXT_WORDS)

# Order of the contextual stages, after all detectors; STAGE_LINE_REF is 103.
STAGE_LAYOUT, STAGE_BALANCE, STAGE_CUSTOMER = 100, 101, 102
STAGE_UPI_PATH, STAGE_LABELLED, STAGE_HISTORY, STAGE_NAME, STAGE_AMOUNT = 104, 105, 106, 107, 108
ROW_NUMBER_RULE = 2

CONTEXT_RULES = [
    MatchRule("ACCOUNT_BALANCE", BALANCE_PATTERN, True, 0.85, "Context", STAGE_BALANCE,
              group=True, digits=1),
    MatchRule("CUSTOMER_ID", CUSTOMER_ID_PATTERN, True, 0.82, "Context", STAGE_CUSTOMER,
              group=True, digits=1, needs=("customer", "cust", "cif", "crn")),
    MatchRule("TRANSACTION_REFERENCE", UPI_CHAIN_PATTERN, True, 0.96,
              "TransactionContext:UPIChain", STAGE_LINE_REF, group=True, in_line=True, rule=0,
              needs=("upi", "imps", "neft", "rtgs")),
    MatchRule("TRANSACTION_REFERENCE", LINE_REF_PATTERN, True, 0.91,
              "TransactionContext:LabeledRef", STAGE_LINE_REF, group=True, in_line=True, rule=1,
              needs=("txn", "transaction", "ref", "utr", "rrn")),
    MatchRule("TRANSACTION_REFERENCE", LONG_NUMBER_PATTERN, False, 0.91,
              "TransactionContext:BankingRowNumber", STAGE_LINE_REF, group=True, in_line=True,
              rule=ROW_NUMBER_RULE, digits=9),
    MatchRule("TRANSACTION_REFERENCE", UPI_PATH_PATTERN, True, 0.95, "Pattern", STAGE_UPI_PATH,
              group=True, digits=9, needs=("/",)),
    MatchRule("TRANSACTION_REFERENCE", LABELLED_REF_PATTERN, True, 0.88, "Context", STAGE_LABELLED,
              group=True, needs=("txn id", "ref no", "reference", "utr")),
    MatchRule("ACCOUNT_HOLDER_NAME", CAPITAL_NAME_PATTERN, False, 0.30, "Context", STAGE_NAME,
              in_line=True),
    MatchRule("TRANSACTION_AMOUNT", AMOUNT_PATTERN, True, 0.75, "Context", STAGE_AMOUNT, digits=1),
]


# -- context bits -------------------------------------------------------------
def mask_of(keywords: list[str]) -> int:
    return sum(1 << CONTEXT_WORDS.index(k) for k in keywords)


def _has_bits(ctx: Column, bits: int) -> Column:
    return ctx.bitwiseAND(F.lit(bits).cast("long")) != 0


def context_has(ctx: Column, keywords: list[str]) -> Column:
    """Whether a context holds any of the keywords."""
    return _has_bits(ctx, mask_of(keywords))


def _keyword_bits(keywords: list[str]) -> Column:
    pairs = [f"struct({quoted(k)} AS k, {mask_of([k])}L AS b)" for k in keywords]
    return F.expr(f"array({', '.join(pairs)})")


def context_words(ctx: Column, keywords: list[str]) -> Column:
    """The keywords a context holds, in the order given."""
    held = F.filter(_keyword_bits(keywords), lambda p: ctx.bitwiseAND(p["b"]) != 0)
    return F.transform(held, lambda p: p["k"])


def has_transaction_context(ctx: Column) -> Column:
    return context_has(ctx, TRANSACTION_KEYWORDS)


def transaction_keyword_hits(text: Column) -> Column:
    """Sorted transaction keywords contained in a text."""
    return keyword_hits(F.lower(text), sorted(TRANSACTION_KEYWORDS))


NO_BITS = "CAST(0 AS BIGINT)"


def text_bits(text: Column) -> Column:
    """Context bits of one piece of text."""
    found = let(
        F.lower(text),
        lambda low: F.aggregate(
            F.filter(_keyword_bits(CONTEXT_WORDS), lambda p: F.contains(low, p["k"])),
            F.expr(NO_BITS),
            lambda acc, p: acc.bitwiseOR(p["b"]),
        ),
    )
    row = F.when(matches(text, DATE_AMOUNT_ROW_PATTERN, True), F.lit(1 << ROW_BIT).cast("long"))
    return found.bitwiseOR(F.coalesce(row, F.expr(NO_BITS)))


def line_bits(text: Column) -> Column:
    """Context bits of every line."""
    return F.transform(F.split(text, "\n", -1), text_bits)


def slice_around(values: Column, line: Column, last_line: Column, window: int = 1) -> Column:
    """Elements of a per-line array for lines ``line - window .. last_line + window``."""
    first = F.greatest(line - window, F.lit(0))
    return F.slice(values, first + 1, last_line + window - first + 1)


def _union(bits: Column) -> Column:
    return F.aggregate(bits, F.expr(NO_BITS), lambda a, b: a.bitwiseOR(b))


def with_surroundings(found: Column, bits: Column, line_conf: Column | None = None) -> Column:
    """``found_spans`` with what stands around each span, worked out while the text is at hand.

    ``ctx`` is the union of the context bits of a match's lines and their neighbours,
    ``near`` the mean confidence of the blocks on those lines (NULL without ``line_conf``).
    Each line's bits are first joined with its neighbours', so a match looks at one entry.
    """

    def neighbours(b):
        side = lambda i: F.coalesce(F.get(b, i), F.expr(NO_BITS))
        return F.transform(b, lambda x, i: x.bitwiseOR(side(i - 1)).bitwiseOR(side(i + 1)))

    def near(s):
        if line_conf is None:
            return F.lit(None).cast("double")
        lines = slice_around(line_conf, s["line"], s["last_line"])
        total = F.aggregate(lines, F.lit(0.0), lambda a, c: a + c["total"])
        return total / F.aggregate(lines, F.lit(0), lambda a, c: a + c["blocks"])

    def span(around, s):
        one = F.get(around, s["line"])
        many = _union(F.slice(around, s["line"] + 1, s["last_line"] - s["line"] + 1))
        ctx = F.when(s["line"] == s["last_line"], one).otherwise(many)
        return F.struct(
            *[s[n].alias(n) for n in ("start", "end", "value", "line", "last_line")],
            F.coalesce(ctx, F.expr(NO_BITS)).alias("ctx"),
            near(s).alias("near"),
        )

    names = ["pii_type", "confidence", "masked", "source_rule", "stage", "rule"]

    def each(around):
        return F.transform(
            found,
            lambda c: F.struct(
                *[c[n].alias(n) for n in names],
                F.transform(c["spans"], lambda s: span(around, s)).alias("spans"),
            ),
        )

    return let(let(bits, neighbours), each)


# -- row rules of the contextual kinds ---------------------------------------
def balance_value(raw: Column) -> Column:
    """A doubled leading 2, 3 or 7 is a misread rupee sign; only then commas go too."""
    plain = F.replace(raw, F.lit(","), F.lit(""))
    return F.when(plain.rlike("^(22|33|77)"), F.substring(plain, 2, 2147483647)).otherwise(raw)


def plausible_customer_id(value: Column) -> Column:
    plain = F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")
    return plain.rlike("^[A-Z0-9]{5,15}$") & plain.rlike("[0-9]")


def only_masking(name: Column) -> Column:
    """Whether a name is blank or nothing but X and * once spaces, dots and dashes are gone."""
    return F.translate(F.upper(name), " .-X*", "") == ""


def acceptable_name(name: Column) -> Column:
    """At least two words, not a known phrase, no banking word, not mere masking."""
    tokens = F.split(name, r"\s+")
    return (
        (F.size(tokens) >= 2)
        & ~only_masking(name)
        & ~name.isin(NAME_STOP_PHRASES)
        & ~F.arrays_overlap(tokens, words(NAME_FORBIDDEN_TOKENS))
    )


def dated_lines(text: Column) -> Column:
    """Number of lines with a date."""
    dated = F.filter(F.split(text, "\n", -1), lambda line: matches(line, DATED_LINE_PATTERN, True))
    return F.size(dated)


HISTORY_RULE = MatchRule("TRANSACTION_HISTORY", "", False, 0.85, "Pattern", STAGE_HISTORY)


def history_found(text: Column, hits: Column | None = None) -> Column:
    """TRANSACTION_HISTORY over the whole of a statement with at least three dated lines.

    Shaped like the elements of ``found_spans``; NULL for other texts.  ``hits`` are keywords already
    found in the text, those of ``DOCUMENT_KEYWORDS`` among them.
    """
    held = keyword_hits(F.lower(text), DOCUMENT_KEYWORDS) if hits is None else hits
    qualifies = let(held, lambda h: document_type_of(h).isin(HISTORY_DOCUMENT_TYPES))
    count = F.when((F.col("_digits") >= 1) & qualifies, dated_lines(text))

    def whole(n):
        span = F.struct(
            F.lit(0).alias("start"),
            F.length(text).alias("end"),
            F.concat(n.cast("string"), F.lit(" transaction rows detected")).alias("value"),
            F.lit(0).alias("line"),
            (F.size(F.split(text, "\n", -1)) - 1).alias("last_line"),
        )
        return F.when(n >= 3, found_struct(HISTORY_RULE, "spans", F.array(span)))

    return let(count, whole)


def clean_context_rows(rows: DataFrame) -> DataFrame:
    """Row rules on raw contextual matches; ``rows`` carries ``ctx`` (context bits).

    A name is tested and kept without the blanks around it; its span stays as found.

    A reference found by several line rules at the same place counts once.
    """
    stage = F.col("ord.stage")
    rows = rows.withColumn(
        "value", F.when(stage == STAGE_NAME, strip(F.col("value"))).otherwise(F.col("value"))
    )
    value = F.col("value")
    bare_number = (stage == STAGE_LINE_REF) & (F.col("ord.rule") == ROW_NUMBER_RULE)
    payment = _has_bits(F.col("ctx"), mask_of(TRANSACTION_KEYWORDS) | (1 << ROW_BIT))
    keep = (
        F.when(stage == STAGE_CUSTOMER, plausible_customer_id(value))
        .when(stage == STAGE_NAME, acceptable_name(value))
        .when(bare_number, payment)
        .otherwise(True)
    )
    kept = rows.filter(keep).withColumn(
        "value", F.when(stage == STAGE_BALANCE, balance_value(value)).otherwise(value)
    )
    is_ref = stage == STAGE_LINE_REF
    place = Window.partitionBy("screen_id", "start", "end", is_ref).orderBy("ord")
    return (
        kept.withColumn("_nth", F.row_number().over(place))
        .filter(~is_ref | (F.col("_nth") == 1))
        .drop("_nth")
    )


def scan_columns(
    rules: list[MatchRule], history: bool = True, line_conf: Column | None = None, hits: Column | None = None
) -> dict[str, Column]:
    """``found``: spans of all rules ``with_surroundings``.

    Line bits are only worked out for texts with a run of four digits: every rule
    that asks for them is about such a number.  Needs the columns of ``with_guards``; ``hits`` as in ``history_found``.
    """
    text = F.col("full_text")
    found = found_spans(rules)
    if history:
        found = F.concat(found, F.array_compact(F.array(history_found(text, hits))))
    bits = F.when(F.col("_digits") >= 4, line_bits(text))
    return {"found": with_surroundings(found, bits, line_conf)}


def text_context(screens: DataFrame, stages: list[int] | None = None) -> DataFrame:
    """Contextual matches found in the text, all kinds or only some stages."""
    rules = [r for r in CONTEXT_RULES if stages is None or r.stage in stages]
    columns = scan_columns(rules, stages is None or STAGE_HISTORY in stages)
    scanned = with_guards(screens).select("screen_id", *[c.alias(n) for n, c in columns.items()])
    rows = match_rows(scanned, surroundings=("ctx",))
    return clean_context_rows(rows).select("screen_id", *MATCH_COLUMNS)


def contextual_entities(screens: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """All contextual matches; layout matches first, and in place of two text rules.

    ``layout`` holds layout matches (``screen_id`` and the match columns).
    """
    found = text_context(screens)
    if layout is None:
        return found
    taken = layout.select("screen_id", "pii_type").distinct()
    text_rule = F.col("ord.stage").isin(STAGE_BALANCE, STAGE_CUSTOMER)
    replaced = found.filter(text_rule).join(taken, ["screen_id", "pii_type"], "left_anti")
    return (
        layout.select("screen_id", *MATCH_COLUMNS)
        .unionByName(found.filter(~text_rule))
        .unionByName(replaced.select("screen_id", *MATCH_COLUMNS))
    )
