"""The twenty-one pattern detectors and their overlap rule."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.catalogs import DETECTOR_TYPES, DETECTORS, NON_CLAIMING_TYPE
from veilscan.functions.regex import SPAN_ARRAY, marked_pieces, piece_spans
from veilscan.functions.tables import explode_rows
from veilscan.functions.text import keyword_hits

# What a text must contain before a detector's pattern can match: a run of so many
# digits, or one of these words.  Only there to skip regex passes.
NEEDS_DIGITS = {
    "PAN": 4, "AADHAAR_MASKED": 4, "AADHAAR_UNMASKED": 4, "CREDIT_DEBIT_CARD": 4, "MASKED_CARD": 4,
    "IFSC": 1, "PASSPORT": 4, "VOTER_ID": 7, "DRIVING_LICENCE": 7, "PHONE_IN": 9, "IP_ADDRESS": 1,
    "DATE_OF_BIRTH": 1, "BANK_ACCOUNT": 9,
}
NEEDS_WORDS = {
    "UPI_HANDLE": ["@"],
    "EMAIL": ["@"],
    "_KW_CCTV": ["cctv", "surveillance", "security", "video"],
    "_KW_VOICE": ["recording", "audio"],
    "_KW_PASSWORD": ["passw", "pwd", "passphrase"],
    "_KW_COOKIE": ["cookie", "session", "auth", "bearer"],
    "_KW_PHOTOGRAPH": ["photo", "selfie", "portrait", "face"],
    "_KW_SIGNATURE": ["sign"],
}
DIGIT_STEPS = [4, 7, 9]
# Words that guard a rule here or in operators.context.
GUARD_WORDS = list(
    dict.fromkeys(
        [*[w for ws in NEEDS_WORDS.values() for w in ws], "customer", "cust", "cif", "crn", "upi",
         "imps", "neft", "rtgs", "txn", "transaction", "ref", "utr", "rrn", "/", "txn id", "ref no",
         "reference"]
    )
)


@dataclass(frozen=True)
class MatchRule:
    """One pattern and what its matches are called."""

    pii_type: str
    pattern: str
    ignore_case: bool
    confidence: float
    source_rule: str
    stage: int
    masked: bool = False
    group: bool = False
    in_line: bool = False
    rule: int = 0
    digits: int = 0
    needs: tuple[str, ...] = ()

    def guard(self) -> Column:
        """Cheap condition that every matching text meets."""
        guard = F.col("_digits") >= self.digits
        if self.needs:
            # A few look-ups in a short array: cheaper than the set that an overlap builds per text.
            guard = guard & reduce(or_, [F.array_contains("_words", w) for w in self.needs])
        return guard


DETECTOR_RULES = [
    MatchRule(
        pii_type, pattern, ignore_case, confidence, "Regex", priority, masked,
        digits=NEEDS_DIGITS.get(pii_type, 0), needs=tuple(NEEDS_WORDS.get(pii_type, ())),
    )
    for priority, (pii_type, pattern, ignore_case, confidence, masked) in enumerate(DETECTORS)
]


def with_guards(screens: DataFrame, also: list[str] | None = None) -> DataFrame:
    """What the guards ask for, worked out once per text.

    ``_lower``, ``_fold`` (case-blind form), ``_words`` (of ``GUARD_WORDS`` and ``also``,
    those ``_fold`` contains) and ``_digits`` (step of the longest digit run).
    """
    text = F.col("full_text")
    digits = F.when(~text.rlike(r"\p{Nd}"), 0)
    for low, high in zip([1, *DIGIT_STEPS], DIGIT_STEPS):
        digits = digits.when(~text.rlike(rf"\p{{Nd}}{{{high}}}"), low)
    lowered = screens.select(
        "*", F.lower(text).alias("_lower"), digits.otherwise(DIGIT_STEPS[-1]).alias("_digits")
    )
    folded = lowered.withColumn("_fold", F.translate("_lower", "ſı̇", "si"))
    listed = list(dict.fromkeys([*GUARD_WORDS, *(also or [])]))
    return folded.withColumn("_words", keyword_hits(F.col("_fold"), listed))


FOUND_TYPE = (
    "array<struct<pii_type:string,confidence:double,masked:boolean,source_rule:string,"
    "stage:int,rule:int,spans:" + SPAN_ARRAY + ">>"
)


def found_struct(rule: MatchRule, name: str, content: Column) -> Column:
    """What to call a rule's matches, and where they are."""
    return F.struct(
        F.lit(rule.pii_type).alias("pii_type"),
        F.lit(rule.confidence).alias("confidence"),
        F.lit(rule.masked).alias("masked"),
        F.lit(rule.source_rule).alias("source_rule"),
        F.lit(rule.stage).alias("stage"),
        F.lit(rule.rule).alias("rule"),
        content.alias(name),
    )


def found_spans(rules: list[MatchRule]) -> Column:
    """Per rule with a hit in the text: what to call the matches, and their spans.

    All patterns run in this one projection, so a text is read once.
    """
    if not rules:
        return F.array().cast(FOUND_TYPE)
    cut = [
        found_struct(
            r, "pieces",
            marked_pieces(
                F.col("full_text"), r.pattern, r.ignore_case, group=r.group, in_line=r.in_line,
                guard=r.guard(),
            ),
        )
        for r in rules
    ]
    kept = F.filter(F.array(*cut), lambda c: c["pieces"].isNotNull())
    names = ["pii_type", "confidence", "masked", "source_rule", "stage", "rule"]
    return F.transform(
        kept, lambda c: F.struct(*[c[n].alias(n) for n in names], piece_spans(c["pieces"]).alias("spans"))
    )


MATCH_COLUMNS = [
    "ord", "pii_type", "value", "start", "end", "confidence", "masked", "source_rule", "line",
    "last_line",
]


def match_rows(scanned: DataFrame, *keep: str, surroundings: tuple[str, ...] = ()) -> DataFrame:
    """Raw matches of texts whose ``found`` column holds ``found_spans``.

    ``ord`` places a match among all of its screen: stage, then line and rule where a
    stage goes line by line, then offset.  ``surroundings`` are further fields of the
    spans.  Rows carry scalars only, so a text with many hits makes many small rows.
    """
    scalars = ["pii_type", "confidence", "masked", "source_rule", "stage", "rule"]
    per_rule = explode_rows(scanned, "found", "c", "screen_id", *keep).select(
        "screen_id", *keep, *[f"c.{n}" for n in scalars], F.col("c.spans").alias("spans")
    )
    rows = explode_rows(per_rule, "spans", "s", "screen_id", *keep, *scalars)
    by_line = F.col("stage") == STAGE_LINE_REF
    return rows.select(
        "screen_id",
        F.struct(
            "stage",
            F.when(by_line, F.col("s.line")).otherwise(0).alias("line"),
            "rule",
            F.col("s.start").alias("start"),
        ).alias("ord"),
        "pii_type", "s.value", "s.start", "s.end", "confidence", "masked", "source_rule",
        "s.line", "s.last_line", *[f"s.{n}" for n in surroundings], *keep,
    )


# The stage whose matches are ordered line by line (see operators.context).
STAGE_LINE_REF = 103


def detect(screens: DataFrame, pii_type: str) -> DataFrame:
    """All matches of one detector, on its own."""
    rule = DETECTOR_RULES[DETECTOR_TYPES.index(pii_type)]
    return match_rows(with_guards(screens).select("screen_id", found_spans([rule]).alias("found")))


def overlapping(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def suppress_overlaps(matches: DataFrame) -> DataFrame:
    """Greedy priority rule: a detector match is dropped if it overlaps one accepted earlier.

    Matches of a screen are first split into clusters that no span crosses, so the
    fold only ever sees the few matches of one cluster, however many a text has.
    Contextual matches (later stages) pass through.
    """
    detector = F.col("ord.stage") < len(DETECTORS)
    place = Window.partitionBy("screen_id", "_detector").orderBy("start", "end", "ord")
    so_far = place.rowsBetween(Window.unboundedPreceding, -1)
    up_to = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.when(F.col("_detector") & (F.col("start") < F.col("_reach")), 0).otherwise(1)
    payload = [c for c in matches.columns if c not in ("screen_id", "ord")]
    clusters = (
        matches.withColumn("_detector", detector)
        .withColumn("_reach", F.max("end").over(so_far))
        .withColumn("_cluster", F.sum(opens).over(up_to))
        .groupBy("screen_id", "_detector", "_cluster")
        .agg(F.array_sort(F.collect_list(F.struct("ord", *payload))).alias("ms"))
    )

    def step(accepted, m):
        blocked = F.exists(
            accepted, lambda a: (a["pii_type"] != NON_CLAIMING_TYPE) & overlapping(a, m)
        )
        return F.when(blocked, accepted).otherwise(F.concat(accepted, F.array(m)))

    accepted = F.when(F.size("ms") == 1, F.col("ms")).otherwise(
        F.aggregate("ms", F.slice("ms", 1, 0), step)
    )
    kept = clusters.select("screen_id", accepted.alias("ms"))
    return explode_rows(kept, "ms", "m", "screen_id").select("screen_id", "m.*")


def detect_all(screens: DataFrame, types: list[str] | None = None) -> DataFrame:
    """All detectors in priority order with overlaps suppressed."""
    rules = [r for r in DETECTOR_RULES if types is None or r.pii_type in types]
    scanned = with_guards(screens).select("screen_id", found_spans(rules).alias("found"))
    return suppress_overlaps(match_rows(scanned))
