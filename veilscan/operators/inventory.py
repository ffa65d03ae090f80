"""The fifty-parameter inventory of each screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.catalogs import (
    CVV_PATTERN,
    OTP_PATTERN,
    PARAMETERS,
    ROPA_APP_PHRASES,
    ROPA_CONSENT_WORDS,
    ROPA_LAW_WORDS,
    RULE_WORDS,
    TEXT_SIGNALS,
    entity_parameter_dim,
    parameter_dim,
    personal_data_dim,
)
from veilscan.functions.regex import matches, spark_pattern
from veilscan.functions.tables import explode_rows
from veilscan.functions.text import keyword_hits, words
from veilscan.operators.classify import DOCUMENT_KEYWORDS, SCREEN_KEYWORDS

PARAMETER_IDS = [p[0] for p in PARAMETERS]
ALL_KEYWORDS = list(
    dict.fromkeys(
        [*DOCUMENT_KEYWORDS, *SCREEN_KEYWORDS, *[w for ws in RULE_WORDS.values() for w in ws],
         *ROPA_CONSENT_WORDS, *ROPA_LAW_WORDS, *[w for _, _, ws in TEXT_SIGNALS for w in ws],
         *[w for phrase in ROPA_APP_PHRASES for w in phrase], "otp", "one", "cvv"]
    )
)


SIGNAL_WORDS = list(dict.fromkeys(w for _, _, ws in TEXT_SIGNALS for w in ws))


def signal_ids(lower_text: Column, held: Column) -> Column:
    """Parameter ids whose text signal is found; each pattern runs only behind its words.

    ``held`` has at least those of ``SIGNAL_WORDS`` that the text contains.
    """
    found = []
    for pid, pattern, needs in TEXT_SIGNALS:
        hit = matches(lower_text, pattern)
        found.append(F.when(F.arrays_overlap(held, words(needs)) & hit if needs else hit, pid))
    return F.array_distinct(F.array_compact(F.array(*found)))


def with_signals(screens: DataFrame) -> DataFrame:
    """``screen_id`` and ``signals`` of every screen."""
    lowered = screens.select("screen_id", F.lower("full_text").alias("_lower"))
    held = lowered.withColumn("_held", keyword_hits(F.col("_lower"), SIGNAL_WORDS))
    return held.select("screen_id", signal_ids(F.col("_lower"), F.col("_held")).alias("signals"))


def with_keywords(screens: DataFrame) -> DataFrame:
    """``_lower`` and ``hits``: the catalogue keywords, signal words and name words in the text."""
    lowered = screens.withColumn("_lower", F.lower("full_text"))
    return lowered.withColumn("hits", keyword_hits(F.col("_lower"), ALL_KEYWORDS))


def fact_columns() -> dict[str, Column]:
    """What the later stages need to know of a text besides ``hits``.

    ``signals`` (parameter ids), and whether a card security code or one-time password
    is shown.  Needs the columns of ``with_keywords``.
    """
    text, held = F.col("full_text"), F.col("hits")
    return {
        "signals": signal_ids(F.col("_lower"), held),
        "shows_cvv": F.array_contains(held, "cvv") & matches(text, CVV_PATTERN, True),
        "shows_otp": F.arrays_overlap(held, words(["otp", "one"])) & matches(text, OTP_PATTERN, True),
    }


# Ways an application name may be split over two screens: (end of one, start of the next).
APP_NAME_SPLITS = [
    (phrase[:i], phrase[i:]) for phrase in ROPA_APP_PHRASES for i in range(1, len(phrase))
]


def app_name_columns() -> dict[str, Column]:
    """Whether a text names the application, and which halves of a name it ends or starts with.

    ``tail`` and ``head`` have one bit per split; ``is_middle`` is set for a text that is
    just the middle word of a longer name.  Needs the columns of ``with_keywords``.
    """
    text = F.col("full_text")
    some_word = F.arrays_overlap("hits", words(sorted({w for p in ROPA_APP_PHRASES for w in p})))

    def said(pattern):
        return text.rlike(spark_pattern(pattern, True))

    def any_of(conditions):
        result = F.lit(False)
        for condition in conditions:
            result = result | condition
        return result

    def mask(pattern_of):
        bits = F.lit(0)
        for i, split in enumerate(APP_NAME_SPLITS):
            bits = bits.bitwiseOR(F.when(said(pattern_of(split)), 1 << i).otherwise(0))
        return F.when(some_word, bits).otherwise(0)

    gap = r"\s+"
    middles = [p[1] for p in ROPA_APP_PHRASES if len(p) == 3]
    return {
        "names_app": some_word & any_of(said(gap.join(p)) for p in ROPA_APP_PHRASES),
        "tail": mask(lambda split: gap.join(split[0]) + r"\s*\z"),
        "head": mask(lambda split: r"\A\s*" + gap.join(split[1])),
        "is_middle": some_word & any_of(said(rf"\A\s*{word}\s*\z") for word in middles),
        "is_blank": ~said(r"\S"),
    }


def text_facts(screens: DataFrame) -> DataFrame:
    """One row per screen with the facts of its text instead of the text."""
    keep = [c for c in screens.columns if c not in ("full_text", "line_conf")]
    return with_keywords(screens).select(*keep, "hits", *[c.alias(n) for n, c in fact_columns().items()])


def entity_pii_ids(entities: DataFrame) -> DataFrame:
    """Parameter ids implied by entity types, one row each."""
    dim = F.broadcast(entity_parameter_dim(entities.sparkSession))
    return entities.select("screen_id", "pii_type").join(dim, "pii_type").select("screen_id", "pii_id").distinct()


def text_signals(screens: DataFrame) -> DataFrame:
    """Parameter ids found in the text, one row each."""
    return explode_rows(with_signals(screens), "signals", "pii_id", "screen_id")


def present_column(entity_ids: Column, signals: Column) -> Column:
    """Ids present, in id order."""
    return F.array_sort(F.array_union(F.coalesce(entity_ids, F.array().cast("array<string>")), signals))


def present_by_screen(entities: DataFrame, screens: DataFrame) -> DataFrame:
    """``present`` (array of ids) for every screen."""
    ids = entity_pii_ids(entities).groupBy("screen_id").agg(F.collect_set("pii_id").alias("entity_ids"))
    return with_signals(screens).join(ids, "screen_id", "left").select(
        "screen_id", present_column(F.col("entity_ids"), F.col("signals")).alias("present")
    )


def inventory_rows(present: DataFrame) -> DataFrame:
    """All fifty ids with PRESENT or ABSENT for every screen."""
    rows = present.select("screen_id", "present", F.explode(words(sorted(PARAMETER_IDS))).alias("pii_id"))
    return rows.select(
        "screen_id",
        "pii_id",
        F.when(F.array_contains("present", F.col("pii_id")), "PRESENT").otherwise("ABSENT").alias("status"),
    )


def pii_inventory(entities: DataFrame, screens: DataFrame) -> DataFrame:
    return inventory_rows(present_by_screen(entities, screens))


def present_ids(inventory: DataFrame) -> DataFrame:
    """Present ids with their names and groups."""
    dim = F.broadcast(parameter_dim(inventory.sparkSession))
    return (
        inventory.filter(F.col("status") == "PRESENT")
        .join(dim, "pii_id", "left")
        .select("screen_id", "pii_id", F.coalesce("pii_name", "pii_id").alias("pii_name"), "pii_group")
    )


def personal_data_inventory(inventory: DataFrame, key: str = "screen_id") -> DataFrame:
    """Rows of the personal-data sheet for the present ids it lists."""
    dim = F.broadcast(personal_data_dim(inventory.sparkSession))
    return (
        inventory.filter(F.col("status") == "PRESENT")
        .join(dim, "pii_id")
        .select(
            key, "pii_id", "category", "parameter", F.lit("Yes").alias("response"),
            F.lit("Digital").alias("mode_collection"), F.lit("Digital").alias("mode_processing"),
        )
    )
