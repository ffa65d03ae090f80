"""Document types and screen types, from keywords contained in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.catalogs import (
    DOCUMENT_WORDS,
    FALLBACK_SCREEN,
    GENERIC_BANK_WORDS,
    RECEIPT_WORDS,
    SCREEN_SIGNALS,
    STATEMENT_WORDS,
    screen_dim,
)
from veilscan.functions.regex import let
from veilscan.functions.tables import explode_rows
from veilscan.functions.text import keyword_hits, quoted, words

DOCUMENT_KEYWORDS = list(
    dict.fromkeys(
        [*RECEIPT_WORDS, *STATEMENT_WORDS, "statement", "date", "balance",
         *[w for _, ws in DOCUMENT_WORDS for w in ws], *GENERIC_BANK_WORDS]
    )
)
RANKED_TYPE = "array<struct<negative_hits:int,list_order:int,screen_type:string>>"
SCREEN_KEYWORDS = list(dict.fromkeys(w for _, ws in SCREEN_SIGNALS for w in ws))


def _document_type(any_of, count_of) -> Column:
    statement = any_of(["statement"])
    chain = (
        F.when(any_of(RECEIPT_WORDS) & ~statement, "Transaction Receipt")
        .when(statement & any_of(["date", "balance"]), "Bank Statement")
        .when(any_of(STATEMENT_WORDS), "Bank Statement")
    )
    for name, keywords in DOCUMENT_WORDS:
        chain = chain.when(any_of(keywords), name)
    return chain.when(count_of(GENERIC_BANK_WORDS) >= 2, "Generic Banking Screen").otherwise(
        "Unknown/Other"
    )


def document_type_of(hits: Column) -> Column:
    """Document type from the keywords already found in a text."""
    return _document_type(
        lambda ws: F.arrays_overlap(hits, words(ws)),
        lambda ws: F.size(F.array_intersect(hits, words(ws))),
    )


def document_type(screens: DataFrame) -> DataFrame:
    held = screens.select("screen_id", keyword_hits(F.lower("full_text"), DOCUMENT_KEYWORDS).alias("held"))
    return held.select("screen_id", document_type_of(F.col("held")).alias("document_type"))


def screen_types_of(hits: Column) -> Column:
    """Screen types with a hit, best first, from the keywords already found in a text.

    ``array<struct<negative_hits,list_order,screen_type>>``.
    """
    listed = ", ".join(
        f"struct({order} AS list_order, '{screen_type}' AS screen_type, "
        f"array({', '.join(map(quoted, ws))}) AS keywords)"
        for order, (screen_type, ws) in enumerate(SCREEN_SIGNALS)
    )

    def ranked(held):
        counts = F.transform(
            F.expr(f"array({listed})"),
            lambda t: F.struct(
                (-F.size(F.array_intersect(t["keywords"], held))).alias("negative_hits"),
                t["list_order"].alias("list_order"),
                t["screen_type"].alias("screen_type"),
            ),
        )
        return F.array_sort(F.filter(counts, lambda c: c["negative_hits"] < 0))

    # Bound once: a column used inside a lambda may be worked out again per element.
    return let(hits, ranked)


def screen_type_hits(screens: DataFrame) -> DataFrame:
    """One row per screen and screen type with a keyword hit."""
    held = screens.select("screen_id", keyword_hits(F.lower("full_text"), SCREEN_KEYWORDS).alias("held"))
    ranked = held.select("screen_id", screen_types_of(F.col("held")).alias("ranked"))
    rows = explode_rows(ranked, "ranked", "h", "screen_id")
    return rows.select(
        "screen_id", "h.screen_type", (-F.col("h.negative_hits")).alias("hits"), "h.list_order"
    )


def class_columns(ranked: Column) -> dict[str, Column]:
    """Screen types, primary type and confidence from the ranked hits of one screen."""
    none = F.size(ranked) == 0
    best = F.coalesce(-F.get(ranked, F.lit(0))["negative_hits"], F.lit(0))
    types = F.when(none, F.array(F.lit(FALLBACK_SCREEN))).otherwise(
        F.transform(ranked, lambda h: h["screen_type"])
    )
    return {
        "screen_types": types,
        "primary_screen_type": F.element_at(types, 1),
        "screen_confidence": F.when(best >= 3, "high").when(best >= 2, "medium").otherwise("low"),
    }


def screen_class(hits: DataFrame, screens: DataFrame) -> DataFrame:
    """One row per screen: types in order, label, legacy document type, confidence."""
    ranked = hits.groupBy("screen_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct((-F.col("hits")).alias("negative_hits"), "list_order", "screen_type")
            )
        ).alias("ranked")
    )
    all_screens = screens.select("screen_id").join(ranked, "screen_id", "left")
    ranked_or_none = F.coalesce("ranked", F.array().cast(RANKED_TYPE))
    classed = all_screens.select(
        "screen_id", *[c.alias(n) for n, c in class_columns(ranked_or_none).items()]
    )
    return with_screen_label(classed)


def with_screen_label(classed: DataFrame) -> DataFrame:
    dim = screen_dim(classed.sparkSession).withColumnRenamed("screen_type", "primary_screen_type")
    return classed.join(F.broadcast(dim), "primary_screen_type", "left")
