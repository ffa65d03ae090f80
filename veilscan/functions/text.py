"""Small text helpers, all built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def words(values: list[str]) -> Column:
    """A literal array of strings."""
    if not values:
        return F.array().cast("array<string>")
    return F.expr("array(" + ", ".join(map(quoted, values)) + ")")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def canonical_text(text: Column) -> Column:
    """Lines stripped, blank lines dropped: the shape text has when built from blocks."""
    lines = F.transform(F.split(text, "\n", -1), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def lower_fold(text: Column) -> Column:
    """Lower case, with the few letters that a case-blind ASCII pattern also accepts."""
    return F.lower(F.translate(text, "ſKıİ", "skii"))


def keyword_pattern(keywords: list[str]) -> str:
    """One regex that finds, at every place, the longest keyword starting there.

    Keywords are merged by their common beginnings, so a place is given up after its
    first letters, however many keywords there are.
    """
    tree: dict = {}
    for keyword in keywords:
        node = tree
        for ch in keyword:
            node = node.setdefault(ch, {})
        node[""] = {}

    def body(node: dict) -> str:
        arms = [(ch if ch.isalnum() else "\\" + ch) + body(child) for ch, child in sorted(node.items()) if ch]
        if not arms:
            return ""
        if len(arms) == 1 and "" not in node:
            return arms[0]
        return "(?:" + "|".join(arms) + ")" + ("?" if "" in node else "")

    return f"(?=({body(tree)}))"


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Keywords contained in lower-cased ``text`` (substring test), in list order.

    One pass finds the longest keyword at every place; any other keyword that occurs
    is the beginning of one of those, so it is enough to look inside them.
    """
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(keyword_pattern(keywords)), F.lit(1)))
    listed = words(keywords)
    return F.element_at(
        F.transform(
            F.array(found),
            lambda longest: F.when(
                F.size(longest) > 0,
                F.filter(listed, lambda kw: F.exists(longest, lambda w: w.startswith(kw))),
            ).otherwise(F.slice(listed, 1, 0)),
        ),
        1,
    )


def contains_any(text: Column, keywords: list[str]) -> Column:
    return F.exists(words(keywords), lambda kw: F.contains(text, kw))


def normalised_value(value: Column) -> Column:
    """Grouping key of a value: white space, commas and dashes removed, lower case."""
    return F.lower(F.regexp_replace(value, r"[\s\x1c-\x1f\x85\p{Z},\-]+", ""))


def compact_value(value: Column) -> Column:
    """Key of the rules-only route: blanks and dashes removed, lower case."""
    return F.lower(F.translate(value, " -", ""))


def label_key(text: Column) -> Column:
    """Label comparison key: lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def clean_spaces(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"[\s\x1c-\x1f\x85\p{Z}]+", " ")


def filled(template: str, *values: Column) -> Column:
    """A text with its ``{}`` replaced by the values, in order; a NULL value reads as empty."""
    parts = [F.lit(p) for p in template.split("{}")]
    pairs = [x for value, part in zip(values, parts[1:]) for x in (F.coalesce(value.cast("string"), F.lit("")), part)]
    return F.concat(parts[0], *pairs)
