"""Pattern matching with offsets, as Spark columns.

Patterns are written in the Python ``re`` dialect.  Python's ``\\b``, ``\\d``,
``\\s`` and ``\\w`` are Unicode aware with their own idea of a word character
(letters, numbers and underscore, but no combining marks), so each is replaced
by an explicit Java class instead of Java's ``(?U)`` flag.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
SPACE_IN_LINE = r"\t\x0b\f\r\x1c-\x1f\x85\p{Z}"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
WORD_START = rf"(?<![{WORD}])"
# What can only match letters, digits and underscores, and at least one of them.
PLAIN_NEXT = re.compile(r"(?:\\[dw]|\[(?:[A-Z]-[A-Z]|[a-z]-[a-z]|[0-9]-[0-9]|[A-Za-z0-9])+\])(?![*?]|\{0|\{,)")
# Characters that no pattern matches; used to cut a text at its hits.
CUT, GROUP = "\x01", "\x02"


def spark_pattern(pattern: str, ignore_case: bool = False, in_line: bool = False) -> str:
    """Java pattern equal to a Python one; ``in_line`` keeps ``\\s`` off newlines."""
    space = SPACE_IN_LINE if in_line else SPACE
    classes = {"d": r"\p{Nd}", "s": space, "w": WORD}
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            if nxt == "b" and not in_class:
                # Before a plain word character only the left side needs a look.
                out.append(WORD_START if PLAIN_NEXT.match(pattern, i + 2) else BOUNDARY)
            elif nxt == "S":
                out.append(f"[^{space}]")
            elif nxt in classes:
                out.append(classes[nxt] if in_class else f"[{classes[nxt]}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(ch)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def matches(text: Column, pattern: str, ignore_case: bool = False, in_line: bool = False) -> Column:
    """Whether a Python pattern is found anywhere in ``text``."""
    return text.rlike(spark_pattern(pattern, ignore_case, in_line))


def literal(text: str) -> str:
    """A replacement or pattern literal, safe for Java."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


SPAN_ARRAY = "array<struct<start:int,end:int,value:string,line:int,last_line:int>>"
# Hits are numbered in chunks of this many pieces (even: pieces alternate gap, hit),
# so a text with a million hits costs about as much per hit as one with ten.
CHUNK = 512


def marked_pieces(
    text: Column,
    pattern: str,
    ignore_case: bool = False,
    *,
    group: bool = False,
    in_line: bool = False,
    guard: Column | None = None,
) -> Column:
    """The text cut at its hits: gap, hit, gap, hit, ..., gap.  NULL when there is no hit.

    One replace pass marks the hits and the text is cut at the marks.  ``guard`` is a
    cheap condition that every text with a hit meets.  With ``group`` a hit piece also
    carries its group 1, which must be the last thing the pattern consumes.
    """
    java = spark_pattern(pattern, ignore_case, in_line)
    present = text.rlike(java)
    if guard is not None:
        present = guard & present
    # Hardly any text holds the marks; looking for them is cheaper than copying every text.
    holds = F.contains(text, F.lit(CUT)) | F.contains(text, F.lit(GROUP))
    clean = F.when(holds, F.translate(text, CUT + GROUP, "\x03\x03")).otherwise(text)
    mark = CUT + "$0" + (GROUP + "$1" if group else "") + CUT
    return F.when(present, F.split(F.regexp_replace(clean, F.lit(java), F.lit(mark)), CUT, -1))


def piece_spans(pieces: Column) -> Column:
    """Hits of a cut text: ``array<struct<start,end,value,line,last_line>>``.

    ``start`` and ``end`` are zero-based code-point offsets, ``line`` and ``last_line``
    the number of newlines before the two ends, from a running sum over the pieces.
    """
    return let(_chunk_spans(pieces), _shift_chunks)


def find_spans(text: Column, pattern: str, ignore_case: bool = False, **options) -> Column:
    """All matches of a Python pattern with their offsets; empty array when there are none."""
    pieces = marked_pieces(text, pattern, ignore_case, **options)
    none = F.array().cast(SPAN_ARRAY)
    return let(pieces, lambda ps: F.when(ps.isNotNull(), piece_spans(ps)).otherwise(none))


def _newlines(piece: Column) -> Column:
    return F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))


def _chunk_spans(pieces: Column) -> Column:
    """Per chunk: its hits counted from the chunk's start, its length, its newlines."""

    def step(state, piece):
        body = F.substring_index(piece, GROUP, 1)
        end, last = state["position"] + F.length(body), state["line"] + _newlines(body)
        value = F.substring_index(piece, GROUP, -1)
        hit = F.struct(
            (end - F.length(value)).cast("int").alias("start"),
            end.cast("int").alias("end"),
            value.alias("value"),
            (last - _newlines(value)).cast("int").alias("line"),
            last.cast("int").alias("last_line"),
        )
        return F.struct(
            end.cast("int").alias("position"),
            last.cast("int").alias("line"),
            (~state["is_hit"]).alias("is_hit"),
            F.when(state["is_hit"], F.concat(state["hits"], F.array(hit)))
            .otherwise(state["hits"])
            .alias("hits"),
        )

    zero = F.struct(
        F.lit(0).alias("position"),
        F.lit(0).alias("line"),
        F.lit(False).alias("is_hit"),
        F.array().cast(SPAN_ARRAY).alias("hits"),
    )
    starts = F.sequence(F.lit(1), F.size(pieces), F.lit(CHUNK))
    return F.transform(starts, lambda at: F.aggregate(F.slice(pieces, at, CHUNK), zero, step))


def _shift_chunks(chunks: Column) -> Column:
    """Hits counted from the start of the text."""
    base = F.array(F.struct(F.lit(0).alias("position"), F.lit(0).alias("line")))
    bases = F.aggregate(
        chunks,
        base,
        lambda done, c: F.concat(
            done,
            F.array(
                F.struct(
                    (F.element_at(done, -1)["position"] + c["position"]).alias("position"),
                    (F.element_at(done, -1)["line"] + c["line"]).alias("line"),
                )
            ),
        ),
    )

    def shifted(bs):
        return F.flatten(
            F.transform(
                chunks,
                lambda c, i: F.transform(
                    c["hits"],
                    lambda h: F.struct(
                        (h["start"] + bs[i]["position"]).alias("start"),
                        (h["end"] + bs[i]["position"]).alias("end"),
                        h["value"].alias("value"),
                        (h["line"] + bs[i]["line"]).alias("line"),
                        (h["last_line"] + bs[i]["line"]).alias("last_line"),
                    ),
                ),
            )
        )

    return let(bases, shifted)
