"""Span search against Python's re, on whole documents and awkward strings."""

import re

import pytest
from conftest import SF
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilscan import catalogs as c
from veilscan.functions.numbers import rounded
from veilscan.functions.regex import WORD_START, find_spans, spark_pattern
from veilscan.functions.text import keyword_hits
from veilscan.operators.inventory import ALL_KEYWORDS

AWKWARD = [
    "PAN ABCDE1234F, aadhaar 2345 6789 0124 and XXXX 1234 5678; card 4111-2222-3333-4444",
    "XXXX XXXX XXXX 1234 a**** 1234 5678 **** 1234 5678",
    "ABCD0123456 p A1234567 b ABC1234567 KA01 2011 0012345 KA0120110012345",
    "a@gmail.com a@mail2.example.com foo.bar@okaxis",
    "+91 9876543210 +919876543210 9876543210 19876543210 919876543210",
    "10.0.0.1 256.1.1.1 12/05/2024 2024-1-2 12.5.24",
    "123456789 123456789012345678 /123456789 123456789- a123456789 é123456789",
    "CCTV video\nrecording audio  clip password PWD sessionid auth-token Bearer selfie sıgn ſign signed",
    "१२३४ ५६७८ ९०१२ éPANABCDE1234F हिABCDE1234F ABCDE1234Fि 1234\n5678\n9012",
    "\x01\x02 sign \x02", "", " ", "sign " * 2000,
]
GROUPED = [
    (c.BALANCE_PATTERN, True, False), (c.CUSTOMER_ID_PATTERN, True, False), (c.UPI_PATH_PATTERN, True, False),
    (c.LABELLED_REF_PATTERN, True, False), (c.UPI_CHAIN_PATTERN, True, True), (c.LINE_REF_PATTERN, True, True),
    (c.LONG_NUMBER_PATTERN, False, True),
]
PLAIN = [(p, ic, False) for _, p, ic, _, _ in c.DETECTORS] + [(c.CAPITAL_NAME_PATTERN, False, True), (c.AMOUNT_PATTERN, True, False)]


def expected(text, pattern, ignore_case, in_line, group):
    rx, out, offset = re.compile(pattern, re.I if ignore_case else 0), [], 0
    for piece in text.split("\n") if in_line else [text]:
        out += [(offset + m.start(group), offset + m.end(group), m.group(group)) for m in rx.finditer(piece)]
        offset += len(piece) + 1
    return [(s, e, v, text[:s].count("\n"), text[:e].count("\n")) for s, e, v in out]


@pytest.mark.parametrize("group,patterns", [(0, PLAIN), (1, GROUPED)])
def test_spans_equal_python(spark, group, patterns):
    documents = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts = AWKWARD + documents
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    columns = [
        find_spans(F.col("text"), p, ic, group=bool(group), in_line=il).alias(f"p{i}") for i, (p, ic, il) in enumerate(patterns)
    ]
    for row in table.select("id", *columns).collect():
        for i, (p, ic, il) in enumerate(patterns):
            assert [tuple(s) for s in row[f"p{i}"]] == expected(texts[row.id], p, ic, il, group), (p, texts[row.id][:80])


def test_many_hits_cross_chunks(spark):
    text = "ab 1\n" * 3000
    spans = spark.createDataFrame([(text,)], "t string").select(find_spans(F.col("t"), r"\d").alias("s")).first().s
    assert [tuple(s) for s in spans] == expected(text, r"\d", False, False, 0)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(ALL_KEYWORDS + ["x", " ", "e", "account n"]), max_size=8), min_size=1, max_size=20))
def test_keyword_hits_equal_substring_tests(spark, drawn):
    texts = ["".join(d) for d in drawn]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for row in table.select("id", keyword_hits(F.col("t"), ALL_KEYWORDS).alias("k")).collect():
        assert row.k == [k for k in ALL_KEYWORDS if k in texts[row.id]]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(0, 2000), st.integers(0, 200000).map(lambda n: n / 100000)), min_size=1, max_size=200))
def test_rounding_equals_python(spark, values):
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for row in table.select("x", rounded(F.col("x")).alias("r")).collect():
        assert row.r == round(row.x, 4)


def test_boundary_before_letters_looks_left_only(spark):
    """F6, F9 to F16, F21: the same hits as Python's, with one look instead of four per place."""
    cheap = [r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", r"\b[A-PR-WY][1-9]\d\s?\d{4}[1-9]\b", r"\b[A-Z][A-Z .'-]*(?:\s+[A-Z][A-Z .'-]*){1,4}\b"]
    whole = [r"\b[A-Z]?x", r"\b[A-Z .]+x", r"\b[A-z]x", r"\b[A-Z]*x", r"\b[A-Z]{0,2}x"]
    texts = ["PAN ABCDE1234F xABCDE1234F éABCDE1234F _ABCDE1234F́ABCDE1234F", "ſBCDE1234K P12 34567 é P123 4567", "RAVI KUMAR éRAVI DAS",
             "x .x Ax _x ^x aAx\x01ABCDE1234F\x02", "", "-- A x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in [*cheap, *whole]:
        java = spark_pattern(pattern, True)
        assert java.startswith("(?iu)" + WORD_START + "[") == (pattern in cheap)
        found = {r.i: [(s.start, s.end) for s in r.s] for r in rows.select("i", find_spans(F.col("t"), pattern, True).alias("s")).collect()}
        for i, text in enumerate(texts):
            assert found[i] == [m.span() for m in re.finditer(pattern, text, re.IGNORECASE) if m.group()], (pattern, text)


def test_scan_searches_a_text_for_keywords_once(spark):
    """The statement rule takes the keywords that the scan has found; other texts are not copied to be cut."""
    from veilscan.operators.resolve import scan_text

    text = "statement date\n01/02/2024 a\n02/02/2024 b\n03/02/2024 c\x01"
    rows = spark.createDataFrame([(1, text, 1.0)], "screen_id long, full_text string, avg_confidence double")
    scanned = scan_text(rows)
    # One for the guards, one where folding changed the text.
    assert scanned._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2
    found = {c.pii_type: [s.value for s in c.spans] for c in scanned.first().found}
    assert found["TRANSACTION_HISTORY"] == ["3 transaction rows detected"]
    assert found["DATE_OF_BIRTH"] == ["01/02/2024", "02/02/2024", "03/02/2024"]
