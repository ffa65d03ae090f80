"""Values worked out by hand for detectors and extractors, and texts of many lines."""

import pytest
from helpers import text_screens

from veilscan.operators.context import text_context
from veilscan.operators.detectors import detect_all
from veilscan.operators.resolve import raw_matches
from veilscan.plans.scan import audit

# text, and what the detectors make of it in order of place
DETECTED = [
    ("PAN ABCDE1234F.", [("PAN", "ABCDE1234F")]),
    ("IFSC ABCD0123456", [("IFSC", "ABCD0123456")]),
    # The handle detector comes first and takes any short lower-case provider.
    ("write to jo.doe@mail.example.com", [("UPI_HANDLE", "jo.doe@mail")]),
    ("pay jo@okaxis now", [("UPI_HANDLE", "jo@okaxis")]),
    ("host 10.20.30.40 is up", [("IP_ADDRESS", "10.20.30.40")]),
    ("the CCTV is on", [("_KW_CCTV", "CCTV")]),
    ("a Selfie or a photo", [("_KW_PHOTOGRAPH", "Selfie"), ("_KW_PHOTOGRAPH", "photo")]),
    ("nothing to see", []),
    ("", []),
]
# text, and the holder names in it
NAMES = [
    ("RAVI KUMAR said so", ["RAVI KUMAR"]),
    ("RAVI KUMAR", ["RAVI KUMAR"]),
    ("ACCOUNT NUMBER is 123", []),
    ("SHARE RECEIPT now", []),
    ("ACCOUNT NUMBER", []),
    ("Dear MEENA IYER,\nhello", ["MEENA IYER"]),
]


def test_detectors(spark):
    found = {}
    for r in sorted(detect_all(text_screens(spark, {i: t for i, (t, _) in enumerate(DETECTED)})).collect(), key=lambda r: r.start):
        found.setdefault(r.screen_id, []).append((r.pii_type, r.value))
    assert [found.get(i, []) for i in range(len(DETECTED))] == [want for _, want in DETECTED]


def test_holder_names_are_stripped_before_they_are_tested(spark):
    rows = text_context(text_screens(spark, {i: t for i, (t, _) in enumerate(NAMES)})).filter("pii_type = 'ACCOUNT_HOLDER_NAME'").collect()
    assert [[r.value for r in rows if r.screen_id == i] for i in range(len(NAMES))] == [want for _, want in NAMES]


@pytest.mark.parametrize(("line", "kind", "value"), [
    ("Available Balance Rs 1,234.50", "ACCOUNT_BALANCE", "1,234.50"),
    ("Customer ID: AB12345", "CUSTOMER_ID", "AB12345"),
    ("Ref no: TX12345678", "TRANSACTION_REFERENCE", "TX12345678"),
    ("UPI/SBIN/123456789012/PAY", "TRANSACTION_REFERENCE", "123456789012"),
])
def test_extractors(spark, line, kind, value):
    found = text_context(text_screens(spark, {1: f"a line before\n{line}\na line after"})).collect()
    assert (kind, value) in {(r.pii_type, r.value) for r in found}


def test_context_reaches_one_line_to_each_side(spark):
    far = "upi payment\n\n\n12345678901\n\n\nupi payment"
    near = {1: "upi payment\n12345678901", 2: "12345678901\nupi payment", 3: far}
    refs = {r.screen_id for r in text_context(text_screens(spark, near)).collect() if r.pii_type == "TRANSACTION_REFERENCE"}
    assert refs == {1, 2}


def test_a_hundred_thousand_numbered_lines(spark):
    screens = text_screens(spark, {0: "\n".join(f"acct {1000000000 + i} ok" for i in range(100_000))})
    assert raw_matches(screens).count() == 100_000
    assert audit(screens, folder=spark.conf.get("spark.checkpoint.dir")).verdicts.count() == 1
