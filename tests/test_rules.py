"""One screen that breaks each rule, and one that does not."""

import pytest
from helpers import text_screens

from veilscan.operators import rules
from veilscan.plans.scan import audit

NAME = "ASHA VERMA"
CASES = {
    "RULE-DM-01": ("Dashboard\nAvailable Balance Rs 10.25\nMobile 9876543210\nmail a@mail2.example.com\nPAN ABCDE1234F", "Dashboard\nMobile 9876543210"),
    "RULE-DM-02": ("Card details\nCVV: 123", "Card details\nXXXX XXXX XXXX 1234"),
    "RULE-DM-03": ("KYC\nAadhaar 234567890124", "KYC\nAadhaar XXXX 5678 9012"),
    "RULE-DM-04": ("Recharge\naddress", "Recharge\nRs 20"),
    "RULE-DM-05": ("Profile\nsalary", "Profile\nname"),
    "RULE-DM-06": ("Profile\nreligion", "Profile\nname"),
    "RULE-CN-01": ("KYC", "KYC\nI agree"),
    "RULE-CN-02": ("I agree", "I agree, used for service"),
    "RULE-CN-03": ("I agree", "I agree, right to withdraw"),
    "RULE-CN-04": ("I agree to all terms", "I agree to these"),
    "RULE-CN-05": ("Fund transfer\nread contacts", "Fund transfer"),
    "RULE-CN-06": (f"Offer\nMobile 9876543210", "Offer\nMobile 9876543210\nno thanks"),
    "RULE-SEC-01": ("Login\npassword", "Login"),
    "RULE-SEC-02": ("Passbook\nAccount number 123456789", "Passbook"),
    "RULE-SEC-03": ("Debug\nexception", "Debug"),
    "RULE-SEC-04": ("OTP 4521", "OTP\n4521"),
    "RULE-SEC-05": ("KYC\nfingerprint", "KYC\nfingerprint scan"),
    "RULE-RET-01": ("Passbook\nPAN ABCDE1234F", "Passbook"),
    "RULE-RET-02": ("Passbook\ndormant\naddress", "Passbook\naddress"),
    "RULE-CHD-01": ("Dashboard\nminor", "Dashboard\nminor\nguardian"),
    "RULE-CHD-02": ("Offer\nminor", "Offer"),
    "RULE-CHD-03": ("Offer\nminor\nrecommended for you", "Offer\nminor"),
    "RULE-TP-01": ("Offer\nRs 500", "Offer"),
    "RULE-TP-02": ("Offer\nName", "Offer"),
    "RULE-SEN-01": ("Dashboard\ncaste", "Dashboard"),
    "RULE-SEN-02": ("Dashboard\nfingerprint", "Dashboard"),
    "RULE-SEN-03": ("Video KYC", "Video KYC\npermission"),
    "RULE-GR-01": ("Profile\nreligion\nsalary\ngender", "Profile\nreligion\nsalary\ngender\ncomplaint"),
    "RULE-ACC-01": ("Profile\nMobile 9876543210\nMobile 8876543210", "Profile\nMobile 9876543210"),
}


@pytest.fixture(scope="module")
def violations(spark):
    texts = {}
    for i, (bad, good) in enumerate(CASES.values()):
        texts[2 * i], texts[2 * i + 1] = bad, good
    # A name needs an external decision: weak evidence alone stays below the threshold.
    done = audit(text_screens(spark, texts), folder=spark.conf.get("spark.checkpoint.dir"))
    found = {}
    for row in done.violations.select("screen_id", "rule_id").collect():
        found.setdefault(row.screen_id, set()).add(row.rule_id)
    verdicts = {r.screen_id: r.verdict for r in done.verdicts.select("screen_id", "verdict").collect()}
    return found, verdicts


@pytest.mark.parametrize("index,rule_id", list(enumerate(CASES)))
def test_rule(violations, index, rule_id):
    found, verdicts = violations
    if rule_id != "RULE-TP-02":
        assert rule_id in found.get(2 * index, set())
        assert verdicts[2 * index] == "YES"
    assert rule_id not in found.get(2 * index + 1, set())


def test_every_rule_is_defined_once():
    assert [r.rule_id for r in rules.RULES] == [r for r, _ in rules.RULE_SCREENS] == list(CASES)


def test_name_next_to_offer(spark):
    screens = text_screens(spark, {1: f"Offer\n{NAME}"})
    decisions = spark.createDataFrame(
        [(1, NAME, "NAME", 0.9, "")], "screen_id long, value string, final_type string, confidence double, reasoning string"
    )
    done = audit(screens, decisions, folder=spark.conf.get("spark.checkpoint.dir"))
    assert "RULE-TP-02" in {r.rule_id for r in done.violations.collect()}
