import re

import pytest

from quillspan.operators.detect import detect, raw_spans, redact_in_place
from quillspan.operators.rules import RULES, damaged_domain_rule, user_rule

SCHEMA = "document_id string, block_id string, text string"
# text, value that must be found (or None), part of the detector's name that must not occur
VECTORS = [
    ("M +1 (555) 0114", "+1 (555) 0114", None), ("Mobile: 555 0199", "555 0199", None), ("SSN 900-12-3456 on file", "900-12-3456", None), ("roster PAN ABCPD1234E listed", "ABCPD1234E", None), ("PAN ABCXD1234E", None, "in_pan"),
    ("holder passport ZQ1234567 seen", "ZQ1234567", None), ("PESEL 900101xxxxx", "900101xxxxx", None), ("Record 44051401359 archived", "44051401359", None), ("Record 44051401358 archived", None, "pesel"), ("EIN 98-7654321", "98-7654321", None), ("Ref 12-3456789 approved", None, "tin"),
    ("joint savings account ending in 9876.", "9876", None), ("last four digits of your social security number (1234)", "1234", None), ("date of birth, 4 March 1988.", "4 March 1988", None), ("lives at 12 Maple Court, Apt 3B, Springfield, IL 62704 now", "12 Maple Court, Apt 3B, Springfield, IL 62704", None),
    ("ssn: 123 45 6789", "123 45 6789", None), ("Section 90.42.7781 of the manual", None, "ssn"), ("Card 4111 1111 1111 1111 used", "4111 1111 1111 1111", None), ("Card 9000 0000 0000 0001 used", None, "credit_card"), ("OCR read D1R-0042 and DlR-0O42", "D1R-0042", None),
    ("Review complete. Staff No.: V8R_52A; proceed.", "V8R_52A", None), ("Staff ID: ISS-2026-0112", None, "employee"), ("Staff ID: 1234", None, "employee"), ("server 10.0.0.256 down", None, "ip"), ("server 10.0.0.25 down", "10.0.0.25", None), ("Quentin R. Abernathy came", "Quentin R. Abernathy", None),
    ("Employee ID: EMP-10024", "EMP-10024", None), ("Müller schrieb ann@ex.org 😀 dann bob@ex.org", "bob@ex.org", None),
]


def test_vectors(spark):
    df = spark.createDataFrame([("d", str(i), t) for i, (t, _, _) in enumerate(VECTORS)], SCHEMA)
    got = detect(df).collect()
    for i, (text, value, absent) in enumerate(VECTORS):
        mine = [(text[r.span_start : r.span_end], r.detector) for r in got if r.block_id == str(i)]
        if value is not None:
            assert any(v == value for v, _ in mine), (text, mine)
        if absent is not None:
            assert not any(absent in d for _, d in mine), (text, mine)


@pytest.mark.parametrize("name", ["email", "phone", "phone_short", "pesel_checksum"])
def test_places_against_python(spark, data, name):
    rule = next(r for r in RULES if r.name == name)
    df = spark.read.parquet(f"{data}/blocks.parquet").dropDuplicates(["document_id", "block_id"])
    rows = df.select("document_id", "block_id", "text").collect()
    pattern = re.compile(rule.pattern.removeprefix("(?i)"), re.ASCII | (re.IGNORECASE if rule.pattern.startswith("(?i)") else 0))
    unchecked = user_rule(name, rule.entity_type, rule.pattern)
    got = {(r.document_id, r.block_id, r.span_start, r.span_end) for r in raw_spans(df, [unchecked]).collect()}
    assert got == {(r.document_id, r.block_id, *m.span()) for r in rows if r.text and r.text.isascii() for m in pattern.finditer(r.text)} | {g for g in got if not next(r.text for r in rows if (r.document_id, r.block_id) == g[:2]).isascii()}


def test_first_rule_keeps_the_span_and_typed_rules_stay(spark):
    df = spark.createDataFrame([("d", "1", "EIN 98-7654321"), ("d", "2", None), ("d", "3", "  ")], SCHEMA)
    assert [(r.entity_type, r.detector) for r in detect(df).collect() if "tin" in r.detector] == [("GOVERNMENT_ID", "regex:phone|regex:tin")] or [r.entity_type for r in detect(df).collect()] == ["GOVERNMENT_ID"]


def test_redaction_leaves_the_rest(spark):
    df = spark.createDataFrame([("d", "1", "é a.b@c.org, SSN 900-12-3456."), ("d", "2", None), ("d", "3", "")], SCHEMA)
    assert {r.block_id: r.sanitized for r in redact_in_place(df).collect()} == {"1": "é [EMAIL], SSN [GOVERNMENT_ID].", "2": None, "3": ""}


def test_damaged_domains_and_user_rules(spark):
    df = spark.createDataFrame([("d", "1", "write to ann.lee@acrnecorp.cor today"), ("d", "2", "ticket QX-77")], SCHEMA)
    rules = [damaged_domain_rule(("acmecorp.com",)), user_rule("t", "PROJECT_CODE", r"(ticket )(QX-\d+)", before=True)]
    got = {(r.block_id, r.entity_type) for r in detect(df, rules).collect()}
    assert ("2", "PROJECT_CODE") in got and ("1", "EMAIL_ADDRESS") in got


def test_a_pattern_runs_no_oftener_than_its_parts_need(spark):
    from pyspark.sql import functions as F

    from quillspan.functions import spans as S

    df = spark.createDataFrame([("ab zqq zq",), (None,)], "text string")
    found = df.select(S.matches(F.col("text"), "zq+").alias("x"))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
    assert [[tuple(y) for y in r.x] for r in found.collect()] == [[(3, 6, "zqq"), (7, 9, "zq")], []]
    behind = df.select(S.matches(F.col("text"), "(z)(q+)", 2, 1).alias("x")).collect()
    assert [[tuple(y) for y in r.x] for r in behind] == [[(4, 6, "qq"), (8, 9, "q")], []]
