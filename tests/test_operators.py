import itertools

from quillspan.functions import spans as S
from quillspan.operators import audit, context, evaluate, gate, redact, registry
from quillspan.operators.merge import merge_entities, risk_summary, valid_entities
from pyspark.sql import functions as F

E = "document_id string, block_id string, span_start int, span_end int, entity_type string, confidence double, detector string"
CASES = [
    ([("PERSON", 0, 15, 0.99), ("EMAIL_ADDRESS", 0, 10, 0.8)], [("EMAIL_ADDRESS", 0, 15, 0.8)]),
    ([("PHONE_NUMBER", 0, 10, 0.99), ("EMPLOYEE_ID", 2, 8, 0.95)], [("EMPLOYEE_ID", 0, 10, 0.95)]),
    ([("PERSON", 0, 10, 0.8), ("LOCATION", 5, 15, 0.9)], [("LOCATION", 0, 15, 0.9)]),
    ([("EMAIL_ADDRESS", 0, 10, 0.8), ("EMAIL_ADDRESS", 8, 20, 0.7), ("EMAIL_ADDRESS", 19, 30, 0.6)], [("EMAIL_ADDRESS", 0, 30, 0.8)]),
    ([("PERSON", 0, 10, 0.8), ("LOCATION", 0, 10, 0.8)], [("LOCATION", 0, 10, 0.8)]),
    ([("PERSON", 0, 5, 0.8), ("PERSON", 5, 10, 0.8)], [("PERSON", 0, 5, 0.8), ("PERSON", 5, 10, 0.8)]),
]


def test_merge_in_any_order(spark):
    rows, want = [], {}
    for i, (spans, out) in enumerate(CASES):
        for j, p in enumerate(itertools.permutations(spans)):
            rows += [(f"{i}.{j}", "b", s, e, t, c, f"x:{t}|y") for t, s, e, c in p]
            want[f"{i}.{j}"] = out
    got = {}
    for r in merge_entities(spark.createDataFrame(rows, E)).orderBy("document_id", "span_start").collect():
        got.setdefault(r.document_id, []).append((r.entity_type, r.span_start, r.span_end, r.confidence))
        assert r.detector.split("|") == sorted(set(r.detector.split("|")))
    assert got == want
    assert merge_entities(spark.createDataFrame([], E)).count() == 0


def test_valid_entities_and_risk(spark):
    b = spark.createDataFrame([("d", "b", "0123456789")], "document_id string, block_id string, text string")
    rows = [("d", "b", 0, 5, " person ", 0.5, None), ("d", "b", -1, 5, "PERSON", 0.5, "x"), ("d", "b", 0, 5, None, 0.5, "x"), ("d", "b", 0, 11, "PERSON", 0.5, "x"), ("d", "b", 0, 5, "Email Address", float("nan"), "x"), ("d", "b", 6, 9, "us-ssn", 1.0, "x")]
    got = valid_entities(spark.createDataFrame(rows, E), b)
    assert {r.entity_type for r in got.collect()} == {"PERSON", "US_SSN"}
    assert {r.risk_level: r.n for r in risk_summary(got).collect()} == {"CRITICAL": 1, "HIGH": 0, "MEDIUM": 1}


def test_tokens_follow_first_appearance(spark):
    b = spark.createDataFrame([("d1", "a", 1, "Alice met Bob"), ("d1", "b", 2, "Bob called Alice x@Q.org X@q.org"), ("d2", "a", 1, None)], "document_id string, block_id string, block_ord long, text string")
    f = spark.createDataFrame([("d1", "s", 0), ("d2", "s", 1)], "document_id string, scope_id string, doc_ord long")
    m = [("d1", "b", 11, 16, "PERSON"), ("d1", "a", 10, 13, "PERSON"), ("d1", "a", 0, 5, "PERSON"), ("d1", "b", 0, 3, "PERSON"), ("d1", "b", 17, 24, "EMAIL_ADDRESS"), ("d1", "b", 25, 32, "EMAIL_ADDRESS")]
    v = redact.values(spark.createDataFrame(m, "document_id string, block_id string, span_start int, span_end int, entity_type string"), b, f)
    t = redact.tokens(v)
    out = {(r.document_id, r.block_id): r.sanitized for r in redact.sanitized(b, v, t).collect()}
    assert out == {("d1", "a"): "[PERSON_001] met [PERSON_002]", ("d1", "b"): "[PERSON_002] called [PERSON_001] [EMAIL_001] [EMAIL_002]", ("d2", "a"): None}
    p = redact.payload(redact.sanitized(b, v, t)).collect()
    assert [r.document_id for r in p] == ["d1"] and p[0].n_blocks == 2
    assert spark.range(1).select(redact.token(F.lit("X"), F.lit(1000))).first()[0] == "[X_1000]"


def test_gate_vectors(spark):
    rows = [
        ("1", "call +1 (212) 555 0147 now", {"gate:digit_run"}), ("2", "logged 2024 06 11 09 15", set()), ("3", "ACC-2026-018 RSK-4488 residual access accepted", set()), ("4", "2026-06-11 08:18:022 @uTN.failure user", set()),
        ("5", "see [PERSON_001] and [EMAIL]", set()), ("6", "see [PERSON_099]", {"gate:unissued_placeholder"}), ("7", "berg @corp.org", {"gate:email_shape"}), ("8", "Staff ID: V8R52A", {"gate:personnel_context"}), ("9", "PAN ABCPD1234E", {"gate:id_shape"}), ("10", "on 2026-06-11 done", set()),
    ]
    t = spark.createDataFrame([("d", i, "s", x) for i, x, _ in rows], "document_id string, block_id string, scope_id string, sanitized string")
    issued = spark.createDataFrame([("s", "[PERSON_001]"), ("other", "[PERSON_099]")], "scope_id string, token string")
    got = {}
    for r in gate.residuals(t, issued).collect():
        got.setdefault(r.block_id, set()).add(r.detector)
    for i, x, want in rows:
        assert got.get(i, set()) == want, x


def test_decision_fails_closed(spark):
    f = spark.createDataFrame([("a", None), ("b", []), ("c", [3]), ("d", [0]), ("e", [None])], "document_id string, ocr_failed_pages array<int>")
    r = spark.createDataFrame([("b", "x", "gate:digit_run")], "document_id string, block_id string, detector string")
    got = {x.document_id: x.status for x in gate.decide(f, r).collect()}
    assert got == {"a": "APPROVED", "b": "BLOCKED", "c": "BLOCKED", "d": "BLOCKED", "e": "BLOCKED"}


def test_registry(spark):
    p = [("s", 1, "Quentin", "Abernathy", ["R."], None), ("s", 2, "Quentin", "Abernathy", [], None), ("s", 3, "Quentin", "Abernathy", ["S."], None), ("s", 4, None, "Vale", [], "H"), ("s", 5, "Hesper", "Vale", ["K."], None), ("s", 6, None, None, None, None)]
    people = spark.createDataFrame(p, "scope_id string, person_ord int, first_name string, last_name string, middles array<string>, name_initial string")
    merged = registry.merge_people(people)
    assert sorted((r.first_name, r.last_name, tuple(r.middles)) for r in merged.collect()) == [("Hesper", "Vale", ("K.",)), ("Quentin", "Abernathy", ("R.",)), ("Quentin", "Abernathy", ("S.",))]
    t = spark.createDataFrame([("d", "1", "s", "Q. R. Abernathy saw Hesper Vale and a vale."), ("d", "2", "z", "Quentin Abernathy")], "document_id string, block_id string, scope_id string, text string")
    text = "Q. R. Abernathy saw Hesper Vale and a vale."
    assert {text[r.span_start : r.span_end] for r in registry.sweep(t, merged).collect()} == {"Q. R. Abernathy", "Hesper Vale"}


def test_context(spark):
    schema = "document_id string, block_id string, block_ord long, text string, kind string, page_number int, slide_number int, table_number int, row_number int, column_number int"
    c = lambda i, t, r, k: ("d", str(i), i, t, "table_cell", None, None, 1, r, k)
    cells = spark.createDataFrame([c(1, "Mobile", 1, 1), c(2, "Staff Code", 1, 2), c(3, "Owner", 1, 3), c(4, "555 0123", 2, 1), c(5, "V8R52A", 2, 2), c(6, "Tobin Read", 2, 3), ("d", "7", 7, "Created by Zelda Quark today", "paragraph", 1, None, None, None, None), ("d", "8", 8, "reach +1", "paragraph", 2, None, None, None, None), ("d", "9", 9, "212-555-0136 now", "paragraph", 2, None, None, None, None)], schema)
    assert [r.block_id for r in context.header_phones(cells).collect()] == ["4"]
    assert [r.block_id for r in context.header_personnel(cells).collect()] == ["5"]
    assert {r.block_id for r in context.role_names(cells).collect()} == {"6", "7"}
    phones = spark.createDataFrame([("d", "9", 0, "PHONE_NUMBER")], "document_id string, block_id string, span_start int, entity_type string")
    assert [(r.block_id, r.span_start, r.span_end) for r in context.split_country_codes(cells, phones).collect()] == [("8", 6, 8)]


def test_audit_has_no_text(spark):
    e = spark.createDataFrame([("d", "1", 0, 4, "PERSON", 0.9, "x"), ("d", "2", 0, 4, "ODD", 0.9, "x")], E)
    b = spark.createDataFrame([("d", "1", "ocr", None, "Anna")], "document_id string, block_id string, extraction_method string, kind string, text string")
    got = {(r.dimension, r.value): r.n for r in audit.counts_by(e, b).collect()}
    assert got[("category", "OTHER")] == 1 and got[("location", "scanned_page")] == 1 and got[("location", "unknown")] == 1
    g = spark.createDataFrame([("d", "BLOCKED", "residual data", 1, True)], "document_id string, status string, reason string, residual_count long, independent boolean")
    assert "Anna" not in audit.report(e, b, g).first().report


def test_evaluation():
    assert evaluate.substring_distance("abcd", "xxabxcdyy") == 1 and evaluate.substring_distance("", "x") == 0
    assert evaluate.locate("Dr. Szewezyk and SZEWCZYK", "Szewczyk") == [(4, 12, True), (17, 25, False)]
    assert evaluate.locate("555-0174", "555-0147") == []
    assert evaluate.locate("anna", "") == []


def test_coverage_and_rates(spark):
    a = spark.createDataFrame([("d", "one two two")], "document_id string, text string")
    b = spark.createDataFrame([("d", "two ONE")], "document_id string, text string")
    assert abs(evaluate.character_coverage(a, b).first().coverage - 6 / 9) < 1e-9
    r = evaluate.rates(spark.createDataFrame([(0, 0, 0), (1, 1, 0), (0, 0, 2)], "tp int, fp int, fn int")).collect()
    assert [(x.precision, x.recall) for x in r] == [(1.0, 1.0), (0.5, 1.0), (0.0, 0.0)]


def test_checks(spark):
    df = spark.createDataFrame([("4111111111111111",), ("4111111111111112",), ("44051401359",), ("123",)], "v string")
    got = df.select((S.luhn_ok(F.col("v")) & S.card_issuer_ok(F.col("v"))).alias("card"), F.coalesce(S.pesel_ok(F.col("v")), F.lit(False)).alias("pesel")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True), (False, False)]


def test_numbers_go_on_after_taken_tokens(spark):
    schema = "scope_id string, canonical_type string, identity string, doc_ord long, block_ord long, span_start int"
    first = redact.tokens(spark.createDataFrame([("s", "PERSON", "A", 0, 5, 0), ("s", "PERSON", "B", 0, 9, 0)], schema)).cache()
    more = redact.tokens(spark.createDataFrame([("s", "PERSON", "A", 0, 5, 0), ("s", "PERSON", "C", 0, 2000, 0), ("s", "PERSON", "D", 1, 0, 0), ("s", "EMAIL", "x", 0, 0, 0)], schema), first)
    assert {(r.identity, r.token) for r in more.collect()} == {("C", "[PERSON_003]"), ("D", "[PERSON_004]"), ("x", "[EMAIL_001]")}


def test_parts_of_a_payload_make_the_whole(spark):
    t = spark.createDataFrame([("d", f"b{i}", i, f"t{i}") for i in range(7)] + [("d", "e", 9, " ")], "document_id string, block_id string, block_ord long, sanitized string")
    parts = sorted((r.part, r.payload) for r in redact.payload_parts(t, part=3).collect())
    assert len(parts) == 3 and "\n".join(p for _, p in parts) == redact.payload(t).first().payload


def test_figures_that_cannot_be_read_are_withheld(spark):
    texts = spark.createDataFrame([("d", "a", 1, "x"), ("d", "b", 2, "y"), ("d", "c", 3, "z")], "document_id string, block_id string, block_ord long, sanitized string")
    lines = spark.createDataFrame([("d", "a", 1, "ocr", None, [0, 0, 10, 10]), ("d", "b", 1, "figure_ocr", 2, None), ("d", "c", 1, "ocr", None, [90, 90, 99, 99])], "document_id string, block_id string, page_number int, extraction_method string, figure_no int, bbox array<int>")
    figures = spark.createDataFrame([("d", 1, 1, False, [0, 0, 20, 20]), ("d", 1, 2, False, [30, 30, 40, 40]), ("d", 1, 3, True, [80, 80, 99, 99])], "document_id string, page_number int, figure_no int, readable boolean, bbox array<int>")
    assert {r.block_id: r.sanitized for r in redact.withhold_figures(texts, lines, figures).collect()} == {"a": "[FIGURE_UNREADABLE_1]", "b": "[FIGURE_UNREADABLE_2]", "c": "z"}


def test_places_seen_by_models_alone(spark):
    got = spark.createDataFrame([("presidio:SpacyRecognizer",), ("presidio:SpacyRecognizer|regex:ip",), ("",)], "d string").select(gate.known_by_models_alone("d")).collect()
    assert [r[0] for r in got] == [True, False, False]
