"""Queries over the tables, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import audit, context, evaluate, gate, redact, registry, repair
from quillspan.operators import lookups as L
from quillspan.operators.detect import detect, redact_in_place, with_found
from quillspan.operators.intervals import merge_intervals, valid_spans
from quillspan.operators.merge import merge_entities, risk, risk_summary, valid_entities
from quillspan.operators.rules import _DATE, _LABELLED, CUSTOM_RULES, NAME_RULES, RULES
from quillspan.plans import pipeline
from quillspan.session import cut
from quillspan.sources.tables import blocks, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_BY_NAME = {r.name: r for r in (*RULES, *CUSTOM_RULES, *NAME_RULES)}
_BLOCK = ["document_id", "block_id"]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- intervals ----

#: Characters of one shard: texts of blocks run to some hundreds, so that most cross shards.
P5_WIDTH = 64
P5_SQL = """
WITH len AS (SELECT document_id, block_id, max(length(text)) AS n FROM blocks WHERE text IS NOT NULL GROUP BY document_id, block_id),
v AS (SELECT DISTINCT document_id, block_id, span_start AS s, span_end AS e FROM entities JOIN len USING (document_id, block_id)
  WHERE span_start >= 0 AND span_end > span_start AND span_end <= n AND confidence IS NOT NULL AND CAST(confidence AS VARCHAR) <> 'nan' AND confidence BETWEEN 0 AND 1),
o AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY document_id, block_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM v),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id, block_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM o),
p AS (SELECT document_id, block_id, min(s) AS s, max(e) AS e FROM g GROUP BY document_id, block_id, grp),
x AS (SELECT document_id, block_id, e AS s, lead(s) OVER (PARTITION BY document_id, block_id ORDER BY s) AS e FROM p)
SELECT document_id, block_id, 'period' AS piece, s AS span_start, e AS span_end FROM p
UNION ALL SELECT document_id, block_id, 'gap', s, e FROM x WHERE e > s
"""


@query("p5_found", P5_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Merged periods and gaps of the detected spans of every block."""
    spans = valid_spans(
        table(spark, d, "entities", "document_id", "block_id", "span_start", "span_end", "confidence"),
        table(spark, d, "blocks", "document_id", "block_id", "text"),
    )
    return merge_intervals(spans, ["document_id", "block_id"], "span_start", "span_end", P5_WIDTH)


# ---- detection rules ----

# Texts that the tables lack, beside all blocks, so that every rule meets a case and its opposite.
VECTORS = (
    "M +1 (555) 0114", "call +44 (20) 7946-012 or +7 (12) 34-56", "Mobile: 555 0199", "Tel. (212) 555 0136 and T 555 01", "Phone: +1 212-555-0147, fax", "telephone : (020) 7946 0999", "SSN 900-12-3456 on file", "SSN 000-12-3456 and 123-00-4567",
    "roster PAN ABCPD1234E listed", "PAN ABCXD1234E", "holder passport ZQ1234567 seen", "Passport no. ab123456", "PESEL 900101xxxxx", "pesel: 44051401359.", "Record 44051401359 archived", "Record 44051401358 archived", "EIN 98-7654321", "tax id no. 123456789 and TIN: 12-34567890",
    "Ref 12-3456789 approved", "joint savings account ending in 9876.", "card that ends with 12345", "last four digits of your social security number (1234)", "last 4 digits 98765", "Social Security number (4321) given, SSN(99)", "ssn: 123 45 6789", "SSN 12-34-567 x", "Section 90.42.7781 of the manual",
    "date of birth, 4 March 1988.", "DOB 12/03/1990 born on May 4, 1971", "born in 1990", "lives at 12 Maple Court, Apt 3B, Springfield, IL 62704 now", "Card 4111 1111 1111 1111 used", "Card 4111 1111 1111 1112 used", "card 9000000000000001", "IBAN GB29NWBK60161331926819 and GB29", "DE89370400440532013000.",
    "OCR read D1R-0042 and DlR-0O42", "EMP-00421 EWP 0O421x EMF0I2l45", "MER- PH-2214, MER-AB-12", "Review complete. Staff No.: V8R_52A; proceed.", "Staff ID: ISS-2026-0112", "Staff ID: 1234", "Staff ID: 12345678901", "employee code 729104, associate id = AB12", "Employee ID: EMP-12345 employee no # 123456",
    "client id: CLI-1234 client id=C-99999", "customer id # CUST-0001, customer id 12345", "portfolio id: AX-77771 portfolio id: 123", "Account: 1234567 account no: ACC-12345 account # 12", "Quentin R. Abernathy met Mia T. O", "Jean-Luc P. Duval-Roy, x", "mail ann.lee@mail.example.org, (bob@x.co) and @bob c@d", "10.0.0.256 and 10.20.30.40",
)
_V = ", ".join(f"('vector', 'v{i}', '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(VECTORS))
_B = "(SELECT document_id, block_id, any_value(text) AS text FROM blocks WHERE text IS NOT NULL GROUP BY document_id, block_id)"
_BV = f"(SELECT * FROM {_B} UNION ALL SELECT * FROM (VALUES {_V}) AS v(document_id, block_id, text))"


def _with_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([("vector", f"v{i}", t) for i, t in enumerate(VECTORS)], "document_id string, block_id string, text string")
    return blocks(spark, d, "document_id", "block_id", "text").unionByName(v)


_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_LUHN = r"""
  length(dg) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda i: CASE WHEN (length(dg) - i) % 2 = 1
    THEN (CASE WHEN CAST(dg[i] AS INT) > 4 THEN CAST(dg[i] AS INT) * 2 - 9 ELSE CAST(dg[i] AS INT) * 2 END) ELSE CAST(dg[i] AS INT) END)) % 10 = 0
  AND ((left(dg, 1) = '4' AND length(dg) IN (13, 16, 19)) OR ((left(dg, 2) BETWEEN '51' AND '55' OR left(dg, 4) BETWEEN '2221' AND '2720') AND length(dg) = 16)
    OR (left(dg, 2) IN ('34', '37') AND length(dg) = 15) OR ((left(dg, 4) = '6011' OR left(dg, 2) = '65' OR left(dg, 3) BETWEEN '644' AND '649') AND length(dg) BETWEEN 16 AND 19)
    OR (left(dg, 4) BETWEEN '3528' AND '3589' AND length(dg) BETWEEN 16 AND 19) OR ((left(dg, 2) IN ('36', '38', '39') OR left(dg, 3) BETWEEN '300' AND '305') AND length(dg) BETWEEN 14 AND 19)
    OR (left(dg, 2) = '62' AND length(dg) BETWEEN 16 AND 19))
"""
_PESEL = r"""
  (10 - list_sum(list_transform(range(1, 11), lambda i: CAST(value[i] AS INT) * [1, 3, 7, 9, 1, 3, 7, 9, 1, 3][i])) % 10) % 10 = CAST(value[11] AS INT)
  AND CAST(value[3:4] AS INT) % 20 BETWEEN 1 AND 12 AND CAST(value[3:4] AS INT) // 20 BETWEEN 0 AND 4 AND CAST(value[5:6] AS INT) BETWEEN 1 AND 31
"""
_LEFT, _DIGITS = "(?:^|[^0-9A-Za-z])", "length(regexp_replace(value, '[^0-9]', '', 'g'))"
_RIGHT = "(?:[^0-9A-Za-z]|$)"
_PERSONNEL_OK = r"""(regexp_full_match(value, '[0-9]{5,10}') OR (length(value) BETWEEN 5 AND 24 AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')))
  AND NOT regexp_full_match(value, '(?i)[A-Z]{2,8}-(?:19|20)\d{2}-\d{2,5}') AND NOT regexp_full_match(value, '(?i)(?:19|20)\d{2}-\d{2}-\d{2}T\d{2}')"""
# rule: (pattern of RE2, group, condition); what a rule looks at beside its match is a part of the pattern here, outside the group
_RULE_SQL: dict[str, tuple[str, int, str]] = {
    "email": (r"(?i)(?:^|[^\w.@%+-])([A-Z0-9_%+-]+(?:\.[A-Z0-9_%+-]+)*@[A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?(?:\.[A-Z0-9](?:[A-Z0-9-]*[A-Z0-9])?)*\.[A-Z]{2,63})(?:[^\w@-]|$)", 1, "true"),
    "labelled_phone_long": (r"(?i)\b(?:phone|telephone|mobile|tel)[ \t]*:[ \t]*((?:\+[1-9]\d{0,2}[ -])?(?:\(\d{2,4}\)|\d{2,4})(?:[ -]\d{2,4}){2,3}|\+[1-9]\d{9,14})(?:[^\w-]|$)", 1, f"{_DIGITS} BETWEEN 10 AND 15"),
    "phone_short": (r"(?:^|[^\w+])(\+\d{1,3}[ \t]?\(\d{2,4}\)[ \t]?\d{3,4}(?:[ \t-]\d{3,4})?)(?:[^\d-]|$)", 1, f"{_DIGITS} >= 7"),
    "labelled_phone": (r"\b(?:M|T|Mob|Mobile|Cell|Phone|Tel|Telephone)\b\.?:?[ \t]*(\(?\d{3}\)?[ .-]?\d{3,4}(?:[ .-]\d{3,4})?)(?:[^\d-]|$)", 1, f"{_DIGITS} >= 7"),
    "pesel": (r"(?i:\bPESEL)[\s:#]*(\d{6}[\dXx]{5})\b", 1, "true"),
    "tin": (r"(?i:\b(?:TIN|EIN|FEIN|tax\s*(?:payer\s*)?(?:id(?:entification)?)(?:\s*(?:no\.?|number|#))?)\b)[\s:#.-]*(\d{2}-?\d{7})(?:[^\d-]|$)", 1, "true"),
    "ssn_last4": (r"(?i:\blast\s+(?:four|4)\s+digits\b)[^.\n]{0,60}?\(?(\d{4})(?:[^\d-]|$)", 1, "true"),
    "ssn_last4_label": (r"(?i:\b(?:social\s+security(?:\s+number)?|SSN)\s*)\((\d{4})\)", 1, "true"),
    "ssn_ocr": (r"(?i:\b(?:SSN|social\s+security(?:\s+(?:no\.?|number))?)\b)[\s:#]*(\d{2,3}[\s.,-]{1,2}\d{2}[\s.,-]{1,2}\d{3,4})(?:[^\d]|$)", 1, "true"),
    "dob": (rf"(?i:\b(?:DOB|D\.O\.B\.?|date\s+of\s+birth|born(?:\s+on)?)\b)[\s:,-]*({_DATE})", 1, "true"),
    **{f"custom_{t.lower()}": (rf"(?i)\b{label}[ \t]*(?::|=|#)[ \t]*({value})(?:[^\w-]|$)", 1, "true") for t, label, value in _LABELLED},
    "custom_personnel": (r"(?i)\b(?:employee|staff|personnel|associate)[ \t]+(?:id|number|no\.?|code)(?:[ \t]+(?:[:=#][ \t]*)?|[:=#][ \t]*)([A-Za-z0-9]+(?:[-_][A-Za-z0-9]+){0,2})(?:[^\w-]|$)", 1, _PERSONNEL_OK),
    "standalone_emp": (rf"{_LEFT}(E[MW][PF]-?\s?[0-9OoIl|]{{5,8}}){_RIGHT}", 1, f"{_DIGITS} >= 3"),
    "standalone_dir": (rf"{_LEFT}(D[I1l|]R-[0-9OoIl|]{{4}}){_RIGHT}", 1, "length(regexp_replace(right(value, 4), '[^0-9]', '', 'g')) >= 2"),
    "standalone_mer": (rf"{_LEFT}(MER-\s*[A-Z]{{2}}-\d{{4}}){_RIGHT}", 1, "true"),
    "name_with_initial": (r"(?:^|[^\w.-])([A-Z][a-z]+(?:-[A-Z][a-z]+)?[ \t]+[A-Z]\.[ \t]+[A-Z][a-z]+(?:-[A-Z][a-z]+)?)(?:[^\w-]|$)", 1, "true"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", 0, "left(value, 3) NOT IN ('000', '666') AND value[5:6] <> '00' AND right(value, 4) <> '0000'"),
    "ip": (rf"\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\b", 0, "true"),
    "iban": (r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]{0,16})\b", 0, "true"),
    "in_pan": (r"\b[A-Z]{3}[ABCFGHJLPT][A-Z]\d{4}[A-Z]\b", 0, "true"),
    "passport": (r"(?i:\bpassport(?:\s+(?:no\.?|number|#))?)[\s:#]*([A-Z]{1,2}\d{6,8})\b", 1, "true"),
    "account_ending": (r"(?i:\b(?:card|account|acct|a/c)\b[^.\n]{0,40}?\b(?:ending|ends)(?:\s+(?:in|with))?)\s+(\d{4})\b", 1, "true"),
    "us_address": (_BY_NAME["us_address"].pattern, 0, "true"),
    "pesel_checksum": (r"(?:^|[^\d-])(\d{11})(?:[^\d-]|$)", 1, _PESEL),
    "credit_card": (r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b|\b\d{13,19}\b", 0, _LUHN),
}


def _rule_query(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = with_found(_with_vectors(spark, d), [_BY_NAME[name]]).select("document_id", "block_id", "text", F.explode("found").alias("x"))
        return found.groupBy("document_id", "block_id", F.expr("substring(text, x.s + 1, x.e - x.s)").alias("value")).agg(F.count("*").alias("n"))

    run.__doc__ = f"Values that the rule {name} finds in blocks, and in texts made for the rules."
    return run


for _r in (*RULES, *CUSTOM_RULES, *NAME_RULES):
    _sql = None
    if _r.name in _RULE_SQL:
        _p, _g, _cond = _RULE_SQL[_r.name]
        _quoted = _p.replace("'", "''")
        _sql = f"SELECT document_id, block_id, value, count(*) AS n FROM (SELECT document_id, block_id, unnest(regexp_extract_all(text, '{_quoted}', {_g})) AS value FROM {_BV}), LATERAL (SELECT regexp_replace(value, '[^0-9]', '', 'g') AS dg) WHERE {_cond} GROUP BY document_id, block_id, value"
    query(f"rule_{_r.name}", _sql)(_rule_query(_r.name))


@query("entities_detected")
def entities_detected(spark: SparkSession, d: str) -> DataFrame:
    """What all rules find in blocks, merged."""
    return detect(blocks(spark, d, "document_id", "block_id", "text"))


@query("redacted_generic")
def redacted_generic(spark: SparkSession, d: str) -> DataFrame:
    """Block texts with generic placeholders."""
    return redact_in_place(blocks(spark, d, "document_id", "block_id", "text")).select("document_id", "block_id", "sanitized", "n_redacted")


@query("pii_by_type_and_risk")
def pii_by_type_and_risk(spark: SparkSession, d: str) -> DataFrame:
    """Detections by type and tier, names of a scope's other documents included: the flagship."""
    return pipeline.summary(pipeline.found(blocks(spark, d, *pipeline.COLUMNS), table(spark, d, "source_files")))


@query("pipeline_gate")
def pipeline_gate(spark: SparkSession, d: str) -> DataFrame:
    """Status of every document after one pass of detection, redaction and check."""
    return pipeline.run(blocks(spark, d, *pipeline.COLUMNS), table(spark, d, "source_files")).gate


# ---- merge, risk, tokens, redaction over recorded entities ----

_VALID = """len AS (SELECT DISTINCT document_id, block_id, length(text) AS n FROM blocks WHERE text IS NOT NULL),
valid AS (SELECT DISTINCT document_id, block_id, span_start, span_end, upper(regexp_replace(trim(entity_type), '[\\s-]+', '_', 'g')) AS entity_type, confidence, coalesce(detector, '') AS detector
  FROM entities JOIN len USING (document_id, block_id) WHERE span_start >= 0 AND span_end > span_start AND span_end <= n AND CAST(confidence AS VARCHAR) <> 'nan' AND confidence BETWEEN 0 AND 1 AND entity_type IS NOT NULL)"""
_SPEC = L.sql_case("entity_type", L.SPECIFICITY, "'0'")
_MERGED = f"""{_VALID},
isl AS (SELECT *, CASE WHEN span_start < max(span_end) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM valid WINDOW w AS (PARTITION BY document_id, block_id ORDER BY span_start, span_end, entity_type, confidence, detector)),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id, block_id ORDER BY span_start, span_end, entity_type, confidence, detector ROWS UNBOUNDED PRECEDING) AS part FROM isl),
ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id, block_id, part ORDER BY CAST({_SPEC} AS INT) DESC, confidence DESC, span_end - span_start DESC, span_start, entity_type, detector) AS r FROM num),
merged AS (SELECT document_id, block_id, min(span_start) AS span_start, max(span_end) AS span_end, max(CASE WHEN r = 1 THEN entity_type END) AS entity_type, max(CASE WHEN r = 1 THEN confidence END) AS confidence,
  array_to_string(list_sort(list_filter(list_distinct(flatten(list(regexp_split_to_array(detector, '[|,]')))), lambda x: trim(x) <> '')), '|') AS detector FROM ranked GROUP BY document_id, block_id, part)"""
_CANON = L.sql_case("upper(trim(entity_type))", L.CANONICAL, "upper(trim(entity_type))")
_RISK = L.sql_case("upper(entity_type)", L.RISK, "'MEDIUM'")
_VALUES = f"""{_MERGED},
bl AS (SELECT DISTINCT document_id, block_id, block_ord, text FROM blocks),
sf AS (SELECT DISTINCT document_id, scope_id, doc_ord FROM source_files),
vals AS (SELECT m.*, scope_id, doc_ord, block_ord, {_CANON} AS canonical_type, substring(text, span_start + 1, span_end - span_start) AS value FROM merged m JOIN bl USING (document_id, block_id) JOIN sf USING (document_id)),
ident AS (SELECT *, CASE WHEN canonical_type = 'EMAIL' AND contains(trim(value), '@') THEN regexp_extract(trim(nfc_normalize(value)), '(?s)^(.*@)[^@]*$', 1) || lower(regexp_extract(trim(nfc_normalize(value)), '([^@]*)$', 1)) ELSE trim(nfc_normalize(value)) END AS identity FROM vals),
firsts AS (SELECT scope_id, canonical_type, identity, min((doc_ord, block_ord, span_start)) AS pos, count(*) AS uses FROM ident GROUP BY scope_id, canonical_type, identity),
tok AS (SELECT scope_id, canonical_type, identity, uses, row_number() OVER (PARTITION BY scope_id, canonical_type ORDER BY pos, identity) AS n FROM firsts),
tokens AS (SELECT *, '[' || canonical_type || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || ']' AS token FROM tok)"""
_SANITIZED = f"""{_VALUES},
marks AS (SELECT i.document_id, i.block_id, i.span_start AS s, i.span_end AS e, token, lag(i.span_end, 1, 0) OVER (PARTITION BY i.document_id, i.block_id ORDER BY i.span_start) AS before FROM ident i JOIN tokens USING (scope_id, canonical_type, identity)),
cut AS (SELECT document_id, block_id, string_agg(substring(text, before + 1, s - before) || token, '' ORDER BY s) || substring(any_value(text), max(e) + 1) AS t FROM marks JOIN bl USING (document_id, block_id) GROUP BY document_id, block_id),
sanitized AS (SELECT document_id, block_id, block_ord, coalesce(t, text) AS sanitized FROM bl LEFT JOIN cut USING (document_id, block_id))"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return merge_entities(valid_entities(table(spark, d, "entities", "document_id", "block_id", "span_start", "span_end", "entity_type", "confidence", "detector"), table(spark, d, "blocks", "document_id", "block_id", "text")))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return redact.values(_merged(spark, d), blocks(spark, d, "document_id", "block_id", "block_ord", "text"), table(spark, d, "source_files", "document_id", "scope_id", "doc_ord"))


def _sanitized(spark: SparkSession, d: str) -> DataFrame:
    v = _values(spark, d)
    return redact.sanitized(blocks(spark, d, "document_id", "block_id", "block_ord", "text"), v, redact.tokens(v))


@query("val0_valid_entities", f"WITH {_VALID} SELECT * FROM valid")
def val0_valid_entities(spark: SparkSession, d: str) -> DataFrame:
    return valid_entities(table(spark, d, "entities"), table(spark, d, "blocks", "document_id", "block_id", "text"))


@query("mrg1_entities_merged", f"WITH {_MERGED} SELECT * FROM merged")
def mrg1_entities_merged(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


@query("rsk1_entity_risk", f"WITH {_MERGED} SELECT document_id, block_id, span_start, entity_type, {_RISK} AS risk_level FROM merged")
def rsk1_entity_risk(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("document_id", "block_id", "span_start", "entity_type", risk(F.col("entity_type")).alias("risk_level"))


@query("rsk2_risk_summary", f"WITH {_MERGED}, t AS (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM']) AS risk_level) SELECT t.risk_level, count(m.risk_level) AS n FROM t LEFT JOIN (SELECT {_RISK} AS risk_level FROM merged) m USING (risk_level) GROUP BY t.risk_level")
def rsk2_risk_summary(spark: SparkSession, d: str) -> DataFrame:
    return risk_summary(_merged(spark, d))


@query("red1_placeholders", f"WITH {_MERGED} SELECT '[' || {_CANON} || ']' AS placeholder, count(*) AS n FROM merged GROUP BY 1")
def red1_placeholders(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).groupBy(F.concat(F.lit("["), redact.canonical(F.col("entity_type")), F.lit("]")).alias("placeholder")).agg(F.count("*").alias("n"))


@query("red2_identities", f"WITH {_VALUES} SELECT document_id, block_id, span_start, canonical_type, identity FROM ident")
def red2_identities(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("document_id", "block_id", "span_start", "canonical_type", "identity")


@query("red3_tokens", f"WITH {_VALUES} SELECT scope_id, canonical_type, identity, token, n, uses FROM tokens")
def red3_tokens(spark: SparkSession, d: str) -> DataFrame:
    return redact.tokens(_values(spark, d))


@query("red5_sanitized", f"WITH {_SANITIZED} SELECT * FROM sanitized")
def red5_sanitized(spark: SparkSession, d: str) -> DataFrame:
    return _sanitized(spark, d)


@query("red9_pairs", f"WITH {_VALUES} SELECT DISTINCT scope_id, value, token FROM ident JOIN tokens USING (scope_id, canonical_type, identity) WHERE length(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 3")
def red9_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = _values(spark, d)
    return redact.replacement_pairs(v, redact.tokens(v))


@query("snk1_payload", f"WITH {_SANITIZED} SELECT document_id, string_agg(sanitized, chr(10) ORDER BY block_ord, block_id) AS payload, count(*) AS n_blocks FROM sanitized WHERE trim(sanitized) <> '' GROUP BY document_id")
def snk1_payload(spark: SparkSession, d: str) -> DataFrame:
    return redact.payload(_sanitized(spark, d))


@query("snk2_approved_counts", r"""
WITH f AS (SELECT DISTINCT document_id FROM source_files WHERE gate_status = 'APPROVED'),
t AS (SELECT document_id, string_agg(text, chr(10) ORDER BY block_ord, block_id) AS p FROM (SELECT DISTINCT document_id, block_id, block_ord, text FROM blocks) WHERE trim(text) <> '' GROUP BY document_id)
SELECT document_id, length(p) AS characters, length(p) - length(replace(p, chr(10), '')) + 1 AS lines, len(regexp_extract_all(p, '\[[A-Z][A-Z_]*(?:_\d+)?\]')) AS tokens, len(list_distinct(regexp_extract_all(p, '\[[A-Z][A-Z_]*(?:_\d+)?\]'))) AS distinct_tokens FROM t JOIN f USING (document_id)""")
def snk2_approved_counts(spark: SparkSession, d: str) -> DataFrame:
    """What an approved document hands on: characters, lines, placeholders."""
    ok = table(spark, d, "source_files", "document_id", "gate_status").filter("gate_status = 'APPROVED'").select("document_id").distinct()
    p = redact.payload(blocks(spark, d, "document_id", "block_id", "block_ord", "text"), "text").join(ok, "document_id", "left_semi")
    tokens = F.regexp_extract_all("payload", F.lit(r"\[[A-Z][A-Z_]*(?:_\d+)?\]"), 0)
    return p.select("document_id", F.length("payload").alias("characters"), F.size(F.split("payload", "\n", -1)).alias("lines"), F.size(tokens).alias("tokens"), F.size(F.array_distinct(tokens)).alias("distinct_tokens"))


# ---- gate ----

@query("gate1_extraction", """
WITH f AS (SELECT DISTINCT document_id, ocr_failed_pages FROM source_files)
SELECT document_id, CASE WHEN len(list_filter(coalesce(ocr_failed_pages, []), lambda p: p IS NULL OR p <= 0)) > 0 THEN 'invalid page list' WHEN len(coalesce(ocr_failed_pages, [])) > 0 THEN 'extraction incomplete' ELSE 'no residual data' END AS reason,
CASE WHEN len(coalesce(ocr_failed_pages, [])) > 0 THEN 'BLOCKED' ELSE 'APPROVED' END AS status FROM f""")
def gate1_extraction(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "document_id string, block_id string, detector string")
    return gate.decide(table(spark, d, "source_files", "document_id", "ocr_failed_pages"), none).select("document_id", "reason", "status")


@query("gate3_placeholders", rf"""
WITH t AS (SELECT document_id, block_id, text, scope_id FROM {_B} JOIN (SELECT DISTINCT document_id, scope_id FROM source_files) USING (document_id)),
iss AS (SELECT DISTINCT scope_id, placeholder FROM redactions JOIN (SELECT DISTINCT document_id, scope_id FROM source_files) USING (document_id)),
n AS (SELECT document_id, block_id, scope_id, unnest(regexp_extract_all(text, '\[[A-Z][A-Z_]*_\d+\]')) AS value FROM t)
SELECT document_id, block_id, value, count(*) AS n, coalesce(value IN (SELECT placeholder FROM iss WHERE iss.scope_id = n.scope_id AND placeholder IS NOT NULL), false) AS issued FROM n GROUP BY document_id, block_id, value, scope_id""")
def gate3_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Numbered placeholders in texts, and whether their scope issued them."""
    scope = table(spark, d, "source_files", "document_id", "scope_id").distinct()
    seen = blocks(spark, d, "document_id", "block_id", "text").join(scope, "document_id").select("document_id", "block_id", "scope_id", F.explode(F.regexp_extract_all("text", F.lit(gate.NUMBERED), 0)).alias("value"))
    issued = table(spark, d, "redactions", "document_id", "placeholder").join(scope, "document_id").select("scope_id", F.col("placeholder").alias("value")).distinct().withColumn("issued", F.lit(True))
    return seen.groupBy("document_id", "block_id", "scope_id", "value").agg(F.count("*").alias("n")).join(issued, ["scope_id", "value"], "left").select("document_id", "block_id", "value", "n", F.coalesce("issued", F.lit(False)).alias("issued"))


@query("gate5_residuals")
def gate5_residuals(spark: SparkSession, d: str) -> DataFrame:
    """What the independent checks find in the sanitized texts."""
    v = _values(spark, d)
    issued = redact.tokens(v)
    scope = table(spark, d, "source_files", "document_id", "scope_id").distinct()
    return gate.residuals(_sanitized(spark, d).join(scope, "document_id"), issued)


@query("gate5d_email_shapes", rf"""
SELECT document_id, block_id, value, count(*) AS n FROM (SELECT document_id, block_id, unnest(regexp_extract_all(text, '{gate.EMAIL_SHAPE}')) AS value FROM {_B})
WHERE NOT (regexp_matches(regexp_extract(value, '^([^@]*)@', 1), '\s$') OR regexp_matches(regexp_extract(value, '(?s)@(.*)$', 1), '^\s')) OR regexp_matches(regexp_extract(value, '^([^@]*)@', 1), '\p{{L}}') GROUP BY document_id, block_id, value""")
def gate5d_email_shapes(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "document_id", "block_id", "text")
    v = b.select("document_id", "block_id", F.explode(F.regexp_extract_all("text", F.lit(gate.EMAIL_SHAPE), 0)).alias("value"))
    return v.filter(gate.email_shape_ok(F.col("value"))).groupBy("document_id", "block_id", "value").agg(F.count("*").alias("n"))


@query("gate9_decision", f"""
WITH {_MERGED}, f AS (SELECT DISTINCT document_id, ocr_failed_pages FROM source_files), n AS (SELECT document_id, count(*) AS residual_count, bool_or(contains(detector, 'gate:')) AS independent FROM (SELECT document_id, replace(detector, 'context:', 'gate:') AS detector FROM merged WHERE contains(detector, 'context:') OR confidence < 0.5) GROUP BY document_id)
SELECT document_id, coalesce(residual_count, 0) AS residual_count, coalesce(independent, false) AS independent, CASE WHEN len(coalesce(ocr_failed_pages, [])) > 0 OR coalesce(residual_count, 0) > 0 THEN 'BLOCKED' ELSE 'APPROVED' END AS status FROM f LEFT JOIN n USING (document_id)""")
def gate9_decision(spark: SparkSession, d: str) -> DataFrame:
    """Status of documents when unsure detections and those from context count as residuals, the
    latter as if independent checks had found them."""
    left = _merged(spark, d).filter(F.col("detector").contains("context:") | (F.col("confidence") < 0.5)).withColumn("detector", F.replace("detector", F.lit("context:"), F.lit("gate:")))
    return gate.decide(table(spark, d, "source_files", "document_id", "ocr_failed_pages"), left).select("document_id", "residual_count", "independent", "status")


# ---- audit and files ----

_LOC = """CASE WHEN extraction_method = 'embedded_image_ocr' THEN 'image' WHEN kind IN ('header', 'footer', 'text_box', 'notes') THEN kind WHEN kind = 'table_cell' THEN 'table' WHEN extraction_method = 'ocr' THEN 'scanned_page' ELSE 'body' END"""
_CATEGORY = "CASE WHEN entity_type IN (" + ", ".join(f"'{c}'" for c in audit.CATEGORIES) + ") THEN entity_type ELSE 'OTHER' END"
_COUNTS = f"""{_MERGED}, bk AS (SELECT DISTINCT document_id, block_id, {_LOC} AS loc FROM blocks), j AS (SELECT m.*, loc FROM merged m LEFT JOIN bk USING (document_id, block_id))"""


@query("aud_counts", f"""
WITH {_COUNTS}
SELECT document_id, 'category' AS dimension, {_CATEGORY} AS value, count(*) AS n FROM j GROUP BY 1, 2, 3
UNION ALL SELECT document_id, 'location', coalesce(loc, 'unknown'), count(*) FROM j GROUP BY 1, 2, 3
UNION ALL SELECT document_id, 'risk', {_RISK}, count(*) FROM j GROUP BY 1, 2, 3""")
def aud_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.counts_by(_merged(spark, d), blocks(spark, d, "document_id", "block_id", "extraction_method", "kind"))


@query("aud_reports")
def aud_reports(spark: SparkSession, d: str) -> DataFrame:
    """One JSON report a document."""
    none = spark.createDataFrame([], "document_id string, block_id string, detector string")
    return audit.report(_merged(spark, d), blocks(spark, d, "document_id", "block_id", "extraction_method", "kind"), gate.decide(table(spark, d, "source_files", "document_id", "ocr_failed_pages"), none))


_WHERE = "CASE WHEN image_name IS NOT NULL AND image_name <> '' THEN 'image ' || image_name WHEN kind IN ('header', 'footer', 'text_box') THEN replace(kind, '_', ' ') WHEN kind = 'notes' THEN 'notes' END"
_PLACE = f"""CASE WHEN {_WHERE} IS NULL AND page_number IS NOT NULL THEN 'p.' || page_number WHEN {_WHERE} IS NULL AND kind = 'table_cell' AND table_number IS NOT NULL AND slide_number IS NULL THEN 'table ' || table_number
 WHEN {_WHERE} IS NULL AND paragraph_number IS NOT NULL THEN 'para ' || paragraph_number WHEN slide_number IS NOT NULL THEN 'slide ' || slide_number || coalesce(' ' || {_WHERE}, '') ELSE coalesce({_WHERE}, 'body') END"""
_PLACES = f"""b AS (SELECT DISTINCT document_id, block_id, block_ord, {_PLACE} AS location FROM blocks),
f AS (SELECT DISTINCT document_id, scope_id, doc_ord, file_name FROM source_files),
r AS (SELECT DISTINCT document_id, block_id, placeholder, upper(regexp_replace(trim(entity_type), '[\\s-]+', '_', 'g')) AS entity_type FROM redactions WHERE placeholder IS NOT NULL),
g AS (SELECT scope_id, placeholder, file_name, coalesce(location, 'unknown') AS location, min((doc_ord, block_ord)) AS pos, min({_CANON}) AS entity_type FROM r JOIN f USING (document_id) LEFT JOIN b USING (document_id, block_id) GROUP BY 1, 2, 3, 4),
places AS (SELECT scope_id, placeholder, entity_type, file_name, location, row_number() OVER (PARTITION BY scope_id, placeholder ORDER BY pos, file_name, location) AS n FROM g)"""


def _places(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "document_id", "block_id", "block_ord", "image_name", "kind", "page_number", "slide_number", "table_number", "paragraph_number")
    return audit.token_places(table(spark, d, "redactions"), b, table(spark, d, "source_files"))


@query("xf1_token_places", f"WITH {_PLACES} SELECT * FROM places")
def xf1_token_places(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d)


@query("xf2_block_places", f"SELECT DISTINCT document_id, block_id, {_PLACE} AS location FROM blocks")
def xf2_block_places(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d, "document_id", "block_id", "image_name", "kind", "page_number", "slide_number", "table_number", "paragraph_number")
    return b.select("document_id", "block_id", audit.location_text(*(F.col(c) for c in ("image_name", "kind", "page_number", "slide_number", "table_number", "paragraph_number"))).alias("location"))


@query("xf4_places_text", f"""
WITH {_PLACES}, byf AS (SELECT scope_id, placeholder, file_name, min(n) AS n, file_name || ' ' || string_agg(location, ', ' ORDER BY n) AS t FROM places GROUP BY scope_id, placeholder, file_name)
SELECT scope_id, placeholder, string_agg(t, '; ' ORDER BY n) AS places, count(*) AS n_files FROM byf GROUP BY scope_id, placeholder""")
def xf4_places_text(spark: SparkSession, d: str) -> DataFrame:
    return audit.places_text(_places(spark, d))


@query("xf3_mail_persons", f"""
WITH {_VALUES}, m AS (SELECT DISTINCT scope_id, identity, list_filter(regexp_split_to_array(regexp_extract(identity, '(?s)^(.*)@', 1), '[._-]'), lambda p: regexp_matches(p, '^\\p{{L}}+$')) AS p FROM ident WHERE canonical_type = 'EMAIL' AND contains(identity, '@')),
k AS (SELECT DISTINCT scope_id, first_name, last_name, lower(replace(last_name, '-', '')) AS surname, lower(substring(coalesce(first_name, name_initial), 1, 1)) AS i FROM people WHERE last_name IS NOT NULL)
SELECT scope_id, identity, min((first_name, last_name))[1] AS first_name, min((first_name, last_name))[2] AS last_name FROM (SELECT m.scope_id, identity, first_name, last_name FROM m JOIN k ON m.scope_id = k.scope_id AND len(p) >= 2 AND lower(p[-1]) = surname AND (i IS NULL OR i = lower(p[1][1]))) GROUP BY scope_id, identity HAVING count(*) = 1""")
def xf3_mail_persons(spark: SparkSession, d: str) -> DataFrame:
    """Mail identities with the one person of their scope that they name."""
    return audit.mail_persons(_values(spark, d), table(spark, d, "people", "scope_id", "first_name", "last_name", "name_initial"))


# ---- context and registry ----

@query("ctx_headers", """
WITH c AS (SELECT DISTINCT document_id, block_id, text, page_number, slide_number, table_number, row_number, column_number FROM blocks WHERE kind = 'table_cell' AND row_number IS NOT NULL AND column_number IS NOT NULL)
SELECT document_id, block_id, header FROM (SELECT document_id, block_id, row_number, max(CASE WHEN row_number = 1 THEN text END) OVER (PARTITION BY document_id, page_number, slide_number, table_number, column_number) AS header FROM c) WHERE row_number > 1""")
def ctx_headers(spark: SparkSession, d: str) -> DataFrame:
    """Table cells with the header of their column."""
    return gate.column_headers(_cells(spark, d)).select("document_id", "block_id", "header")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d, "document_id", "block_id", "block_ord", "text", "kind", "page_number", "slide_number", "table_number", "row_number", "column_number")


# A table that the data lack: (row, column, text).
CELLS = ((1, 1, "Name"), (1, 2, "Direct line"), (1, 3, "Staff Code"), (1, 4, "Project Code"), (2, 1, "Ann"), (2, 2, "(212) 555-0147"), (2, 3, "V8R52A"), (2, 4, "482731"), (3, 1, "Bob"), (3, 2, "ext. 12"), (3, 3, "729104 or ISS-2026-0112"), (3, 4, "AB12C"))
_CELLS_SQL = "cells AS (SELECT DISTINCT document_id, block_id, text, page_number, slide_number, table_number, row_number, column_number FROM blocks WHERE kind = 'table_cell' AND row_number IS NOT NULL AND column_number IS NOT NULL UNION ALL SELECT 'vector', r || '/' || c, t, NULL, NULL, 1, r, c FROM (VALUES " + ", ".join(f"({r}, {c}, '{t}')" for r, c, t in CELLS) + ") AS v(r, c, t)), heads AS (SELECT *, max(CASE WHEN row_number = 1 THEN text END) OVER (PARTITION BY document_id, page_number, slide_number, table_number, column_number) AS header FROM cells)"


def _all_cells(spark: SparkSession, d: str) -> DataFrame:
    v = spark.createDataFrame([("vector", f"{r}/{c}", 0, t, "table_cell", None, None, 1, r, c) for r, c, t in CELLS], "document_id string, block_id string, block_ord long, text string, kind string, page_number int, slide_number int, table_number int, row_number int, column_number int")
    return _cells(spark, d).unionByName(v)


def _values_of(spans: DataFrame, texts: DataFrame) -> DataFrame:
    return spans.join(texts.select(*_BLOCK, "text"), _BLOCK).groupBy(*_BLOCK, F.expr("substring(text, span_start + 1, span_end - span_start)").alias("value")).agg(F.count("*").alias("n"))


@query("ctx1_header_phones", rf"""WITH {_CELLS_SQL} SELECT document_id, block_id, value, count(*) AS n FROM (SELECT document_id, block_id, unnest(regexp_extract_all(text, '(?:^|\W)(\+?\(?\d[\d ().-]{{5,}}\d)(?:\W|$)', 1)) AS value FROM heads
WHERE row_number > 1 AND regexp_matches(header, '(?i)\b(?:mobile|phone|tel|telephone|cell|direct line|contact)\b')) WHERE {_DIGITS} >= 7 GROUP BY 1, 2, 3""")
def ctx1_header_phones(spark: SparkSession, d: str) -> DataFrame:
    c = _all_cells(spark, d)
    return _values_of(context.header_phones(c), c)


@query("ctx2_header_personnel", rf"""WITH {_CELLS_SQL}, words AS (SELECT document_id, block_id, unnest(regexp_extract_all(regexp_replace(text, '([^\w-])', '\1\1', 'g'), '(?:^|[^\w-])([A-Za-z0-9]+(?:[-_][A-Za-z0-9]+){{0,2}})(?:[^\w-]|$)', 1)) AS value FROM heads
WHERE row_number > 1 AND regexp_matches(header, '(?i)\b(?:employee|staff|personnel|associate)[ \t]+(?:id|number|no\.?|code)(?:\W|$)')) SELECT document_id, block_id, value, count(*) AS n FROM words WHERE {_PERSONNEL_OK} GROUP BY 1, 2, 3""")
def ctx2_header_personnel(spark: SparkSession, d: str) -> DataFrame:
    c = _all_cells(spark, d)
    return _values_of(context.header_personnel(c), c)


@query("ctx3_role_names")
def ctx3_role_names(spark: SparkSession, d: str) -> DataFrame:
    return context.role_names(_cells(spark, d))


@query("ctx4_split_country_codes")
def ctx4_split_country_codes(spark: SparkSession, d: str) -> DataFrame:
    b = _cells(spark, d)
    return context.split_country_codes(b, detect(b, [r for r in RULES if r.entity_type == "PHONE_NUMBER"]))


@query("reg1_email_names", r"""
WITH l AS (SELECT document_id, block_ord, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 1)) AS loc, generate_subscripts(regexp_extract_all(text, '([A-Za-z0-9._%+-]+)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 1), 1) AS i
  FROM (SELECT DISTINCT document_id, block_id, block_ord, text FROM blocks WHERE text IS NOT NULL)),
p AS (SELECT document_id, block_ord, i, list_filter(regexp_split_to_array(loc, '[._-]'), lambda x: regexp_matches(x, '^\p{L}+$')) AS q FROM l)
SELECT document_id, lower(q[-1]) AS surname, arg_min(lower(q[1][1]), (block_ord, i)) AS initial FROM p WHERE len(q) >= 2 AND length(q[-1]) >= 3 GROUP BY 1, 2""")
def reg1_email_names(spark: SparkSession, d: str) -> DataFrame:
    return registry.email_names(blocks(spark, d, "document_id", "block_id", "block_ord", "text"))


@query("reg2_honorific_surnames", r"""SELECT DISTINCT document_id, unnest(regexp_extract_all(text, '\b(?:Mr|Ms|Mrs|Miss|Mx|Dr|Prof)\.?\s+([A-Z][a-z]+(?:-[A-Z][a-z]+)?)(?:[^\p{L}\p{N}_]|$)', 1)) AS surname FROM blocks WHERE text IS NOT NULL""")
def reg2_honorific_surnames(spark: SparkSession, d: str) -> DataFrame:
    return registry.honorific_surnames(blocks(spark, d, "document_id", "block_id", "text"))


@query("reg5_people_merged")
def reg5_people_merged(spark: SparkSession, d: str) -> DataFrame:
    """The registered people of every scope, each once."""
    return registry.merge_people(table(spark, d, "people"))


@query("reg8_resolved")
def reg8_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Identities of recorded values where a name is the one registered person it can mean."""
    return registry.resolved(_values(spark, d), registry.merge_people(table(spark, d, "people"))).select("document_id", "block_id", "span_start", "canonical_type", "identity")


@query("reg7_sweep")
def reg7_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Registered names of each scope in its texts."""
    scope = table(spark, d, "source_files", "document_id", "scope_id").distinct()
    t = blocks(spark, d, "document_id", "block_id", "text").filter("text is not null").join(scope, "document_id")
    return registry.sweep(t, registry.merge_people(table(spark, d, "people")))


# ---- evaluation ----

_TRUTH = """lab AS (SELECT DISTINCT row_id, document_id, CASE entity_type WHEN 'EMAIL' THEN 'EMAIL' ELSE entity_type END AS kind, lower(trim(value_text)) AS value FROM label_rows JOIN (SELECT DISTINCT document_id, file_name FROM source_files) USING (file_name) WHERE value_text IS NOT NULL)"""


@query("ev1_rates", f"""
WITH {_VALUES}, {_TRUTH}, t AS (SELECT DISTINCT document_id, kind, value FROM lab), g AS (SELECT DISTINCT document_id, canonical_type AS kind, lower(trim(value)) AS value FROM vals WHERE canonical_type IN ('PERSON', 'EMAIL', 'PHONE', 'GOVERNMENT_ID', 'ADDRESS')),
c AS (SELECT kind, sum(CASE WHEN t.document_id IS NOT NULL AND g.document_id IS NOT NULL THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t.document_id IS NULL THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN g.document_id IS NULL THEN 1 ELSE 0 END) AS fn FROM t FULL JOIN g USING (document_id, kind, value) GROUP BY kind),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall FROM c)
SELECT kind, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r""")
def ev1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Recorded detections against labels, by distinct value of a document."""
    t = _labels(spark, d).select("document_id", F.col("entity_type").alias("kind"), F.lower(F.trim("value_text")).alias("value")).distinct().withColumn("t", F.lit(1))
    g = _values(spark, d).select("document_id", F.col("canonical_type").alias("kind"), F.lower(F.trim("value")).alias("value")).filter(F.col("kind").isin("PERSON", "EMAIL", "PHONE", "GOVERNMENT_ID", "ADDRESS")).distinct().withColumn("g", F.lit(1))
    c = t.join(g, ["document_id", "kind", "value"], "full").groupBy("kind").agg(F.sum((F.col("t").isNotNull() & F.col("g").isNotNull()).cast("long")).alias("tp"), F.sum(F.col("t").isNull().cast("long")).alias("fp"), F.sum(F.col("g").isNull().cast("long")).alias("fn"))
    return evaluate.rates(c)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files", "document_id", "file_name").distinct()
    return table(spark, d, "label_rows", "row_id", "file_name", "entity_type", "value_text", "location_type", "uncertain").filter("value_text is not null").distinct().join(files, "file_name")


@query("ev2_one_to_one")
def ev2_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.match_one_to_one(_labels(spark, d).select("document_id", "entity_type", F.col("value_text").alias("value"), F.format_string("%012d", "row_id").alias("ord")), _values(spark, d).select("document_id", F.col("canonical_type").alias("entity_type"), "value", F.format_string("%012d %012d", "block_ord", "span_start").alias("ord")))


@query("ev3_structure", f"""
WITH {_SANITIZED}, o AS (SELECT DISTINCT document_id, block_id, text FROM blocks)
SELECT document_id, avg(CASE WHEN trim(coalesce(text, '')) = '' OR trim(coalesce(sanitized, '')) <> '' THEN 1.0 ELSE 0.0 END) AS kept FROM o JOIN sanitized USING (document_id, block_id) GROUP BY document_id""")
def ev3_structure(spark: SparkSession, d: str) -> DataFrame:
    o = blocks(spark, d, "document_id", "block_id", "block_ord", "text", "page_number", "slide_number", "paragraph_number")
    s = _sanitized(spark, d).withColumnRenamed("sanitized", "text").join(o.drop("text", "block_ord"), _BLOCK)
    return evaluate.structure_kept(o, s)


@query("ev4_page_offsets", """
WITH b AS (SELECT DISTINCT document_id, block_id, block_ord, length(coalesce(text, '')) AS n, CASE WHEN image_name IS NOT NULL AND image_name <> '' THEN image_name ELSE coalesce(CAST(page_number AS VARCHAR), CAST(slide_number AS VARCHAR), '') END AS page_key FROM blocks),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY document_id, page_key ORDER BY block_ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM b)
SELECT document_id, page_key, block_id, CAST(so_far + sum(CASE WHEN so_far > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_key ORDER BY block_ord, block_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS offset FROM c""")
def ev4_page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.page_offsets(blocks(spark, d, "document_id", "block_id", "block_ord", "text", "page_number", "slide_number", "image_name"))


@query("ev7_labels_found")
def ev7_labels_found(spark: SparkSession, d: str) -> DataFrame:
    """The places of labels in their document, each stretch claimed by one label, the longest first."""
    pages = evaluate.page_texts(blocks(spark, d, "document_id", "block_id", "block_ord", "text", "page_number", "slide_number", "image_name"))
    return evaluate.labels_found(_labels(spark, d), pages)


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.page_offsets(blocks(spark, d, "document_id", "block_id", "block_ord", "text", "page_number", "slide_number", "image_name"))


_OFFSETS = """pg AS (SELECT DISTINCT document_id, block_id, block_ord, length(coalesce(text, '')) AS n, CASE WHEN image_name IS NOT NULL AND image_name <> '' THEN image_name ELSE coalesce(CAST(page_number AS VARCHAR), CAST(slide_number AS VARCHAR), '') END AS page_key FROM blocks),
pc AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY document_id, page_key ORDER BY block_ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM pg),
po AS (SELECT document_id, page_key, block_id, so_far + sum(CASE WHEN so_far > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_key ORDER BY block_ord, block_id ROWS UNBOUNDED PRECEDING) AS off FROM pc),
spans AS (SELECT document_id, page_key, block_id, CAST(span_start + off AS INTEGER) AS span_start, CAST(span_end + off AS INTEGER) AS span_end, entity_type FROM merged JOIN po USING (document_id, block_id))"""


@query("ev8_page_spans", f"WITH {_MERGED}, {_OFFSETS} SELECT * FROM spans")
def ev8_page_spans(spark: SparkSession, d: str) -> DataFrame:
    """Recorded detections in characters of their pages."""
    return evaluate.page_spans(_merged(spark, d), _offsets(spark, d))


@query("ev9_overlaps", f"""WITH {_MERGED}, {_OFFSETS}, w AS (SELECT document_id, page_key, span_start + 2 AS span_start, span_end + 3 AS span_end FROM spans)
SELECT w.document_id, w.page_key, w.span_start, w.span_end, s.span_start AS x_start, s.span_end AS x_end, s.entity_type AS x_type FROM w JOIN spans s ON w.document_id = s.document_id AND w.page_key = s.page_key AND w.span_start < s.span_end AND s.span_start < w.span_end""")
def ev9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Detections that stretches of their page overlap: the stretches are the detections themselves,
    moved by two characters and one longer."""
    spans = ev8_page_spans(spark, d)
    moved = spans.select("document_id", "page_key", (F.col("span_start") + 2).alias("span_start"), (F.col("span_end") + 3).alias("span_end"))
    return evaluate.overlaps(moved, spans, "span_start")


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = blocks(spark, d, "document_id", "block_id", "block_ord", "text", "page_number", "slide_number", "image_name", "extraction_method")
    pages = cut(evaluate.page_texts(b))
    labels = _labels(spark, d)
    places = cut(evaluate.labels_found(labels, pages).join(labels.select("row_id", "document_id", "location_type", "uncertain", "file_name").distinct(), "row_id"))
    methods = b.withColumn("page_key", evaluate.page_key(F.col("image_name"), F.col("page_number"), F.col("slide_number"))).groupBy("document_id", "page_key").agg(F.min("extraction_method").alias("method"))
    return places, evaluate.judged(places, ev8_page_spans(spark, d), pages), methods


@query("ev10_slices")
def ev10_slices(spark: SparkSession, d: str) -> DataFrame:
    """Recall and residual rate of certain labels over all, by type, by channel and by location."""
    places, seen, methods = _judged(spark, d)
    rows = seen.join(places.select("row_id", "entity_type", "location_type", "uncertain").distinct(), "row_id").filter("not coalesce(uncertain, false)").join(methods, ["document_id", "page_key"], "left")
    return evaluate.slices(rows.select("entity_type", evaluate.channel(F.col("location_type"), F.col("method")).alias("channel"), F.coalesce("location_type", F.lit("unknown")).alias("location"), "detected", "residual"))


@query("ev11_micro_average")
def ev11_micro_average(spark: SparkSession, d: str) -> DataFrame:
    """Rates of every labelled file and of all together."""
    places, seen, _ = _judged(spark, d)
    files = places.select("document_id", "file_name").distinct()
    certain = places.filter("not coalesce(uncertain, false)").select("row_id").distinct()
    fn = seen.join(certain, "row_id").groupBy("document_id").agg(F.sum((~F.col("detected")).cast("long")).alias("fn"), F.sum(F.col("residual").cast("long")).alias("residual"))
    tp = evaluate.judged_detections(places, ev8_page_spans(spark, d)).groupBy("document_id").agg(F.sum(F.col("tp").cast("long")).alias("tp"), F.sum(F.col("fp").cast("long")).alias("fp"))
    counts = files.join(tp, "document_id", "left").join(fn, "document_id", "left").select("file_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "residual")])
    return evaluate.micro_average(counts)


@query("ev12_coverage", f"""
WITH {_SANITIZED}, a AS (SELECT document_id, w, count(*) AS a FROM (SELECT document_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM bl WHERE text IS NOT NULL) GROUP BY 1, 2),
b AS (SELECT document_id, w, count(*) AS b FROM (SELECT document_id, unnest(regexp_extract_all(lower(sanitized), '[\\p{{L}}\\p{{N}}]+')) AS w FROM sanitized WHERE sanitized IS NOT NULL) GROUP BY 1, 2)
SELECT document_id, sum(length(w) * least(a, coalesce(b, 0))) / sum(length(w) * a) AS coverage FROM a LEFT JOIN b USING (document_id, w) GROUP BY document_id""")
def ev12_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document's text the sanitized text still holds."""
    return evaluate.character_coverage(blocks(spark, d, "document_id", "block_id", "text"), _sanitized(spark, d).withColumnRenamed("sanitized", "text"))


@query("ev14_cells_kept", f"""
WITH {_SANITIZED}, c AS (SELECT DISTINCT document_id, block_id, table_number, row_number, column_number, text FROM blocks WHERE kind = 'table_cell' AND table_number IS NOT NULL AND row_number IS NOT NULL AND column_number IS NOT NULL),
r AS (SELECT document_id, table_number, row_number, column_number, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS v FROM c), x AS (SELECT DISTINCT document_id, table_number, row_number, column_number, regexp_replace(lower(sanitized), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS v FROM c JOIN sanitized USING (document_id, block_id))
SELECT document_id, avg(CASE WHEN x.v IS NOT NULL THEN 1.0 ELSE 0.0 END) AS kept, count(*) AS cells FROM r LEFT JOIN x USING (document_id, table_number, row_number, column_number, v) WHERE r.v <> '' GROUP BY document_id""")
def ev14_cells_kept(spark: SparkSession, d: str) -> DataFrame:
    place = ["document_id", "table_number", "row_number", "column_number"]
    c = blocks(spark, d, *place, "block_id", "text", "kind").filter("kind = 'table_cell' and table_number is not null and row_number is not null and column_number is not null")
    return evaluate.cells_kept(c, c.drop("text").join(_sanitized(spark, d).withColumnRenamed("sanitized", "text"), _BLOCK), place)


@query("ev15_substring_distance")
def ev15_substring_distance(spark: SparkSession, d: str) -> DataFrame:
    """Edits between every label and the nearest stretch of its document's pages. Equal values of a
    document are measured once."""
    pages = evaluate.page_texts(blocks(spark, d, "document_id", "block_id", "block_ord", "text", "page_number", "slide_number", "image_name"))
    labels = _labels(spark, d)
    near = evaluate.nearest_stretches(labels, pages)
    return labels.join(near, ["document_id", "value_text"]).groupBy("row_id").agg(F.min("distance").alias("distance"))


@query("ev16_compared", f"""
WITH {_VALUES}, {_TRUTH}, kinds AS (SELECT unnest(['PERSON', 'EMAIL', 'PHONE', 'GOVERNMENT_ID', 'ADDRESS']) AS kind), t AS (SELECT DISTINCT document_id, kind, value FROM lab),
g AS (SELECT document_id, canonical_type AS kind, lower(trim(value)) AS value, max(confidence) AS c FROM vals GROUP BY 1, 2, 3),
runs AS (SELECT unnest([0.0, 0.8]) AS least), c AS (SELECT least, t.kind, sum(CASE WHEN g.c >= least THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN g.c >= least THEN 0 ELSE 1 END) AS fn FROM t CROSS JOIN runs LEFT JOIN g ON t.document_id = g.document_id AND t.kind = g.kind AND t.value = g.value GROUP BY 1, 2),
r AS (SELECT least, kind, tp / (tp + fn) AS recall FROM c) SELECT a.kind, b.recall AS recall_before, a.recall AS recall_after, a.recall - b.recall AS recall_delta FROM r a JOIN r b ON a.kind = b.kind AND a.least = 0.8 AND b.least = 0.0""")
def ev16_compared(spark: SparkSession, d: str) -> DataFrame:
    """Recall by type with all recorded detections and with those of confidence 0.8 and more."""
    t = _labels(spark, d).select("document_id", F.col("entity_type").alias("kind"), F.lower(F.trim("value_text")).alias("value")).distinct()
    g = _values(spark, d).groupBy("document_id", F.col("canonical_type").alias("kind"), F.lower(F.trim("value")).alias("value")).agg(F.max("confidence").alias("c"))
    j = t.join(g, ["document_id", "kind", "value"], "left")

    def run(least: float) -> DataFrame:
        hit = F.coalesce(F.col("c") >= least, F.lit(False)).cast("long")
        return evaluate.rates(j.groupBy("kind").agg(F.sum(hit).alias("tp"), F.lit(0).alias("fp"), F.sum(1 - hit).alias("fn"), F.lit(0).alias("residual")), residual="residual")

    return evaluate.compared(run(0.0), run(0.8), "kind").select("kind", "recall_before", "recall_after", "recall_delta")


# ---- repair of scans, export ----

@query("aud6_residual_diagnostics", f"""
WITH {_MERGED}, bk AS (SELECT DISTINCT document_id, block_id, page_number, extraction_method FROM blocks)
SELECT document_id, {_CATEGORY} AS entity_type, list_sort(list_distinct(list_filter(regexp_split_to_array(coalesce(detector, ''), '\\|'), lambda x: x IN ({", ".join(f"'{x}'" for x in audit.DETECTORS)})))) AS detectors, CASE WHEN page_number > 0 THEN page_number END AS page,
CASE WHEN extraction_method IN ({", ".join(f"'{x}'" for x in audit.METHODS)}) THEN extraction_method ELSE 'unknown' END AS extraction_method FROM merged LEFT JOIN bk USING (document_id, block_id)""")
def aud6_residual_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What may be told of recorded detections, were they residuals."""
    return audit.residual_diagnostics(_merged(spark, d), blocks(spark, d, "document_id", "block_id", "page_number", "extraction_method"))


@query("aud4_safe_counts", f"""
WITH {_COUNTS}, raw AS (SELECT document_id, upper(coalesce(loc, 'odd')) AS value FROM j)
SELECT document_id, 'category' AS dimension, {_CATEGORY} AS value, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1, 2, 3
UNION ALL SELECT document_id, 'location', 'unknown', CAST(count(*) AS BIGINT) FROM raw GROUP BY 1
UNION ALL SELECT document_id, 'risk', {_RISK}, CAST(count(*) AS BIGINT) FROM j GROUP BY 1, 2, 3""")
def aud4_safe_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a report after places in an unknown spelling, and counts that can't be, were added."""
    c = aud_counts(spark, d).withColumn("value", F.when(F.col("dimension") == "location", F.upper("value")).otherwise(F.col("value")))
    odd = c.select("document_id", "dimension", F.lit("x").alias("value"), F.lit(-1).cast("long").alias("n")).unionByName(c.select("document_id", F.lit("secret").alias("dimension"), "value", "n"))
    return audit.safe_counts(c.unionByName(odd), audit.SAFE)


_SCAN_TEXTS = "sc AS (SELECT document_id, block_id, any_value(text) AS text FROM blocks WHERE text IS NOT NULL AND extraction_method IN ('ocr', 'figure_ocr', 'embedded_image_ocr') GROUP BY document_id, block_id)"
_SCAN_COLUMNS = ("document_id", "block_id", "block_ord", "text", "extraction_method", "page_number", "slide_number", "image_name")


@query("sr1_attached_characters", rf"""
WITH {_MERGED}, {_SCAN_TEXTS}, c AS (SELECT m.*, text, length(regexp_extract(substring(text, 1, span_start), '[\p{{L}}\p{{N}}]*$')) AS glued, length(regexp_replace(regexp_extract(substring(text, span_end + 1), '^\S*'), '[,.;:)\]}}''"]+$', '')) AS tail FROM merged m JOIN sc USING (document_id, block_id)),
x AS (SELECT *, span_start - glued - CASE WHEN entity_type = 'EMAIL_ADDRESS' AND regexp_matches(substring(text, 1, span_start - glued), '(?:^|[^\w.])[a-z][ \t]$') THEN 2 ELSE 0 END AS s, span_end + tail AS e FROM c)
SELECT document_id, block_id, CAST(s AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end, entity_type, confidence, detector FROM x WHERE s <> span_start OR e <> span_end""")
def sr1_attached_characters(spark: SparkSession, d: str) -> DataFrame:
    """Recorded detections of scans widened over what is glued to them."""
    return repair.attached_characters(blocks(spark, d, *_SCAN_COLUMNS), _merged(spark, d))


@query("ocr3_initials_before", rf"""
WITH {_MERGED}, {_SCAN_TEXTS}, c AS (SELECT m.*, regexp_extract(substring(text, 1, span_start), '(?:^|[^\w&.,])((?:(?:[A-Z][.,]|&|[A-Z]{{1,2}})[ \t]){{1,3}})$|(^[a-z][.,]?[ \t])$', 1) || regexp_extract(substring(text, 1, span_start), '^[a-z][.,]?[ \t]$') AS i FROM merged m JOIN sc USING (document_id, block_id) WHERE entity_type = 'PERSON')
SELECT document_id, block_id, CAST(span_start - length(i) AS INTEGER) AS span_start, span_end, 'PERSON' AS entity_type, CAST(0.8 AS DOUBLE) AS confidence, 'name_sweep_ocr' AS detector FROM c WHERE i <> ''""")
def ocr3_initials_before(spark: SparkSession, d: str) -> DataFrame:
    """Recorded names of scans with the misread initials before them."""
    return repair.initials_before(blocks(spark, d, *_SCAN_COLUMNS), _merged(spark, d))


def _people_of_documents(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files", "document_id", "scope_id").distinct()
    p = table(spark, d, "people", "scope_id", "first_name", "last_name", "middles", "name_initial").filter("last_name is not null").distinct()
    return p.join(f, "scope_id").drop("scope_id").withColumnRenamed("document_id", "scope_id")


@query("ocr1_damaged_emails")
def ocr1_damaged_emails(spark: SparkSession, d: str) -> DataFrame:
    """Damaged mail addresses in scans."""
    b = blocks(spark, d, *_SCAN_COLUMNS)
    return repair.damaged_emails(b, _merged(spark, d))


@query("ocr2_damaged_surnames")
def ocr2_damaged_surnames(spark: SparkSession, d: str) -> DataFrame:
    """Damaged surnames in scans."""
    return repair.damaged_surnames(blocks(spark, d, *_SCAN_COLUMNS), _people_of_documents(spark, d))


@query("ocr4_damaged_identifiers")
def ocr4_damaged_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Damaged codes, addresses of machines and dates of birth in scans."""
    return repair.damaged_identifiers(blocks(spark, d, *_SCAN_COLUMNS))


@query("sr6_repaired")
def sr6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """All repairs of recorded detections that need no boxes of words."""
    return repair.repaired(blocks(spark, d, *_SCAN_COLUMNS), cut(_merged(spark, d)), _people_of_documents(spark, d))
