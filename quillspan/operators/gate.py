"""The independent check of sanitized text. It fails closed: what can't be judged is blocked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import spans as S

# Shapes that are looked for once more, whatever detection found.
GENERIC = r"\[[A-Z][A-Z_]*\]"
NUMBERED = r"\[[A-Z][A-Z_]*_\d+\]"
EMAIL_SHAPE = r"[A-Za-z0-9._%+|-]+\s?@\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DIGIT_RUN = r"(?<![\w-])\+?\(?\d[\d ().-]*\d(?![\w-])"
ID_SHAPES = (r"\b(?:EMP|DIR|MER|CUST|CLI|ACC)-?\s?(?:[A-Z]{2}-)?\d{4,10}\b", r"\b[A-Z]{3}[ABCFGHJLPT][A-Z]\d{4}[A-Z]\b", r"\b\d{3}-\d{2}-\d{4}\b")
RECORDS = r"\b[A-Z]{2,4}-(?:19|20)\d{2}-\d{2,5}\b|\b(?:RSK|ISS|INC|BRC|PBR|EXC|CHL|SPK|LOS|CTL|GRP)-(?:[A-Z]{2,4}-)?\d{2,6}\b"
MIN_CONFIDENCE = 0.40
# The gate's own personnel patterns, apart from the rules of detection on purpose.
PERSONNEL_HEADER = r"\b(?:employee|staff|personnel|associate)[ \t]+(?:id|number|no\.?|code)(?!\w)"
PERSONNEL_TOKEN = r"(?<![\w-])[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+){0,2}(?![\w-])"
PERSONNEL_RECORD = r"(?i)[A-Z]{2,8}-(?:19|20)\d{2}-\d{2,5}"
PERSONNEL_TIMESTAMP = r"(?i)(?:19|20)\d{2}-\d{2}-\d{2}T\d{2}"


def personnel_token_ok(v: Column) -> Column:
    """A number of 5 to 10 digits or a code with letters and digits that is no record and no moment."""
    number, code = v.rlike(r"^\d{5,10}$"), F.length(v).between(5, 24) & v.rlike(r"[A-Za-z].*\d|\d.*[A-Za-z]")
    return (number | code) & ~v.rlike(f"^(?:{PERSONNEL_RECORD})$") & ~v.rlike(f"^(?:{PERSONNEL_TIMESTAMP})$")


def digit_run_ok(v: Column) -> Column:
    """Seven digits or more that are no date and no time."""
    core = F.regexp_replace(v, r"^[ .()\-]+|[ .()\-]+$", "")
    groups = F.regexp_extract_all(core, F.lit(r"\d+"), 0)
    year = lambda g: g.rlike(r"^(?:19|20)\d{2}$")
    moment = core.rlike(r"^\d{4}-[01]\d-[0-3]\d[T17][0-2]\d$") | (F.exists(groups, year) & F.forall(groups, lambda g: year(g) | (F.length(g) <= 2)))
    return (F.length(S.digits(core)) >= 7) & ~core.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~moment


def email_shape_ok(v: Column) -> Column:
    local, domain = F.regexp_extract(v, r"^([^@]*)@", 1), F.regexp_extract(v, r"@(.*)$", 1)
    split = local.rlike(r"\s$") | domain.rlike(r"^\s")
    return ~split | local.rlike(r"\p{L}")


def intentional(text: Column, issued: Column) -> Column:
    """Generic placeholders, and numbered ones that were issued."""
    return F.concat(S.matches(text, GENERIC, hint=r"\["), F.filter(S.matches(text, NUMBERED, hint=r"\["), lambda x: F.array_contains(issued, x["v"])))


def with_issued(texts: DataFrame, issued: DataFrame, text: str = "sanitized") -> DataFrame:
    """Non-blank ``texts`` with ``issued``, the tokens in them that their scope has issued."""
    ids = ["document_id", "block_id"]
    t = F.col(text)
    # only the tokens that stand in the block travel with it
    seen = texts.select(*ids, "scope_id", F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(NUMBERED), 0))).alias("token"))
    real = seen.join(issued.select("scope_id", "token").distinct(), ["scope_id", "token"]).groupBy(*ids).agg(F.collect_set("token").alias("issued"))
    return texts.filter(F.trim(t) != "").join(real, ids, "left").withColumn("issued", F.coalesce("issued", F.array().cast("array<string>")))


def outside(spans: DataFrame, texts: DataFrame, issued: DataFrame, text: str = "sanitized") -> DataFrame:
    """``spans`` that don't lie inside an intentional placeholder of their block."""
    own = with_issued(texts, issued, text).select("document_id", "block_id", intentional(F.col(text), F.col("issued")).alias("_own"))
    return spans.join(own, ["document_id", "block_id"]).filter(~S.in_any(F.col("span_start"), F.col("span_end"), F.col("_own"))).drop("_own")


def residuals(texts: DataFrame, issued: DataFrame, text: str = "sanitized", header: str | None = None, named: DataFrame | None = None) -> DataFrame:
    """What independent checks find in ``texts`` (document_id, block_id, scope_id and the text),
    given the tokens ``issued`` (scope_id, token): one row per span, typed by the first check,
    outside intentional placeholders. ``header`` names a column with the table header above;
    ``named`` are the places of registered names in these texts."""
    ids = ["document_id", "block_id"]
    t = F.col(text)
    rows = with_issued(texts, issued, text)
    if named is None:
        rows = rows.withColumn("_named", F.lit(None).cast(S.SPAN))
    else:
        places = named.groupBy(*ids).agg(F.collect_list(F.struct(F.col("span_start").cast("int").alias("s"), F.col("span_end").cast("int").alias("e"), F.lit("").alias("v"))).alias("_named"))
        rows = rows.join(places, ids, "left")
    staged = rows.select(
        "*", intentional(t, F.col("issued")).alias("_own"), S.matches(t, RECORDS, hint=r"-\d").alias("_records"),
        F.filter(S.matches(t, rf"(?i)({PERSONNEL_HEADER}[ \t]*(?:[:=#][ \t]*)?)([A-Za-z0-9]+(?:[-_][A-Za-z0-9]+){{0,2}})(?![\w-])", 2, 1, "(?i)employee|staff|personnel|associate"), lambda x: personnel_token_ok(x["v"])).alias("_labelled"),
        (F.when(F.col(header).rlike("(?i)" + PERSONNEL_HEADER), F.filter(S.matches(t, PERSONNEL_TOKEN), lambda x: personnel_token_ok(x["v"]))) if header else F.lit(None)).alias("_column"),
        F.filter(S.matches(t, NUMBERED, hint=r"\["), lambda x: ~F.array_contains("issued", x["v"])).alias("_unissued"),
        F.filter(S.matches(t, EMAIL_SHAPE, hint="@"), lambda x: email_shape_ok(x["v"])).alias("_mail"),
        F.concat(*[S.matches(t, p, hint=r"\d") for p in ID_SHAPES]).alias("_shape"),
        F.filter(S.matches(t, DIGIT_RUN, hint=r"\d"), lambda x: digit_run_ok(x["v"])).alias("_run"),
    )
    tag = lambda c, kind, check, n: F.transform(F.coalesce(c, F.array().cast(S.SPAN)), lambda x: F.struct(F.lit(n).alias("o"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("entity_type"), F.lit("gate:" + check).alias("detector")))
    every = F.concat(
        tag(F.concat(F.col("_labelled"), F.coalesce(F.col("_column").cast(S.SPAN), F.array().cast(S.SPAN))), "EMPLOYEE_ID", "personnel_context", 1),
        tag(F.col("_unissued"), "PII", "unissued_placeholder", 2), tag(F.col("_named"), "PERSON", "name_registry", 3), tag(F.col("_mail"), "EMAIL_ADDRESS", "email_shape", 4),
        tag(F.filter("_shape", lambda x: ~S.in_any(x["s"], x["e"], F.col("_records"))), "GOVERNMENT_ID", "id_shape", 5), tag(F.col("_run"), "PHONE_NUMBER", "digit_run", 6),
    )
    flat = staged.select(*ids, "_own", every.alias("x")).select(*ids, F.explode(F.filter("x", lambda x: ~S.in_any(x["s"], x["e"], F.col("_own")))).alias("x"))
    best = flat.groupBy(*ids, "x.s", "x.e").agg(F.min(F.struct("x.o", "x.entity_type", "x.detector")).alias("b"))
    return best.select(*ids, F.col("s").alias("span_start"), F.col("e").alias("span_end"), F.col("b.entity_type").alias("entity_type"), F.lit(1.0).alias("confidence"), F.col("b.detector").alias("detector"))


def known_by_models_alone(detector: Column | str) -> Column:
    """Whether nothing but a name model saw a span: on sanitized text no place is taken from it alone
    (GATE-4)."""
    names = F.filter(F.split(detector, r"\|"), lambda d: F.trim(d) != "")
    return (F.size(names) > 0) & F.forall(names, lambda d: d.startswith("presidio:"))


def column_headers(cells: DataFrame) -> DataFrame:
    """Table cells below the first row with ``header``, the text of their column's first cell."""
    w = Window.partitionBy("document_id", "page_number", "slide_number", "table_number", "column_number")
    t = cells.filter("kind = 'table_cell' and row_number is not null and column_number is not null")
    return t.withColumn("header", F.max(F.when(F.col("row_number") == 1, F.col("text"))).over(w)).filter("row_number > 1")


def decide(files: DataFrame, found: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """Status a document: BLOCKED where pages failed, where the list of pages is not sound, where
    residuals are left, or where something ``unresolved`` (document_id) is to be looked at; else
    APPROVED. What is unresolved is no residual, so that no later pass redacts it."""
    n = found.groupBy("document_id").agg(F.count("*").alias("residual_count"), F.max(F.col("detector").contains("gate:")).alias("independent"))
    docs = files.groupBy("document_id").agg(F.max_by("ocr_failed_pages", F.size(F.coalesce("ocr_failed_pages", F.array().cast("array<int>")))).alias("failed"))
    d = docs.join(n, "document_id", "left").withColumn("residual_count", F.coalesce("residual_count", F.lit(0)))
    unsound = F.exists("failed", lambda p: p.isNull() | (p <= 0))
    status = F.when(F.coalesce(unsound, F.lit(False)) | (F.coalesce(F.size("failed"), F.lit(0)) > 0) | (F.col("residual_count") > 0), "BLOCKED").otherwise("APPROVED")
    reason = F.when(F.coalesce(unsound, F.lit(False)), "invalid page list").when(F.coalesce(F.size("failed"), F.lit(0)) > 0, "extraction incomplete").when(F.col("residual_count") > 0, "residual data").otherwise("no residual data")
    if unresolved is not None:
        d = d.join(unresolved.select("document_id").distinct().withColumn("_unresolved", F.lit(True)), "document_id", "left")
        open_ = (status == "APPROVED") & F.coalesce("_unresolved", F.lit(False))
        status, reason = F.when(open_, "BLOCKED").otherwise(status), F.when(open_, "unresolved name in image text").otherwise(reason)
    return d.select("document_id", status.alias("status"), reason.alias("reason"), "residual_count", F.coalesce("independent", F.lit(False)).alias("independent"))
