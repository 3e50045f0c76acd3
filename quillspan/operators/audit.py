"""Counts for audit, where values stand, and how files are linked by tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import lookups as L

CATEGORIES = tuple(sorted({*L.SPECIFICITY, "NRP", "US_PASSPORT", "US_DRIVER_LICENSE", "MEDICAL_LICENSE", "CRYPTO_ADDRESS", "PII"}))
BLOCK = ["document_id", "block_id"]


def category(c: Column) -> Column:
    return F.when(c.isin(*CATEGORIES), c).otherwise("OTHER")


def location_type(method: Column, kind: Column) -> Column:
    return (
        F.when(method == "embedded_image_ocr", "image").when(kind.isin("header", "footer", "text_box", "notes"), kind)
        .when(kind == "table_cell", "table").when(method == "ocr", "scanned_page").otherwise("body")
    )


def location_text(image: Column, kind: Column, page: Column, slide: Column, tab: Column, para: Column) -> Column:
    """Short words for a place: p.3, slide 8, para 12, table 2, header, image a.png."""
    where = F.when(image.isNotNull() & (image != ""), F.concat(F.lit("image "), image)).when(kind.isin("header", "footer", "text_box"), F.replace(kind, F.lit("_"), F.lit(" "))).when(kind == "notes", "notes")
    tabled = F.when((kind == "table_cell") & tab.isNotNull() & slide.isNull(), F.concat(F.lit("table "), tab.cast("string")))
    on = F.when(slide.isNotNull(), F.concat_ws(" ", F.concat(F.lit("slide "), slide.cast("string")), where))
    return F.when(where.isNull() & page.isNotNull(), F.concat(F.lit("p."), page.cast("string"))).when(where.isNull() & tabled.isNotNull(), tabled).when(where.isNull() & para.isNotNull(), F.concat(F.lit("para "), para.cast("string"))).otherwise(F.coalesce(on, where, F.lit("body")))


def counts_by(entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """Detections a document by (dimension, value): category, location and risk in one pass."""
    from quillspan.operators.merge import risk

    b = blocks.select(*BLOCK, location_type(F.col("extraction_method"), F.col("kind")).alias("loc"))
    rows = entities.join(b, BLOCK, "left").select("document_id", F.explode(F.array(
        F.struct(F.lit("category").alias("dimension"), category(F.col("entity_type")).alias("value")),
        F.struct(F.lit("location").alias("dimension"), F.coalesce("loc", F.lit("unknown")).alias("value")),
        F.struct(F.lit("risk").alias("dimension"), risk(F.col("entity_type")).alias("value")),
    )).alias("x"))
    return rows.groupBy("document_id", "x.dimension", "x.value").agg(F.count("*").alias("n"))


def report(entities: DataFrame, blocks: DataFrame, gate: DataFrame) -> DataFrame:
    """One JSON report a document: counts only, never text."""
    c = counts_by(entities, blocks).groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "dimension", "value").alias("k"), F.col("n").alias("v"))))).alias("counts"), F.sum(F.when(F.col("dimension") == "category", F.col("n"))).alias("detected_count"))
    rows = gate.join(c, "document_id", "left")
    reason = F.when(F.col("status") == "APPROVED", "Document passed privacy validation.").when(F.col("residual_count") > 0, "Document blocked because residual sensitive data was detected.").otherwise("Document blocked by privacy validation.")
    return rows.select("document_id", F.to_json(F.struct(F.coalesce("detected_count", F.lit(0)).alias("detected_count"), "counts", F.struct("status", reason.alias("reason"), "residual_count").alias("validation"))).alias("report"))


def token_places(redactions: DataFrame, blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Where each placeholder of a scope stands: scope_id, placeholder, entity_type, file_name,
    location, n (its order), once a place."""
    from quillspan.operators.redact import canonical

    loc = location_text(F.col("image_name"), F.col("kind"), F.col("page_number"), F.col("slide_number"), F.col("table_number"), F.col("paragraph_number"))
    b = blocks.select(*BLOCK, "block_ord", loc.alias("location"))
    f = files.select("document_id", "scope_id", "doc_ord", "file_name").distinct()
    r = redactions.filter("placeholder is not null").select(*BLOCK, "placeholder", canonical(L.clean_type(F.col("entity_type"))).alias("entity_type")).distinct()
    rows = r.join(f, "document_id").join(b, BLOCK, "left").withColumn("location", F.coalesce("location", F.lit("unknown")))
    first = rows.groupBy("scope_id", "placeholder", "file_name", "location").agg(F.min(F.struct("doc_ord", "block_ord")).alias("at"), F.min("entity_type").alias("entity_type"))
    n = F.row_number().over(Window.partitionBy("scope_id", "placeholder").orderBy("at", "file_name", "location"))
    return first.select("scope_id", "placeholder", "entity_type", "file_name", "location", n.alias("n"))


def places_text(places: DataFrame) -> DataFrame:
    """'policy.pdf p.1, p.35; pack.pptx slide 8' for every placeholder of a scope."""
    by_file = places.groupBy("scope_id", "placeholder", "file_name").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("n", "location"))).alias("x"))
    t = by_file.select("scope_id", "placeholder", "n", F.concat("file_name", F.lit(" "), F.array_join(F.transform("x", lambda r: r["location"]), ", ")).alias("t"))
    return t.groupBy("scope_id", "placeholder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda r: r["t"]), "; ").alias("places"), F.count("*").alias("n_files"))


def mail_persons(values: DataFrame, people: DataFrame) -> DataFrame:
    """Mail identities of a scope with the one registered person they name (last part the surname,
    first part the given name or its initial): scope_id, identity, first_name, last_name. Mail
    that names no one, or more than one, is left out."""
    parts = F.filter(F.split(F.regexp_extract("identity", r"(?s)^(.*)@", 1), r"[._-]"), lambda p: p.rlike(r"^\p{L}+$"))
    mail = values.filter("canonical_type = 'EMAIL' and identity like '%@%'").select("scope_id", "identity").distinct().withColumn("p", parts).filter("size(p) >= 2")
    mail = mail.select("scope_id", "identity", F.lower(F.try_element_at("p", F.lit(-1))).alias("surname"), F.lower(F.substring(F.get("p", F.lit(0)), 1, 1)).alias("initial"))
    known = people.filter("last_name is not null").select("scope_id", "first_name", "last_name", F.lower(F.regexp_replace("last_name", "-", "")).alias("surname"), F.lower(F.substring(F.coalesce("first_name", "name_initial"), 1, 1)).alias("i")).distinct()
    near = mail.join(known, ["scope_id", "surname"]).filter(F.col("i").isNull() | (F.col("i") == F.col("initial")))
    one = near.groupBy("scope_id", "identity").agg(F.count("*").alias("n"), F.min(F.struct("first_name", "last_name")).alias("x")).filter("n = 1")
    return one.select("scope_id", "identity", "x.first_name", "x.last_name")


# What reports may name.
PAGE_STATUSES = ("native", "ocr", "failed")
IMAGE_STATUSES = ("ocr", "skipped_vector", "skipped_tiny", "failed", "unknown")
LOCATIONS = ("image", "header", "footer", "text_box", "notes", "table", "scanned_page", "body", "unknown")
METHODS = ("native", "pdf_native", "docx_native", "pptx_native", "ocr", "embedded_image_ocr", "figure_ocr")
DETECTORS = (
    "presidio:SpacyRecognizer", "presidio:EmailRecognizer", "presidio:PhoneRecognizer", "presidio:IpRecognizer", "presidio:CreditCardRecognizer", "presidio:IbanRecognizer", "presidio:UsSsnRecognizer",
    "regex:email", "regex:email_ocr", "regex:labelled_phone", "regex:phone", "regex:phone_short", "regex:ssn", "regex:ssn_last4", "regex:ssn_ocr", "regex:ip", "regex:iban", "regex:credit_card", "regex:in_pan", "regex:passport", "regex:pesel", "regex:pesel_checksum", "regex:tin", "regex:dob", "regex:account_ending", "regex:us_address",
    "custom:employee_id", "custom:client_id", "custom:customer_id", "custom:portfolio_id", "custom:account_number", "custom:personnel_id", "name_sweep", "name_sweep_ocr", "pattern:ocr_email", "pattern:ocr_labelled_id", "pattern:ocr_ip", "pattern:ocr_dob",
    "context:column_role", "context:wrapped_value", "context:figure_duplicate", "pattern:name_with_initial", "context:table_header", "context:split_phone", "context:role_name", "gate:personnel_context", "gate:id_shape", "gate:digit_run", "gate:email_shape", "gate:name_registry", "gate:unissued_placeholder",
)


def safe_counts(counts: DataFrame, known: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """Rows (document_id, dimension, value, n) with nothing in them that a report may not name
    (AUD-4): of each dimension in ``known`` (its values, and what others count as) the counts that
    are not negative; other dimensions are left out. What is renamed alike is summed."""
    value = F.lit(None).cast("string")
    for name, (values, other) in known.items():
        value = F.when(F.col("dimension") == name, F.when(F.col("value").isin(*values), F.col("value")).otherwise(other)).otherwise(value)
    rows = counts.withColumn("value", value).filter("value is not null and n >= 0")
    return rows.groupBy("document_id", "dimension", "value").agg(F.sum("n").alias("n"))


#: The dimensions of ``counts_by`` as ``safe_counts`` takes them.
SAFE = {"category": (CATEGORIES, "OTHER"), "location": (LOCATIONS, "unknown"), "risk": (L.TIERS, "MEDIUM"), "image": (IMAGE_STATUSES, "unknown")}


def safe_pages(pages: DataFrame) -> DataFrame:
    """Page reports (document_id, page, status, attempts, seconds) fit to export (AUD-4): pages from 1
    on, known states, attempts and seconds that are real and not negative; else null."""
    seconds = F.when((F.col("seconds") >= 0) & (F.col("seconds") < float("inf")) & ~F.isnan("seconds"), F.col("seconds"))
    return pages.filter("page >= 1").select("document_id", "page", F.when(F.col("status").isin(*PAGE_STATUSES), F.col("status")).otherwise("unknown").alias("status"), F.when(F.col("attempts") >= 0, F.col("attempts")).alias("attempts"), seconds.alias("seconds"))


def safe_audit_id(c: Column) -> Column:
    """A correlation id in the form of a UUID, in lower case; null if it is none."""
    return F.when(c.rlike(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"), F.lower(c))


def residual_diagnostics(residuals: DataFrame, blocks: DataFrame) -> DataFrame:
    """What may be told of residuals (AUD-6), without text and places: document_id, entity_type,
    detectors (those that are known, sorted), page (from 1 on, else null) and extraction_method."""
    b = blocks.select(*BLOCK, "page_number", "extraction_method")
    detectors = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce("detector", F.lit("")), r"\|"), lambda d: d.isin(*DETECTORS))))
    rows = residuals.select(*BLOCK, "entity_type", "detector").join(b, BLOCK, "left")
    return rows.select(
        "document_id", F.when(F.col("entity_type").isin(*CATEGORIES), F.col("entity_type")).otherwise("OTHER").alias("entity_type"), detectors.alias("detectors"),
        F.when(F.col("page_number") > 0, F.col("page_number")).alias("page"), F.when(F.col("extraction_method").isin(*METHODS), F.col("extraction_method")).otherwise("unknown").alias("extraction_method"),
    )


def safe_location(block: dict[str, Column]) -> Column:
    """The places of a block that a record may hold (RED-6): whole numbers from 0 on, else null."""
    return F.struct(*[F.when(c.cast("long") >= 0, c.cast("int")).alias(name) for name, c in block.items()])
