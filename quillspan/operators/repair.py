"""Detections that scanning has damaged: found again by likeness, by place, by the words beside.

All operators work on scanned blocks (``document_id, block_id, block_ord, text, extraction_method,
page_number, slide_number, image_name`` and where named ``figure_no`` and ``boxes``, one pixel box
[x0, y0, x1, y1] a word) and give rows ``document_id, block_id, span_start, span_end, entity_type,
confidence, detector``. Lines of one image, figure or page form a container. Null texts hold
nothing; a line whose words and boxes differ in number has no words. Likeness is searched by
shared trigrams, neighbours by equal keys, so nothing is compared with everything.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions import spans as S
from quillspan.operators import rules
from quillspan.operators.context import ROLE, ROLE_NAME
from quillspan.operators.detect import raw_spans
from quillspan.operators.ordinary import ORDINARY
from quillspan.sources.tables import SCANS

# How alike is alike, how far is near.
DOMAIN_LIKE, DOMAIN_LETTERS = 0.75, 6
SURNAME_LIKE, SURNAME_LETTERS = 0.85, 6
FIRST_LIKE, WORD_LIKE, BOX_SHARE = 0.8, 0.6, 0.5
WRAP_LINES, NEAR_LINES, CELL_GAP = 6, 3, 1.5
# Shapes.
TLD = r"\.[ \t]?[a-z]{2,10}\b|,[a-z]{2,10}\b|[ \t](?:c[o0][a-z]{0,2}|org|net)\b"
SURNAME_TOKEN = r"(?<![\w-])[A-Z][A-Za-z'’-]{3,}(?![\w-])"
INITIALS_BEFORE = r"(?:(?<![\w&.,])(?:(?:[A-Z][.,]|&|[A-Z]{1,2})[ \t]){1,3}|^[a-z][.,]?[ \t])$"
LABELLED_ID = r"(\b(?:(?i:pass\s?p[o0][a-z]{0,3}(?:\s+no\.?)?)|PAN)[\s:#]*)([A-Z]{1,2}\d{6,9}|[A-Z]{5,6}\d{4}[A-Z])\b"
OCR_IP = r"(?<![\d.,])\d{1,3}(?:[.,]\d{1,3}){3}(?![\d.,]?\d)"
DOB_LABEL_AT_END = r"(?i:\b(?:DOB|D\.O\.B\.?|date\s+of\s+birth))\s*:?\s*$"
DOB_DAMAGED = r"((?i:\b(?:DOB|date\s+of\s+birth))[\s:]*)(\d{3,4}[/.-]\d{2,4}|\d{1,2}[/.-]\d{3,6})(?![\w/.-])"
BIRTH_WORD, DATE_WORD = r"(?i)^(?:BIRTH|DOB)\W*$", r"\d|^[A-Z][a-z]{2,8}\.?,?$"
PERSON_HEADER = r"(?i)^(?:(?:full |user |display )?names?|(?:risk |control |process |issue |data )?owners?|assignees?|users?|created by|modified by|updated by|changed by|requested by|approved by|attested by|reviewers?|approvers?|employees?|members?)$"
ONLY_INITIALS = r"^\s*(?:\(?(?:[A-Z][.,]?|(?:[A-Z]\.){2,3})(?:\s+|$)){1,3}$"
TRAILING_INITIALS = r"(?<![\w.])(?:[A-Z][.,][ \t]?){1,3}$"
PHONE_HEAD = r"(?<![\w+])(\+\d{1,3})([ \t]+(?:\(\d{1,4}\)|\d{1,4}))?(?![\d])"
ID_HEAD, ID_TAIL = r"(?<![\w-])[A-Z]{2,5}-(?=[\s)]|$)", r"(?<![\w-])[A-Z0-9]{1,5}-\d{3,}(?![\w-])"
DIGITS_AT_START = r"^[ \t(]*(\d[\d \t-]{2,}\d)(?![\w])"
ID_TYPES = ("EMPLOYEE_ID", "CLIENT_ID", "CUSTOMER_ID", "PORTFOLIO_ID", "ACCOUNT_NUMBER", "GOVERNMENT_ID")

KEY = ["document_id", "block_id"]
CONTAINER = ["document_id", "image_name", "page_number", "slide_number", "figure_no"]


def _scans(blocks: DataFrame) -> DataFrame:
    b = blocks if "figure_no" in blocks.columns else blocks.withColumn("figure_no", F.lit(None).cast("int"))
    return b.filter(F.col("text").isNotNull() & F.col("extraction_method").isin(*SCANS))


def _lines(blocks: DataFrame) -> DataFrame:
    """Scanned lines with ``box_of``, a key of their container, and ``line``, their number in it."""
    c = _scans(blocks).withColumn("box_of", F.to_json(F.struct(*CONTAINER[1:])))
    return c.withColumn("line", F.row_number().over(Window.partitionBy("document_id", "box_of").orderBy("block_ord", "block_id")))


def _found(df: DataFrame, s: Column, e: Column, kind: str | Column, confidence: float | Column, detector: str | Column) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(*KEY, s.cast("int").alias("span_start"), e.cast("int").alias("span_end"), lit(kind).alias("entity_type"), lit(confidence).cast("double").alias("confidence"), lit(detector).alias("detector"))


def _each(df: DataFrame, spans: Column, kind: str, confidence: float, detector: str) -> DataFrame:
    return _found(df.select(*KEY, F.explode(spans).alias("x")), F.col("x.s"), F.col("x.e"), kind, confidence, detector)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of letters in common runs: twice the matching letters over all."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def trigrams(c: Column) -> Column:
    """Distinct runs of three letters; shorter words have none."""
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z]", "")


def _local_part(prefix: str, ordinary: frozenset[str]) -> tuple[int, str] | None:
    """Where the local part of an address begins, if what stands before its domain is one."""
    split = re.search(r"([\w.-]*?)[ \t]*@[ \t]*([\w.-]*)$", prefix)
    glued = re.search(r"[\w.-]*$", prefix)
    if split and (split.group(1) or split.group(2)):
        if re.search(r"[ \t]@[ \t]*[\w.-]*$", prefix) and split.group(1).lower() in ordinary:
            return None
        start, local = split.start(1), split.group(1)
    else:
        start, local = glued.start(), glued.group()
    return (start, local) if re.search(r"[^\W\d_]", prefix[start:]) else None


def damaged_address(text: str, s: int, e: int, label: str, ordinary: frozenset[str]) -> tuple[int, int] | None:
    """The mail address around the stretch of the word [s, e) that reads most like ``label``, a domain
    that stands intact elsewhere: behind it an ending, or before it an @, and a local part."""
    word = text[s:e].lower()
    match = SequenceMatcher(None, "", label, autojunk=False)
    best = (0.0, 0, 0)
    for n in (len(label) - 1, len(label), len(label) + 1):
        for at in range(len(word) - n + 1):
            piece = word[at : at + n]
            if piece.replace("-", "").isalnum():
                match.set_seq1(piece)
                if match.quick_ratio() > best[0] and (like := match.ratio()) > best[0]:
                    best = (like, at, at + n)
    if best[0] < DOMAIN_LIKE:
        return None
    begin, stop = s + best[1], s + best[2]
    stop += len(re.match(r"[^\W_]*", text[stop:]).group())
    ending = re.compile(TLD, re.IGNORECASE).match(text, stop)
    if not ending and not text[max(0, begin - 2) : begin].strip().endswith("@"):
        return None
    found = _local_part(text[:begin], ordinary)
    if found is None:
        return None
    start, local = found
    if comma := re.search(r"(?<![^\W_])[^\W\d_],$", text[:start]):
        start = comma.start()
    elif not re.search(r"[._-]", local) and (word_before := re.search(r"(?<![\w.@-])([a-z][a-z0-9._-]+)[ \t]$", text[:start])) and word_before.group(1) not in ordinary:
        start = word_before.start(1)
    return start, ending.end() if ending else stop


def damaged_emails(blocks: DataFrame, entities: DataFrame, ordinary: tuple[str, ...] = ORDINARY) -> DataFrame:
    """Mail addresses in scans whose domain reads like one that stands intact in the document."""
    value = F.expr("substring(text, span_start + 1, span_end - span_start)")
    labels = entities.filter("entity_type = 'EMAIL_ADDRESS'").join(blocks.select(*KEY, "text"), KEY).select("document_id", F.lower(F.regexp_extract(value, r"@([A-Za-z0-9-]+)\.[A-Za-z]{2,}\b", 1)).alias("label")).filter(F.length("label") >= DOMAIN_LETTERS).distinct()
    b = _scans(blocks)
    words = b.select(*KEY, F.explode(S.matches(F.col("text"), r"[A-Za-z0-9][A-Za-z0-9._'’-]*")).alias("x")).withColumn("gram", F.explode(trigrams(F.lower("x.v"))))
    near = words.join(labels.withColumn("gram", F.explode(trigrams(F.col("label")))), ["document_id", "gram"]).filter(F.length("x.v") >= F.length("label") - 1).select(*KEY, "x", "label").distinct()
    common = frozenset(ordinary)

    @F.pandas_udf(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
    def address(text: pd.Series, s: pd.Series, e: pd.Series, label: pd.Series) -> pd.DataFrame:
        got = [damaged_address(*x, common) or (None, None) for x in zip(text, s, e, label)]
        return pd.DataFrame(got, columns=["s", "e"]).astype("Int32")

    hit = near.join(b.select(*KEY, "text"), KEY).select(*KEY, "x", "label", address("text", F.col("x.s"), F.col("x.e"), "label").alias("at")).filter("at.s is not null")
    one = hit.groupBy(*KEY, "x").agg(F.min_by("at", "label").alias("at"))  # a word is one address
    return _found(one, F.col("at.s"), F.col("at.e"), "EMAIL_ADDRESS", 0.8, "pattern:ocr_email").distinct()


def damaged_surnames(blocks: DataFrame, people: DataFrame) -> DataFrame:
    """Capitalised words of scans that read nearly like a surname registered in the document (people
    with scope_id as document). Surnames under six letters are left to exact search."""
    known = people.select(F.col("scope_id").alias("document_id"), F.lower(F.regexp_replace("last_name", "-", "")).alias("surname")).filter(F.length("surname") >= SURNAME_LETTERS).distinct()
    words = _scans(blocks).select(*KEY, F.explode(S.matches(F.col("text"), SURNAME_TOKEN)).alias("x")).withColumn("token", _letters(F.col("x.v"))).filter(F.length("token") >= SURNAME_LETTERS - 1)
    words = words.join(known.withColumnRenamed("surname", "token"), ["document_id", "token"], "left_anti")
    pairs = words.withColumn("gram", F.explode(trigrams(F.col("token")))).join(known.withColumn("gram", F.explode(trigrams(F.col("surname")))), ["document_id", "gram"]).filter(F.abs(F.length("surname") - F.length("token")) <= 2)
    alike = pairs.select("document_id", "token", "surname").distinct().filter(likeness("token", "surname") >= SURNAME_LIKE).select("document_id", "token").distinct()
    return _found(words.join(alike, ["document_id", "token"]), F.col("x.s"), F.col("x.e"), "PERSON", 0.8, "name_sweep_ocr")


def _in_scans(blocks: DataFrame, entities: DataFrame) -> DataFrame:
    return entities.select(*KEY, "span_start", "span_end", "entity_type", "confidence", "detector").distinct().join(_scans(blocks).select(*KEY, "text"), KEY).withColumn("before", F.expr("substring(text, 1, span_start)")).withColumn("after", F.expr("substring(text, span_end + 1)"))


def initials_before(blocks: DataFrame, entities: DataFrame) -> DataFrame:
    """Names of scans with the misread initials right before them."""
    e = _in_scans(blocks, entities).filter("entity_type = 'PERSON'").withColumn("i", F.regexp_extract("before", INITIALS_BEFORE, 0)).filter("i <> ''")
    return _found(e, F.col("span_start") - F.length("i"), F.col("span_end"), "PERSON", 0.8, "name_sweep_ocr")


def damaged_identifiers(blocks: DataFrame) -> DataFrame:
    """In scans: codes behind a damaged label, addresses of machines with commas for dots, dates of
    birth that lost a sign, and a date on the line after a label of birth in the same container."""
    b = _lines(blocks)
    t = F.col("text")
    octets = lambda v: F.forall(F.split(v, "[.,]"), lambda o: o.cast("int") <= 255)
    ips = F.filter(S.matches(t, OCR_IP, hint=r"\d[.,]\d"), lambda x: (F.length(x["v"]) - F.length(F.replace(x["v"], F.lit("."))) >= 2) & octets(x["v"]))
    out = _each(b, S.matches(t, LABELLED_ID, 2, 1), "GOVERNMENT_ID", 0.85, "pattern:ocr_labelled_id").unionByName(_each(b, ips, "IP_ADDRESS", 0.8, "pattern:ocr_ip")).unionByName(_each(b, S.matches(t, DOB_DAMAGED, 2, 1), "DATE_OF_BIRTH", 0.85, "pattern:ocr_dob"))
    below = b.withColumn("above", F.lag("text").over(Window.partitionBy("document_id", "box_of").orderBy("line"))).filter(F.col("above").rlike(DOB_LABEL_AT_END))
    return out.unionByName(_each(below, F.slice(S.matches(t, rf"(?<!\w){rules._DATE}(?!\w)"), 1, 1), "DATE_OF_BIRTH", 0.85, "pattern:ocr_dob"))


def words_of(lines: DataFrame) -> DataFrame:
    """The words of lines with ``boxes``, one row each: the line's keys, ``n``, start, end, word, x0,
    y0, x1, y1. Words are what single blanks part."""
    parts = F.split("text", " ")
    w = lines.filter(F.size(parts) == F.size("boxes")).select(*[c for c in lines.columns if c not in ("text", "boxes")], F.posexplode(F.arrays_zip(parts.alias("word"), F.col("boxes").alias("box"))).alias("n", "x"), F.transform(parts, lambda p: F.length(p)).alias("_len"))
    start = F.aggregate(F.slice("_len", F.lit(1), F.col("n")), F.lit(0), lambda a, x: a + x + 1)
    return w.withColumn("start", start).withColumn("end", F.col("start") + F.length("x.word")).select(*[c for c in w.columns if c not in ("x", "_len")], "start", "end", F.col("x.word").alias("word"), *[F.col("x.box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def births_below(blocks: DataFrame) -> DataFrame:
    """Dates printed under a word of birth on a form, by place: digits and month-like words that begin
    within three heights below the word, from three heights left of its label to twelve right."""
    w = words_of(_lines(blocks).select(*KEY, "box_of", "line", "text", "boxes"))
    label = w.filter(F.col("word").rlike(BIRTH_WORD)).select("document_id", "box_of", F.monotonically_increasing_id().alias("label"), "x0", "y0", "x1", "y1", F.greatest(F.lit(1), F.col("y1") - F.col("y0")).alias("h"))
    a, b = label.alias("a"), w.alias("b")
    beside = a.join(b, ["document_id", "box_of"]).filter((F.abs(F.col("b.y0") - F.col("a.y0")) <= F.col("a.h")) & F.col("b.x0").between(F.col("a.x0") - 12 * F.col("a.h"), F.col("a.x0")))
    left = beside.groupBy("document_id", "box_of", "label", *[F.col(f"a.{c}").alias(c) for c in ("x0", "x1", "y1", "h")]).agg(F.min("b.x0").alias("left"))
    below = left.alias("a").join(b, ["document_id", "box_of"]).filter((F.col("b.y0") > F.col("a.y1")) & (F.col("b.y0") <= F.col("a.y1") + 3 * F.col("a.h")) & F.col("b.x0").between(F.col("left") - 3 * F.col("a.h"), F.col("a.x1") + 12 * F.col("a.h")) & F.col("b.word").rlike(DATE_WORD))
    value = below.groupBy("document_id", "block_id", "label").agg(F.min("start").alias("s"), F.max("end").alias("e")).join(blocks.select(*KEY, "text"), KEY)
    return _found(value.filter(F.expr("substring(text, s + 1, e - s)").rlike(r"\d")), F.col("s"), F.col("e"), "DATE_OF_BIRTH", 0.85, "pattern:ocr_dob").distinct()


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()), T.StructField("person", T.BooleanType())])))
def _columns_udf(words: pd.Series) -> pd.Series:
    """Columns of a line if it heads a table with a column of people: at least three cells, parted by
    wide gaps; none with digits or a full stop at the end."""

    def columns(ws) -> list[dict] | None:
        ws = sorted(ws, key=lambda w: w["n"])
        text = " ".join(w["word"] for w in ws)
        if not ws or any(c.isdigit() for c in text) or text.rstrip().endswith("."):
            return None
        heights = sorted(w["y1"] - w["y0"] for w in ws)
        m = len(heights) // 2
        gap = CELL_GAP * (heights[m] if len(heights) % 2 else (heights[m - 1] + heights[m]) / 2)
        cells = [[ws[0]]]
        for w in ws[1:]:
            cells[-1].append(w) if w["x0"] - cells[-1][-1]["x1"] <= gap else cells.append([w])
        if len(cells) < 3:
            return None
        rights = [c[0]["x0"] for c in cells[1:]] + [10**9]
        out = []
        for cell, right in zip(cells, rights):
            label = " ".join(filter(None, (re.sub("[^A-Za-z]", "", w["word"]) for w in cell)))
            out.append({"left": cell[0]["x0"] - int(gap), "right": right - int(gap / 2), "person": bool(re.match(PERSON_HEADER, label))})
        return out if any(c["person"] for c in out) else None

    return words.map(columns)


def people_columns(blocks: DataFrame, ordinary: tuple[str, ...] = ORDINARY) -> DataFrame:
    """Names under a heading of people in a table read from pixels (CTX-5). The last heading above a
    line counts; a line that fills fewer than two columns is no row of it, and one that also begins
    in the first column ends the table. Lines run from top to bottom."""
    w = words_of(_lines(blocks).select(*KEY, "box_of", "block_ord", "text", "boxes"))
    rows = w.groupBy(*KEY, "box_of", "block_ord").agg(F.collect_list(F.struct("n", "word", "start", "end", "x0", "y0", "x1", "y1")).alias("words"), F.min("y0").alias("top"), F.max("y1").alias("foot"))
    rows = rows.withColumn("head", _columns_udf("words"))
    down = Window.partitionBy("document_id", "box_of").orderBy("top", "block_ord", "block_id")
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("table", F.sum(F.col("head").isNotNull().cast("int")).over(so_far)).withColumn("cols", F.last("head", True).over(so_far)).withColumn("floor", F.last(F.when(F.col("head").isNotNull(), F.col("foot")), True).over(so_far))
    body = rows.filter(F.col("head").isNull() & F.col("cols").isNotNull() & (F.col("top") >= F.col("floor")))
    centre = lambda x: (x["x0"] + x["x1"]) / 2
    inside = lambda x, c: (centre(x) >= c["left"]) & (centre(x) < c["right"])
    body = body.withColumn("filled", F.size(F.filter("cols", lambda c: F.exists("words", lambda x: inside(x, c)))))
    first = F.array_min(F.transform("words", centre))
    ends = (F.col("filled") < 2) & (first >= F.col("cols")[0]["left"]) & (first < F.col("cols")[0]["right"])
    in_table = Window.partitionBy("document_id", "box_of", "table").orderBy("top", "block_ord", "block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = body.withColumn("over", F.sum(ends.cast("int")).over(in_table)).filter("over = 0 and filled >= 2")
    cells = body.select(*KEY, F.explode(F.filter("cols", lambda c: c["person"])).alias("c"), "words").withColumn("held", F.filter("words", lambda x: inside(x, F.col("c")))).filter(F.size("held") > 0)
    cells = cells.select(*KEY, F.array_min(F.transform("held", lambda x: x["start"])).alias("s"), F.array_max(F.transform("held", lambda x: x["end"])).alias("e")).join(blocks.select(*KEY, "text"), KEY).withColumn("cell", F.expr("substring(text, s + 1, e - s)"))
    plain = lambda v: ~F.exists(F.regexp_extract_all(F.lower(v), F.lit(r"[a-z]{2,}(?:-[a-z]+)?"), 0), lambda x: x.isin(*ordinary))
    names = F.filter(S.matches(F.col("cell"), ROLE_NAME), lambda x: ~x["v"].rlike(ROLE) & plain(x["v"]))
    return _found(cells.select(*KEY, "s", F.explode(names).alias("x")), F.col("s") + F.col("x.s"), F.col("s") + F.col("x.e"), "PERSON", 0.8, "context:column_role")


def attached_characters(blocks: DataFrame, entities: DataFrame) -> DataFrame:
    """Detections of scans widened over what is glued to them, and mail over an initial whose dot was
    read as a blank."""
    e = _in_scans(blocks, entities)
    glued = F.length(F.regexp_extract("before", r"[\p{L}\p{N}]*\z", 0))
    tail = F.regexp_replace(F.regexp_extract("after", r"^\S*", 0), r"[,.;:)\]}'\"]+$", "")
    initial = F.when((F.col("entity_type") == "EMAIL_ADDRESS") & F.expr("substring(text, 1, span_start)").substr(F.lit(1), F.col("span_start") - glued).rlike(r"(?<![\w.])[a-z][ \t]$"), 2).otherwise(0)
    e = e.withColumn("s", F.col("span_start") - glued - initial).withColumn("e", F.col("span_end") + F.length(tail)).filter("s <> span_start or e <> span_end")
    return _found(e, F.col("s"), F.col("e"), F.col("entity_type"), F.col("confidence"), F.col("detector"))


def wrapped_initials(blocks: DataFrame, entities: DataFrame, people: DataFrame) -> DataFrame:
    """Initials parted from their surname by the end of a line: a line of nothing else before one that
    begins with a name, detected or nearly a registered surname, and initials at the end of a line
    before one that begins with a detected name."""
    w = Window.partitionBy("document_id", "box_of").orderBy("line")
    names = entities.filter("entity_type = 'PERSON'").groupBy(*KEY).agg(F.min("span_start").alias("first_name_at"))
    b = _lines(blocks).select(*KEY, "box_of", "line", "text").join(names, KEY, "left")
    skipped = F.length(F.regexp_extract("text", r"^[ (]*", 0))
    b = b.withColumn("named", F.coalesce(F.col("first_name_at") <= skipped + 1, F.lit(False))).withColumn("word", F.regexp_extract("text", r"^[ (]*([A-Za-z][A-Za-z'’-]+)", 1)).withColumn("skipped", skipped)
    known = people.select(F.col("scope_id").alias("document_id"), _letters(F.col("last_name")).alias("surname")).filter("length(surname) >= 5").distinct().withColumn("gram", F.explode(trigrams(F.col("surname"))))
    asked = b.filter("word <> ''").select("document_id", _letters(F.col("word")).alias("token")).distinct().withColumn("gram", F.explode(trigrams(F.col("token"))))
    alike = asked.join(known, ["document_id", "gram"]).select("document_id", "token", "surname").distinct().filter(likeness("token", "surname") >= SURNAME_LIKE).select("document_id", "token", F.lit(True).alias("alike")).distinct()
    b = b.withColumn("token", _letters(F.col("word"))).join(alike, ["document_id", "token"], "left").withColumn("alike", F.coalesce("alike", F.lit(False)))
    nxt = F.lead(F.struct("block_id", "named", "alike", "word", "skipped")).over(w)
    b = b.withColumn("next", nxt).filter("next is not null")
    whole = b.filter(F.col("text").rlike(ONLY_INITIALS) & (F.col("next.named") | F.col("next.alike")))
    first = _found(whole, F.length(F.regexp_extract("text", r"^\s*", 0)), F.length(F.regexp_replace("text", r"\s+$", "")), "PERSON", 0.8, "name_sweep_ocr")
    second = _found(whole.filter("not next.named").select("document_id", "next").select("document_id", "next.*"), F.col("skipped"), F.col("skipped") + F.length("word"), "PERSON", 0.8, "name_sweep_ocr")
    rest = b.filter(~F.col("text").rlike(ONLY_INITIALS) & F.col("next.named")).withColumn("t", F.regexp_replace("text", r"\s+$", "")).withColumn("i", F.regexp_extract("t", TRAILING_INITIALS, 0)).filter("i <> ''")
    return first.unionByName(second).unionByName(_found(rest, F.length("t") - F.length("i"), F.length("t"), "PERSON", 0.8, "name_sweep_ocr"))


def registered_first_names(blocks: DataFrame, entities: DataFrame, people: DataFrame) -> DataFrame:
    """A misread given name, or one with the middle initial glued on, before the surname of a person
    who is registered with nearly that name."""
    e = _in_scans(blocks, entities).filter("entity_type = 'PERSON'")
    value = F.expr("substring(text, span_start + 1, span_end - span_start)")
    e = e.withColumn("last", F.lower(F.regexp_replace(F.coalesce(F.try_element_at(F.regexp_extract_all(value, F.lit(r"[A-Za-z][A-Za-z'’-]+"), 0), F.lit(-1)), F.lit("")), "-", ""))).withColumn("word", F.regexp_extract("before", r"(\S+)[ \t]+$", 1)).withColumn("blank", F.regexp_extract("before", r"\S+([ \t]+)$", 1)).filter("word <> ''")
    e = e.withColumn("given", F.lower(F.regexp_replace("word", r"[A-Z]\.$", ""))).filter(F.col("given").rlike(r"^\p{L}+$"))
    known = people.filter("first_name is not null").select(F.col("scope_id").alias("document_id"), F.lower(F.regexp_replace("last_name", "-", "")).alias("last"), F.lower("first_name").alias("first")).distinct()
    hit = e.join(known, ["document_id", "last"]).filter(likeness("given", "first") >= FIRST_LIKE)
    return _found(hit, F.col("span_start") - F.length("blank") - F.length("word"), F.col("span_end"), "PERSON", F.col("confidence"), "name_sweep_ocr").distinct()


def _as_one(joined: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Of distinct ``joined`` texts those that the rules read as one value of the ``kinds``: joined,
    entity_type (of the first rule)."""
    texts = joined.select("joined").distinct()
    probe = texts.select(F.lit("").alias("document_id"), F.col("joined").alias("block_id"), F.col("joined").alias("text"))
    order = F.array_position(F.array(*[F.lit(r.detector) for r in (*rules.RULES, *rules.CUSTOM_RULES)]), F.col("detector"))
    got = raw_spans(probe, (*rules.RULES, *rules.CUSTOM_RULES)).filter(F.col("entity_type").isin(*kinds) & (F.col("span_start") <= 1) & (F.col("span_end") >= F.length("block_id") - 1))
    return got.groupBy(F.col("block_id").alias("joined")).agg(F.min_by("entity_type", order).alias("entity_type"))


def wrapped_values(blocks: DataFrame, entities: DataFrame) -> DataFrame:
    """The other part of a value that was wrapped inside a cell, where the rules read both as one:
    a country code with nothing detected there and the first phone number without one on the lines
    after, a phone number and digits that begin one of the next lines, an id's beginning and its
    end on one of the next lines. The nearest line counts."""
    lines = _lines(blocks).select(*KEY, "box_of", "line", "text")
    taken = entities.groupBy(*KEY).agg(F.collect_set(F.struct(F.col("span_start").alias("s"), F.col("span_end").alias("e"))).alias("taken"))
    lines = lines.join(taken, KEY, "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<struct<s:int,e:int>>")))
    free = lambda s, e: ~F.exists("taken", lambda t: (t["s"] < e) & (t["e"] > s))
    ahead = lambda df, n: df.withColumn("to", F.explode(F.sequence(F.col("line") + 1, F.col("line") + n)))
    phones = entities.filter("entity_type = 'PHONE_NUMBER'").join(lines, KEY).withColumn("v", F.expr("substring(text, span_start + 1, span_end - span_start)"))
    place = ["document_id", "box_of"]

    heads = lines.select(*KEY, *place[1:], "line", "taken", F.explode(S.matches(F.col("text"), PHONE_HEAD, hint=r"\+\d")).alias("x"))
    heads = heads.withColumn("cc", F.length(F.regexp_extract("x.v", r"^\+\d{1,3}", 0))).filter(free(F.col("x.s"), F.col("x.s") + F.col("cc")))
    tails = phones.filter("v not like '+%'").groupBy(*place, "line").agg(F.min_by(F.struct("v"), "span_start").alias("tail"))
    near = ahead(heads, WRAP_LINES).join(tails.withColumnRenamed("line", "to"), [*place, "to"])
    near = near.groupBy(*KEY, "x", "cc").agg(F.min_by("tail", "to").alias("tail"))
    bare = F.col("x.v").rlike(r"[ \t]\d+$") & F.col("tail.v").rlike(r"^\s*\(")
    near = near.withColumn("end", F.when(bare, F.col("x.s") + F.col("cc")).otherwise(F.col("x.e"))).withColumn("joined", F.concat(F.expr("substring(x.v, 1, end - x.s)"), F.lit(" "), F.col("tail.v")))
    out = _found(near.join(_as_one(near, ("PHONE_NUMBER",)), "joined"), F.col("x.s"), F.col("end"), "PHONE_NUMBER", 0.8, "context:wrapped_value")

    open_ = phones.filter(~F.expr("substring(text, span_end + 1)").rlike(r"^[ \t]*\d")).select(*KEY, "box_of", "line", "v", "span_start")
    starts = lines.select(*place, F.col("line").alias("to"), F.col("block_id").alias("next_id"), F.explode(S.matches(F.col("text"), r"(^[ \t(]*)(\d[\d \t-]{2,}\d)(?![\w])", 2, 1)).alias("d"))
    cont = ahead(open_, NEAR_LINES).join(starts, [*place, "to"]).withColumn("joined", F.concat_ws(" ", "v", "d.v"))
    cont = cont.join(_as_one(cont, ("PHONE_NUMBER",)), "joined").groupBy(*KEY, "span_start").agg(F.min_by(F.struct("next_id", "d"), "to").alias("n"))
    out = out.unionByName(_found(cont.select("document_id", F.col("n.next_id").alias("block_id"), "n.d"), F.col("d.s"), F.col("d.e"), "PHONE_NUMBER", 0.8, "context:wrapped_value"))

    begun = lines.select(*KEY, "box_of", "line", "taken", F.explode(S.matches(F.col("text"), ID_HEAD, hint="-")).alias("x")).filter(free(F.col("x.s"), F.col("x.e")))
    ended = lines.select(*place, F.col("line").alias("to"), F.col("block_id").alias("next_id"), F.explode(S.matches(F.col("text"), ID_TAIL, hint="-")).alias("d"))
    ids = ahead(begun, NEAR_LINES).join(ended, [*place, "to"]).withColumn("joined", F.concat("x.v", "d.v"))
    ids = ids.join(_as_one(ids, ID_TYPES), "joined").groupBy(*KEY, "x").agg(F.min_by(F.struct("next_id", "d", "entity_type"), F.struct("to", "d.s")).alias("n"))
    out = out.unionByName(_found(ids, F.col("x.s"), F.col("x.e"), F.col("n.entity_type"), 0.8, "context:wrapped_value"))
    return out.unionByName(_found(ids.select("document_id", F.col("n.next_id").alias("block_id"), "n.d", "n.entity_type"), F.col("d.s"), F.col("d.e"), F.col("entity_type"), 0.8, "context:wrapped_value")).distinct()


#: Pixels of one tile of the join by place.
TILE = 128


def figure_duplicates(blocks: DataFrame, entities: DataFrame) -> DataFrame:
    """Words of a page that lie on a detected word of a figure and read alike take its type; runs of
    such words with one type become one span. Boxes meet in tiles of the page."""
    b = _scans(blocks).select(*KEY, "page_number", "extraction_method", "text", "boxes")
    w = words_of(b)
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    tiles = lambda a, z: F.sequence(F.floor(F.col(a) / TILE), F.floor(F.col(z) / TILE))
    tiled = lambda df: df.withColumn("tx", F.explode(tiles("x0", "x1"))).withColumn("ty", F.explode(tiles("y0", "y1")))
    figure = w.filter("extraction_method = 'figure_ocr'").join(entities.select(*KEY, "span_start", "span_end", "entity_type"), KEY).filter("start < span_end and end > span_start")
    figure = tiled(figure.select("document_id", "page_number", letters(F.col("word")).alias("read"), "entity_type", "x0", "y0", "x1", "y1").distinct())
    page = tiled(w.filter("extraction_method = 'ocr'").select(*KEY, "page_number", "n", "start", "end", letters(F.col("word")).alias("letters"), "x0", "y0", "x1", "y1").filter("letters <> ''"))
    f = figure.select("document_id", "page_number", "tx", "ty", "read", "entity_type", *[F.col(c).alias("f" + c) for c in ("x0", "y0", "x1", "y1")])
    wide, high = F.least("x1", "fx1") - F.greatest("x0", "fx0"), F.least("y1", "fy1") - F.greatest("y0", "fy0")
    area = lambda p: (F.col(p + "x1") - F.col(p + "x0")) * (F.col(p + "y1") - F.col(p + "y0"))
    met = page.join(f, ["document_id", "page_number", "tx", "ty"]).filter((wide > 0) & (high > 0) & (wide * high >= BOX_SHARE * F.greatest(F.lit(1), F.least(area(""), area("f")))))
    same = met.select(*KEY, "n", "start", "end", "letters", "read", "entity_type").distinct().filter(likeness("letters", "read") >= WORD_LIKE)
    same = same.groupBy(*KEY, "n", "start", "end").agg(F.min("entity_type").alias("entity_type"))
    by = Window.partitionBy(*KEY).orderBy("n")
    runs = same.withColumn("new", F.when((F.lag("n").over(by) == F.col("n") - 1) & (F.lag("entity_type").over(by) == F.col("entity_type")), 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return _found(runs.groupBy(*KEY, "run", "entity_type").agg(F.min("start").alias("s"), F.max("end").alias("e")), F.col("s"), F.col("e"), F.col("entity_type"), 0.8, "context:figure_duplicate")


def repaired(blocks: DataFrame, entities: DataFrame, people: DataFrame) -> DataFrame:
    """All repairs of spans (SR-6): wrapped values, initials, given names and, where ``blocks`` have
    ``boxes``, words that a figure was read twice; glued characters last, so that they are taken
    in by the repaired ones too."""
    out = wrapped_values(blocks, entities).unionByName(wrapped_initials(blocks, entities, people)).unionByName(registered_first_names(blocks, entities, people))
    if "boxes" in blocks.columns:
        out = out.unionByName(figure_duplicates(blocks, entities))
    return out.unionByName(attached_characters(blocks, entities.select(*out.columns).unionByName(out)))
