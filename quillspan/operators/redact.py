"""Stable tokens for values, and their places in the text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions import spans as S
from quillspan.operators import lookups as L

#: Blocks of a file whose identities are numbered, and whose texts are put together, in one task.
PART = 1024


def canonical(c: Column) -> Column:
    return L.lookup(L.CANONICAL)(F.upper(F.trim(c)))


@F.pandas_udf(T.StringType())
def _composed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def composed(c: Column) -> Column:
    """Unicode's composed form; text without combining marks or other letters to compose is in it."""
    return F.when(c.rlike(r"[^\x00-\u02FF]"), _composed(c)).otherwise(c)


def identity(kind: Column, value: Column) -> Column:
    """What makes two values the same: the value in composed form without blanks around; of mail
    addresses the domain's case doesn't matter. The case of all else does."""
    v = F.trim(value)
    return F.when((kind == "EMAIL") & v.contains("@"), F.concat(F.regexp_extract(v, r"(?s)^(.*@)[^@]*$", 1), F.lower(F.regexp_extract(v, r"([^@]*)$", 1)))).otherwise(v)


def values(merged: DataFrame, blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Merged spans with their value, canonical type, identity, and place in reading order: scope,
    file order, block order, start."""
    b = blocks.select("document_id", "block_id", "block_ord", "text")
    f = files.select("document_id", "scope_id", "doc_ord").distinct()
    rows = merged.join(b, ["document_id", "block_id"]).join(f, "document_id")
    rows = rows.withColumn("canonical_type", canonical(F.col("entity_type"))).withColumn("value", F.expr("substring(text, span_start + 1, span_end - span_start)"))
    return rows.withColumn("identity", identity(F.col("canonical_type"), composed(F.col("value")))).drop("text")


def tokens(found: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """One token an identity, numbered a type in the order of first appearance within the scope:
    scope_id, canonical_type, identity, token, n, uses. Repeated values are summed up before
    anything is sorted, and only distinct identities are numbered, on two levels: a scope's in the
    order of its files, then within each file. Identities of ``taken`` tokens get none anew, and
    numbers go on from theirs."""
    group = ["scope_id", "canonical_type"]
    first = found.groupBy(*group, "identity").agg(F.min(F.struct("doc_ord", "block_ord", "span_start")).alias("at"), F.count("*").alias("uses"))
    if taken is not None:
        first = first.join(taken.select(*group, "identity"), [*group, "identity"], "left_anti")
    part = F.struct(F.col("at.doc_ord").alias("d"), F.floor(F.col("at.block_ord") / PART).alias("p"))
    first = first.withColumn("part", part)
    sizes = first.groupBy(*group, "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*group, "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    out = first.withColumn("n", F.row_number().over(Window.partitionBy(*group, "part").orderBy("at", "identity"))).join(bases, [*group, "part"]).withColumn("n", (F.col("n") + F.col("base")).cast("int"))
    if taken is not None:
        last = taken.groupBy(*group).agg(F.max("n").alias("last"))
        out = out.join(last, group, "left").withColumn("n", (F.col("n") + F.coalesce("last", F.lit(0))).cast("int"))
    return out.select("scope_id", "canonical_type", "identity", token(F.col("canonical_type"), F.col("n")).alias("token"), "n", "uses")


def token(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("_"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")), F.lit("]"))


def sanitized(blocks: DataFrame, found: DataFrame, issued: DataFrame) -> DataFrame:
    """document_id, block_id, block_ord, sanitized: every value replaced by its scope's token.
    Blocks without values keep their text, null text stays null."""
    ids = ["document_id", "block_id"]
    marks = found.join(issued.select("scope_id", "canonical_type", "identity", "token"), ["scope_id", "canonical_type", "identity"])
    by = marks.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(F.col("span_start").alias("s"), F.col("span_end").alias("e"), "token"))).alias("pieces"))
    rows = blocks.select(*ids, "block_ord", "text").join(by, ids, "left")
    return rows.select(*ids, "block_ord", F.when(F.col("pieces").isNull(), F.col("text")).otherwise(S.splice(F.col("text"), F.col("pieces"))).alias("sanitized"))


def replacement_pairs(found: DataFrame, issued: DataFrame) -> DataFrame:
    """Distinct (scope_id, value, token) with at least three letters or digits in the value."""
    p = found.join(issued, ["scope_id", "canonical_type", "identity"]).select("scope_id", "value", "token").distinct()
    return p.filter(F.length(F.regexp_replace("value", r"[^\p{L}\p{N}]", "")) >= 3)


def payload(texts: DataFrame, column: str = "sanitized") -> DataFrame:
    """What a document hands on: its non-blank texts in order, joined by line breaks. For documents
    of any size see ``payload_parts``."""
    rows = payload_parts(texts, column).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("part", "payload"))).alias("x"), F.sum("n_blocks").cast("int").alias("n_blocks"))
    return rows.select("document_id", F.array_join(F.transform("x", lambda r: r["payload"]), "\n").alias("payload"), "n_blocks")


def payload_parts(texts: DataFrame, column: str = "sanitized", part: int = PART) -> DataFrame:
    """The same in parts of ``part`` blocks, so that no row grows with the document: document_id,
    part, payload, n_blocks. Parts in order, joined by line breaks, are the whole."""
    rows = texts.filter(F.trim(F.col(column)) != "").groupBy("document_id", F.floor(F.col("block_ord") / part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("block_ord", "block_id", F.col(column).alias("t")))).alias("x"))
    return rows.select("document_id", "part", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("payload"), F.size("x").alias("n_blocks"))


def withhold_figures(texts: DataFrame, lines: DataFrame, figures: DataFrame, column: str = "sanitized") -> DataFrame:
    """``texts`` (document_id, block_id, block_ord and ``column``) with every line inside an unreadable
    figure replaced by the figure's token (RED-7), numbered in a document in reading order. ``lines``
    place the blocks (document_id, block_id, page_number, extraction_method, figure_no, bbox),
    ``figures`` are document_id, page_number, figure_no, readable, bbox. A line of figure text lies in
    the figure of its number, a line of page text in that whose box holds its centre, the first one
    if several do."""
    bad = figures.filter("not coalesce(readable, false) and size(bbox) = 4").select("document_id", "page_number", F.col("figure_no").alias("fig"), F.col("bbox").alias("area"))
    x, y = (F.col("bbox")[0] + F.col("bbox")[2]) / 2, (F.col("bbox")[1] + F.col("bbox")[3]) / 2
    inside = (F.size("bbox") == 4) & x.between(F.col("area")[0], F.col("area")[2]) & y.between(F.col("area")[1], F.col("area")[3])
    at = lines.filter(F.col("extraction_method").isin("ocr", "figure_ocr")).join(bad, ["document_id", "page_number"])
    at = at.filter(F.when(F.col("extraction_method") == "figure_ocr", F.col("figure_no") == F.col("fig")).otherwise(inside))
    at = at.groupBy("document_id", "block_id").agg(F.min(F.struct("page_number", "fig")).alias("where")).join(texts.select("document_id", "block_id", "block_ord"), ["document_id", "block_id"])
    seen = at.groupBy("document_id", "where").agg(F.min("block_ord").alias("first"))
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("first", "where"))
    named = at.join(seen.select("document_id", "where", F.concat(F.lit("[FIGURE_UNREADABLE_"), n.cast("string"), F.lit("]")).alias("_figure")), ["document_id", "where"]).select("document_id", "block_id", "_figure")
    return texts.join(named, ["document_id", "block_id"], "left").withColumn(column, F.coalesce("_figure", column)).drop("_figure")


def masked_words(words: DataFrame, spans: DataFrame) -> DataFrame:
    """The boxes of words that redacted spans touch (RED-11), to be covered in the picture: the
    columns of ``words`` (document_id, block_id, start, end, x0, y0, x1, y1), once each."""
    s = spans.select("document_id", "block_id", "span_start", "span_end").distinct()
    return words.join(s, ["document_id", "block_id"]).filter("start < span_end and end > span_start").select(*words.columns).distinct()
