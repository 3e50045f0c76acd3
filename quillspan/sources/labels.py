"""Labels, transcriptions and results from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("file", "page", "location_type", "entity_type", "value", "uncertain", "note")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Label rows from CSV: blanks trimmed, rows without a value left out, ``uncertain`` true for
    yes, true and 1. A missing column raises."""
    df = spark.read.option("header", "true").csv(path)
    if missing := [c for c in COLUMNS if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    df = df.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS])
    return df.filter("value <> ''").withColumn("uncertain", F.lower("uncertain").isin("yes", "true", "1"))


def read_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of page_NN.txt files: page, line_no, text; lines that begin with # are comments."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"page_0*(\d+)\.txt", 1).cast("int").alias("page"), F.posexplode(F.split("value", "\n")).alias("line_no", "text"))
    return whole.filter("page is not null and not startswith(text, '#')")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark results from JSON; without ``files`` and ``total`` it raises."""
    df = spark.read.option("multiLine", "true").json(path)
    if not {"files", "total"} <= set(df.columns):
        raise ValueError("not a results file")
    return df


def lines_of_words(words: DataFrame) -> DataFrame:
    """Words of a page (document_id, page, block, par, line, ord, text, left, top, width, height) as
    lines: the text joined by one space, the box around all, the words in order."""
    key = ["document_id", "page", "block", "par", "line"]
    w = words.filter("text is not null and trim(text) <> ''")
    box = [F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1")]
    return w.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("words"), *box).withColumn("text", F.array_join(F.transform("words", lambda x: x["text"]), " "))
