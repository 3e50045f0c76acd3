"""Merge of recorded detections, risk tiers, and their summaries, over an entities table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import lookups as L

BLOCK = ("document_id", "block_id")


def valid_entities(entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct detections with real bounds, a confidence from 0 to 1 and a type, the type in one
    spelling. A null detector counts as empty."""
    lengths = blocks.filter("text is not null").select(*BLOCK, F.length("text").alias("n")).distinct()
    e = entities.filter((F.col("span_start") >= 0) & (F.col("span_end") > F.col("span_start")) & F.col("confidence").isNotNull() & ~F.isnan("confidence") & F.col("confidence").between(0.0, 1.0) & F.col("entity_type").isNotNull())
    e = e.select(*BLOCK, "span_start", "span_end", L.clean_type(F.col("entity_type")).alias("entity_type"), "confidence", F.coalesce("detector", F.lit("")).alias("detector")).distinct()
    return e.join(lengths, list(BLOCK)).filter("span_end <= n").drop("n")


def merge_entities(entities: DataFrame) -> DataFrame:
    """Overlapping detections of a block as one: the union of their spans, the type and confidence
    of the most specific, surest, longest, first, and the distinct detectors in order. Touching
    spans stay apart. One exchange by block serves window and grouping."""
    w = Window.partitionBy(*BLOCK).orderBy("span_start", "span_end", "entity_type", "confidence", "detector")
    spec = L.lookup(L.SPECIFICITY, "0")(F.col("entity_type")).cast("int")
    seen = F.max("span_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = entities.withColumn("_new", F.when(seen.isNull() | (F.col("span_start") >= seen), 1).otherwise(0)).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.struct((-spec).alias("a"), (-F.col("confidence")).alias("b"), (F.col("span_start") - F.col("span_end")).alias("c"), F.col("span_start").alias("d"), F.col("entity_type").alias("e"), F.col("detector").alias("f"))
    merged = rows.groupBy(*BLOCK, "_part").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), F.min(key).alias("k"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("detector", r"[|,]"))))).alias("dets"))
    return merged.select(*BLOCK, "span_start", "span_end", F.col("k.e").alias("entity_type"), (-F.col("k.b")).alias("confidence"), F.array_join(F.filter("dets", lambda d: F.trim(d) != ""), "|").alias("detector"))


def risk(c: Column) -> Column:
    return L.lookup(L.RISK, "MEDIUM")(F.upper(c))


def risk_summary(entities: DataFrame) -> DataFrame:
    """Detections a tier; tiers without any count 0."""
    spark = entities.sparkSession
    tiers = spark.createDataFrame([(t,) for t in L.TIERS], "risk_level string")
    n = entities.select(risk(F.col("entity_type")).alias("risk_level")).groupBy("risk_level").agg(F.count("*").alias("n"))
    return tiers.join(n, "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))
