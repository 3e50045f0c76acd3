"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCANS = ("ocr", "figure_ocr", "embedded_image_ocr")


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of ``folder``; naming the columns keeps the scan to them."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def blocks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Blocks, each key once. Redelivered rows are equal in all columns, so any of them serves;
    without ``columns`` all that the block operators use."""
    names = columns or ("document_id", "block_ord", "block_id", "text", "page_number", "extraction_method", "kind")
    keys = ["document_id", "block_id"]
    return table(spark, folder, "blocks", *dict.fromkeys((*keys, *names))).dropDuplicates(keys)
