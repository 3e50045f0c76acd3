"""Detection and generic redaction on a stream of blocks: all of it happens inside the row, so it
needs no state, no watermark and no shuffle; late rows are treated like others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.detect import ALL_RULES, redact_in_place
from quillspan.operators.rules import Rule


def redacted_stream(spark: SparkSession, folder: str, schema, rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """A streaming DataFrame over Parquet files that arrive in ``folder``, with ``sanitized``."""
    return redact_in_place(spark.readStream.schema(schema).parquet(folder), rules)


def redactions_by_hour(stream: DataFrame, time: str = "received_at", late: str = "2 hours") -> DataFrame:
    """Replacements an hour of arrival; rows later than ``late`` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour")).agg(F.sum("n_redacted").alias("n_redacted"), F.count("*").alias("blocks"))
