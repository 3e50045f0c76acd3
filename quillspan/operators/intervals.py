"""Overlapping and gapped intervals: merged periods and the gaps between them.

The merge works on two levels, so that no entity has to fit into one task. Every interval is cut
at the borders of fixed shards of the axis; each (entity, shard) merges on its own; only pieces
that an interval carries across a border go into the second step, at most two per shard. Gaps are
found the same way: inside a shard by looking at the next period, across shards from one row per
(entity, shard).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_WIDTH = 65_536


def _struct(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("_"))


def merge_periods(df: DataFrame, keys: Sequence[str], start: str, end: str, shard_width: int = SHARD_WIDTH) -> DataFrame:
    """Merged half-open integer periods of each entity: columns ``k`` (struct of the keys),
    ``shard`` (of the start), ``s``, ``e``.

    Intervals with a common position merge, also through others; intervals that only touch do
    not. Rows with a null bound or an end that isn't after the start hold no position and take
    no part. Null keys form an entity of their own. Repeated rows count once. Other columns are
    ignored, whatever their names. An empty input gives an empty result.
    """
    if shard_width < 1:
        raise ValueError("shard_width must be positive")
    w = F.lit(int(shard_width)).cast("long")
    rows = (
        df.select(_struct(keys).alias("k"), F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e"))
        .filter("s is not null and e is not null and e > s")
        .groupBy("k", "s").agg(F.max("e").alias("e"))  # equal starts overlap: the longest holds them all
    )
    cut = rows.select("k", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / w), F.floor((F.col("e") - 1) / w))).alias("shard")).select(
        "k", "shard",
        F.greatest("s", F.col("shard") * w).alias("s"),
        F.least("e", (F.col("shard") + 1) * w).alias("e"),
        (F.col("s") < F.col("shard") * w).alias("from_left"),
        (F.col("e") > (F.col("shard") + 1) * w).alias("to_right"),
    )
    by_start = Window.partitionBy("k", "shard").orderBy("s", F.col("from_left").desc())
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_start.rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max("e").over(before)
    pieces = (
        cut.withColumn("new", F.when(seen.isNull() | (F.col("s") >= seen), 1).otherwise(0))
        .withColumn("piece", F.sum("new").over(upto))
        .groupBy("k", "shard", "piece")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("from_left").alias("open_left"), F.max("to_right").alias("open_right"))
    )
    inner = pieces.filter("not open_left and not open_right").select("k", "shard", "s", "e")
    along = Window.partitionBy("k").orderBy("shard", "s").rowsBetween(Window.unboundedPreceding, 0)
    stitched = (
        pieces.filter("open_left or open_right")
        .withColumn("run", F.sum(F.when(F.col("open_left"), 0).otherwise(1)).over(along))
        .groupBy("k", "run").agg(F.min("shard").alias("shard"), F.min("s").alias("s"), F.max("e").alias("e"))
        .select("k", "shard", "s", "e")
    )
    return inner.unionByName(stitched)


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, shard_width: int = SHARD_WIDTH) -> DataFrame:
    """Periods and gaps of each entity: the keys, ``piece`` (``period`` or ``gap``), and the
    bounds under the names of the input's.

    A gap is an uncovered stretch of at least one position between successive periods of one
    entity; touching periods have none, and there is none before the first or after the last.
    For empty, null, repeated and clashing input see :func:`merge_periods`."""
    periods = merge_periods(df, keys, start, end, shard_width)
    inside = Window.partitionBy("k", "shard").orderBy("s")
    firsts = periods.groupBy("k", "shard").agg(F.min("s").alias("first_s"))
    later = firsts.select("k", "shard", F.lead("first_s").over(Window.partitionBy("k").orderBy("shard")).alias("later_s"))
    both = (
        periods.withColumn("next_s", F.lead("s").over(inside))
        .join(later, ["k", "shard"])
        .withColumn("next_s", F.coalesce("next_s", "later_s"))
        .select("k", F.explode(F.array(
            F.struct(F.lit("period").alias("piece"), "s", "e"),
            F.struct(F.lit("gap").alias("piece"), F.col("e").alias("s"), F.col("next_s").alias("e")),
        )).alias("x"))
        .filter("x.e > x.s")
    )
    kind = dict(df.dtypes)
    return both.select(
        *[F.col("k")[k].alias(k) for k in keys], F.col("x.piece").alias("piece"),
        F.col("x.s").cast(kind[start]).alias(start), F.col("x.e").cast(kind[end]).alias(end),
    )


def valid_spans(entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct (document_id, block_id, span_start, span_end) of the entity rows that stand for a
    real stretch of their block: bounds not null, 0 <= start < end <= length of the text, and a
    confidence that is a number from 0 to 1. Rows of unknown blocks or of blocks without text
    are left out."""
    spans = (
        entities.filter(F.col("span_start").isNotNull() & F.col("span_end").isNotNull() & (F.col("span_start") >= 0) & (F.col("span_end") > F.col("span_start")))
        .filter(F.col("confidence").isNotNull() & ~F.isnan("confidence") & F.col("confidence").between(0.0, 1.0))
        .select("document_id", "block_id", "span_start", "span_end").distinct()
    )
    lengths = blocks.filter("text is not null").select("document_id", "block_id", F.length("text").alias("n")).groupBy("document_id", "block_id").agg(F.max("n").alias("n"))
    return spans.join(lengths, ["document_id", "block_id"]).filter("span_end <= n").drop("n")
