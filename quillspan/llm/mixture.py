"""Mixing sources to target shares of tokens.

Records are counted in tokens of a public tokenizer, shuffled within their source by hash, and
laid end to end; the stream of each source is cut into blocks of equally many tokens. Slots of
the mixture get their source from golden-ratio points mapped through the cumulative target
shares, so that every stretch of the mixture keeps the shares; the n-th slot of a source takes
the source's n-th block. All running counts work on two levels, within buckets and over them.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspan.session import cut, spread

TOKENIZERS = "/opt/tokenizers"
BLOCK = 1024
#: Rows of one bucket of the running counts; there are as many buckets as that takes, ``BUCKETS`` at
#: least. Sums of up to ``BROADCAST`` buckets are broadcast, more are joined by exchange.
BUCKET_ROWS, BUCKETS, BROADCAST = 100_000, 256, 200_000
# How the byte-level vocabularies split text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_GOLDEN = (math.sqrt(5) - 1) / 2
_STEP = round(_GOLDEN * 2**53)


def count_tokens(df: DataFrame, text: str, folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``df`` with ``n_tokens``, the tokens of the whole text; null texts have none. A column of
    that name in the input is replaced. Special tokens' strings count as ordinary text."""
    kept = df.drop("n_tokens")
    schema = StructType([*kept.schema, StructField("n_tokens", LongType())])  # add() would change the frame's own schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(f"{folder}/{vocabulary}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield b.assign(n_tokens=[len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in b[text]])

    return spread(kept).mapInPandas(run, schema)


def buckets_of(rows: int) -> int:
    return max(BUCKETS, math.ceil(rows / BUCKET_ROWS))


def running(df: DataFrame, group: str, bucket: Column, order: list[str], amount: str, out: str, buckets: int) -> DataFrame:
    """``out``: the sum of ``amount`` over the rows of the group before each row, in the order of
    bucket (one of ``buckets``), then ``order``. Rows of a bucket sort together; over the buckets
    goes one row each."""
    b = df.withColumn("_bucket", bucket)
    sums = b.groupBy(group, "_bucket").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = F.broadcast(sums) if buckets <= BROADCAST else sums
    return b.withColumn("_in", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(sums, [group, "_bucket"]).withColumn(out, (F.col("_base") + F.col("_in")).cast("long")).drop("_bucket", "_base", "_in")


def slots(spark, n: int, shares: list[tuple[str, float]]) -> DataFrame:
    """(slot, source, rank): slot i goes to the source in whose part of the cumulative shares the
    i-th golden-ratio point falls; rank counts the source's slots before it. Points are computed
    in whole numbers, so they are exact at any length."""
    total = sum(w for _, w in shares)
    edges, at = [], 0.0
    for s, w in shares:
        edges.append((s, at))
        at += w / total
    # i * step mod 2^53, by halves, within 64 bits
    low, high = _STEP & (2**26 - 1), _STEP >> 26
    i = F.col("slot")
    ih, il = F.shiftright(i, 20), i.bitwiseAND(2**20 - 1)
    mod = F.lit(2**53)
    mul = lambda a, b: (a * F.lit(b)) % mod
    shift = lambda x, k: ((x % F.lit(2 ** (53 - k))) * F.lit(2**k)) % mod
    point = (mul(il, low) + shift(mul(il, high), 26) + shift(mul(ih, low), 20) + shift(shift(mul(ih, high), 20), 26)) % mod
    source = F.lit(edges[0][0])
    for s, edge in edges[1:]:
        source = F.when(F.col("point") >= F.lit(int(edge * 2**53)), F.lit(s)).otherwise(source)
    rows = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("source", source).withColumn("_one", F.lit(1))
    buckets = buckets_of(n)
    width = max(1, math.ceil(n / buckets))
    return running(rows, "source", F.floor(F.col("slot") / width), ["slot"], "_one", "rank", buckets).select("slot", "source", "rank")


def mix(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, seed: int = 0, folder: str = TOKENIZERS) -> DataFrame:
    """The mixture: (``slot``, ``source``, ``block_no``, ``use_no``, doc_id, ``token_from``,
    ``token_to``): slot by slot the pieces of records, as token ranges of their texts.

    Every slot holds ``block`` tokens of one source. A record is used at most ``max_repeats``
    times, the uses one whole round of the source apart. The mixture is as long as the scarcest
    source allows. Sources without records or with no share can't take part; the others keep
    their shares in proportion (see :func:`shares`). Records without a source, without tokens,
    or of a source without target are not used; null shares or repeats count as 0. Equal ids in
    one source count as one record, the longest."""
    spark = documents.sparkSession
    goal = {r["source"]: (r["w"], r["m"]) for r in targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m")).collect() if (r["w"] or 0) > 0 and (r["m"] or 0) > 0}
    empty = f"slot long, source string, block_no long, use_no int, `{doc_id}` {documents.schema[doc_id].dataType.simpleString()}, token_from long, token_to long"
    rows = documents.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("t")).filter(F.col("source").isin(list(goal)))
    sized = count_tokens(rows, "t", folder).select("d", "source", "n_tokens").groupBy("source", "d").agg(F.max("n_tokens").alias("n_tokens")).filter("n_tokens > 0")
    sized = cut(sized.withColumn("h", F.xxhash64("d", F.lit(seed))))
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()
    stock, buckets = {r["source"]: r["n"] for r in sums}, buckets_of(max((r["rows"] for r in sums), default=0))
    blocks = {s: stock[s] * goal[s][1] // block for s in stock}
    live = sorted((s, goal[s][0]) for s in blocks if blocks[s] > 0)
    if not live:
        return spark.createDataFrame([], empty)
    total = sum(w for _, w in live)
    n = min(math.floor(blocks[s] * total / w) for s, w in live) + 8
    plan = cut(slots(spark, n, live))
    # the points leave a source's share by a few slots: end before the first slot without a block
    have = F.create_map(*[x for s in blocks for x in (F.lit(s), F.lit(blocks[s]))])
    over = plan.filter(F.col("rank") >= have[F.col("source")]).agg(F.min("slot")).first()[0]
    if over is not None:
        plan = plan.filter(F.col("slot") < over)

    laid = running(sized, "source", F.pmod("h", F.lit(buckets)), ["h", "d"], "n_tokens", "begin", buckets)
    round_of = F.create_map(*[x for s in stock for x in (F.lit(s), F.lit(stock[s]).cast("long"))])  # use_no times it passes 2^31
    repeats = F.create_map(*[x for s in stock for x in (F.lit(s), F.lit(goal[s][1]))])
    used = laid.withColumn("use_no", F.explode(F.sequence(F.lit(0), repeats[F.col("source")] - 1)))
    used = used.withColumn("at", F.col("begin") + F.col("use_no") * round_of[F.col("source")])
    pieces = used.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n_tokens") - 1) / block))))
    pieces = pieces.select(
        "source", "block_no", "use_no", "d",
        (F.greatest("at", F.col("block_no") * block) - F.col("at")).alias("token_from"),
        (F.least(F.col("at") + F.col("n_tokens"), (F.col("block_no") + 1) * block) - F.col("at")).alias("token_to"),
    )
    mixed = plan.withColumnRenamed("rank", "block_no").join(pieces, ["source", "block_no"])
    return mixed.select("slot", "source", "block_no", "use_no", F.col("d").alias(doc_id), "token_from", "token_to")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each target: target_share, the tokens in the mixture, the share reached, and how often
    its most used record is used. Targets without records reach 0."""
    most = mixture.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"), F.max(F.col("use_no") + 1).alias("most_uses"))
    all_tokens = most.agg(F.sum("tokens").alias("all_tokens"))
    t = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = t.join(F.broadcast(most), "source", "left").join(F.broadcast(all_tokens))
    return out.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
