import os

import pytest
from pyspark.sql import functions as F

from quillspan.llm import mixture

pytestmark = pytest.mark.skipif(not os.path.isdir(mixture.TOKENIZERS), reason="no tokenizers here")


def test_mixture(spark):
    docs = [(i, "a" if i % 3 else "b", f"word{i} some more text here {'x ' * (i % 40)}") for i in range(600)] + [(1000, None, "no source"), (1001, "z", "no target"), (1002, "a", None), (1003, "a", "")]
    d = spark.createDataFrame(docs + docs[:5], "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("none", 0.1, 2), ("c", None, 1)], "source string, target_share double, max_repeats int")
    m = mixture.mix(d, t, block=64).cache()
    rows = m.collect()
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r.slot, []).append(r)
        assert 0 <= r.token_from < r.token_to
    assert sorted(by_slot) == list(range(len(by_slot)))
    assert all(sum(r.token_to - r.token_from for r in v) == 64 and len({r.source for r in v}) == 1 for v in by_slot.values())
    used = {}
    for r in rows:
        used.setdefault((r.source, r.doc_id, r.use_no), []).append((r.token_from, r.token_to))
    for v in used.values():  # no token of a record twice in one use
        v = sorted(v)
        assert all(x[1] <= y[0] for x, y in zip(v, v[1:]))
    assert max(r.use_no for r in rows if r.source == "a") == 0 and max(r.use_no for r in rows if r.source == "b") <= 2
    s = {r.source: r for r in mixture.shares(m, t).collect()}
    assert abs(s["a"].share - 0.6) < 0.02 and abs(s["b"].share - 0.4) < 0.02 and s["none"].tokens == 0
    for n in (25, 50):  # the shares hold in every stretch
        assert abs(sum(v[0].source == "a" for k, v in by_slot.items() if k < n) / n - 0.6) < 0.07
    assert mixture.mix(d.limit(0), t).count() == 0


def test_points_are_exact(spark):
    got = [r.source for r in mixture.slots(spark, 300, [("a", 0.5), ("b", 0.3), ("c", 0.2)]).orderBy("slot").collect()]
    point = lambda i: i * mixture._STEP % 2**53 / 2**53
    assert got == ["a" if point(i) < 0.5 else "b" if point(i) < 0.8 else "c" for i in range(300)]


def test_scan_of_many_splits(spark):
    # such a scan is not spread, so the tokens are counted on the frame itself
    df = spark.range(0, 32, 1, 16).selectExpr("id as doc_id", "'a' as source", "concat('word ', id) as text")
    assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    got = mixture.count_tokens(df, "text")
    assert got.columns == ["doc_id", "source", "text", "n_tokens"] and df.columns == ["doc_id", "source", "text"]
    assert got.filter("n_tokens >= 2").count() == 32


def test_rounds_past_two_thousand_million_tokens(spark, monkeypatch):
    monkeypatch.setattr(mixture, "count_tokens", lambda df, text, folder: df.withColumn("n_tokens", F.lit(1_000_000_000).cast("long")))
    d = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 1.0, 4)], "source string, target_share double, max_repeats int")
    rows = mixture.mix(d, t, block=2**26).collect()
    assert max(r.use_no for r in rows) == 3 and sum(r.token_to - r.token_from for r in rows) == 4_000_000_000 // 2**26 * 2**26
