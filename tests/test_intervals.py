import random

import pytest

from quillspan.operators.intervals import merge_intervals, valid_spans

SCHEMA = "id string, a int, b int"


def brute(rows):
    out, by = set(), {}
    for k, a, b in rows:
        if a is not None and b is not None and b > a:
            by.setdefault(k, []).append((a, b))
    for k, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:]) if y[0] > x[1]}
    return out


def run(spark, rows, width):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in merge_intervals(df, ["id"], "a", "b", width).collect()}


@pytest.mark.parametrize("width", [1, 3, 7, 65536])
def test_against_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["x", "y", None]), a := rng.randint(-10, 60), a + rng.randint(-1, 12)) for _ in range(300)]
    assert run(spark, rows, width) == brute(rows)


def test_touching_stays_apart_also_at_shard_borders(spark):
    assert run(spark, [("x", 0, 4), ("x", 4, 8)], 4) == {("x", "period", 0, 4), ("x", "period", 4, 8)}
    assert run(spark, [("x", 0, 4), ("x", 4, 8), ("x", 3, 5)], 4) == {("x", "period", 0, 8)}
    assert run(spark, [("x", 0, 40), ("x", 90, 91)], 4) == {("x", "period", 0, 40), ("x", "gap", 40, 90), ("x", "period", 90, 91)}


def test_nulls_repeats_empty_and_clashing_columns(spark):
    assert run(spark, [("x", None, 3), ("x", 1, None), ("x", 3, 3), ("x", 5, 2)], 8) == set()
    assert run(spark, [("x", 1, 3)] * 4, 8) == {("x", "period", 1, 3)}
    assert run(spark, [], 8) == set()
    clash = spark.createDataFrame([("x", 1, 3, 9, "z", 7)], "id string, a int, b int, k int, shard string, piece int")
    assert [tuple(r) for r in merge_intervals(clash, ["id"], "a", "b").collect()] == [("x", "period", 1, 3)]
    with pytest.raises(ValueError):
        merge_intervals(clash, ["id"], "a", "b", 0)


def test_valid_spans(spark):
    b = spark.createDataFrame([("d", "1", "abcdé"), ("d", "2", None)], "document_id string, block_id string, text string")
    nan = float("nan")
    e = [("d", "1", 0, 5, 0.5), ("d", "1", 0, 5, 1.0), ("d", "1", 0, 6, 0.5), ("d", "1", -1, 2, 0.5), ("d", "1", 2, 2, 0.5), ("d", "1", 1, 2, nan), ("d", "1", 1, 2, None), ("d", "1", 1, 2, 1.1), ("d", "1", None, 2, 0.5), ("d", "2", 0, 1, 0.5), ("d", "3", 0, 1, 0.5)]
    e = spark.createDataFrame(e, "document_id string, block_id string, span_start int, span_end int, confidence double")
    assert [tuple(r) for r in valid_spans(e, b).collect()] == [("d", "1", 0, 5)]
