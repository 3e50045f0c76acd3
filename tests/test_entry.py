import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COMPARED = ["p5_found", "mrg1_entities_merged", "red5_sanitized", "aud_counts", "xf4_places_text", "ev4_page_offsets", "ev9_overlaps", "rule_email", "sr1_attached_characters", "gate3_placeholders", "reg1_email_names", "rule_us_address"]


def rows(values):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values)


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({entry.oracle_sql()[name]})").fetchall()
    assert rows(map(tuple, df.select(*cols).collect())) == rows(want)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["entity_type", "risk_level", "n", "documents"]


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_text_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "quillspan")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"quillspan\.llm|from quillspan import llm", open(os.path.join(folder, f)).read()), f


@pytest.mark.parametrize("name", ["p5_found", "red5_sanitized", "gate5_residuals", "reg7_sweep"])
def test_no_cross_joins(spark, data, name):
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
