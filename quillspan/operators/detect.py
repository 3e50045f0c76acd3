"""Detection, merge and generic redaction inside each block's row: no shuffle, batch or stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import spans as S
from quillspan.operators import lookups as L
from quillspan.operators.rules import CUSTOM_RULES, NAME_RULES, RULES, Rule

FOUND = "array<struct<s:int,e:int,entity_type:string,confidence:double,detector:string,typed:boolean,apart:boolean>>"
ALL_RULES = (*RULES, *CUSTOM_RULES, *NAME_RULES)


def _of_rule(text: Column, r: Rule) -> Column:
    got = S.matches(text, r.pattern, 2 if r.before else 0, 1 if r.before else None, r.hint)
    if r.check is not None:
        got = F.filter(got, lambda x: r.check(x["v"]))
    return F.transform(got, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(r.entity_type).alias("entity_type"), F.lit(r.confidence).alias("confidence"), F.lit(r.detector).alias("detector"), F.lit(r.typed).alias("typed"), F.lit(r.apart).alias("apart")))


def with_found(blocks: DataFrame, rules: Sequence[Rule] = ALL_RULES, text: str = "text", out: str = "found") -> DataFrame:
    """``blocks`` with ``out``: the spans of all rules, in the rules' order. The first rule to claim
    a span keeps it; a typed rule also keeps a span that rules of other types claimed, an ``apart``
    rule gives way to spans around its own. Null or blank text has none."""
    t = F.col(f"`{text}`")
    names = [f"_rule{i}" for i in range(len(rules))]
    staged = blocks.select("*", *[_of_rule(t, r).alias(n) for r, n in zip(rules, names)])
    every = F.flatten(F.array(*names)) if names else F.array()
    staged = staged.withColumn("_all", F.coalesce(every.cast(FOUND), F.array().cast(FOUND)))
    same = lambda x, y: (y["s"] == x["s"]) & (y["e"] == x["e"]) & (~x["typed"] | (y["entity_type"] == x["entity_type"]))
    around = lambda x, y: x["apart"] & (y["s"] <= x["s"]) & (x["e"] <= y["e"])
    first = F.filter("_all", lambda x, i: ~F.exists(F.slice("_all", F.lit(1), i), lambda y: same(x, y) | around(x, y)))
    return staged.withColumn(out, first).drop(*names, "_all")


def merged_inside(found: Column) -> Column:
    """The spans of one row, merged: overlapping ones (touching is not overlapping) become their
    union, typed as the most specific, surest, longest, first of them, with all detectors."""
    spec = L.lookup(L.SPECIFICITY, "0")
    key = lambda x: F.struct((-spec(x["entity_type"]).cast("int")).alias("a"), (-x["confidence"]).alias("b"), (x["s"] - x["e"]).alias("c"), x["s"].alias("s"), x["entity_type"].alias("entity_type"), x["detector"].alias("detector"))
    one = "struct<s:int,e:int,key:struct<a:int,b:double,c:int,s:int,entity_type:string,detector:string>,detectors:array<string>>"
    start = F.array().cast(f"array<{one}>")

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        dets = F.split(x["detector"], r"[|,]")
        fresh = F.struct(x["s"].alias("s"), x["e"].alias("e"), key(x).alias("key"), dets.alias("detectors"))
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), F.least(last["key"], key(x)).alias("key"), F.concat(last["detectors"], dets).alias("detectors"))
        return F.when(F.size(a) == 0, F.array(fresh)).when(x["s"] >= last["e"], F.concat(a, F.array(fresh))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined)))

    merged = F.aggregate(F.array_sort(found), start, step)
    return F.transform(merged, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["key"]["entity_type"].alias("entity_type"), (-x["key"]["b"]).alias("confidence"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(x["detectors"], lambda d: F.trim(d) != ""))), "|").alias("detector"),
    ))


def detect(blocks: DataFrame, rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """One row per merged span: document_id, block_id, span_start, span_end, entity_type,
    confidence, detector."""
    rows = with_found(blocks.select("document_id", "block_id", "text"), rules).select("document_id", "block_id", F.explode(merged_inside(F.col("found"))).alias("x"))
    return rows.select("document_id", "block_id", F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end"), "x.entity_type", "x.confidence", "x.detector")


def raw_spans(blocks: DataFrame, rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """One row per span of a rule, before the merge."""
    rows = with_found(blocks.select("document_id", "block_id", "text"), rules).select("document_id", "block_id", F.explode("found").alias("x"))
    return rows.select("document_id", "block_id", F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end"), "x.entity_type", "x.confidence", "x.detector")


def redact_in_place(blocks: DataFrame, rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """``blocks`` with ``sanitized``: generic placeholders such as [EMAIL] for all found spans, and
    ``n_redacted``. Works row by row, so also on a stream."""
    canon = L.lookup(L.CANONICAL)
    rows = with_found(blocks, rules, out="_found").withColumn("_merged", merged_inside(F.col("_found")))
    tokens = F.transform("_merged", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("["), canon(x["entity_type"]), F.lit("]")).alias("token")))
    return rows.withColumn("sanitized", F.when(F.col("text").isNull(), None).otherwise(S.splice(F.col("text"), tokens))).withColumn("n_redacted", F.size("_merged")).drop("_found", "_merged")
