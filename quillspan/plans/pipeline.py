"""The whole way of a collection: detect, merge, number, redact, check, report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import audit, context, gate, redact, registry
from quillspan.operators.detect import ALL_RULES, raw_spans
from quillspan.operators.merge import merge_entities, risk
from quillspan.operators.ordinary import ORDINARY
from quillspan.operators.rules import Rule
from quillspan.session import cut

# What a run reads of the blocks.
COLUMNS = ("document_id", "block_ord", "block_id", "text", "extraction_method", "kind", "page_number", "slide_number", "table_number", "row_number", "column_number")


class GateRefused(RuntimeError):
    """Raised where text of documents that are not approved is asked for."""


@dataclass
class Result:
    """The tables of a run."""

    entities: DataFrame
    values: DataFrame
    tokens: DataFrame
    sanitized: DataFrame
    residuals: DataFrame
    gate: DataFrame

    def payload(self, strict: bool = False) -> DataFrame:
        """Texts of approved documents; with ``strict`` a document that is not approved raises."""
        if strict and self.gate.filter("status <> 'APPROVED'").head(1):
            raise GateRefused("some documents are not approved")
        return redact.payload(self.sanitized).join(self.gate.filter("status = 'APPROVED'").select("document_id"), "document_id", "left_semi")


@dataclass
class Found:
    """What detection gives: merged entities, and the people of every document and scope."""

    entities: DataFrame
    people: DataFrame
    scope_people: DataFrame | None = None


def find(blocks: DataFrame, rules: Sequence[Rule] = ALL_RULES, extra: DataFrame | None = None, ordinary: tuple[str, ...] = ORDINARY) -> Found:
    """Detection over ``blocks`` (with ``COLUMNS``): rules, table headers, roles, split country
    codes, then the registry of people of each document and its sweep. ``extra`` are detections
    from elsewhere (a name model): its single words are kept as names only if the registry knows
    them, and no place is kept where the sweep has a name."""
    b = blocks.filter(F.col("text").rlike(r"\S"))
    found = raw_spans(b, rules)
    if extra is not None:
        found = found.unionByName(extra.select(*found.columns))
    found = cut(found)  # cut often: the plans are large, and the driver holds them
    found = found.unionByName(cut(context.header_phones(b).unionByName(context.header_personnel(b)).unionByName(context.role_names(b, ordinary)))).unionByName(cut(context.split_country_codes(b, found)))
    texts = b.select("document_id", "block_id", "block_ord", "text", F.col("document_id").alias("scope_id"))
    people = cut(registry.build(texts, found, ordinary))
    swept = cut(registry.sweep(texts, people))
    if extra is not None:
        place = ["document_id", "block_id", "span_start", "span_end"]
        single = (F.col("entity_type") == "PERSON") & F.col("detector").startswith("presidio") & registry.single_token(F.col("v"))
        valued = found.join(texts.select("document_id", "block_id", "text"), ["document_id", "block_id"]).withColumn("v", F.expr("substring(text, span_start + 1, span_end - span_start)")).filter(single).select(*place, "detector", "v")
        asked = valued.select("document_id", F.col("document_id").alias("scope_id"), F.col("v").alias("block_id"), F.col("v").alias("text")).distinct()
        known = registry.sweep(asked, people).select("document_id", F.col("block_id").alias("v"))
        unknown = valued.join(known, ["document_id", "v"], "left_anti").select(*place, "detector", F.lit("PERSON").alias("entity_type"))
        found = found.join(unknown, [*place, "detector", "entity_type"], "left_anti")
        found = found.join(swept.select(*place, F.lit("LOCATION").alias("entity_type")), [*place, "entity_type"], "left_anti")
    return Found(cut(merge_entities(found.unionByName(swept))), people)


def found(blocks: DataFrame, files: DataFrame, rules: Sequence[Rule] = ALL_RULES, extra: DataFrame | None = None, ordinary: tuple[str, ...] = ORDINARY) -> Found:
    """``find``, and the people of a scope's other documents, swept for by full names."""
    own = find(blocks, rules, extra, ordinary)
    people = cut(registry.of_scopes(own.people, files))
    scoped = files.select("document_id", "scope_id").distinct()
    others = cut(registry.sweep(blocks.select("document_id", "block_id", "text").join(scoped, "document_id"), people, single_words=False))
    return Found(cut(merge_entities(own.entities.unionByName(others))), own.people, people)


def run(blocks: DataFrame, files: DataFrame, rules: Sequence[Rule] = ALL_RULES, passes: int = 1, extra: DataFrame | None = None, ordinary: tuple[str, ...] = ORDINARY) -> Result:
    """One run over all documents. ``extra`` are detections from elsewhere (a name model), merged
    with the run's own. A person of a scope has one token, however the name is written. With ``passes`` the residuals of a pass are redacted in the next; a
    document in which an independent check ever found something stays blocked."""
    own = found(blocks, files, rules, extra, ordinary)
    scoped = files.select("document_id", "scope_id").distinct()
    values = cut(registry.resolved(redact.values(own.entities, blocks, files), own.scope_people))
    issued = cut(redact.tokens(values))
    clean = cut(redact.sanitized(blocks, values, issued))
    places = blocks.drop("text", "block_ord")
    sticky = None
    for n in range(passes):
        text = clean.join(places, ["document_id", "block_id"]).join(scoped, "document_id")
        plain = text.withColumnRenamed("sanitized", "text")
        headed = text.join(gate.column_headers(plain).select("document_id", "block_id", "header"), ["document_id", "block_id"], "left")
        named = cut(registry.sweep(plain.withColumn("scope_id", F.col("document_id")), own.people))
        checked = cut(gate.residuals(headed, issued, header="header", named=named))
        again = find(plain, rules, ordinary=ordinary).entities.filter(f"confidence >= {gate.MIN_CONFIDENCE}")
        again = gate.outside(again, text, issued).filter(~((F.col("entity_type") == "LOCATION") & gate.known_by_models_alone(F.col("detector"))))
        left = cut(merge_entities(checked.unionByName(again)))
        hit = left.filter(F.col("detector").contains("gate:")).select("document_id").distinct()
        sticky = hit if sticky is None else sticky.union(hit).distinct()
        if n + 1 < passes:
            more = cut(registry.resolved(redact.values(left, clean.withColumnRenamed("sanitized", "text"), files), own.scope_people))
            issued = cut(issued.unionByName(redact.tokens(more, issued)))
            clean = cut(redact.sanitized(clean.withColumnRenamed("sanitized", "text"), more, issued))
    doubtful = cut(gate.outside(context.image_names(plain, ordinary), text, issued))
    decision = gate.decide(files, left, doubtful)
    if passes > 1:
        s = sticky.withColumn("sticky", F.lit(True))
        decision = decision.join(s, "document_id", "left").withColumn("status", F.when(F.col("sticky"), "BLOCKED").otherwise(F.col("status"))).drop("sticky")
    return Result(own.entities, values, issued, clean, left, decision)


def summary(result: Result | Found) -> DataFrame:
    """Detections by type and tier."""
    e = result.entities
    return e.groupBy("entity_type", risk(F.col("entity_type")).alias("risk_level")).agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


def reports(result: Result, blocks: DataFrame) -> DataFrame:
    return audit.report(result.entities, blocks, result.gate)
