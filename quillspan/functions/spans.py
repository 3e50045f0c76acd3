"""Spans of text on the JVM side: matches with their places, checks of digits, splicing.

All places count characters (code points) from 0, end exclusive. Null text has no spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,v:string>>"


def matches(text: Column, pattern: str, value: int = 0, before: int | None = None, hint: str | None = None) -> Column:
    """All matches of a Java pattern as (s, e, v). With ``before``, the pattern is ``(before)(value)``
    and what counts is the value group behind the other. ``hint`` is a cheap pattern that every
    text with a match has: others skip the real one. The pattern must not match nothing."""
    p = F.lit(pattern)
    whole, gaps = F.regexp_extract_all(text, p, 0), F.split(text, pattern, -1)
    # each array costs a run of the pattern, also one that is named twice
    parts = [gaps.alias("g"), whole.alias("m")] + ([F.regexp_extract_all(text, p, value).alias("v")] if value else []) + ([F.regexp_extract_all(text, p, before).alias("h")] if before else [])
    zipped = F.arrays_zip(*parts)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["g"]) + (F.length(x["h"]) if before else F.lit(0))
        v = x["v"] if value else x["m"]
        found = F.concat(a["out"], F.array(F.struct(s.cast("int").alias("s"), (s + F.length(v)).cast("int").alias("e"), v.alias("v"))))
        return F.when(x["m"].isNull(), a).otherwise(F.struct((a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"), found.alias("out")))

    found = F.aggregate(zipped, start, step, lambda a: a["out"])
    fits = text.rlike(hint) if hint else text.isNotNull()
    return F.when(fits, found).otherwise(F.array().cast(SPAN))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _digit(c: Column, i: Column | int) -> Column:
    return F.substring(c, i if isinstance(i, Column) else F.lit(i), F.lit(1)).try_cast("int")


def luhn_ok(c: Column) -> Column:
    """13 to 19 digits whose Luhn sum ends in 0; separators are ignored."""
    d = digits(c)
    n = F.length(d)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, F.when(_digit(d, i) > 4, _digit(d, i) * 2 - 9).otherwise(_digit(d, i) * 2)).otherwise(_digit(d, i)))
    return n.between(13, 19) & (total % 10 == 0)


# Prefixes (first to last) and lengths of the card schemes.
CARD_SCHEMES = (
    ((("4", "4"),), (13, 16, 19)),
    ((("51", "55"), ("2221", "2720")), (16,)),
    ((("34", "34"), ("37", "37")), (15,)),
    ((("6011", "6011"), ("65", "65"), ("644", "649")), (16, 17, 18, 19)),
    ((("3528", "3589"),), (16, 17, 18, 19)),
    ((("36", "36"), ("38", "39"), ("300", "305")), (14, 15, 16, 17, 18, 19)),
    ((("62", "62"),), (16, 17, 18, 19)),
)


def card_issuer_ok(c: Column) -> Column:
    d = digits(c)
    out = F.lit(False)
    for prefixes, lengths in CARD_SCHEMES:
        for lo, hi in prefixes:
            out = out | (F.length(d).isin(*lengths) & F.substring(d, 1, len(lo)).between(lo, hi))
    return out


def pesel_ok(c: Column) -> Column:
    """11 digits with a right check digit and a month and day that occur."""
    weights = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
    total = sum((_digit(c, i + 1) * w for i, w in enumerate(weights)), F.lit(0))
    month, day = F.substring(c, 3, 2).try_cast("int"), F.substring(c, 5, 2).try_cast("int")
    return (F.length(c) == 11) & ((10 - total % 10) % 10 == _digit(c, 11)) & (month % 20).between(1, 12) & F.floor(month / 20).between(0, 4) & day.between(1, 31)


def splice(text: Column, pieces: Column) -> Column:
    """``text`` with each piece (s, e, token), sorted and apart, replaced by its token."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), x["token"]).alias("out"), x["e"].alias("at"))
    return F.aggregate(pieces, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def in_any(s: Column, e: Column, spans: Column) -> Column:
    """Whether [s, e) lies inside one of the spans."""
    return F.exists(spans, lambda x: (x["s"] <= s) & (e <= x["e"]))
