"""Variant spellings of personal names, linked within a scope.

Surnames live in a metric space (Levenshtein distance). Each scope's space is partitioned around
pivots, and cells that are still large are partitioned again around pivots of their own; by the
triangle inequality a surname is replicated to every cell in which a neighbour within the radius
can be at home, so an exact join inside the cells finds all near pairs, each once. Near surnames with given names that agree make links, the links' components are persons,
and spellings with too little in them (initials, a surname alone) go to the only person of the
scope they can mean.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.unicode_form import map_literal, usual_form
from quillspan.session import cut

#: A cell with more surnames at home is split, around about so many pivots at most; cells that
#: stay too large are split again, so neither bounds the result.
CELL, FAN = 12, 64
#: Nodes that one pass of the local part of the components holds at a time.
NODES = 500_000
#: Surnames of so many letters may be two edits apart where the given names agree.
TWO_SLIPS = 6

# Titles that are no part of a name.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame lord lady rev herr frau monsieur madame mme mlle senor senora sr sra don dona".split())
# Short forms of given names. A form of several names stands with each of them.
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "xander": "alexander", "drew": "andrew", "andy": "andrew", "tony": "anthony", "barb": "barbara", "barbie": "barbara", "babs": "barbara",
    "ben": "benjamin", "benji": "benjamin", "benny": "benjamin", "chris": "christopher", "kit": "christopher", "topher": "christopher", "dan": "daniel", "danny": "daniel", "deb": "deborah", "debbie": "deborah", "debby": "deborah",
    "ed": "edward", "eddie": "edward", "ned": "edward", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "betty": "elizabeth", "betsy": "elizabeth", "libby": "elizabeth",
    "fred": "frederick", "freddie": "frederick", "freddy": "frederick", "greg": "gregory", "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "joe": "joseph", "joey": "joseph", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine", "kat": "katherine",
    "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "marge": "margaret", "greta": "margaret", "matt": "matthew", "matty": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael", "micky": "michael", "mitch": "michael",
    "nick": "nicholas", "nicky": "nicholas", "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "pippa": "philippa", "pip": "philippa", "becky": "rebecca", "becca": "rebecca", "dick": "richard", "rich": "richard", "rick": "richard", "ricky": "richard", "richie": "richard",
    "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert", "bert": "robert", "sam": "samuel", "sammy": "samuel", "steve": "stephen", "stevie": "stephen", "steph": "stephen", "sue": "susanne", "susie": "susanne", "suzy": "susanne", "theo": "theodore", "ted": "theodore", "teddy": "theodore",
    "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vic": "victor", "bill": "william", "will": "william", "billy": "william", "willy": "william", "liam": "william", "jim": "james", "jimmy": "james", "jamie": "james", "jack": "john", "johnny": "john", "tom": "thomas", "tommy": "thomas",
    "dave": "david", "davy": "david", "jerry": "gerald", "ron": "ronald", "don": "donald", "ken": "kenneth", "larry": "lawrence", "len": "leonard", "ray": "raymond", "tim": "timothy", "phil": "philip", "pete": "peter", "hank": "henry", "harry": "henry", "chuck": "charles", "charlie": "charles",
    "abby": "abigail", "cindy": "cynthia", "mandy": "amanda", "nan": "nancy", "sally": "sarah", "jess": "jessica", "gabe": "gabriel", "nate": "nathaniel", "zach": "zachary", "josh": "joshua", "max": "maximilian", "hans": "johannes", "fritz": "friedrich", "paco": "francisco", "pepe": "jose",
}
_OTHER_LETTERS = str.maketrans({"ø": "o", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"})
_TOKEN = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, without accents."""
    t = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in t if not unicodedata.combining(c)).translate(_OTHER_LETTERS)


def readings(text: str | None) -> list[tuple[str, str, str, str]]:
    """What a written name can mean, the likeliest first: (family, given, given's initial,
    family's initial), with empty strings for what is not said. Titles and middle names drop out."""
    if not text:
        return []
    t = re.sub(r"(?<=\w)\s*[-‐‑–]\s*(?=\w)", "", re.sub(r"['’`´]", "", fold(text)))
    parts = [[w for w in _TOKEN.findall(p) if w not in TITLES] for p in t.split(",", 1)]
    if len(parts) == 2 and parts[0] and parts[1]:
        family, (first, *_) = "".join(parts[0]), parts[1]
        out = [(family, first if len(first) > 1 else "", first[0], "")]
        if len(first) > 2 and len(family) > 2:
            out.append((first, family, family[0], ""))
        if len(parts[0]) == 2 and len(first) == 1:
            out.append((parts[0][1], "", first, ""))
        return out
    ws = parts[0] or (parts[1] if len(parts) == 2 else [])
    full = [w for w in ws if len(w) > 1]
    if not full:
        return []
    if len(ws) == 1:
        return [(ws[0], "", "", ""), ("", ws[0], ws[0][0], "")]
    if len(full) == 1:
        at = ws.index(full[0])
        if at:  # initials before the surname
            return [(full[0], "", ws[0], "")]
        return [("", full[0], full[0][0], ws[-1]), (full[0], "", ws[1], "")]
    if len(full) == 2:
        a, b = full
        if len(ws[-1]) == 1:  # surname first, then given name and a middle initial
            return [(a, b, b[0], ""), (b, a, a[0], "")]
        return [(b, a, a[0], ""), (a, b, b[0], "")]
    a, *mid, z = full
    whole = "".join(full[1:])
    return [(whole, a, a[0], ""), (z, a, a[0], ""), ("".join(full[:-1]), z, z[0], ""), (a, z, z[0], "")]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("family", "given", "gi", "fi")])))
def _readings(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("family", "given", "gi", "fi"), r)) for r in readings(t)])


def one_slip(a: Column, b: Column) -> Column:
    """At most one letter exchanged, left out, added, or two neighbours swapped."""
    swapped = F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & swapped)


def metric_cells(df: DataFrame, group: str, value: str, radius: int) -> DataFrame:
    """The distinct values of each group in cells: ``g``, ``cell``, ``v``, ``home`` and ``d``, the
    distances to the pivots around which the cell's surroundings were split last.

    A value is at home in the cell of its nearest pivot, and stands as a copy in every other cell
    whose pivot is at most 2 * ``radius`` further away: if b is at home with pivot p and a is within
    the radius of b, d(a, p) <= r + d(b, p) <= r + d(b, q) <= 2r + d(a, q) for every other pivot q.
    The same holds when a cell is split again, so cells are split until each is home to at most
    ``CELL`` values. Two pivots at least split a cell, each its own home, so this ends."""
    rows = cut(df.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("g is not null and v is not null").distinct().select("g", F.lit("").alias("cell"), "v", F.lit(True).alias("home"), F.array().cast("array<int>").alias("d")))
    level = 0
    while True:
        h = F.xxhash64("v", F.lit(level))
        large = rows.filter("home").groupBy("g", "cell").agg(F.count("*").alias("n"), F.min_by("v", h).alias("one"), F.max_by("v", h).alias("other")).filter(F.col("n") > CELL)
        if not large.head(1):
            return rows
        wanted = F.least(F.lit(FAN), F.ceil(F.col("n") / F.lit(max(1, CELL // 4))))
        sampled = rows.filter("home").join(large, ["g", "cell"]).filter(F.pmod(h, F.greatest(F.lit(1), F.floor(F.col("n") / wanted))) == 0).groupBy("g", "cell").agg(F.collect_set("v").alias("more"))
        pivots = large.join(sampled, ["g", "cell"], "left").select("g", "cell", F.array_sort(F.array_union(F.array("one", "other"), F.coalesce("more", F.array().cast("array<string>")))).alias("pivots"))
        far = rows.join(pivots, ["g", "cell"]).withColumn("d", F.transform("pivots", lambda p: F.levenshtein("v", p))).withColumn("least", F.array_min("d"))
        near = far.select("g", "cell", "v", "home", "d", "least", F.array_position("d", F.col("least")).cast("int").alias("nearest"), F.posexplode("d").alias("i", "di")).filter(F.col("di") <= F.col("least") + 2 * radius)
        split = near.select("g", F.concat_ws(".", "cell", F.col("i").cast("string")).alias("cell"), "v", (F.col("home") & (F.col("i") + 1 == F.col("nearest"))).alias("home"), "d")
        rows = cut(rows.join(large.select("g", "cell"), ["g", "cell"], "left_anti").unionByName(split))
        level += 1


def _may_be_near(a: Column, b: Column, radius: int) -> Column:
    """What the triangle inequality leaves: distances to the same pivots differ by the radius at
    most, and so do lengths."""
    return (F.abs(F.length(a["v"]) - F.length(b["v"])) <= radius) & ~F.exists(F.zip_with(a["d"], b["d"], lambda x, y: F.abs(x - y) > radius), lambda x: x)


def radius_join(df: DataFrame, group: str, value: str, radius: int) -> DataFrame:
    """All ordered pairs (``group``, ``a``, ``b``) of distinct values of one group within
    ``radius`` edits, each value with itself included, by metric-space partitioning. Nulls take no
    part."""
    cells = metric_cells(df, group, value, radius)
    homes = cells.filter("home").groupBy("g", "cell").agg(F.collect_list(F.struct("v", "d")).alias("members"))  # at most CELL
    me = F.struct("v", "d")
    near = F.filter("members", lambda m: _may_be_near(me, m, radius) & (F.levenshtein(F.col("v"), m["v"], radius) >= 0))
    found = cells.join(homes, ["g", "cell"]).select("g", "v", F.explode(near).alias("m"))
    return found.select(F.col("g").alias(group), F.col("v").alias("a"), F.col("m.v").alias("b"))


def join_counts(df: DataFrame, group: str, value: str, radius: int = 2) -> DataFrame:
    """How the partitioning of each group works out: ``group``, its values, cells, copies beside
    the homes, pairs met in cells, pairs left to the edit distance, and pairs found."""
    cells = cut(metric_cells(df, group, value, radius))
    homes = cells.filter("home").groupBy("g", "cell").agg(F.collect_list(F.struct("v", "d")).alias("members"))
    me = F.struct("v", "d")
    left = F.filter("members", lambda m: _may_be_near(me, m, radius))
    met = cells.join(homes, ["g", "cell"]).select("g", "cell", "home", F.size("members").alias("met"), F.size(left).alias("measured"), F.size(F.filter(left, lambda m: F.levenshtein(F.col("v"), m["v"], radius) >= 0)).alias("found"))
    return met.groupBy(F.col("g").alias(group)).agg(F.sum(F.col("home").cast("int")).alias("values"), F.countDistinct("cell").alias("cells"), F.sum((~F.col("home")).cast("int")).alias("copies"), F.sum("met").alias("met"), F.sum("measured").alias("measured"), F.sum("found").alias("found"))


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of one partition as edges to the least node reached: the same components with fewer
    and shorter paths. Beyond ``NODES`` nodes it starts anew, which only costs edges."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def drawn() -> pd.DataFrame:
        return pd.DataFrame([(x, find(x)) for x in list(root)], columns=["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > NODES:
            yield drawn()
            root.clear()
    yield drawn()


def components(edges: DataFrame, near: str | None = None, rounds: int = 50) -> DataFrame:
    """Connected components of ``a``-``b``: ``node``, ``root`` (the least node). Edges with the same
    ``near`` are contracted side by side first (large groups are split, small ones put together by
    the rebalancing exchange); what is left goes in rounds, each taking the least root among the
    neighbours and then the root's root, cut from its past in the shared folder, until nothing
    changes."""
    placed = edges.hint("rebalance", F.col(near)) if near else edges
    both = cut(placed.select("a", "b").mapInPandas(_stars, "a string, b string").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(rounds):
        step = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r")).join(roots, "node").select("node", "root", F.least("root", "r").alias("new"))
        jump = step.join(roots.select(F.col("node").alias("new"), F.col("root").alias("beyond")), "new", "left")
        after = cut(jump.select("node", F.least("new", F.coalesce("beyond", "new")).alias("root"), (F.least("new", F.coalesce("beyond", "new")) != F.col("root")).alias("moved")))
        roots = after.select("node", "root")
        if not after.filter("moved").head(1):
            return roots
    raise RuntimeError("components did not settle")


def _spelled(given: Column) -> Column:
    """Signatures of which two given names share one if they are equal, a short form and its name,
    or a slip apart: the name itself, its full form, both with one letter left out."""
    full = map_literal(NICKNAMES)
    forms = F.array_distinct(F.array(given, F.coalesce(full[given], given)))
    less = lambda s: F.when(F.length(s) >= 4, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, less))))


def _agree(a: Column, b: Column) -> Column:
    full = map_literal(NICKNAMES)
    fa, fb = F.coalesce(full[a], a), F.coalesce(full[b], b)
    # both short forms may stand for several names; a slip is one in names of four letters or more
    return (a == b) | (fa == fb) | ((F.length(fa) >= 4) & (F.length(fb) >= 4) & one_slip(fa, fb))


def link_names(mentions: DataFrame, scope: str, key: str, name: str, radius: int = 2) -> DataFrame:
    """Each mention (distinct ``scope``, ``key``, ``name``) with its ``person``: mentions of one
    scope have the same person when their spellings mean the same one.

    Null and empty names, and names without a word of two letters, are persons of their own;
    mentions without a scope are left out. Repeated rows count once."""
    rows = mentions.select(F.col(scope).alias("scope"), F.col(key).alias("key"), F.col(name).alias("name")).filter("scope is not null").distinct()
    rows = usual_form(rows, ["scope", "key"], "name").withColumn("meant", _readings(F.coalesce("clean_text", F.lit(""))))
    told = F.transform("meant", lambda m: F.concat_ws("/", m["family"], m["given"], m["gi"], m["fi"]))
    rows = cut(rows.withColumn("node", F.concat_ws("|", "scope", F.when(F.size("meant") == 0, F.concat(F.lit("?"), F.col("key").cast("string"))).otherwise(F.concat_ws("+", told)))).select("scope", "key", "name", "node", "meant"))
    nodes = rows.select("scope", "node", "meant").distinct()
    alts = nodes.select("scope", "node", F.posexplode("meant").alias("alt", "m")).select("scope", "node", "alt", "m.family", "m.given", "m.gi", "m.fi")
    near = radius_join(alts.filter(F.length("family") >= 2), "scope", "family", radius)
    near = near.withColumn("close", (F.col("a") == F.col("b")) | ((F.least(F.length("a"), F.length("b")) >= 4) & one_slip(F.col("a"), F.col("b"))))
    wide = cut(near.filter(F.col("close") | (F.least(F.length("a"), F.length("b")) >= TWO_SLIPS)))
    near = wide.filter("close").drop("close")

    strong = alts.filter("family <> '' and given <> ''")
    signed = strong.withColumn("sig", F.explode(_spelled(F.col("given"))))
    left = signed.select("scope", F.col("family").alias("a"), "sig", F.col("node").alias("na"), F.col("given").alias("ga"))
    right = signed.select("scope", F.col("family").alias("b"), "sig", F.col("node").alias("nb"), F.col("given").alias("gb"))
    # surnames further apart count only beside given names that agree
    edges = left.join(wide, ["scope", "a"]).join(right, ["scope", "b", "sig"]).filter((F.col("na") < F.col("nb")) & _agree(F.col("ga"), F.col("gb")))
    roots = components(edges.select("scope", F.col("na").alias("a"), F.col("nb").alias("b")), "scope")
    strong = cut(strong.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))

    # what is known of each person: surnames with given names and their initials
    full = map_literal(NICKNAMES)
    known = strong.select("scope", "root", F.col("family").alias("b"), "given", F.explode(F.array_distinct(F.array("gi", F.substring(F.coalesce(full[F.col("given")], F.col("given")), 1, 1)))).alias("gi"), F.substring("family", 1, 1).alias("fi")).distinct()
    weak = alts.join(strong.select("node").distinct(), "node", "left_anti")

    def only(found: DataFrame) -> DataFrame:
        """The one candidate at the least distance, where there is just one."""
        at = found.groupBy("node", "far").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        best = at.groupBy("node").agg(F.min_by(F.struct("lo", "hi"), "far").alias("x"))
        return best.filter("x.lo = x.hi").select("node", F.col("x.lo").alias("root"))

    by_family = weak.filter("family <> ''").withColumnRenamed("family", "a").join(near, ["scope", "a"])
    far = (F.col("alt") * 10 + F.when(F.col("a") == F.col("b"), 0).otherwise(1)).alias("far")
    initial = by_family.filter("gi <> ''").join(known.select("scope", "b", "gi", "root"), ["scope", "b", "gi"]).select("node", "root", far)
    alone = by_family.filter("gi = ''").join(known.select("scope", "b", "root").distinct(), ["scope", "b"]).select("node", "root", far)
    given = weak.filter("family = ''").withColumn("sig", F.explode(_spelled(F.col("given"))))
    people = known.select("scope", "root", "given", "fi").distinct().withColumn("sig", F.explode(_spelled(F.col("given")))).withColumnRenamed("given", "g")
    by_given = given.join(people.withColumnRenamed("fi", "f"), ["scope", "sig"]).filter(_agree(F.col("given"), F.col("g")) & ((F.col("fi") == "") | (F.col("fi") == F.col("f"))))
    by_given = by_given.select("node", "root", (F.col("alt") * 10 + F.when(F.col("given") == F.col("g"), 0).otherwise(1) + 5).alias("far"))
    placed = cut(only(initial.unionByName(alone).unionByName(by_given).distinct()))

    # no full name to go to: spellings with the same surname and initial belong together, a
    # surname alone to the only such group
    rest = weak.join(placed, "node", "left_anti").filter("family <> ''")
    rest = rest.groupBy("scope", "node").agg(F.min_by(F.struct("family", "gi"), "alt").alias("m")).select("scope", "node", "m.family", "m.gi")
    groups = rest.filter("gi <> ''").select("scope", "family", "gi").distinct().groupBy("scope", "family").agg(F.min("gi").alias("lo"), F.max("gi").alias("hi"))
    taken = strong.select("scope", "family").distinct().withColumn("taken", F.lit(True))
    rest = rest.join(groups, ["scope", "family"], "left").join(taken, ["scope", "family"], "left")
    group = F.when(F.col("gi") != "", F.col("gi")).when((F.col("lo") == F.col("hi")) & F.col("taken").isNull(), F.col("lo")).otherwise("")
    rest = rest.select("node", F.concat_ws("|", F.lit("~"), "scope", "family", group).alias("root"))

    persons = strong.select("node", "root").distinct().unionByName(placed).unionByName(rest)
    return rows.join(persons, "node", "left").select(F.col("scope").alias(scope), F.col("key").alias(key), F.col("name").alias(name), F.coalesce("root", "node").alias("person"))


def mention_pairs(linked: DataFrame, scope: str, key: str) -> DataFrame:
    """Pairs of different keys with the same person, the smaller key first."""
    m = linked.select(F.col(scope).alias("s"), F.col("person").alias("p"), F.col(key).alias("k")).distinct()
    return m.alias("x").join(m.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.k") < F.col("y.k"))).select(F.col("x.k").alias("mention_a"), F.col("y.k").alias("mention_b")).distinct()


def name_mentions(people: DataFrame, label_rows: DataFrame, source_files: DataFrame) -> DataFrame:
    """The PERSON records of both tables as (scope_id, mention, name); redelivered rows once."""
    known = people.select("scope_id", F.col("person_id").alias("mention"), F.concat_ws(" ", F.concat("last_name", F.lit(",")), F.coalesce("first_name", "name_initial"), F.array_join("middles", " ")).alias("name"))
    files = source_files.select("file_name", "scope_id").distinct()
    labels = label_rows.filter(F.upper(F.trim("entity_type")) == "PERSON").select("file_name", F.col("row_id").alias("mention"), F.col("value_text").alias("name"))
    return known.unionByName(labels.join(files, "file_name").select("scope_id", "mention", "name")).distinct()
