"""Repair of text from scanned pages.

Running headers and page numbers are found at the edges of pages, by lines that come again on
other pages of the file, also slightly damaged, and by numbers that run along with the pages.
Words broken at hyphens are joined and misread words mended where the vocabulary of the whole
corpus says so. Verdicts are made once per distinct spelling and joined back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.session import cut
from quillspan.sources.tables import SCANS

#: Share of the pages of a file on which a running line stands at least, and pages it needs.
HEADER_SHARE, NUMBER_SHARE, PAGES = 0.12, 0.25, 2
#: Lines at the top and at the foot of a page that may be running headers or page numbers.
EDGE_LINES = 2
#: How much more frequent the mended spelling must be.
TIMES, LEAST = 8, 3

# What is read instead of what: (seen, meant).
MISREADINGS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("6", "g"), ("8", "b"), ("@", "a"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("$", "s"),
    ("c", "e"), ("f", "t"), ("b", "h"), ("cl", "d"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("m", "in"), ("h", "b"), ("e", "c"), ("t", "f"), ("i", "l"), ("l", "i"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("li", "h"), ("n", "u"), ("u", "n"), ("y", "v"), ("v", "y"),
)
# Words that go with a page number.
_PAGE_WORDS = frozenset("page pages p pp pg of sheet folio fol seite s von blatt página pagina pág pag hoja de feuille no nr vol".split())
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_PIECE = re.compile(r"[^\W\d_]+|\d+")

_WORD = r"[\p{L}\p{N}]+(?:[@!|$][\p{L}\p{N}]+)*"
_MAIL = r"\S+@\S+\.\S+"
_BREAK = r"(?<![\p{N}@._+])(?<!\p{L})([\p{L}\p{N}@!]*\p{L})[-¬]\s+(\p{L}+)(?![\p{L}@_+]|\.\p{L})"
_TAIL = r"(?<![\p{L}\p{N}@._+])([\p{L}\p{N}@!]*\p{L})[-¬]\s*$"


def _fold_line(text: str) -> str:
    """Letters of a line in a form that the usual misreadings do not change."""
    t = text.lower()
    for a, b in (("rn", "m"), ("in", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w")):
        t = t.replace(a, b)
    return re.sub(r"[\W\d_]+", "", t.translate(str.maketrans("01!|i5$@cbf9", "lllllssaehtg")))


def _roman(word: str) -> int | None:
    if not word or not _ROMAN.fullmatch(word):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    nums = [value[c] for c in word]
    return sum(-n if n < m else n for n, m in zip(nums, [*nums[1:], 0]))


def edge_line(line: str) -> tuple[str, list[int], bool, bool]:
    """Of a line at the edge of a page: the folded words beside page words and numbers, the
    numbers in it, whether it is nothing but a number with page words, and whether it could be
    nothing else than a page number."""
    low = line.lower().strip()
    mended = re.sub(r"(?<=[a-z])[0159@!](?=[a-z])", lambda m: "olsgai"["0159@!".index(m.group())], low)
    mended = re.sub(r"(?<=\d)[lo]|\b[lo](?=\d)", lambda m: "1" if m.group() == "l" else "0", mended)
    pieces = _PIECE.findall(mended)
    nums = [int(p) for p in pieces if p.isdigit() and len(p) <= 5]
    words = [p for p in pieces if not p.isdigit()]
    rest = [w for w in words if w not in _PAGE_WORDS]
    labelled = len(rest) < len(words)
    if not nums and len(rest) == 1 and (r := _roman(rest[0])):
        return "", [r], True, len(words) == 1 and rest[0] not in ("i", "mix")
    bare = bool(nums) and (not rest or (len(rest) == 1 and len(rest[0]) <= 2))
    marked = bool(re.fullmatch(r"[-–—\[(|•.\s]+\d{1,4}[-–—\])|•.\s]+|\d{1,4}\s*/\s*\d{1,4}|[a-z]-\d{1,4}", mended))
    return _fold_line(" ".join(rest)), nums, bare, bare and (labelled or marked)


def _edge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [edge_line(t) for t in b["line"]]
        yield b.drop(columns="line").assign(key=[g[0] for g in got], nums=[g[1] for g in got], bare=[g[2] for g in got], sure=[g[3] for g in got])


def page_marks(scans: DataFrame) -> DataFrame:
    """Lines that are running headers or page numbers: document_id, block_id, line_no (from 0),
    is_header, is_number. Blocks without a page have no edges."""
    lines = scans.filter("extraction_method = 'ocr' and page_number is not null").select("document_id", "page_number", "block_ord", "block_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    page = Window.partitionBy("document_id", "page_number")
    edges = lines.withColumn("top", F.row_number().over(page.orderBy("block_ord", "block_id", "line_no"))).withColumn("end", F.row_number().over(page.orderBy(F.desc("block_ord"), F.desc("block_id"), F.desc("line_no"))))
    edges = edges.filter(f"top <= {EDGE_LINES} or end <= {EDGE_LINES}").select("document_id", "page_number", "block_id", "line_no", "line")
    edges = cut(edges.mapInPandas(_edge_rows, "document_id string, page_number int, block_id string, line_no int, key string, nums array<int>, bare boolean, sure boolean"))
    pages = scans.filter("extraction_method = 'ocr' and page_number is not null").select("document_id", "page_number").distinct().groupBy("document_id").agg(F.count("*").alias("pages"))

    keys = edges.filter("length(key) >= 4").select("document_id", "key", "page_number").distinct().groupBy("document_id", "key").agg(F.count("*").alias("n"))
    keys = keys.join(pages, "document_id")
    often = keys.filter((F.col("n") >= PAGES) & (F.col("n") >= HEADER_SHARE * F.col("pages"))).select("document_id", F.col("key").alias("header"), F.explode(F.sequence(F.length("key") - 2, F.length("key") + 2)).alias("len"))
    headers = keys.withColumn("len", F.length("key")).join(often, ["document_id", "len"]).filter(F.levenshtein("key", "header") <= F.greatest(F.lit(0), F.least(F.lit(2), (F.length("header") / 6).cast("int")))).select("document_id", "key", F.lit(True).alias("is_header")).distinct()

    runs = edges.select("document_id", "page_number", F.explode("nums").alias("num")).withColumn("offset", F.col("num") - F.col("page_number"))
    runs = runs.select("document_id", "offset", "page_number").distinct().groupBy("document_id", "offset").agg(F.count("*").alias("n")).join(pages, "document_id")
    steady = runs.filter((F.col("n") >= PAGES) & (F.col("n") >= NUMBER_SHARE * F.col("pages"))).groupBy("document_id").agg(F.collect_set("offset").alias("offsets"))  # at most 2 * EDGE_LINES / NUMBER_SHARE values a file and number of a line
    marked = edges.join(headers, ["document_id", "key"], "left").join(steady, "document_id", "left").join(pages, "document_id")
    runs_along = F.coalesce(F.exists("nums", lambda x: F.array_contains("offsets", x - F.col("page_number"))), F.lit(False))
    marked = marked.withColumn("is_header", F.coalesce("is_header", F.lit(False))).withColumn("is_number", (runs_along & (F.col("bare") | F.col("is_header"))) | (F.col("sure") & F.col("offsets").isNull()))
    return marked.filter("is_header or is_number").groupBy("document_id", "block_id", "line_no").agg(F.max("is_header").alias("is_header"), F.max("is_number").alias("is_number"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """Every word and hyphenated compound of all texts (columns text, extraction_method), in lower
    case: word, native (times in text that was not scanned), total. Words broken at a hyphen
    count as joined."""
    native = (~F.coalesce(F.col("extraction_method"), F.lit("")).isin(*SCANS)).cast("int")
    t = F.regexp_replace(F.lower("text"), _MAIL, " ")
    joined = F.regexp_replace(t, r"(?<=\p{L})[-¬]\s+(?=\p{Ll})", "")
    words = F.concat(F.regexp_extract_all(joined, F.lit(_WORD), 0), F.regexp_extract_all(t, F.lit(r"\p{L}+-\p{L}+"), 0))
    return texts.filter("text is not null").select(F.explode(words).alias("word"), native.alias("native")).groupBy("word").agg(F.sum("native").alias("native"), F.count("*").alias("total"))


def respellings(word: str) -> list[str]:
    """What a misread word may have been: one misreading undone, at one place or everywhere."""
    out = []
    for seen, meant in MISREADINGS:
        at = word.find(seen)
        if at < 0:
            continue
        if word.count(seen) > 1:
            out.append(word.replace(seen, meant))
        while at >= 0:
            out.append(word[:at] + meant + word[at + len(seen) :])
            at = word.find(seen, at + 1)
    odd = word.translate(str.maketrans("0159@!|$", "olsgails"))
    if odd != word:
        out.append(odd)
    return list(dict.fromkeys(out))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _respellings(words: pd.Series) -> pd.Series:
    return words.map(respellings)


def misread_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Which of the distinct ``word`` are misread, and as what: word, meant. A word is misread if
    native text never has it, and undoing one misreading gives a word ``TIMES`` as frequent; or
    if a sign or digit stands between its letters."""
    known = vocab.select("word", "native", "total")
    odd = words.join(known, "word").filter((F.col("native") == 0) & (F.length(F.regexp_replace("word", r"[^\p{L}]", "")) >= 2) & (F.length(F.regexp_replace("word", r"[\p{L}@!|$]", "")) <= 2) & (F.length("word") >= 3))
    tries = odd.select("word", "total", F.explode(_respellings("word")).alias("meant"))
    hits = tries.join(known.select(F.col("word").alias("meant"), F.col("native").alias("rn"), F.col("total").alias("rt")), "meant").filter((F.col("rt") >= LEAST) & (F.col("rt") >= TIMES * F.col("total")) & F.col("meant").rlike(r"^\p{L}+$"))
    best = hits.groupBy("word").agg(F.max_by("meant", F.struct("rt", "meant")).alias("meant"))
    inside = odd.filter(F.col("word").rlike(r"^\p{L}{2,}[0159@!|$]\p{L}{2,}$|^\p{L}[0159@!|$]\p{L}{3,}$|^\p{L}{3,}[0159@!|$]\p{L}$")).join(best.select("word"), "word", "left_anti")
    return best.unionByName(inside.select("word", F.translate("word", "0159@!|$", "olsgails").alias("meant")))


def broken_words(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Verdict on distinct (``a``, ``b``) in lower case: ``whole`` if the two are one word broken in
    two, not a compound that keeps its hyphen."""
    asked = pairs.select("a", "b", F.explode(F.array(
        F.struct(F.lit("joined").alias("role"), F.concat("a", "b").alias("word")), F.struct(F.lit("compound").alias("role"), F.concat_ws("-", "a", "b").alias("word")),
        F.struct(F.lit("left").alias("role"), F.col("a").alias("word")), F.struct(F.lit("right").alias("role"), F.col("b").alias("word")),
    )).alias("x")).select("a", "b", "x.role", "x.word")
    n = lambda role, c: F.coalesce(F.max(F.when(F.col("role") == role, F.col(c))), F.lit(0))
    seen = asked.join(vocab, "word", "left").groupBy("a", "b").agg(n("joined", "native").alias("joined"), n("joined", "total").alias("joined_all"), n("compound", "total").alias("compound"), n("left", "native").alias("left"), n("right", "native").alias("right"))
    whole = F.when((F.col("compound") > 0) & (F.col("compound") >= F.col("joined")), False).when(F.col("joined") > 0, True).when((F.col("left") > 0) & (F.col("right") > 0), False).otherwise(True)
    return seen.select("a", "b", whole.alias("whole"), (F.col("joined") > 0).alias("known"))


def _analysed(blocks: DataFrame) -> dict[str, DataFrame]:
    """Tables that both results are made of; the small ones are cut from their past."""
    known = blocks.filter("text is not null")
    scans = known.filter(F.col("extraction_method").isin(*SCANS)).dropDuplicates(["document_id", "block_id"])
    scans = cut(scans.select("document_id", "block_id", "block_ord", "page_number", "extraction_method", "text"))
    vocab = cut(vocabulary(known))
    marks = cut(page_marks(scans))

    gone = marks.groupBy("document_id", "block_id").agg(F.collect_set("line_no").alias("gone"))
    bodies = scans.join(gone, ["document_id", "block_id"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    bodies = bodies.withColumn("body", F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    found = F.arrays_zip(F.regexp_extract_all("body", F.lit(_BREAK), 1).alias("a"), F.regexp_extract_all("body", F.lit(_BREAK), 2).alias("b"))
    inside = bodies.select("document_id", "block_id", F.explode(found).alias("x")).select("document_id", "block_id", "x.a", "x.b", F.lit(None).cast("string").alias("next_id"))

    # a word that goes on in the next block: inside a page by looking ahead, over pages by one row each
    flow = bodies.filter("extraction_method = 'ocr' and trim(body) <> ''").select("document_id", "page_number", "block_ord", "block_id", F.regexp_extract("body", _TAIL, 1).alias("a"), F.struct(F.regexp_extract("body", r"^\s*(\p{L}+)(?![@_+]|\.\p{L})", 1).alias("b"), "block_id").alias("head"))
    page = Window.partitionBy("document_id", "page_number").orderBy("block_ord", "block_id")
    first = flow.groupBy("document_id", "page_number").agg(F.min_by("head", F.struct("block_ord", "block_id")).alias("head"))
    later = first.select("document_id", "page_number", F.lead("head").over(Window.partitionBy("document_id").orderBy("page_number")).alias("later"))
    ahead = flow.withColumn("next", F.lead("head").over(page)).filter("a <> ''").join(later.filter("page_number is not null"), ["document_id", "page_number"], "left").withColumn("next", F.coalesce("next", "later"))
    across = ahead.filter("next.b <> ''").select("document_id", "block_id", "a", F.col("next.b").alias("b"), F.col("next.block_id").alias("next_id"))

    breaks = inside.unionByName(across).withColumn("la", F.lower("a")).withColumn("lb", F.lower("b"))
    verdicts = broken_words(breaks.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), vocab)
    breaks = breaks.join(verdicts.select(F.col("a").alias("la"), F.col("b").alias("lb"), "whole", "known"), ["la", "lb"])
    capital = F.col("b").rlike(r"^\p{Lu}\p{Ll}")
    breaks = cut(breaks.withColumn("whole", F.col("whole") & (F.col("known") | (~capital & F.col("next_id").isNull()) | (F.col("next_id").isNotNull() & F.col("b").rlike(r"^\p{Ll}")))))

    going_on = breaks.filter("next_id is not null and whole").select("document_id", F.col("next_id").alias("block_id"), F.lit(True).alias("goes_on")).distinct()
    t = F.regexp_replace(F.regexp_replace(F.lower("text"), _MAIL, " "), r"(?<=\p{L})[-¬]\s+(?=\p{Ll})", "")
    t = F.regexp_replace(t, r"[\p{L}\p{N}]+[-¬]\s*$", "")
    words = scans.join(going_on, ["document_id", "block_id"], "left").withColumn("t", F.when(F.col("goes_on"), F.regexp_replace(t, r"^\s*\p{L}+", "")).otherwise(t))
    words = words.select("document_id", "block_id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(_WORD), 0))).alias("word"))
    misread = cut(misread_words(words.select("word").distinct(), vocab))
    return {"bodies": bodies, "marks": marks, "breaks": breaks, "misread": words.join(misread, "word"), "words": misread}


def find_defects(blocks: DataFrame) -> DataFrame:
    """One row per scanned block and defect: document_id, block_id, ``defect`` (hyphenation,
    misread, running_header, page_number).

    ``blocks`` are all blocks, scanned or not: the vocabulary comes from every one. Blocks with
    null text or no scan method have no defects; repeated rows count once; an empty table gives
    an empty result."""
    x = _analysed(blocks)
    ids = ["document_id", "block_id"]
    kinds = [
        x["breaks"].filter("whole").select(*ids, F.lit("hyphenation").alias("defect")),
        x["misread"].select(*ids, F.lit("misread").alias("defect")),
        x["marks"].filter("is_header").select(*ids, F.lit("running_header").alias("defect")),
        x["marks"].filter("is_number").select(*ids, F.lit("page_number").alias("defect")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.distinct()


@F.pandas_udf(T.StringType())
def _mend(body: pd.Series, joins: pd.Series, words: pd.Series) -> pd.Series:
    def one(text: str, pairs, fixes) -> str:
        whole = {(p["a"], p["b"]) for p in (pairs if pairs is not None else ())}
        meant = {f["word"]: f["meant"] for f in (fixes if fixes is not None else ())}

        def join(m: re.Match) -> str:
            a, b = m.group(1), m.group(3)
            return a + b if (a, b) in whole else a + "-" + b

        t = re.sub(r"([^\W_]+)([-¬])\s+([^\W\d_]+)", join, text or "")

        def fix(m: re.Match) -> str:
            w = m.group()
            good = meant.get(w.lower())
            return w if good is None else good.upper() if w.isupper() and len(w) > 1 else good.capitalize() if w[0].isupper() else good

        t = re.sub(r"[^\W_]+(?:[@!|$][^\W_]+)*", fix, t)
        return re.sub(r"[ \t]*\n[ \t]*", " ", t).strip()

    return pd.Series([one(*x) for x in zip(body, joins, words)])


def repaired(blocks: DataFrame) -> DataFrame:
    """Every scanned block with text as one continuous paragraph, ``clean_text``: running headers
    and page numbers removed, words at line ends joined, misread words mended. A word that goes
    on in the next block is completed where it begins and left out where it ends."""
    x = _analysed(blocks)
    ids = ["document_id", "block_id"]
    inside = x["breaks"].filter("whole and next_id is null").groupBy(*ids).agg(F.collect_set(F.struct("a", "b")).alias("joins"))
    fixes = x["misread"].groupBy(*ids).agg(F.collect_set(F.struct("word", "meant")).alias("fixes"))
    ends = x["breaks"].filter("whole and next_id is not null")
    begun = ends.groupBy(*ids).agg(F.first("b").alias("rest"))
    ended = ends.select("document_id", F.col("next_id").alias("block_id"), F.col("b").alias("done")).dropDuplicates(ids)
    rows = x["bodies"].join(inside, ids, "left").join(fixes, ids, "left").join(begun, ids, "left").join(ended, ids, "left")
    body = F.when(F.col("rest").isNotNull(), F.concat(F.regexp_replace("body", r"[-¬]\s*$", ""), "rest")).otherwise(F.col("body"))
    rows = rows.withColumn("body", body)
    rows = rows.withColumn("body", F.when(F.col("done").isNotNull(), F.regexp_replace("body", r"^\s*\p{L}+\s*", "")).otherwise(F.col("body")))
    return rows.select(*ids, "block_ord", _mend("body", "joins", "fixes").alias("clean_text"))


def scaled_confidence(c: Column) -> Column:
    """Confidence as a share of one, from shares or percentages; null where it is neither."""
    return F.when(c.isNull() | F.isnan(c) | (c < 0) | (c > 100), None).when(c > 1, c / 100).otherwise(c)


def repaired_figures(figure_lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """The text of every figure as one paragraph from its lines, in order: document_id, block_id,
    figure_no, ``confidence`` (mean over characters, of the lines that have one) and
    ``clean_text``. Redelivered lines count once; null texts are left out."""
    lines = figure_lines.filter("text is not null").groupBy("document_id", "block_id", "page_number", "figure_no", "line_no").agg(F.min("text").alias("text"), F.max(scaled_confidence(F.col("confidence"))).alias("c"))
    weight = F.when(F.col("c").isNotNull(), F.length("text"))
    figures = lines.groupBy("document_id", "block_id", "page_number", "figure_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"), (F.sum(F.col("c") * weight) / F.sum(weight)).alias("confidence"))
    known = blocks.filter("text is not null").select("text", "extraction_method")
    vocab = cut(vocabulary(known))
    ids = ["document_id", "block_id", "figure_no"]
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(_BREAK), 1).alias("a"), F.regexp_extract_all("text", F.lit(_BREAK), 2).alias("b"))
    pairs = figures.select(*ids, F.explode(found).alias("x")).select(*ids, "x.a", "x.b")
    verdicts = broken_words(pairs.select(F.lower("a").alias("a"), F.lower("b").alias("b")).distinct(), vocab).filter("whole").select(F.col("a").alias("la"), F.col("b").alias("lb"))
    joins = pairs.join(verdicts, (F.lower("a") == F.col("la")) & (F.lower("b") == F.col("lb"))).groupBy(*ids).agg(F.collect_set(F.struct("a", "b")).alias("joins"))
    t = F.regexp_replace(F.lower("text"), r"(?<=\p{L})[-¬]\s+(?=\p{Ll})", "")
    words = figures.select(*ids, F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(_WORD), 0))).alias("word"))
    fixes = words.join(misread_words(words.select("word").distinct(), vocab), "word").groupBy(*ids).agg(F.collect_set(F.struct("word", "meant")).alias("fixes"))
    return figures.join(joins, ids, "left").join(fixes, ids, "left").select(*ids, "page_number", "confidence", _mend("text", "joins", "fixes").alias("clean_text"))
