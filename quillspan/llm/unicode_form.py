"""One consistent form for text that looks the same but differs in its characters.

Texts with nothing but plain ASCII pass as they are. The others are exploded into positioned
words and, where a word holds something else, into positioned code points; a broadcast table of
Unicode's decompositions, combining classes, invisible characters and look-alike letters is
joined to them; combining marks are ordered by class, composed again, and the strings rebuilt.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.session import cut

# Letters of other scripts that read as Latin letters. The first two are taken for
# Latin even if a whole word consists of them, the third only inside words with Latin letters.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ", "ABESIJKMHOPCTYXaesijopcyxdhqw"))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"))
_ONLY_IN_LATIN_WORDS = {
    **dict(zip("αγικρυχкмнтвգօսոհɑɡ", "ayikpuxkmhtbqounhag")),
    **dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏂᏃᏏᏒᏙᏚᏞᏟᏢᏦᏴ", "DRTiAJEWMHGhZbRVSLCPKB")),  # Cherokee
    **dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "HIKMNOPCTYXopc")),  # Coptic
    **dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")),  # Lisu
    **dict(zip("ոսցհյօԼՏ", "nughjoLS")),  # Armenian
}
#: Compatibility forms that stand for the same letter, digit or space; raised, circled, squared
#: and fraction forms mean something else and stay.
_SAME = ("<font>", "<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
_HYPHENS = "‐‑﹣－⁃"
_FILLERS = (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0))
_KEPT_FORMATS = (*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)
_JOINERS = (0x200C, 0x200D, 0x200E, 0x200F)
_AFTER_SIGNS = (*range(0xFE00, 0xFE10), *range(0xE0020, 0xE0080))

_SPACES = r"  -   　  "
#: Words that hold something beyond ASCII, single unusual spaces, and all that stands between.
_RUNS = rf"(?s)[0-9A-Za-z]*[^\x00-\x7F{_SPACES}][0-9A-Za-z[^\x00-\x7F{_SPACES}]]*|[{_SPACES}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|(?:(?![0-9A-Za-z]*[^\x00-\x7F{_SPACES}])[0-9A-Za-z]+|[^0-9A-Za-z{_SPACES}\x00-\x08\x0B\x0C\x0E-\x1F\x7F&&[\x00-\x7F]])+"
_SPECIAL = r"[^\x00-\x7F]|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def _decomposed(ch: str) -> str:
    """Full decomposition through canonical and same-letter compatibility steps."""
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    tag, *rest = d.split() if d[0] == "<" else ("", *d.split())
    letters = "".join(chr(int(x, 16)) for x in rest)
    same = tag == "" or tag in _SAME or (tag == "<compat>" and (letters == " " or ch == "ſ" or "ﬀ" <= ch <= "ﬗ" or "Ⅰ" <= ch <= "ⅿ" or "ﾠ" <= ch <= "ￜ"))
    return "".join(_decomposed(c) for c in letters) if same else ch


def _kind(ch: str) -> str:
    cat, name = unicodedata.category(ch), unicodedata.name(ch, "")
    if cat[0] == "L":
        return "L" if "LATIN" in name else "G" if name.startswith(("GREEK", "CYRILLIC", "COPTIC")) else "X"
    return {"N": "N", "M": "M", "P": "P", "Z": "Z"}.get(cat[0], "X")


@cache
def _rows() -> tuple[list[tuple], dict[str, str]]:
    pairs: dict[str, str] = {}
    for cp in range(0xA0, sys.maxunicode + 1):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (chr(int(x, 16)) for x in d.split())
            pairs[a + b] = ch
    seconds = {p[1:] for p in pairs} | {chr(c) for c in range(0x1161, 0x1176)} | {chr(c) for c in range(0x11A8, 0x11C3)}
    rows = []
    for cp in [*range(0x00, 0x20), *range(0x7F, 0x2FA20), *range(0xE0000, 0xE01F0)]:
        ch = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or ch in "\t\n\r":
            continue
        cat, parts, look, loose, gone = unicodedata.category(ch), _decomposed(ch), None, False, None
        if ch in _HYPHENS:
            parts = "-"
        elif cat == "Zs":
            parts = " "
        elif cp in (0x2028, 0x2029, 0x85):
            parts = "\n"
        elif cp in _JOINERS:
            gone = "between"
        elif cp in _AFTER_SIGNS:
            gone = "after"
        elif cp in _FILLERS or (cat == "Cf" and cp not in _KEPT_FORMATS) or 0xE0100 <= cp <= 0xE01EF:
            gone = "always"
        plain = parts if len(parts) == 1 else ""
        for table, is_loose in ((_CYRILLIC, False), (_GREEK, False), (_ONLY_IN_LATIN_WORDS, True)):
            if plain in table:
                look, loose = table[plain], is_loose
        ccc = unicodedata.combining(ch)
        if parts == ch and not (look or gone or ccc or ch in seconds):
            continue
        first = unicodedata.category(parts[0])[0]
        counts = gone is not None or (parts != ch and (first in "LNM" or parts in "- "))
        rows.append((ch, [(c, unicodedata.combining(c), c in seconds) for c in parts], _kind(parts[0]), look, loose, gone, counts))
    return rows, pairs


_SCHEMA = "ch string, parts array<struct<c:string,ccc:int,second:boolean>>, kind string, look string, loose boolean, gone string, counts boolean"


def character_table(spark: SparkSession) -> DataFrame:
    """Decomposition, class and look-alike of every character that is not already in the usual
    form: some 12,000 rows, as many as Unicode has, whatever the data."""
    return spark.createDataFrame(_rows()[0], _SCHEMA)


def map_literal(entries: dict[str, str]) -> Column:
    """A constant map column; the optimizer folds it into one literal."""
    keys, values = ("\x1f".join(x) for x in (entries.keys(), entries.values()))
    return F.map_from_arrays(F.split(F.lit(keys), "\x1f"), F.split(F.lit(values), "\x1f"))


def _compose(parts: Column) -> Column:
    """Marks ordered by class behind their letter, then composed: one string."""
    pairs = map_literal({k: v for k, v in _rows()[1].items() if not "가" <= v <= "힣"})

    def code(c: Column) -> Column:
        return F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")

    def char(n: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")

    def hangul(a: Column, b: Column) -> Column:
        x, y = code(a), code(b)
        return F.when(a.between("ᄀ", "ᄒ") & b.between("ᅡ", "ᅵ"), char(F.lit(0xAC00) + ((x - 0x1100) * 21 + (y - 0x1161)) * 28)).when(
            a.between("가", "힣") & b.between("ᆨ", "ᇂ") & ((x - 0xAC00) % 28 == 0), char(x + y - 0x11A7)
        )

    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("string").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(s: Column, p: Column) -> Column:
        free = p["second"] & s["base"].isNotNull() & F.when(s["rest"] == "", True).otherwise((s["last"] < p["ccc"]) & (p["ccc"] > 0))
        whole = F.when(free, F.coalesce(pairs[F.concat(s["base"], p["c"])], hangul(s["base"], p["c"])))
        return F.when(
            whole.isNotNull(), F.struct(s["out"].alias("out"), whole.alias("base"), s["rest"].alias("rest"), s["last"].alias("last"))
        ).when(
            p["ccc"] == 0, F.struct(F.concat(s["out"], F.coalesce(s["base"], F.lit("")), s["rest"]).alias("out"), p["c"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
        ).otherwise(F.struct(s["out"].alias("out"), s["base"].alias("base"), F.concat(s["rest"], p["c"]).alias("rest"), p["ccc"].alias("last")))

    return F.aggregate(parts, start, step, lambda s: F.concat(s["out"], F.coalesce(s["base"], F.lit("")), s["rest"]))


def _ordered(parts: Column) -> Column:
    """Combining marks in the order of their classes, letters where they stand."""
    numbered = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<g:int,ccc:int,i:int,c:string,second:boolean>>").alias("a")),
        lambda s, p: F.struct(
            (s["n"] + F.when(p["ccc"] == 0, 1).otherwise(0)).alias("n"),
            F.concat(s["a"], F.array(F.struct((s["n"] + F.when(p["ccc"] == 0, 1).otherwise(0)).alias("g"), p["ccc"].alias("ccc"), F.size(s["a"]).alias("i"), p["c"].alias("c"), p["second"].alias("second")))).alias("a"),
        ),
        lambda s: s["a"],
    )
    return F.when(F.exists(parts, lambda p: p["ccc"] > 0), F.array_sort(numbered)).otherwise(
        F.transform(parts, lambda p, i: F.struct(i.alias("g"), p["ccc"].alias("ccc"), i.alias("i"), p["c"].alias("c"), p["second"].alias("second")))
    )


def unusual_texts(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """The distinct rows of (keys, text) with a character outside plain ASCII: ``k`` (struct of the
    keys), ``h`` (hash of the text; the text itself would travel with every code point),
    ``clean`` (its usual form) and ``is_case`` (a letter, digit, hyphen or space of it was not
    stored as its usual character, or it held something invisible)."""
    spark = df.sparkSession
    rows = df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("k"), F.col(f"`{text}`").alias("t")).filter(F.col("t").rlike(_SPECIAL))
    # the exchange of the distinct texts serves both groupings below: code points stay where they arise
    rows = rows.withColumn("h", F.xxhash64("t")).dropDuplicates(["k", "h"])
    runs = rows.select("k", "h", F.posexplode(F.regexp_extract_all("t", F.lit(_RUNS), 0)).alias("run", "word"))
    odd = F.col("word").rlike(_SPECIAL)
    points = runs.select("k", "h", "run", odd.alias("odd"), F.posexplode(F.when(odd, F.regexp_extract_all("word", F.lit("(?s)."), 0)).otherwise(F.array("word"))).alias("at", "ch"))
    points = points.join(F.broadcast(character_table(spark)), "ch", "left")
    default_kind = (
        F.when(~F.col("odd"), "P").when(F.col("ch").rlike(r"^\p{IsLatin}"), "L").when(F.col("ch").rlike(r"^[\p{IsGreek}\p{IsCyrillic}]"), "G")
        .when(F.col("ch").rlike(r"^\p{N}"), "N").when(F.col("ch").rlike(r"^[\p{P}\p{Z}]"), "P").otherwise("X")
    )
    own = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"), F.lit(False).alias("second")))
    point = F.struct(
        "at", "ch", F.coalesce("parts", own).alias("parts"), F.coalesce("kind", default_kind).alias("kind"), "look",
        F.coalesce("loose", F.lit(False)).alias("loose"), F.coalesce("gone", F.lit("")).alias("gone"), F.coalesce("counts", F.lit(False)).alias("counts"),
    )
    words = points.groupBy("k", "h", "run").agg(F.max("odd").alias("odd"), F.array_sort(F.collect_list(point)).alias("p"))

    sign = lambda i: F.coalesce(F.get("p", i)["kind"], F.lit("P")).isin("X", "M")
    kept = F.filter("p", lambda x, i: ~((x["gone"] == "always") | ((x["gone"] == "between") & ~(sign(i - 1) & sign(i + 1))) | ((x["gone"] == "after") & ~sign(i - 1))))
    words = words.withColumn("kept", F.when(F.col("odd"), kept).otherwise(F.col("p")))
    count = lambda test: F.size(F.filter("kept", test))
    words = (
        words.withColumn("latin", count(lambda x: x["kind"] == "L"))
        .withColumn("foreign", count(lambda x: (x["kind"] == "G") & x["look"].isNull()))
        .withColumn("alike", count(lambda x: x["look"].isNotNull()))
        .withColumn("loosely", count(lambda x: x["look"].isNotNull() & x["loose"]))
    )
    in_latin = (F.col("latin") > 0) & (F.col("latin") + F.col("alike") - F.col("loosely") > F.col("foreign"))
    alone = (F.col("latin") == 0) & (F.col("foreign") == 0) & (F.col("loosely") == 0)

    def rebuilt(with_looks: Column) -> Column:
        parts = F.flatten(F.transform("kept", lambda x: F.when(with_looks & x["look"].isNotNull(), F.array(F.struct(x["look"].alias("c"), F.lit(0).alias("ccc"), F.lit(False).alias("second")))).otherwise(x["parts"])))
        return F.when(F.col("odd"), _compose(_ordered(parts))).otherwise(F.get("kept", F.lit(0))["ch"])

    words = words.select(
        "k", "h", "run", "foreign",
        F.when((F.col("alike") > 0) & in_latin, "latin").when((F.col("alike") > 0) & alone, "alone").otherwise("").alias("how"),
        rebuilt((F.col("alike") > 0) & (in_latin | alone)).alias("mapped"),
        F.when((F.col("alike") > 0) & alone, rebuilt(F.lit(False))).alias("unmapped"),
        # what the word would be if only changes that don't count were made
        F.concat_ws("", F.transform("p", lambda x: F.when(x["counts"] | (F.size(x["parts"]) != 1), x["ch"]).otherwise(x["parts"][0]["c"]))).alias("before"),
        (F.size("kept") != F.size("p")).alias("hidden"),
    )
    word = F.struct("run", "foreign", "how", "mapped", "unmapped", "before", "hidden")
    texts = words.groupBy("k", "h").agg(F.array_sort(F.collect_list(word)).alias("w"))
    # a word all of look-alikes is proper where the word beside it is in that script
    beside = lambda i, step: (F.coalesce(F.get("w", i + 2 * step)["foreign"], F.lit(0)) > 0) & (F.trim(F.coalesce(F.get("w", i + step)["mapped"], F.lit("."))) == "")
    chosen = F.transform("w", lambda x, i: F.struct(
        F.when((x["how"] == "alone") & (beside(i, 1) | beside(i, -1)), x["unmapped"]).otherwise(x["mapped"]).alias("now"), x["before"].alias("before"), x["hidden"].alias("hidden")
    ))
    texts = texts.withColumn("w", chosen)
    return texts.select(
        "k", "h",
        F.concat_ws("", F.transform("w", lambda x: x["now"])).alias("clean"),
        F.exists("w", lambda x: x["hidden"] | (x["now"] != x["before"])).alias("is_case"),
    )


def usual_form(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Every distinct row of (keys, text) with ``clean_text`` and ``is_case``.

    Full-width, mathematical and ligature letters and digits, unusual spaces and hyphens become
    the plain ones; accents are composed; invisible characters go, but for those that emoji and
    scripts outside Latin, Greek and Cyrillic need; look-alike letters become Latin inside Latin
    words and where a whole word consists of them and no word beside it is of their script.
    Quotes, dashes, signs, raised digits, fractions and proper words of other scripts stay.
    Null text gives null and no case, empty text stays empty; repeated rows come out once; other
    columns are left out, whatever their names."""
    base = df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("k"), F.col(f"`{text}`").alias("t"))
    plain = base.filter(F.col("t").isNull() | ~F.col("t").rlike(_SPECIAL)).distinct().select("k", "t", F.col("t").alias("clean"), F.lit(False).alias("is_case"))
    # the odd texts are read once, for the code points and for the join
    odd = cut(base.filter(F.col("t").rlike(_SPECIAL)).distinct())
    done = unusual_texts(odd.select("k.*", F.col("t").alias("_t")) if "_t" not in keys else df, keys, "_t" if "_t" not in keys else text)
    odd = odd.withColumn("h", F.xxhash64("t")).join(done, ["k", "h"]).select("k", "t", "clean", "is_case")
    both = plain.unionByName(odd)
    return both.select(*[F.col("k")[k].alias(k) for k in keys], F.col("t").alias(text), F.col("clean").alias("clean_text"), "is_case")


def look_alikes() -> dict[str, str]:
    """Letters of other scripts that read as Latin ones, for readers that look at words themselves."""
    return {**_CYRILLIC, **_GREEK}
