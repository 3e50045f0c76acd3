"""Subject areas of documents, from class-association rules.

Parallel frequent-pattern growth over the sentences of hand-labelled documents finds which words,
alone and together, speak for which subject: each word's conditional sentences form a group that
grows on its own. Rules that a shorter rule says as well are pruned. Every sentence of every
document is then judged by the summed evidence of the rules it matches, a document by the expected
number of sentences in the stretch of a paragraph most devoted to a subject, with a threshold
calibrated on labelled documents that the rules have not seen.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut, spread

#: Labelled documents to learn from, at most; chosen by the hash of their ids.
LABELLED = 20_000
#: Of these, one in so many is kept back to calibrate on.
KEPT_BACK = 10
#: A rule's words stand together in so many sentences at least, or in so small a share of them; a
#: word alone in so many documents.
RULE_SENTENCES, RULE_SHARE, WORD_DOCUMENTS = 4, 1e-4, 4
#: A body of words this sure of a subject grows no further: no longer rule could say more. What a
#: longer rule must add to every shorter one, in confidence and in standard errors.
SURE, GAIN, ERRORS = 0.98, 0.02, 4.5
#: A sentence of more words than LONG has lost its stops: it is read in pieces of about PIECE words.
LONG, PIECE = 30, 12
THRESHOLDS = tuple(x / 4 for x in range(3, 18))

_BROKEN = re.compile(r"(?<=\w)[-¬­]\s*\n\s*(?=\w)")
_NEW_ITEM = re.compile(r"\n\s*(?=(?:[•*\-–]|\d{1,3}[.)])\s)")
_END = re.compile(r"(?<=[.?!])[\s\"'”)]+")
_WORD = re.compile(r"[^\W\d_]{3,}")


def paragraphs(text: str | None) -> list[list[list[str]]]:
    """Words of three letters or more, by sentence, by paragraph. A paragraph ends at an empty
    line; sentences end at a stop or where a list item begins; those without two words drop out.
    Text without stops comes in pieces."""
    if not text:
        return []
    out = []
    for part in re.split(r"\n\s*\n", _BROKEN.sub("", text).lower()):
        found = []
        for item in _NEW_ITEM.split(part):
            for sentence in _END.split(item):
                words = _WORD.findall(sentence)
                n = max(1, round(len(words) / PIECE)) if len(words) > LONG else 1
                if len(words) > 1:
                    found += [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]
        if found:
            out.append(found)
    return out


def _sentence_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for d, s, t in zip(b["d"], b["subjects"], b["t"]):
            rows += [(d, n, s, list(dict.fromkeys(w))) for n, w in enumerate(w for p in paragraphs(t) for w in p)]
        yield pd.DataFrame(rows, columns=["d", "n", "subjects", "words"])


class Judge:
    """Rules, and what they say about sentences and documents; lives in a worker."""

    def __init__(self, rules: dict[tuple[str, ...], dict[str, float]], prior: dict[str, float], rank: dict[str, int] | None = None):
        self.rules = rules
        self.base = {s: math.log(p / (1 - p)) for s, p in prior.items()}
        self.by_word: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for r in rules:  # found by its rarest word
            self.by_word[min(r, key=lambda w: ((rank or {}).get(w, 0), w))].append(r)

    def sentence(self, words: list[str]) -> dict[str, float]:
        """How likely each subject is, against all others and none, from its share among documents and
        the evidence: the sum of the log-odds of the matching rules. A rule inside a longer
        matching one is not heard. Without any rule there is no subject."""
        here = set(words)
        found = {r for w in here if w in self.by_word for r in self.by_word[w] if len(r) == 1 or here.issuperset(r)}
        if not found:
            return {}
        inside = {s for r in found if len(r) > 1 for n in range(1, len(r)) for s in combinations(r, n)}
        evidence: dict[str, float] = defaultdict(float)
        for r in found - inside:
            for subject, weight in self.rules[r].items():
                evidence[subject] += weight
        odds = {s: math.exp(min(50.0, e + self.base[s])) for s, e in evidence.items()}
        return {s: o / (1 + sum(odds.values())) for s, o in odds.items()}

    def document(self, text: str | None) -> dict[str, float]:
        """For each subject the weight of the stretch of one paragraph most devoted to it: the sum
        of its likelihood in the sentences, less the likeliest other subject's there, and less a
        half of what is left where no subject is likely."""
        best: dict[str, float] = {}
        for paragraph in paragraphs(text):
            says = [self.sentence(words) for words in paragraph]
            for subject in {s for q in says for s, x in q.items() if x >= 0.5}:
                run = top = 0.0
                for q in says:
                    own, other = q.get(subject, 0.0), max((x for s, x in q.items() if s != subject), default=0.0)
                    run = max(0.0, run + own - other - 0.5 * max(0.0, 1 - own - other))
                    top = max(top, run)
                if top > best.get(subject, 0.0):
                    best[subject] = top
        return best


def _grown(item: str, rows: list[tuple[tuple[str, ...], tuple[str, ...], int]], least: int) -> Iterator[tuple[tuple[str, ...], int, dict[str, int]]]:
    """Frequent bodies of words whose last in the order is ``item``, from its conditional sentences
    (words before it, subjects, times): (body, times, times a subject). A body grows by words that
    stand before all of it. It does not grow by words that always stand beside it (the longer body
    says the same), nor once it is sure of a subject."""
    todo = [((item,), rows)]
    while todo:
        body, rows = todo.pop()
        n, heads = 0, defaultdict(int)
        for _, subjects, times in rows:
            n += times
            for s in subjects:
                heads[s] += times
        yield body, n, heads
        if n < least or max(heads.values(), default=0) >= SURE * (n + 1):
            continue
        beside: dict[str, list] = defaultdict(list)
        for before, subjects, times in rows:
            for k, w in enumerate(before):
                beside[w].append((before[:k], subjects, times))
        for w, held in beside.items():
            if len(held) >= least or sum(r[2] for r in held) >= least:
                if len(held) == len(rows):
                    continue
                todo.append(((w, *body), held))


def mine_rules(sentences: DataFrame) -> tuple[dict[tuple[str, ...], dict[str, float]], dict[str, float], dict[str, int]]:
    """Class-association rules from sentences (``d``, ``n``, ``subjects`` of the document, ``words``):
    {words in order: {subject: weight}}, the subjects' shares among the documents, and in how many
    documents each word stands. The weight is the log-odds of the rule's smoothed confidence
    against the subject's share. A rule is pruned where its confidence is under a half, or not
    clearly above that of each rule with fewer of its words.

    What comes to the driver grows with the labelled sample, which is bounded."""
    docs = sentences.select("d", "subjects").distinct()
    shares = {r["s"]: r["n"] for r in docs.select(F.explode(F.concat("subjects", F.array(F.lit("")))).alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
    total = shares.pop("", 0)
    if not total or not shares:
        return {}, {}, {}
    prior = {s: min(max(n / total, 1e-3), 1 - 1e-3) for s, n in shares.items()}
    known = cut(sentences.select("d", F.explode("words").alias("w")).distinct().groupBy("w").agg(F.count("*").alias("docs")).filter(F.col("docs") >= WORD_DOCUMENTS))
    rank = {r["w"]: r["docs"] for r in known.collect()}
    baskets = sentences.select("d", "n", "subjects", F.explode("words").alias("w")).join(known, "w").groupBy("d", "n").agg(F.first("subjects").alias("subjects"), F.array_sort(F.collect_set(F.struct((-F.col("docs")).alias("k"), "w"))).alias("x"))
    baskets = cut(baskets.select("subjects", F.transform("x", lambda x: x["w"]).alias("words")))
    least = max(RULE_SENTENCES, math.ceil(RULE_SHARE * baskets.count()))
    conditional = baskets.select("subjects", "words", F.posexplode("words").alias("k", "item")).select("item", "subjects", F.slice("words", F.lit(1), F.col("k")).alias("before")).groupBy("item", "before", "subjects").agg(F.count("*").alias("times"))

    def grow(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        rows = [(tuple(b), tuple(s), int(t)) for b, s, t in zip(g["before"], g["subjects"], g["times"])]
        out = []
        for body, n, heads in _grown(key[0], rows, least):
            # under a half no rule comes of it, and none is pruned by it
            out += [(list(body), n, s, k) for s, k in heads.items() if k + prior[s] >= (0.5 - GAIN) * (n + 1)]
        return pd.DataFrame(out, columns=["body", "n", "head", "k"])

    mined = conditional.groupBy("item").applyInPandas(grow, "body array<string>, n long, head string, k long")
    sure = {(tuple(sorted(r["body"])), r["head"]): ((r["k"] + prior[r["head"]]) / (r["n"] + 1), r["n"]) for r in mined.collect()}
    rules: dict[tuple[str, ...], dict[str, float]] = defaultdict(dict)
    for (body, head), (c, n) in sure.items():
        p = prior[head]
        shorter = max((sure[part, head][0] for k in range(1, len(body)) for part in combinations(body, k) if (part, head) in sure), default=0.0)
        if c >= 0.5 and c > p and (len(body) == 1 or (c > shorter + GAIN and c - shorter >= ERRORS * math.sqrt(max(shorter, p) * (1 - max(shorter, p)) / n))):
            rules[body][head] = math.log(c / (1 - c)) - math.log(p / (1 - p))
    return dict(rules), prior, rank


def find_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and subject to which a stretch of about three sentences is devoted:
    ``doc_id``, ``subject`` as spelled in ``subjects``, and ``weight`` of the stretch.

    Labels (doc_id, subject) are read without regard to case and blanks; null ones say "none";
    unknown subjects and unknown documents are ignored; repeated rows count once. At most
    ``LABELLED`` labelled documents are learnt from, everything else covers all rows. Null and
    empty texts have no subject. Without usable labels there are no rules and no rows."""
    judge, threshold, spelled = learn_subjects(documents, labels, subjects, doc_id, text)[:3]
    kind = documents.schema[doc_id].dataType.simpleString()
    corpus = documents.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).filter("t is not null and t <> ''")
    found = spread(corpus).mapInPandas(_weights(judge), f"d {kind}, s string, w double").filter(F.col("w") >= threshold)
    names = F.create_map(*[F.lit(x) for kv in spelled.items() for x in kv]) if spelled else F.create_map().cast("map<string,string>")
    return found.select(F.col("d").alias(doc_id), names[F.col("s")].alias("subject"), F.col("w").alias("weight"))


def _weights(judge: Judge):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, w) for d, t in zip(b["d"], b["t"]) for s, w in sorted(judge.document(t).items())]
            yield pd.DataFrame(rows, columns=["d", "s", "w"])

    return run


def learn_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Judge, float, dict[str, str], dict[float, tuple[int, int, int]]]:
    """The judge, the threshold, the subjects' spellings, and for every threshold how many (document,
    subject) of the documents kept back it gives that are labelled, gives at all, and are labelled."""
    kind = documents.schema[doc_id].dataType.simpleString()
    spelled = {r[0].strip().lower(): r[0] for r in subjects.select("subject").filter("subject is not null").distinct().collect()}
    named = labels.select(F.col(doc_id).alias("d"), F.lower(F.trim("subject")).alias("s")).filter("d is not null").distinct()
    named = named.filter(F.col("s").isNull() | F.col("s").isin(list(spelled)))
    chosen = named.groupBy("d").agg(F.array_sort(F.collect_set("s")).alias("subjects")).orderBy(F.xxhash64("d"), "d").limit(LABELLED)
    corpus = documents.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).filter("t is not null and t <> ''")
    learn = cut(corpus.join(F.broadcast(chosen), "d").dropDuplicates(["d"]))  # bounded by LABELLED
    kept_back = F.pmod(F.xxhash64("d", F.lit("kept back")), F.lit(KEPT_BACK)) == 0
    sentences = cut(spread(learn.filter(~kept_back)).mapInPandas(_sentence_rows, f"d {kind}, n int, subjects array<string>, words array<string>"))
    judge = Judge(*mine_rules(sentences))

    held = spread(learn.filter(kept_back))
    met = held.select("d", "t").mapInPandas(_weights(judge), f"d {kind}, s string, w double")
    given = held.select("d", F.explode("subjects").alias("s"), F.lit(1).alias("given"))
    test = met.join(given, ["d", "s"], "full").agg(*[F.sum(F.when((F.col("w") >= t) & (F.col("given") == 1), 1).otherwise(0)).alias(f"hit{i}") for i, t in enumerate(THRESHOLDS)], *[F.sum(F.when(F.col("w") >= t, 1).otherwise(0)).alias(f"all{i}") for i, t in enumerate(THRESHOLDS)], F.sum(F.coalesce("given", F.lit(0))).alias("true"))
    r = test.first()
    counts = {t: (r[f"hit{i}"] or 0, r[f"all{i}"] or 0, r["true"] or 0) for i, t in enumerate(THRESHOLDS)}
    f1 = {t: 2 * hit / max(1, given + true) for t, (hit, given, true) in counts.items()}
    # labels hardly tell neighbouring thresholds apart: the middle one of those within half a percent of the best
    good = [t for t in THRESHOLDS if f1[t] >= max(f1.values()) - 0.005]
    return judge, good[(len(good) - 1) // 2], spelled, counts
