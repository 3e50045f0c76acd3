"""Evaluation passages inside training documents.

Every partition of the corpus is cut into shards of bounded size, long documents into overlapping
pieces; each shard gets a suffix array over its words, in which every suffix of every evaluation
item is searched by binary search, word by word, to its longest match. All maximal verbatim
matches with their places come out of the narrowing ranges; where they could make a row long
enough, an exact alignment of the two texts measures the longest row of words, through exchanged
words. Documents are never shuffled: only the items travel, in broadcast parts of bounded size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import spread

#: Words of one suffix array; bounds the memory of a task.
SHARD_WORDS = 400_000
#: Words of items in one broadcast part. The parts are searched one after another in every shard,
#: so neither driver nor worker holds more than one.
ITEM_WORDS = 2_000_000
#: Words that may stand between two parts of a row: a running header, a page number, a mark.
BETWEEN = 12
#: Matches that are held at once before they are reduced.
HITS = 2_000_000

# What scanning makes of letters, each group read as its last member.
_MISREAD_PAIRS = (("rn", "m"), ("in", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h"))
_MISREAD_CHARS = str.maketrans({"0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "$": "s", "@": "a", "c": "e", "b": "h", "6": "h", "f": "t", "8": "h", "9": "g", "q": "g"})

_JOIN = re.compile(r"(?<=\w)[-¬­‐‑]\s*(?=\w)")
_INVISIBLE = re.compile("[­᠎​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+(?:[@!|$][^\W_]+)*")
_NUMBER = re.compile(r"\d+$")


def fold_word(word: str) -> str:
    """One form for a word and what scanning may have made of it; numbers stay as they are."""
    if _NUMBER.match(word):
        return word
    for a, b in _MISREAD_PAIRS:
        word = word.replace(a, b)
    return word.translate(_MISREAD_CHARS)


def words_of(text: str | None) -> list[str]:
    """The words of a text without regard to case, accents, punctuation, spacing, hyphens at
    line ends or not, and invisible characters. Null and empty texts have none."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _JOIN.sub("", text))
        text = _INVISIBLE.sub("", "".join(c for c in text if not unicodedata.combining(c)))
    return _WORD.findall(_JOIN.sub("", text).lower())


def suffix_array(words: np.ndarray) -> np.ndarray:
    """The positions of all known words (ids above 0) in the order of the suffixes that begin there,
    by prefix doubling. A 0 (an unknown word, or the end of a text) is like no other, so suffixes
    are told apart where one meets it, and doubling ends with the longest repeated row."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    none = words == 0
    rank = np.where(none, np.cumsum(none) - 1, words.astype(np.int64) + n)
    step = 1
    while True:
        later = np.zeros(n, np.int64)
        if step < n:
            later[: n - step] = rank[step:] + 1
        # a suffix that met a 0 within the step is settled; the rest is told apart by what comes after
        key = rank * (int(later.max()) + 1) + later
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if fresh.max() == n - 1 or step >= n:
            return order[~none[order]]
        rank, step = fresh, step * 2


def _narrow(words: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, word: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the ranges [low, high) of ``order`` whose suffixes have ``word`` at place ``d``."""
    ends = []
    for side in (0, 1):
        a, b = low.copy(), high.copy()
        while (busy := a < b).any():
            mid = (a + b) >> 1
            at = words[order[np.minimum(mid, len(order) - 1)] + d]
            right = busy & ((at <= word) if side else (at < word))
            a = np.where(right, mid + 1, a)
            b = np.where(busy & ~right, mid, b)
        ends.append(a)
    return ends[0], ends[1]


def search(words: np.ndarray, order: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [low, high) of ``order`` whose suffixes begin with the first ``depth`` words of each
    row of ``wanted``, narrowed by binary search word by word; and the rows that have any."""
    rows = np.arange(len(wanted))
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    padded = np.concatenate((words, np.zeros(depth + 1, words.dtype)))
    for d in range(depth):
        low, high = _narrow(padded, order, low, high, wanted[rows, d], d)
        keep = low < high
        rows, low, high = rows[keep], low[keep], high[keep]
        if not len(rows):
            break
    return rows, low, high


def longest_matches(words: np.ndarray, order: np.ndarray, items: np.ndarray, suffix: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From ranges in which the item suffixes (places in ``items``, where 0 ends a text) match for
    ``depth`` words, every match to its full length: (place in ``items``, place in ``words``,
    words), in pieces of some ``HITS``. What leaves a range as it narrows has found its length.
    Matches that go on to the left are parts of longer ones and left out."""
    words = np.concatenate((words, [0]))
    longest = int(np.diff(np.flatnonzero(np.concatenate(([0], items, [0])) == 0)).max(initial=0)) + 1
    padded = np.concatenate((words, np.zeros(longest + 1, words.dtype)))
    d = depth
    while len(suffix):
        word = items[suffix + d]
        lo, hi = _narrow(padded, order, low, high, np.where(word > 0, word, -1), d)
        for a, b in ((low, np.where(lo < hi, lo, high)), (np.where(lo < hi, hi, high), high)):
            left = b - a
            ends = np.cumsum(left)
            begin = 0
            while begin < len(left):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HITS, side="right")))
                n = left[begin:stop]
                which = np.repeat(np.arange(begin, stop), n)
                at = order[a[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
                j = suffix[which]
                fresh = (j == 0) | (at == 0) | (items[j - 1] == 0) | (items[j - 1] != words[at - 1])
                if fresh.any():
                    yield j[fresh], at[fresh], np.full(int(fresh.sum()), d, np.int64)
                begin = stop
        keep = lo < hi
        suffix, low, high = suffix[keep], lo[keep], hi[keep]
        d += 1


def longest_row(item: list[str], doc: list[str]) -> tuple[int, int, int, int]:
    """The most words in a row of ``item`` that ``doc`` holds, a word exchanged, left out or added
    here and there not breaking it: (words, first word in item, first word in doc, longest stretch
    without any difference). Differences must stand apart (at least two equal words after each) and
    come to at most an eighth of the row."""
    found = [b for b in SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks() if b.size]
    best, verbatim = (0, 0, 0), max((b.size for b in found), default=0)
    for i, first in enumerate(found):
        wrong, end = 0, first.a + first.size
        reach = first
        if end - first.a > best[0]:
            best = (end - first.a, first.a, first.b)
        for b in found[i + 1 :]:
            gap_a, gap_b = b.a - (reach.a + reach.size), b.b - (reach.b + reach.size)
            cost = max(gap_a, gap_b)
            if gap_a == 0 and 0 < gap_b <= BETWEEN:
                cost = 1  # something stands between: a running header, a page number, a mark
            elif "".join(item[b.a - gap_a : b.a]) == "".join(doc[b.b - gap_b : b.b]):
                cost = 0  # only spacing differs
            if cost > 2:
                break
            wrong += cost
            reach, row = b, b.a + b.size - first.a
            if b.size >= 2 and wrong * 8 <= row and row > best[0]:
                best = (row, first.a, first.b)
    return *best, verbatim


def reach_of(words: int) -> int:
    """How many words of a document a row of so many item words can lie over: one difference in
    eight, each with up to ``BETWEEN`` words beside."""
    return words + (words // 8 + 1) * BETWEEN


class Searcher:
    """Finds the items in batches of documents; lives in a worker."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int, depth: int):
        self.least, self.depth = least, depth
        # w wrong words among n leave at least n - w - (depth - 1) * (w + 1) places where `depth` words are equal
        self.places = max(1, min(n - n // 8 - (depth - 1) * (n // 8 + 1) for n in range(least, least + 8)))
        self.items = [(k, [fold_word(w) for w in ws]) for k, ws in items]
        self.ids: dict[str, int] = {}
        flat = [0]
        self.begin = []
        self.glued: dict[str, tuple[str, str]] = {}
        for _, ws in self.items:
            self.begin.append(len(flat))
            flat += [self.ids.setdefault(w, len(self.ids) + 1) for w in ws] + [0]
            self.glued.update({a + b: (a, b) for a, b in zip(ws, ws[1:])})
        self.flat, self.begin = np.array(flat, np.int64), np.array(self.begin, np.int64)
        at = np.flatnonzero(self.flat)
        rows = np.stack([np.concatenate((self.flat, np.zeros(depth, np.int64)))[at + d] for d in range(depth)], 1) if len(at) else np.zeros((0, depth), np.int64)
        whole = (rows > 0).all(1)
        self.suffix = at[whole]
        self.wanted, same = np.unique(rows[whole], axis=0, return_inverse=True)
        same = same.reshape(-1)
        self.by = np.argsort(same, kind="stable")
        self.first = np.searchsorted(same[self.by], np.arange(len(self.wanted) + 1))
        self.folded: dict[str, str] = {}

    def fold(self, words: list[str]) -> tuple[list[str], list[int]]:
        """The words in the form they are compared in, and the number of each in the text. A word
        that is no item word, but two words of an item without the space, counts as the two; two
        words that make up an item word, one of them unknown, count as it."""
        known = self.folded
        if len(known) > 500_000:
            known.clear()
        plain = []
        for w in words:
            f = known.get(w)
            if f is None:
                f = known[w] = fold_word(w)
            plain.append(f)
        out, at = [], []
        ids, glued = self.ids, self.glued
        n = 0
        while n < len(plain):
            w = plain[n]
            if w not in ids and w in glued:
                out += glued[w]
                at += [n, n]
            elif n + 1 < len(plain) and (w not in ids or plain[n + 1] not in ids) and w + plain[n + 1] in ids:
                out.append(w + plain[n + 1])
                at.append(n)
                n += 1
            else:
                out.append(w)
                at.append(n)
            n += 1
        return out, at

    def shard(self, docs: list[list[str]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(number of the text, item id, words of the row, its first word in the item and in the
        text, longest stretch without difference) for every row of ``least`` words or more."""
        get = self.ids.get
        ids = [np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)) for ws in docs]
        begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in ids])))
        words = np.concatenate([np.append(x, 0) for x in ids]) if ids else np.zeros(0, np.int64)
        order = suffix_array(words)
        if not len(order) or not len(self.wanted):
            return
        rows, low, high = search(words, order, self.wanted, self.depth)
        uses = self.first[rows + 1] - self.first[rows]
        which = np.repeat(np.arange(len(rows)), uses)
        suffix = self.suffix[self.by[self.first[rows][which] + np.arange(len(which)) - np.repeat(np.cumsum(uses) - uses, uses)]]
        parts = []
        for j, at, size in longest_matches(words, order, self.flat, suffix, low[which], high[which], self.depth):
            doc, item = np.searchsorted(begin, at, side="right") - 1, np.searchsorted(self.begin, j, side="right") - 1
            parts.append(np.stack((doc * len(self.items) + item, j - self.begin[item], at - begin[doc], size), 1))
        if not parts:
            return
        hits = np.concatenate(parts)
        hits = hits[np.lexsort((hits[:, 2], hits[:, 0]))]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(hits[:, 0])) + 1, [len(hits)]))
        enough = np.add.reduceat(hits[:, 3] - self.depth + 1, edges[:-1]) >= self.places
        for a, b in zip(edges[:-1][enough], edges[1:][enough]):
            d, n = divmod(int(hits[a, 0]), len(self.items))
            item, doc = self.items[n][1], docs[d]
            for lo, hi in windows(hits[a:b, 1:], len(item), self.places, self.depth):
                row, first, start, verbatim = longest_row(item, doc[max(0, lo) : hi])
                if row >= self.least:
                    yield d, self.items[n][0], row, first, max(0, lo) + start, verbatim


def windows(hits: np.ndarray, length: int, places: int, depth: int) -> list[tuple[int, int]]:
    """Stretches of the document that may hold the item, from the matches (place in item, place in
    document, words): as far around each as a row can reach, those that overlap put together. A
    stretch counts from so many ``places`` of the item on at which ``depth`` words are equal."""
    lo = hits[:, 1] - np.array([reach_of(int(j)) for j in hits[:, 0]])
    hi = hits[:, 1] + np.array([reach_of(length - int(j)) for j in hits[:, 0]])
    by = np.argsort(lo, kind="stable")
    lo, hi, hits = lo[by], hi[by], hits[by]
    edges = np.concatenate(([0], np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1]) + 1, [len(lo)]))
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        met = {p for j, _, n in hits[a:b].tolist() for p in range(j, j + n - depth + 1)}
        if len(met) >= places:
            out.append((int(lo[a]), int(hi[a:b].max())))
    return out


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", least: int = 20, depth: int = 4) -> DataFrame:
    """One row per document and item of which the document holds at least ``least`` words in a
    row: both ids, ``row_words`` (the longest such row), ``row_start`` (its first word in the
    item), ``doc_start`` (its first word in the document; words as :func:`words_of` counts them,
    from 0) and ``verbatim_words`` (the longest stretch without any difference).

    Words are compared as :func:`words_of` and :func:`fold_word` make them; a word exchanged here
    and there does not break a row (:func:`longest_row`). Null and empty texts hold nothing and
    leak nowhere; items under ``least`` words can't be found. Documents with equal texts give
    equal rows; repeated rows give repeated rows. Without items there are no rows. Items go to the
    workers in broadcast parts of ``ITEM_WORDS`` words, made one after another; the corpus is read
    once, whatever their number."""
    kind = {f.name: f.dataType.simpleString() for f in (documents.schema[doc_id], items.schema[item_id])}
    schema = f"`{doc_id}` {kind[doc_id]}, `{item_id}` {kind[item_id]}, row_words int, row_start int, doc_start int, verbatim_words int"
    corpus = spread(documents.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).filter("t is not null and t <> ''"))
    sc = documents.sparkSession.sparkContext

    def cut_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "w": [words_of(t) for t in b["t"]]})

    asked = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).distinct().mapInPandas(cut_words, f"i {kind[item_id]}, w array<string>").filter(F.size("w") >= least)
    parts, part, size, longest = [], [], 0, 0
    for i, ws in asked.toLocalIterator():
        if part and size + len(ws) > ITEM_WORDS:
            parts.append(sc.broadcast(part))
            part, size = [], 0
        part.append((i, list(ws)))
        size += len(ws)
        longest = max(longest, len(ws))
    if part:
        parts.append(sc.broadcast(part))
    if not parts:
        return documents.sparkSession.createDataFrame([], schema)
    overlap = reach_of(longest)
    piece = max(SHARD_WORDS, 2 * overlap)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: list[Searcher] = []

        def searchers() -> Iterator[Searcher]:
            for p in parts:
                if len(parts) > 1 or not ready:
                    ready[:] = [Searcher(p.value, least, depth)]
                yield ready[0]

        best: dict = {}
        texts: list[tuple] = []

        def search_shard() -> None:
            for searcher in searchers():
                folded = [searcher.fold(ws) for _, _, ws in texts]
                for n, i, row, first, start, verbatim in searcher.shard([f[0] for f in folded]):
                    key, offset, _ = texts[n]
                    old = best.get((key, i))
                    if old is None or row > old[0]:
                        best[key, i] = (row, first, offset + folded[n][1][start], max(verbatim, old[3] if old else 0))
            texts.clear()

        def drawn(docs: list) -> pd.DataFrame:
            rows = [(docs[k], i, *v) for (k, i), v in best.items()]
            best.clear()
            return pd.DataFrame(rows, columns=[doc_id, item_id, "row_words", "row_start", "doc_start", "verbatim_words"])

        docs: list = []
        count = 0
        for batch in batches:
            for d, t in zip(batch["d"], batch["t"]):
                ws = words_of(t)
                if len(ws) < least // 2:
                    continue
                docs.append(d)
                # pieces of a long document overlap by what a row can lie over
                for lo in range(0, max(1, len(ws) - overlap), piece - overlap):
                    texts.append((len(docs) - 1, lo, ws[lo : lo + piece]))
                    count += len(texts[-1][2])
                    if count >= SHARD_WORDS:
                        search_shard()
                        count = 0
                if not texts:  # no document is half read: what was found can go
                    yield drawn(docs)
                    docs = []
        search_shard()
        yield drawn(docs)

    return corpus.mapInPandas(scan, schema)


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents in which no item was found, all columns kept. Rows with a null id stay."""
    return documents.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
