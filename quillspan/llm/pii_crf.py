"""Personal information in free text: a skip-chain conditional random field.

Tokens of a block form a chain with learnt potentials; equal and look-alike tokens of one document
share skip potentials, which make their labels agree however far apart they are. The tokens of one
form are tied by a hub, a hidden variable for what the form stands for in the document: a token
whose type agrees with its hub's gains a learnt strength. Inference is loopy message passing:
forward-backward inside every block, token to hub, hub to token, each message without what came
over the same edge, until the beliefs rest. No edge leaves a document, so all rounds of a document of
bounded size run where its blocks were read; larger ones stay spread over the cluster, where a round
costs one pre-aggregated sum and one join.

The chain is trained by gradient steps on a bounded sample of blocks whose spans were recorded,
in part, by detectors; the spans are cleaned first, and what the first model finds beside them is
added before the second training. The strengths of the skip potentials are then set to the likeliest
ones, on marginals of models that never saw the block.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.unicode_form import look_alikes
from quillspan.operators.intervals import valid_spans
from quillspan.session import cut, spread

TYPES = ("EMAIL", "PHONE", "GOVERNMENT_ID", "ADDRESS", "PERSON")
LABELS = ("O", *[f"{p}-{t}" for t in TYPES for p in "BI"])
#: Of each label its group: outside, or the type.
GROUPS = np.array([0, *[i + 1 for i in range(len(TYPES)) for _ in "BI"]])
N_GROUPS = len(TYPES) + 1
#: Blocks to train on, at most, chosen by the hash of their keys; characters of one of them that
#: are read in training; passes over them.
SAMPLE, SAMPLE_TEXT, EPOCHS = 12_000, 20_000, 5
#: Times as many blocks as are wanted are looked through for them at first.
SPARE = 6
BITS = 18
#: Message passing rests when no block's beliefs move by more than CHANGE (the sum over its tied
#: tokens); messages are damped from round DAMPED on, so that it comes to rest; ROUNDS is a brake.
CHANGE, DAMPED, ROUNDS = 0.02, 4, 25
#: Strengths of the skip potentials that are tried for each group.
STRENGTHS = tuple(x / 4 for x in range(0, 21))
TOKENS_A_BATCH = 120_000
#: Characters of a document that is read whole by one worker, each block counted with BLOCK_COST more;
#: of the documents read together; and of a task.
LOCAL_TEXT, BLOCK_COST, CHUNK_TEXT, TASK_TEXT = 1_000_000, 50, 400_000, 10_000_000
#: Words whose attributes a worker keeps; large documents that are told to all workers.
KNOWN_WORDS, BROADCAST = 300_000, 100_000

# Names of the detectors' types for the five types asked for.
TYPE_NAMES = {
    "EMAIL_ADDRESS": "EMAIL", "EMAIL": "EMAIL", "PHONE_NUMBER": "PHONE", "PHONE": "PHONE", "GOVERNMENT_ID": "GOVERNMENT_ID", "US_SSN": "GOVERNMENT_ID",
    "ADDRESS": "ADDRESS", "STREET_ADDRESS": "ADDRESS", "PERSON": "PERSON",
}

_WIDE, _LINE = re.compile(r"[^\x00-\x7f]"), re.compile("\n")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_LABEL = r"[^\W_]+(?:-\n?[^\W_]+)*"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\s+dot\s+)"
_EMAIL = re.compile(
    rf"(?<![\w.+-])[^\W_](?:[\w.+]|-\n?(?=\w))*(?:(?:\s?@\n?\s?|\s?[\[(]\s?at\s?[\])]\s?){_LABEL}(?:{_DOT}{_LABEL})+|\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})+)", re.IGNORECASE
)
_NUMBER = re.compile(r"(?<![\w@.])(?:\+\s?|\(\s?)?\d+(?:(?:[ \n]|\)[ \n]?|[ \n]?\(|[./]|-\n?)\d+)*(?!\w)")
_EXTENSION = re.compile(r",?\s*(?:ext\.?|extn\.?|extension|x)\s*\d{1,6}(?!\w)", re.IGNORECASE)
_CODE = re.compile(r"(?<![\w@])(?:[A-Z]{3,5}\d{4}[A-Z]|[A-Z]{2}(?:[ \n]?\d{2}){3}[ \n]?[A-Z]|[A-Z]{1,3}[ \n]?\d{3}[ \n]?\d{3,6}|[A-Z]{1,3}\d{5,9}[A-Z]?)(?![\w@])")
# Words of addresses.
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Way|Terrace|Crescent|Row|Boulevard|Blvd|Place|Pl|Square|Sq|Close|Highway|Hwy|Parkway|Pkwy|Circle|Gardens|Walk|Mews|Quay|Grove"
_UNITS = "Suite|Ste|Apt|Apartment|Unit|Flat|Floor|Room|#"
_GERMAN = "weg|straße|strasse|str\\.|platz|allee|gasse|ring|damm|ufer"
_SPANISH = "Calle|Avenida|Av\\.|Plaza|Paseo|Camino"
_FRENCH = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours"
_CAP = r"[^\W\d_a-zß-ÿ][^\W\d_]*(?:[-'’][^\W\d_]+)*"
_UNIT = rf"(?:{_UNITS})\.?\s?\d+[A-Z]?"
_STREET = rf"(?:{_CAP}\s){{1,4}}(?:{_STREETS})\b\.?"
_TOWN = rf"{_CAP}(?:\s{_CAP})?"
_ADDRESS = re.compile(
    rf"(?<!\w)(?:(?P<us>(?:\d{{1,5}}\s{_STREET}|P\.?\s?O\.?\s?Box\s\d+)(?:,?\s{_UNIT})?,?\s{_TOWN},?\s[A-Z]{{2}}\s\d{{5}}(?:-\d{{4}})?)"
    rf"|(?P<uk>(?:{_UNIT},?\s)?\d{{1,5}}[A-Z]?\s{_STREET},?\s{_TOWN}\s[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}})"
    rf"|(?P<de>{_CAP}(?:{_GERMAN})\s\d{{1,4}}[a-z]?,?\s\d{{5}}\s{_CAP})"
    rf"|(?P<es>(?:{_SPANISH})\s(?:[^\W\d_]+\s){{1,5}}\d{{1,4}},(?:\s\d+º(?:\s[A-Z])?,)?\s\d{{5}}\s{_CAP})"
    rf"|(?P<fr>\d{{1,4}}(?:\s(?:bis|ter))?\s(?:{_FRENCH})\s(?:[^\W\d_'’]+[\s'’]?){{1,6}},\s\d{{5}}\s{_CAP}))(?!\w)"
)
#: A word with signs or digits between its letters: misread, so its form is that of the whole.
_MIXED = re.compile(r"[^\W\d_]+(?:[0-9!|$@]+[^\W\d_]+)+")
#: Without one of these signs before a letter no word is misread; without a digit there are no numbers;
#: without a postal code there is no street address; without these words no address of mail is spelt out.
_MIXED_HINT, _DIGIT, _TOWN_HINT = re.compile(r"[0-9!|$@][^\W\d_]"), re.compile(r"\d"), re.compile(r"\d{5}|\s\d[A-Z]{2}")
_AT_HINT, _SPELT_HINT, _DOT_HINT = re.compile(r"[\[(]\s?at\s?[\])]", re.IGNORECASE), re.compile(r"\sat\s", re.IGNORECASE), re.compile(r"\sdot\s", re.IGNORECASE)
_PLACEHOLDER = re.compile(r"[\[<{][A-Z_]{3,}(?:_?\d+)?[\]>}]")


def plain_form(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alike and compatibility characters as plain ones and invisible ones left
    out, and for each of its characters the place in ``text`` (None if they are the same)."""
    if text.isascii():
        return text, None
    table = look_alikes()
    latin = re.search("[a-z]", text) is not None
    out, at = [], []
    done = 0
    for m in _WIDE.finditer(text):
        i, ch = m.start(), m.group()
        out += text[done:i]
        at += range(done, i)
        done = i + 1
        if unicodedata.category(ch) == "Cf":
            continue
        if unicodedata.combining(ch):
            if out:
                whole = unicodedata.normalize("NFC", out[-1] + ch)
                if len(whole) == 1:
                    out[-1] = whole
            continue
        n = unicodedata.normalize("NFKC", ch) if ch not in "ºª²³½¼¾™…" else ch
        n = table.get(n, n) if latin and len(n) == 1 else n
        for c in n:
            out.append(" " if c.isspace() and c != "\n" else "-" if c in "‐‑" else c)
            at.append(i)
    out += text[done:]
    at += range(done, len(text))
    return "".join(out), at


_KINDS = {"E": ("EMAIL",), "A": ("ADDRESS",), "N": ("PHONE", "GOVERNMENT_ID"), "C": ("GOVERNMENT_ID",)}


def _valid_11(d: str) -> bool:
    return (10 - sum(int(a) * b for a, b in zip(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))) % 10) % 10 == int(d[10])


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """Stretches that look like an address of mail, a number or a code: (start, end, kind, shape).
    The kind is only a feature; labels come from the field."""
    out = [(m.start(), m.end(), "E", "@" if "@" in m.group() else "at") for m in _EMAIL.finditer(text)] if "@" in text or ("[" in text or "(" in text) and _AT_HINT.search(text) or "dot" in text.lower() and _DOT_HINT.search(text) and _SPELT_HINT.search(text) else []
    if not _DIGIT.search(text):
        return out
    if _TOWN_HINT.search(text):
        out += [(m.start(), m.end(), "A", m.lastgroup) for m in _ADDRESS.finditer(text)]
    taken = [(s, e) for s, e, _, _ in out]

    def free(s: int, e: int) -> bool:
        return all(e <= a or s >= b for a, b in taken)

    for m in _CODE.finditer(text):
        if free(m.start(), m.end()):
            out.append((m.start(), m.end(), "C", re.sub(r"\s", " ", re.sub(r"\d", "9", re.sub(r"[A-Z]", "A", m.group())))))
            taken.append((m.start(), m.end()))
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        digits = re.sub(r"\D", "", m.group())
        if not 7 <= len(digits) <= 16 or not free(m.start(), m.end()):
            continue
        end = m.end()
        if x := _EXTENSION.match(text, end):
            end = x.end()
        shape = re.sub(r"\s", " ", re.sub(r"\d", "9", m.group())) + (" x" if end > m.end() else "")
        if len(digits) == 11 and digits == m.group():
            shape += "v" if _valid_11(digits) else "n" if digits[0] == "1" and digits[1] not in "01" else ""
        out.append((m.start(), end, "N", shape))
        taken.append((m.start(), end))
    return sorted(out)


def _hash(s: str) -> int:
    return zlib.crc32(s.encode())


def _shape(w: str) -> str:
    if w.isdigit():
        return f"9{len(w)}"
    if not w[0].isalpha():
        return w
    return "x" if w.islower() else ("X1" if len(w) == 1 else "Xx" if w[1:].islower() else "XX" if w.isupper() else "xX")


class Field:
    """Weights of the chain, and all that a worker needs to read text with them."""

    def __init__(self, counts: Counter, lower: set[str]):
        self.words, self.lower = {w for w, n in counts.items() if n >= 2}, lower
        self.w = np.zeros((1 << BITS, len(LABELS)), np.float32)
        self.t = np.zeros((len(LABELS), len(LABELS)), np.float32)
        for i, a in enumerate(LABELS):
            for j, b in enumerate(LABELS):
                if b[0] == "I" and a[2:] != b[2:]:
                    self.t[i, j] = -30.0
        self.reset()
        self.trained = False
        self.skip = np.zeros(N_GROUPS)
        self.doubt = 0.0

    def forget(self) -> None:
        self.w[:] = 0
        self.t[self.t > -20] = 0

    def reset(self) -> None:
        """Forgets the words seen: their numbers, attributes and forms by number, and forms' numbers."""
        self.known: dict[str, int] = {}
        self.table, self.tie = np.zeros((1024, 6), np.int64), np.full(1024, -1)
        self.forms: dict[str, int] = {}
        self.folded: dict[str, str | None] = {}

    def trim(self) -> None:
        if max(len(self.known), len(self.forms), len(self.folded)) > KNOWN_WORDS:
            self.reset()

    def number(self, w: str) -> int:
        """The row of ``table`` with the word's attributes."""
        n = self.known.get(w)
        if n is None:
            n = len(self.known)
            low = w.lower()
            shape = _shape(w)
            base = low if not low.isdigit() else shape
            lex = "k" if low in self.lower else "u"
            fold = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
            a = (_hash("w" + base) if base in self.words or not low.isalpha() else 7, _hash(shape), _hash(fold[-3:] + lex), _hash(fold[-4:] + shape), _hash(fold[:3] + shape), _hash(lex + shape))
            if n == len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
                self.tie = np.concatenate((self.tie, np.full_like(self.tie, -1)))
            self.table[n] = a
            if (form := self.form(w)) is not None:
                self.tie[n] = self.forms.setdefault(form, len(self.forms))
            self.known[w] = n
        return n

    def form(self, w: str) -> str | None:
        """The form under which a word is tied; None for short and ordinary ones."""
        if w not in self.folded:
            tied = len(w) >= (4 if w.isdigit() else 3) and w[0].isalnum() and w.lower() not in self.lower
            self.folded[w] = fold_token(w) if tied else None
        return self.folded[w]

    def read(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray, str, list[int] | None, list[tuple[int, int, str, str]]]:
        """Tokens (start, end in the plain form), attributes a token, the plain form, its places,
        and the candidates."""
        self.trim()
        [(spans, plain, at, cands, _)], rows = self.read_all([text])
        return spans, rows[: len(spans)], plain, at, cands

    def read_all(self, texts: list[str]) -> tuple[list[tuple], np.ndarray]:
        """For each text its tokens, plain form, places, candidates and the tokens' word numbers; and
        the attributes of all tokens, with three empty rows after each text."""
        plains = [plain_form(t) for t in texts]
        # no token holds white space, so those of all texts are found in one
        joined = "\n".join([p for p, _ in plains])
        words = _TOKEN.findall(joined)
        begins = [m.start() for m in _TOKEN.finditer(joined)]
        known = self.known
        try:
            ids = [known[w] for w in words]
        except KeyError:
            ids = [self.number(w) for w in words]
        ids, begin = np.array(ids, np.int64), np.array(begins, np.int64)
        end = begin + np.fromiter(map(len, words), np.int64, len(words))
        offset = np.cumsum([0, *(len(p) + 1 for p, _ in plains)])
        first = np.searchsorted(begin, offset)
        text_no = np.repeat(np.arange(len(texts)), np.diff(first))
        row = np.arange(len(words)) + 3 * text_no
        rows = np.zeros((len(words) + 3 * len(texts), 10), np.int64)
        rows[row, :6] = self.table[ids]
        gaps = np.full(len(words) + 1, 2)
        gaps[1:-1][begin[1:] == end[:-1]] = 3
        gaps[0] = 1
        gaps[np.searchsorted(begin, [m.start() for m in _LINE.finditer(joined)], side="right")] = 1
        rows[row, 8] = gaps[:-1]
        local = offset[text_no]
        toks, edges, marked, out = list(zip((begin - local).tolist(), (end - local).tolist())), first.tolist(), [], []
        for n, (plain, at) in enumerate(plains):
            cands, lo, hi, shift, done = candidates(plain), edges[n], edges[n + 1], int(offset[n]), 0
            out.append((toks[lo:hi], plain, at, cands, ids[lo:hi]))
            for a, z, kind, shape in cands:  # a token belongs to the first candidate that reaches past its start
                i, j = bisect_left(begins, shift + max(a, done), lo, hi), bisect_left(begins, shift + z, lo, hi)
                done = max(done, z)
                if i < j:
                    inner = _hash(kind + "I"), _hash(kind + shape + "I")
                    marked += [(k + 3 * n, *inner) for k in range(i, j)]
                    if begins[i] == shift + a:
                        marked[i - j] = (i + 3 * n, _hash(kind + "B"), _hash(kind + shape + "B"))
        if marked:
            m = np.array(marked)
            rows[m[:, 0], 6], rows[m[:, 0], 7] = m[:, 1], m[:, 2]
        return out, rows

    @staticmethod
    def features(rows: np.ndarray) -> np.ndarray:
        """Feature numbers a token: attributes of the token and its neighbours, alone and joined."""
        n = len(rows)
        pad = np.zeros((n + 6, rows.shape[1]), np.int64)
        pad[3 : n + 3] = rows
        cols = np.ascontiguousarray(pad.T).astype(np.uint64)
        W, S, X3, X4, P, L, C, H, G = range(9)
        groups = [
            [(0, W)], [(-1, W)], [(1, W)], [(-2, W)], [(2, W)], [(-1, W), (0, W)], [(0, W), (1, W)], [(0, S)], [(-1, S), (0, S), (1, S)],
            [(0, X3), (0, S)], [(0, X4)], [(0, P)], [(0, L)], [(-1, L), (0, L)], [(0, L), (1, L)], [(-1, L), (0, L), (1, L)], [(0, C)], [(0, H)], [(-1, W), (0, H)], [(-2, W), (-1, W), (0, C)],
            [(-1, W), (0, L)], [(0, L), (1, W)], [(-2, W), (-1, W), (0, L)], [(0, L), (1, W), (2, W)], [(0, G), (0, L), (-1, S)], [(-2, L), (-1, L), (0, L), (1, L), (2, L)], [(-1, C), (0, S), (0, G)], [(-2, W), (-1, L), (0, L)], [(-3, W), (0, L)], [(3, W), (0, L)], [(-1, G), (0, G), (1, G), (0, S)],
        ]
        out = np.empty((len(groups), n), np.int64)
        for g, parts in enumerate(groups):
            h = np.full(n, (g + 1) * 0x9E3779B1, np.uint64)
            for off, col in parts:
                h ^= cols[col, 3 + off : 3 + off + n]
                h *= np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
            out[g] = h & np.uint64((1 << BITS) - 1)
        return out.T

    def scores(self, feats: np.ndarray) -> np.ndarray:
        out = np.zeros((len(feats), len(LABELS)), np.float32)
        got = np.empty_like(out)
        for g in range(feats.shape[1]):
            out += np.take(self.w, feats[:, g], axis=0, out=got, mode="clip")
        return out

    def pass_messages(self, emit: list[np.ndarray], need_pairs: bool = False):
        """Forward-backward over chains at once: marginals a chain, log-likelihood parts, and the
        expected transitions if asked for. Long chains come first, so that the running ones are
        always the first rows."""
        order = sorted(range(len(emit)), key=lambda i: -len(emit[i]))
        lens = np.array([len(emit[i]) for i in order])
        most, b, k = int(lens[0]) if len(lens) else 0, len(order), len(LABELS)
        e = np.zeros((most, b, k))
        for r, i in enumerate(order):
            x = emit[i].astype(np.float64)
            e[: len(x), r] = x
        top = e.max(2, keepdims=True)
        e = np.exp(e - top)
        trans = np.exp(self.t.astype(np.float64))
        start = np.array([1e-13 if x[0] == "I" else 1.0 for x in LABELS])
        alive = [int((lens > t).sum()) for t in range(most)]
        alpha, scale = np.zeros_like(e), np.ones((most, b))
        for t in range(most):
            n = alive[t]
            a = (start if t == 0 else alpha[t - 1, :n] @ trans) * e[t, :n]
            z = a.sum(1)
            alpha[t, :n], scale[t, :n] = a / z[:, None], z
        beta = np.ones_like(e)
        pairs = np.zeros((k, k))
        for t in range(most - 2, -1, -1):
            n = alive[t + 1]
            right = beta[t + 1, :n] * e[t + 1, :n] / scale[t + 1, :n, None]
            beta[t, :n] = right @ trans.T
            if need_pairs:
                pairs += trans * (alpha[t, :n].T @ right)
        both = alpha * beta
        total = both.sum(2, keepdims=True)
        both /= np.where(total > 0, total, 1)
        out: list = [None] * b
        for r, i in enumerate(order):
            out[i] = both[: lens[r], r]
        return out, pairs

    def decode(self, marginals: list[np.ndarray]) -> list[np.ndarray]:
        """For each chain the labels with the most expected right ones among the allowed sequences,
        all chains at once. ``doubt`` is taken off what staying outside is worth: the records miss
        spans. Where outside is best for every token of a chain, it is best for the chain."""
        sizes = [len(m) for m in marginals]
        out = [np.zeros(n, np.int64) for n in sizes]
        if not sum(sizes):
            return out
        every = np.log(np.concatenate(marginals) + 1e-9)
        every[:, 0] -= self.doubt
        ends = np.cumsum(sizes)
        worth = [every[e - n : e] for e, n in zip(ends.tolist(), sizes)]
        inside = np.searchsorted(ends, np.flatnonzero(every[:, 0] < every.max(1)), side="right")
        open_ = sorted(np.unique(inside).tolist(), key=lambda i: -sizes[i])
        if not open_:
            return out
        lens = np.array([sizes[i] for i in open_])
        most, k = int(lens[0]), len(LABELS)
        r = np.zeros((most, len(open_), k))
        for n, i in enumerate(open_):
            r[: lens[n], n] = worth[i]
        allowed = np.where(self.t < -20, -1e9, 0.0)
        best = r[0] + np.array([-1e9 if x[0] == "I" else 0.0 for x in LABELS])
        back = np.zeros((most, len(open_), k), np.int8)
        for t in range(1, most):
            n = int((lens > t).sum())
            x = best[:n, :, None] + allowed
            back[t, :n] = x.argmax(1)
            best[:n] = x.max(1) + r[t, :n]
        y = best.argmax(1)
        paths = np.zeros((most, len(open_)), np.int64)
        for t in range(most - 1, -1, -1):
            n = int((lens > t).sum())
            paths[t, :n] = y[:n]
            y[:n] = back[t, np.arange(n), y[:n]]
        for c, i in enumerate(open_):
            out[i] = paths[: lens[c], c]
        return out

    def ties(self, plain: str, toks: list[tuple[int, int]], cands: list[tuple[int, int, str, str]]) -> list[tuple[int, str]]:
        """The tokens with skip edges, (number, form): of three letters or four digits and more, and
        no word that the sample writes small as a rule. Tokens of one form in a document are tied.
        Inside addresses, of mail or street, a form is tied to its like there."""
        odd = self.odd_forms(plain, toks, cands)
        forms = ((i, odd[i] if i in odd else self.form(plain[s:e])) for i, (s, e) in enumerate(toks))
        return [(i, form) for i, form in forms if form is not None]

    def odd_forms(self, plain: str, toks: list[tuple[int, int]], cands: list[tuple[int, int, str, str]]) -> dict[int, str | None]:
        """The forms of tokens whose form is not that of their word: misread ones, and those inside
        addresses."""
        out, done = {}, 0
        mixed = {m.start(): m.group() for m in _MIXED.finditer(plain)} if _MIXED_HINT.search(plain) else {}
        cands = [c for c in cands if c[2] in "EA"]
        starts = [s for s, _ in toks] if mixed or cands else []
        for s, w in mixed.items():
            if (i := bisect_left(starts, s)) < len(starts) and starts[i] == s:
                out[i] = self.form(w)
        for a, z, kind, _ in cands:
            for i in range(bisect_left(starts, max(a, done)), bisect_left(starts, z)):
                form = self.form(plain[toks[i][0] : toks[i][1]])
                out[i] = None if form is None else kind + form
            done = max(done, z)
        return out

    def train(self, chains: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float = 0.35) -> None:
        """Adaptive gradient steps on the log-likelihood of (features, labels) chains."""
        rng = np.random.default_rng(7)
        g2, t2 = np.full(self.w.shape, 1e-4, np.float32), np.full(self.t.shape, 1e-2)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 250)):
                part = [chains[i] for i in batch]
                emit = [self.scores(f) for f, _ in part]
                marg, pairs = self.pass_messages(emit, need_pairs=True)
                delta = np.concatenate(marg).astype(np.float32)
                gold = np.concatenate([y for _, y in part])
                delta[np.arange(len(gold)), gold] -= 1.0
                delta[gold < 0] = 0.0  # not known: nothing to learn from
                busy = np.abs(delta).max(1) > 1e-3
                feats = np.concatenate([f for f, _ in part])[busy]
                rows, where = np.unique(feats, return_inverse=True)
                where = where.reshape(feats.shape)
                grad = np.stack([np.bincount(where.ravel(), weights=np.repeat(delta[busy, j], feats.shape[1]), minlength=len(rows)) for j in range(len(LABELS))], 1).astype(np.float32)
                grad += 3e-3 * self.w[rows]
                g2[rows] += grad * grad
                self.w[rows] -= rate * grad / np.sqrt(g2[rows])
                for _, y in part:
                    both = (y[:-1] >= 0) & (y[1:] >= 0)
                    np.subtract.at(pairs, (y[:-1][both], y[1:][both]), 1.0)
                pairs[self.t < -20] = 0
                t2 += pairs * pairs
                self.t -= (rate * 0.5 * pairs / np.sqrt(t2)).astype(np.float32)


def _name_like(tokens: list[str], lower: set[str]) -> bool:
    words = [t for t in tokens if t.isalpha()]
    return bool(words) and all(t.isalpha() or t in ".,-'’" for t in tokens) and all(w[0].isupper() for w in words) and not any(w.lower() in lower for w in words if len(w) > 1) and any(len(w) > 2 for w in words) and len(words) <= 6


def gold_labels(field: Field, text: str, spans: list[tuple[int, int, str]], told: dict[tuple[str, str], str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a block from its recorded spans, widened to whole tokens or to the
    candidate they lie in; spans that can't be of their type are left out. Labels inside addresses
    that no record speaks of are not known (-1)."""
    toks, rows, plain, at, cands = field.read(text)
    y = np.zeros(len(toks), np.int64)
    place = {i: j for j, i in reversed(list(enumerate(at)))} if at else None
    for s, e, kind in sorted(spans, key=lambda x: x[0] - x[1]):
        if place is not None:
            s, e = place.get(s, -1), place.get(e - 1, -2) + 1
            if s < 0 or e <= s:
                continue
        want = {"EMAIL": "E", "PHONE": "N", "GOVERNMENT_ID": "NC"}.get(kind)
        if want:
            inside = [c for c in cands if c[2] in want and c[0] < e and s < c[1] and min(e, c[1]) - max(s, c[0]) >= 0.5 * (c[1] - c[0]) and s >= c[0] - 2 and e <= c[1] + 2]
            if not inside:
                continue
            s, e = inside[0][0], inside[0][1]
        hit = [i for i, (a, b) in enumerate(toks) if a < e and s < b]
        if not hit or y[hit].any():
            continue
        words = [plain[toks[i][0] : toks[i][1]] for i in hit]
        if kind == "PERSON" and not _name_like(words, field.lower):
            continue
        if kind == "ADDRESS" and (len(hit) < 4 or not any(w.isdigit() for w in words) or sum(w[0].islower() and w in field.lower for w in words) > 3 or s != toks[hit[0]][0] or e != toks[hit[-1]][1]):
            continue
        b = 1 + 2 * TYPES.index(kind)
        y[hit[0]], y[hit[1:]] = b, b + 1
    for a, z, kind, shape in cands:
        hit = [i for i, (s, e) in enumerate(toks) if a <= s and e <= z]
        if (kind, shape) in told and hit and not y[hit].any():
            b = 1 + 2 * TYPES.index(told[kind, shape])
            y[hit[0]], y[hit[1:]] = b, b + 1
        elif kind in "EA" and hit and not y[hit].any():
            y[hit] = -1
    return Field.features(rows), y


def learn(sample: list[tuple[str, str, list[tuple[int, int, str]]]], epochs: int = EPOCHS) -> Field:
    """A field trained on (document, text, recorded spans), twice: the second time with what the
    first model is sure of where nothing was recorded. Strengths of the skip potentials come from
    the first models' marginals on the half they never saw."""
    counts: Counter = Counter()
    lower: Counter = Counter()
    written: Counter = Counter()
    for _, text, _ in sample:
        plain = plain_form(text)[0]
        for w in re.findall(r"[^\W\d_]+", plain):
            counts[w.lower()] += 1
        for w in re.findall(r"(?<![\w.@+-])[^\W\d_]+(?![\w.@+-]*[\w@])", _EMAIL.sub(" ", plain)):
            written[w.lower()] += 1
            if w.islower():
                lower[w] += 1
    # ordinary words; names now and then written small are none
    field = Field(counts, {w for w, n in lower.items() if n >= 2 and len(w) > 1 and n >= 0.3 * written[w]})
    told = _told_shapes([(t, s) for _, t, s in sample])
    chains, tied = [], []
    for d, t, s in sample:
        c = gold_labels(field, t, s, told)
        if len(c[1]):
            toks, _, plain, _, cands = field.read(t)
            chains.append(c)
            tied.append([(d, i, form) for i, form in field.ties(plain, toks, cands)])
    if not chains:
        return field
    again: list = [None] * len(chains)
    seen: list = [None] * len(chains)
    for side in (0, 1):
        field.forget()
        field.train(chains[side::2], max(2, epochs // 2 + 1))
        other = list(range(1 - side, len(chains), 2))
        for lo in range(0, len(other), 500):
            part = other[lo : lo + 500]
            marg, _ = field.pass_messages([field.scores(chains[i][0]) for i in part])
            for i, m, path in zip(part, marg, field.decode(marg)):
                again[i] = (chains[i][0], _mended(chains[i][1], path, m))
                seen[i] = m
    _strengths(field, seen, [y for _, y in again], tied)
    field.doubt = _doubt(field, seen, [y for _, y in chains])
    field.forget()
    field.train(again, epochs)
    field.trained = any((y > 0).any() for _, y in again)
    field.w = field.w.astype(np.float16).astype(np.float32)
    field.reset()
    return field


def grouped(m: np.ndarray) -> np.ndarray:
    """Marginals of labels as beliefs of groups."""
    return np.concatenate((m[:, :1], m[:, 1::2] + m[:, 2::2]), 1)


def _strengths(field: Field, marg: list[np.ndarray], gold: list[np.ndarray], tied: list[list[tuple[str, int, str]]]) -> None:
    """Sets ``skip`` to the strengths under which the labels of the tied tokens are likeliest after
    one exchange of messages, one group at a time, twice around."""
    number: dict[tuple[str, str], int] = {}
    hub, belief, label = [], [], []
    for m, y, ties in zip(marg, gold, tied):
        b = grouped(m) if ties else m
        for d, i, form in ties:
            if y[i] >= 0:
                hub.append(number.setdefault((d, form), len(number)))
                belief.append(b[i])
                label.append(GROUPS[y[i]])
    if not hub:
        return
    h, b, y = np.array(hub), np.clip(np.array(belief), 1e-6, 1), np.array(label)
    keep = np.bincount(h)[h] > 1
    h, b, y = h[keep], b[keep], y[keep]
    if not len(h):
        return

    def fit(w: np.ndarray) -> float:
        sent = np.log1p(np.expm1(w) * b)
        rest = np.stack([np.bincount(h, weights=sent[:, g]) for g in range(N_GROUPS)], 1)[h] - sent
        other = np.exp(rest - rest.max(1, keepdims=True))
        after = b * (1 + np.expm1(w) * other / other.sum(1, keepdims=True))
        return float(np.log(after[np.arange(len(y)), y] / after.sum(1)).sum() - 0.5 * (w * w).sum())

    w = np.zeros(N_GROUPS)
    for _ in range(2):
        for g in range(N_GROUPS):
            tries = [np.where(np.arange(N_GROUPS) == g, x, w) for x in STRENGTHS]
            w = max(tries, key=fit)
    field.skip = w


def _doubt(field: Field, marg: list[np.ndarray], gold: list[np.ndarray]) -> float:
    """How much staying outside is to be worth less, so that of the recorded spans as many as can be
    are found by models that never saw them, and of what is found little is unrecorded: the best
    F2, as records miss spans and invent few."""
    best = (-1.0, 0.0)
    for doubt in (0.0, 0.35, 0.7, 1.05, 1.4):
        field.doubt = doubt
        hit = found = true = 0
        for lo in range(0, len(marg), 500):
            for y, path in zip(gold[lo : lo + 500], field.decode(marg[lo : lo + 500])):
                known = y >= 0
                a, b = {(i, j, y[i]) for i, j in _runs(np.where(known, y, 0))}, {(i, j, path[i]) for i, j in _runs(np.where(known, path, 0))}
                hit, found, true = hit + len(a & b), found + len(b), true + len(a)
        best = max(best, (5 * hit / max(1, 4 * true + found), -doubt))
    return -best[1]


def _runs(path) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(path):
        j = i + 1
        if LABELS[path[i]][0] == "B":
            while j < len(path) and path[j] == path[i] + 1:
                j += 1
            yield i, j
        i = j


def _mended(y: np.ndarray, path: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Labels of a block after a model that never saw it: what it is fairly sure of is added where
    nothing was recorded, what it finds out of the question is taken out; what was not known is
    what it says."""
    z = np.where(y < 0, 0, y)
    for i, j in _runs(y):
        if m[i:j, 0].mean() > 0.98:
            z[i:j] = 0
    for i, j in _runs(path):
        if not z[i:j].any() and 1 - m[i:j, 0].mean() > 0.4:
            z[i:j] = path[i:j]
    return z


def _told_shapes(sample: list[tuple[str, list[tuple[int, int, str]]]]) -> dict[tuple[str, str], str]:
    """For each shape of candidate what most of them were recorded as, if most of them were: the
    others were then overlooked."""
    all_of: Counter = Counter()
    as_kind: Counter = Counter()
    for text, spans in sample:
        plain, at = plain_form(text)
        if at is not None:
            continue
        for a, b, kind, shape in candidates(plain):
            all_of[kind, shape] += 1
            hit = [t for s, e, t in spans if t in _KINDS[kind] and min(e, b) - max(s, a) >= 0.6 * max(e - s, b - a)]
            if hit:
                as_kind[kind, shape, hit[0]] += 1
    return {(k, s): t for (k, s, t), n in as_kind.items() if n >= 3 and n >= 0.4 * all_of[k, s]}


def fold_token(w: str) -> str:
    """One form for a token and its look-alikes: no case, no accents, misread signs undone."""
    low = "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))
    return low.translate(str.maketrans("01!|5$@9", "olllssag"))


def tidy(start: int, end: int, kind: str, plain: str, cands: list[tuple[int, int, str, str]]) -> tuple[int, int] | None:
    """The exact check: a span of mail, phone or identity number takes the bounds of the candidate
    it lies on; without one it keeps its own, if it has the signs of an address or the digits of a
    number; titles and marks at the ends of names go."""
    want = {"EMAIL": "E", "PHONE": "N", "GOVERNMENT_ID": "NC"}.get(kind)
    if want:
        best = max((c for c in cands if c[2] in want), key=lambda c: min(end, c[1]) - max(start, c[0]), default=None)
        if best is not None and min(end, best[1]) > max(start, best[0]):
            start, end = best[0], best[1]
            if kind == "GOVERNMENT_ID" and (x := re.search(r",?\s*(?:ext\.?|extn\.?|extension|x)\s*\d+$", plain[start:end], re.IGNORECASE)):
                end = start + x.start()
            return start, end
        # no usual shape: the field's own bounds, if there is enough in them for one value
        while end > start and not plain[end - 1].isalnum():
            end -= 1
        while start < end and not (plain[start].isalnum() or (kind == "PHONE" and plain[start] in "+(")):
            start += 1
        value = plain[start:end]
        digits = sum(c.isdigit() for c in value)
        enough = {"EMAIL": bool(re.search(r"\w\s?@\s?\w+\s?\.\s?\w", value)), "PHONE": 7 <= digits <= 16 and digits * 2 >= len(value), "GOVERNMENT_ID": digits >= 6 and digits * 2 >= len(value)}
        return (start, end) if enough[kind] else None
    if kind == "ADDRESS":
        best = max((c for c in cands if c[2] == "A"), key=lambda c: min(end, c[1]) - max(start, c[0]), default=None)
        if best is not None and min(end, best[1]) > max(start, best[0]):
            # the second word of a town is told by the field alone
            longer = best[3] in ("de", "es", "fr") and re.fullmatch(rf"\s{_CAP}", plain[best[1] : end])
            return best[0], end if longer else best[1]
        end = start + len(re.sub(r"(?:,\s*[a-z]+|\s+[a-z]+)+$", "", plain[start:end]))
    while start < end and not (plain[start].isalnum() or (kind == "ADDRESS" and plain[start] in "#")):
        start += 1
    while end > start and not plain[end - 1].isalnum():
        if kind == "PERSON" and plain[end - 1] == "." and re.search(r"(?:^|[\s.])[^\W\d_]\.$", plain[start:end]) and plain[start:end].count(".") >= 1 and len(plain[start:end]) > 3:
            break
        end -= 1
    return (start, end) if end > start else None


def one_by_one(start: int, end: int, plain: str) -> list[tuple[int, int]]:
    """The names of a list that was read as one: parts between commas, but a surname with the given
    name or initials behind it stays one name."""
    if "," not in plain[start:end]:
        return [(start, end)]
    parts, at = [], start
    for piece in plain[start:end].split(","):
        a = at + len(piece) - len(piece.lstrip())
        parts.append((a, at + len(piece.rstrip())))
        at += len(piece) + 1
    words = [re.findall(r"[^\W\d_]{2,}(?:[-'’][^\W\d_]+)*", plain[a:b]) for a, b in parts]
    out, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and len(words[i]) == 1 and len(words[i + 1]) <= 1 and "." not in plain[parts[i][0] : parts[i][1]]:
            out.append((parts[i][0], parts[i + 1][1]))
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return [(a, b) for a, b in out if b > a]


class Reader:
    """Labels batches of blocks with a field; lives in a worker."""

    def __init__(self, field: Field):
        self.field = field

    def emissions(self, texts: list[str]) -> tuple[list[tuple], list[np.ndarray]]:
        """For each text what ``Field.read_all`` gives of it, and the scores of its tokens."""
        self.field.trim()
        read, emit, lo = [], [], 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and hi - lo < 4000 and size + len(texts[hi]) <= TOKENS_A_BATCH:
                size += len(texts[hi])
                hi += 1
            got, rows = self.field.read_all(texts[lo:hi])
            scores, at = self.field.scores(Field.features(rows)), 0
            for r in got:
                emit.append(scores[at : at + len(r[0])])
                at += len(r[0]) + 3
            read += got
            lo = hi
        return read, emit

    def labelled(self, emit: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Marginals and labels of chains; those of similar length pass messages together."""
        by = sorted(range(len(emit)), key=lambda i: len(emit[i]))
        marg: list = [np.zeros((0, len(LABELS)))] * len(emit)
        path: list = [np.zeros(0, np.int64)] * len(emit)
        i = 0
        while i < len(by):
            j = i
            while j < len(by) and (j - i + 1) * len(emit[by[j]]) <= TOKENS_A_BATCH // 4 and j - i < 2000:
                j += 1
            j = max(j, i + 1)
            got, _ = self.field.pass_messages([emit[k] for k in by[i:j]])
            for k, m, p in zip(by[i:j], got, self.field.decode(got)):
                marg[k], path[k] = m, p
            i = j
        return marg, path

    def batch(self, texts: list[str], heard: list[list[tuple[int, list[float]]]] | None = None) -> Iterator[tuple[list[tuple[int, int, str]], list[dict]]]:
        """For each text its spans (start, end, type in characters of the text) and its tied tokens:
        ``form``, ``token`` (its number), ``belief`` of each group and the messages it ``heard``, one
        log a group."""
        read, emit = self.emissions(texts)
        for i, told in enumerate(heard or ()):
            if told:
                emit[i] = emit[i].copy()
                for token, logs in told:
                    emit[i][token] += np.asarray(logs, np.float32)[GROUPS]
        marg, path = self.labelled(emit)
        for n, (toks, plain, places, cands, _) in enumerate(read):
            yield self.spans(toks, plain, places, cands, path[n]), self.tied(toks, plain, cands, marg[n], heard[n] if heard is not None else [])

    def whole(self, documents: list[str], texts: list[str], rounds: int) -> list[list[tuple[int, int, str]]]:
        """The spans of each text, all rounds of messages included; the texts are all those of their
        documents. The same as ``batch`` and ``_hubs`` in turn."""
        read, emit = self.emissions(texts)
        marg, path = self.labelled(emit)
        f, sizes = self.field, [len(r[0]) for r in read]
        begin = np.cumsum([0, *sizes])
        text_no = np.repeat(np.arange(len(read)), sizes)
        tie = f.tie[np.concatenate([r[4] for r in read])] if read else np.zeros(0, np.int64)
        for n, (toks, plain, _, cands, _) in enumerate(read):
            for i, form in f.odd_forms(plain, toks, cands).items():
                tie[begin[n] + i] = -1 if form is None else f.forms.setdefault(form, len(f.forms))
        at = np.flatnonzero(tie >= 0)
        doc_no = pd.factorize(np.array(documents, object))[0].astype(np.int64)
        _, hubs, n_tied = np.unique(doc_no[text_no[at]] * len(f.forms) + tie[at], return_inverse=True, return_counts=True)
        keep = n_tied[hubs] > 1
        at, hubs = at[keep], hubs[keep]
        if len(at):
            text_at = text_no[at]
            token_at = at - begin[text_at]
            starts = np.searchsorted(text_at, np.arange(len(texts) + 1))
            here = lambda n: slice(starts[n], starts[n + 1])
            believed = lambda m: np.clip(grouped(m), 1e-9, 1).astype(np.float32)
            belief, heard = believed(np.concatenate(marg)[at]), np.zeros((len(at), N_GROUPS), np.float32)
        for n in range(rounds if len(at) else 0):
            told, moved = hub_messages(hubs, belief, heard, self.field.skip, 0.5 if n >= DAMPED else 0.0)
            again = np.flatnonzero(np.bincount(text_at, weights=moved) > CHANGE)
            if not len(again):
                break
            fresh = []
            for k in again:
                e = emit[k].copy()
                e[token_at[here(k)]] += told[here(k)][:, GROUPS]
                fresh.append(e)
            for k, m, p in zip(again, *self.labelled(fresh)):
                marg[k], path[k] = m, p
            rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in again])
            belief[rows], heard[rows] = believed(np.concatenate([marg[k][token_at[here(k)]] for k in again])), told[rows]
        found: list = [[]] * len(read)
        for k in np.unique(text_no[np.concatenate(path) > 0]).tolist() if read else ():
            found[k] = self.spans(*read[k][:4], path[k])
        return found

    def spans(self, toks, plain, places, cands, path) -> list[tuple[int, int, str]]:
        if not self.field.trained or not path.any():
            return []
        out = []
        masked = [p.span() for p in _PLACEHOLDER.finditer(plain)] if "[" in plain or "<" in plain or "{" in plain else []
        for i, j in _runs(path):
            kind = LABELS[path[i]][2:]
            got = tidy(toks[i][0], toks[j - 1][1], kind, plain, cands)
            for a, b in one_by_one(*got, plain) if got and kind == "PERSON" else [got] if got else []:
                if not any(s < b and a < x for s, x in masked) and not any(s < b and a < x for s, x, _ in out):
                    out.append((a, b, kind))
        return [(s, t, k) if places is None else (places[s], places[t - 1] + 1, k) for s, t, k in out]

    def tied(self, toks, plain, cands, m, heard) -> list[dict]:
        ties = self.field.ties(plain, toks, cands) if len(m) else []
        if not ties:
            return []
        belief = np.clip(grouped(m[[i for i, _ in ties]]), 1e-9, 1)
        before = dict(heard)
        none = [0.0] * N_GROUPS
        return [{"form": form, "token": i, "belief": b, "heard": before.get(i, none)} for (i, form), b in zip(ties, belief.tolist())]


def hub_messages(hubs: np.ndarray, belief: np.ndarray, heard: np.ndarray, skip: np.ndarray, damp: float) -> tuple[np.ndarray, np.ndarray]:
    """``_hubs`` for tied tokens at hand: ``hubs`` has the number of the hub of each."""
    w, b, h = np.expm1(skip), belief.astype(np.float64), heard.astype(np.float64)
    own = b * np.exp(-h)
    says = np.log1p(w * own / own.sum(1, keepdims=True))
    rest = np.stack([np.bincount(hubs, weights=says[:, g]) for g in range(N_GROUPS)], 1)[hubs] - says
    parts = np.exp(rest - rest.max(1, keepdims=True))
    logs = np.log1p(w * parts / parts.sum(1, keepdims=True))
    told = (1.0 - damp) * (logs - logs[:, :1]) + damp * h
    after = b * np.exp(told - h)
    return told.astype(np.float32), np.abs(after / after.sum(1, keepdims=True) - b).sum(1) / 2


def _hubs(edges: DataFrame, skip: list[float], damp: float) -> DataFrame:
    """What the hubs tell the tied tokens (``edges``: keys, form, token, belief, heard): keys, token,
    ``told`` (a log message a group, 0 for outside) and ``moved``, by how much the token's belief
    would move. A token says what it believes without what the hub told it; a hub leaves out what
    the token itself said."""
    each, w = range(N_GROUPS), [float(np.expm1(x)) for x in skip]
    total = lambda name: reduce(lambda a, x: a + x, [F.col(f"{name}{g}") for g in each])
    log_of = lambda g, part, whole: F.log1p(F.lit(w[g]) * F.col(f"{part}{g}") / F.col(whole)) if w[g] else F.lit(0.0)

    def said(df: DataFrame) -> DataFrame:
        df = df.withColumns({f"b{g}": F.col("belief")[g].cast("double") for g in each} | {f"h{g}": F.col("heard")[g].cast("double") for g in each})
        df = df.withColumns({f"own{g}": F.col(f"b{g}") * F.exp(-F.col(f"h{g}")) for g in each}).withColumn("own_sum", total("own"))
        return df.withColumns({f"says{g}": log_of(g, "own", "own_sum") for g in each})

    hubs = said(edges).groupBy("document_id", "form").agg(F.count("*").alias("n"), *[F.sum(f"says{g}").alias(f"all{g}") for g in each]).filter("n > 1").drop("n")
    heard = said(edges.join(hubs, ["document_id", "form"])).withColumns({f"rest{g}": F.col(f"all{g}") - F.col(f"says{g}") for g in each})
    heard = heard.withColumn("top", F.greatest(*[f"rest{g}" for g in each])).withColumns({f"part{g}": F.exp(F.col(f"rest{g}") - F.col("top")) for g in each}).withColumn("part_sum", total("part"))
    heard = heard.withColumns({f"log{g}": log_of(g, "part", "part_sum") for g in each})
    fresh = [F.col(f"log{g}") - F.col("log0") for g in each]
    heard = heard.withColumns({f"told{g}": F.lit(1.0 - damp) * fresh[g] + F.lit(damp) * F.col(f"h{g}") if damp else fresh[g] for g in each})
    heard = heard.withColumns({f"after{g}": F.col(f"b{g}") * F.exp(F.col(f"told{g}") - F.col(f"h{g}")) for g in each}).withColumn("mass", total("after"))
    moved = reduce(lambda a, x: a + x, [F.abs(F.col(f"after{g}") / F.col("mass") - F.col(f"b{g}")) for g in each]) / 2
    return heard.select("document_id", "block_id", "token", F.array(*[F.col(f"told{g}").cast("float") for g in each]).alias("told"), moved.alias("moved"))


def _sample(blocks: DataFrame, entities: DataFrame) -> list[tuple[str, str, list[tuple[int, int, str]]]]:
    """At most ``SAMPLE`` blocks of documents with recorded spans, with their spans: half of them
    blocks with spans, a quarter any others, and a quarter the blocks of whole documents, in which
    tied tokens meet. Of a longer block the first ``SAMPLE_TEXT`` characters are learnt from."""
    ids = ["document_id", "block_id"]
    h, n = F.xxhash64(*ids), max(1, blocks.count())
    kind = F.upper(F.regexp_replace(F.trim("entity_type"), r"[\s-]+", "_"))
    seen = entities.select("document_id").distinct()

    def rows_of(blocks: DataFrame, entities: DataFrame) -> DataFrame:
        named = entities.withColumn("kind", kind).filter(F.col("kind").isin(list(TYPE_NAMES)))
        good = valid_spans(named, blocks).join(named.select(*ids, "span_start", "span_end", "kind", "confidence"), [*ids, "span_start", "span_end"])
        found = good.groupBy(*ids, "span_start", "span_end").agg(F.max_by("kind", "confidence").alias("kind")).groupBy(*ids).agg(F.collect_list(F.struct("span_start", "span_end", "kind")).alias("spans"))
        rows = blocks.filter("text is not null and text <> ''").join(seen, "document_id", "left_semi").dropDuplicates(ids).join(found, ids, "left")
        return rows.select("document_id", "block_id", F.substring("text", 1, SAMPLE_TEXT).alias("text"), F.filter(F.coalesce("spans", F.array().cast("array<struct<span_start:int,span_end:int,kind:string>>")), lambda x: x["span_end"] <= SAMPLE_TEXT).alias("spans"))

    def least(by: Column, parts: list[tuple[Column, int]]) -> list:
        """Of the rows of each part the given number with the least hashes. Only rows with hashes
        below a bound are put together; it is raised until every part has enough."""
        share = SPARE * sum(k for _, k in parts) / n
        while True:
            below = by < F.lit(int(share * 2**64) - 2**63) if share < 1 else F.lit(True)
            rows = rows_of(blocks.filter(below), entities.filter(below))
            rows = cut(rows) if share < 1 else rows
            got = [rows.filter(c).orderBy(by, h, *ids).limit(k).collect() for c, k in parts]
            if share >= 1 or all(len(g) == k for g, (_, k) in zip(got, parts)):
                return [r for g in got for r in g]
            share *= 8

    picked = least(h, [(F.size("spans") > 0, SAMPLE // 2), (F.size("spans") == 0, SAMPLE // 4)]) + least(F.xxhash64("document_id"), [(F.lit(True), SAMPLE // 4)])
    got = {(r["document_id"], r["block_id"]): r for r in picked}
    return [(k[0], r["text"], [(x["span_start"], x["span_end"], TYPE_NAMES[x["kind"]]) for x in sorted(r["spans"])]) for k, r in sorted(got.items(), key=lambda kr: zlib.crc32("/".join(map(str, kr[0])).encode()))]


def find_pii(blocks: DataFrame, entities: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per value: document_id, block_id, entity_type, span_start, span_end, in characters of
    the stored text, end exclusive. Spans of a block don't overlap.

    ``entities`` are the incomplete records to learn from; without any the field finds nothing.
    Blocks with null or empty text hold nothing; redelivered blocks count once. With ``rounds`` 0
    the chains alone decide; otherwise messages go round until no block's beliefs move by more than
    ``CHANGE``, ``rounds`` times at most."""
    ids = ["document_id", "block_id"]
    return label_blocks(blocks, learn(_sample(blocks.select(*ids, "text"), entities)), rounds)


def label_blocks(blocks: DataFrame, learnt: Field, rounds: int = ROUNDS) -> DataFrame:
    """``find_pii`` with a field that has been learnt."""
    ids = ["document_id", "block_id"]
    field = blocks.sparkSession.sparkContext.broadcast(learnt)  # its size is fixed: 2^BITS weights and the words of the sample
    rows = spread(blocks.select(*ids, "text").filter("text is not null and text <> ''"))
    sizes = cut(rows.groupBy("document_id").agg(F.sum(F.length("text") + BLOCK_COST).alias("size")))
    n, total = sizes.agg(F.count(F.when(F.col("size") > LOCAL_TEXT, 1)), F.sum("size")).first()
    large = sizes.filter(F.col("size") > LOCAL_TEXT).select("document_id")
    large = F.broadcast(large) if n <= BROADCAST else large
    # blocks without document are tied to nothing and need not come together
    alone = rows.filter("document_id is null")
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism * 2, -(-(total or 0) // TASK_TEXT))
    small = rows.filter("document_id is not null")
    small = (small.join(large, "document_id", "left_anti") if n else small).repartition(tasks, "document_id").sortWithinPartitions("document_id")

    def label_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, held = Reader(field.value), None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(held):
                continue
            last = int((held["document_id"] == held["document_id"].iat[-1]).to_numpy().argmax())
            yield from _label_documents(reader, held.iloc[:last], rounds)
            held = held.iloc[last:]
        if held is not None:
            yield from _label_documents(reader, held, rounds)

    found = small.mapInPandas(label_whole, "document_id string, block_id string, entity_type string, span_start int, span_end int")
    wide = rows.join(large, "document_id", "left_semi").unionByName(alone) if n else alone
    return found.unionByName(_label_spread(wide, field, rounds)) if wide.head(1) else found


def _label_documents(reader: Reader, b: pd.DataFrame, rounds: int) -> Iterator[pd.DataFrame]:
    """The spans of whole documents, some documents at a time."""
    b = b.drop_duplicates(["document_id", "block_id"])
    docs, blocks, texts = (b[c].tolist() for c in ("document_id", "block_id", "text"))
    lo = size = 0
    for hi in range(1, len(docs) + 1):
        size += len(texts[hi - 1])
        if hi == len(docs) or size >= CHUNK_TEXT and docs[hi] != docs[hi - 1]:
            out = [(docs[i], blocks[i], t, s, e) for i, spans in enumerate(reader.whole(docs[lo:hi], texts[lo:hi], rounds), lo) for s, e, t in spans]
            yield pd.DataFrame(out, columns=["document_id", "block_id", "entity_type", "span_start", "span_end"])
            lo, size = hi, 0


def _label_spread(rows: DataFrame, field, rounds: int) -> DataFrame:
    """``label_blocks`` for documents of any size: blocks are read anywhere, hubs gather the messages."""
    ids = ["document_id", "block_id"]
    texts = cut(rows.dropDuplicates(ids))
    schema = "document_id string, block_id string, spans array<struct<s:int,e:int,t:string>>, ties array<struct<form:string,token:int,belief:array<float>,heard:array<float>>>"

    def label(with_heard: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = Reader(field.value)
            for b in batches:
                for lo in range(0, len(b), 1000):
                    part = b.iloc[lo : lo + 1000]
                    heard = [[(x["token"], x["told"]) for x in e] for e in part["heard"]] if with_heard else None
                    got = list(reader.batch(part["text"].tolist(), heard))
                    yield pd.DataFrame({
                        "document_id": part["document_id"].values, "block_id": part["block_id"].values,
                        "spans": [[{"s": s, "e": e, "t": t} for s, e, t in g[0]] for g in got],
                        "ties": [g[1] for g in got],
                    })

        return run

    state = cut(texts.mapInPandas(label(False), schema))
    for n in range(rounds):
        edges = state.select(*ids, F.explode("ties").alias("x")).select(*ids, "x.*")
        told = _hubs(edges, field.value.skip.tolist(), 0.5 if n >= DAMPED else 0.0)
        # blocks whose beliefs rest keep their labels and the messages these were made with
        moved = cut(told.groupBy(*ids).agg(F.collect_list(F.struct("token", "told")).alias("heard"), F.sum("moved").alias("moved")).filter(F.col("moved") > CHANGE).drop("moved"))
        if not moved.head(1):
            break
        again = texts.join(moved, ids).mapInPandas(label(True), schema)
        state = cut(state.join(moved.select(*ids), ids, "left_anti").unionByName(again))
    found = state.select(*ids, F.explode("spans").alias("x"))
    return found.select(*ids, F.col("x.t").alias("entity_type"), F.col("x.s").alias("span_start"), F.col("x.e").alias("span_end"))


def replace_spans(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Blocks with ``clean_text``: each span replaced by ``[TYPE]``, all else unchanged. Spans must
    not overlap; blocks without spans keep their text; null text stays null."""
    ids = ["document_id", "block_id"]
    by = spans.groupBy(*ids).agg(F.array_sort(F.collect_set(F.struct("span_start", "span_end", "entity_type"))).alias("spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(F.concat(a["out"], F.substring("text", a["at"] + 1, x["span_start"] - a["at"]), F.lit("["), x["entity_type"], F.lit("]")).alias("out"), x["span_end"].alias("at"))
    done = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    return blocks.join(by, ids, "left").withColumn("clean_text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done)).drop("spans")
