import random

import numpy as np

from quillspan.llm import leakage


def text(rng, n, words="alpha beta gamma delta omega river stone cloud winter lantern copper meadow".split()):
    return [rng.choice(words) + str(rng.randint(0, 60)) for _ in range(n)]


def ranked(words, i):
    """A suffix up to its first 0, which is like no other."""
    out = []
    for k in range(i, len(words)):
        out.append((1, int(words[k])) if words[k] else (0, k))
        if not words[k]:
            break
    return out + [(-1, 0)]


def test_suffix_array_and_search_against_brute_force():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, 400)
    order = leakage.suffix_array(words)
    assert list(order) == sorted(np.flatnonzero(words > 0), key=lambda i: ranked(words, i))
    wanted = np.unique(rng.integers(1, 4, (30, 3)), axis=0)
    rows, low, high = leakage.search(words, order, wanted, 3)
    found = {int(r): {int(x) for x in order[a:b]} for r, a, b in zip(rows, low, high)}
    for i, w in enumerate(wanted):
        assert found.get(i, set()) == {j for j in range(398) if tuple(words[j : j + 3]) == tuple(w)}
    one = np.array([1, 2] * 3000)
    assert list(leakage.suffix_array(one)) == sorted(range(6000), key=lambda i: (one[i], -i))  # long repeats are sorted to the end


def test_longest_matches_against_brute_force(monkeypatch):
    monkeypatch.setattr(leakage, "HITS", 7)
    rng = np.random.default_rng(2)
    words = rng.integers(0, 4, 300)
    s = leakage.Searcher([(k, [f"w{x}" for x in rng.integers(1, 4, 25)]) for k in range(3)], 20, 2)
    code = {v: k for k, v in s.ids.items()}
    words = np.array([s.ids.get(f"w{x}", 0) for x in words])
    order = leakage.suffix_array(words)
    rows, low, high = leakage.search(words, order, s.wanted, 2)
    suffix, lo, hi = [], [], []
    for r, a, b in zip(rows, low, high):
        for k in range(s.first[r], s.first[r + 1]):
            suffix.append(s.suffix[s.by[k]])
            lo.append(a)
            hi.append(b)
    got = sorted(tuple(map(int, x)) for part in leakage.longest_matches(words, order, s.flat, np.array(suffix), np.array(lo), np.array(hi), 2) for x in zip(*part))
    want = []
    for j in np.flatnonzero(s.flat):
        for i in np.flatnonzero(words):
            n = 0
            while i + n < len(words) and words[i + n] and words[i + n] == s.flat[j + n]:
                n += 1
            if n >= 2 and not (i and words[i - 1] and words[i - 1] == s.flat[j - 1]):
                want.append((int(j), int(i), n))
    assert len(code) == 3 and got == sorted(want)


def test_planted_passages(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_WORDS", 300)
    rng = random.Random(5)
    items = [(i, " ".join(text(rng, 60))) for i in range(8)]
    w = items[0][1].split()
    swapped = [x if k % 11 else "other" for k, x in enumerate(w[:45])]
    fill = lambda: text(rng, 80, ["zinc", "yew", "xenon"])
    docs = [
        (1, " ".join(fill() + w[5:35] + fill())), (2, " ".join(fill() + w[5:24] + fill())), (3, " ".join(fill() + swapped + fill())), (4, "\n".join(fill() + [x.upper() + "," for x in w[20:45]])),
        (5, " ".join(fill())), (6, None), (7, ""), (8, " ".join(fill() + w[5:35] + items[3][1].split()[10:40])), (9, " ".join(w[:15] + fill() + w[40:55])),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    e = spark.createDataFrame(items + items[:1] + [(99, None), (98, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, e).collect()}
    assert got == {(1, 0), (3, 0), (4, 0), (8, 0), (8, 3)}
    clean = leakage.without_leaks(d, leakage.find_leaks(d, e))
    assert {r.doc_id for r in clean.collect()} == {2, 5, 6, 7, 9}
    monkeypatch.setattr(leakage, "ITEM_WORDS", 100)
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, e).collect()} == got
    assert leakage.find_leaks(d.limit(0), e).count() == 0
    assert leakage.find_leaks(d, e.limit(0)).count() == 0


def test_long_documents_spacing_and_places(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_WORDS", 250)
    rng = random.Random(6)
    item = text(rng, 40)
    spaced = item[:10] + [item[10] + item[11]] + item[12:20] + [item[20][:3], item[20][3:]] + item[21:30]
    filler = lambda n: text(rng, n, ["zinc", "yew", "xenon"])
    docs = [(1, " ".join(filler(5000) + item[3:33] + filler(900))), (2, " ".join(filler(30) + spaced)), (3, " ".join(filler(20) + item[:14] + filler(12) + item[14:30]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in leakage.find_leaks(d, e).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].row_words, got[1].row_start, got[1].doc_start, got[1].verbatim_words) == (30, 3, 5000, 30)
    assert got[2].doc_start == 30 and got[2].row_words == 30 and got[3].row_words == 30 and got[3].doc_start == 20


def test_scan_damage_folds():
    assert [leakage.fold_word(w) for w in ("explained", "vanished", "with")] == [leakage.fold_word(w) for w in ("explainecl", "vani5hed", "witb")]
    assert leakage.words_of("The circ-\nular, so-called “Résumé”!") == ["the", "circular", "socalled", "resume"]
    assert leakage.words_of(None) == []
