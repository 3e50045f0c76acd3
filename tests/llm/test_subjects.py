import random

from quillspan.llm import subjects

WORDS = {"Law": "court clause statute appeal verdict tribunal".split(), "sport": "pitch league striker medal coach relay".split()}


def paragraph(rng, subject, n):
    w = WORDS.get(subject)
    return " ".join(f"We saw the {rng.choice(w)} and the {rng.choice(w)} again." if w else f"The {rng.choice(['sheet', 'office', 'folder'])} was filed on time." for _ in range(n))


def test_held_out(spark):
    rng = random.Random(2)
    docs, labels, truth = [], [], {}
    for i in range(240):
        s = [None, "Law", "sport"][i % 3]
        passing = paragraph(rng, "sport" if s == "Law" else "Law", 1) if i % 5 == 0 else ""
        docs.append((i, f"{paragraph(rng, s, 4)}\n\n{paragraph(rng, None, 2)} {passing}"))
        truth[i] = s
        if i < 150:
            labels.append((i, None if s is None else s.upper() if i % 2 else f" {s.lower()} "))
    docs += [(900, None), (901, ""), (902, paragraph(rng, "Law", 5) + "\n\n" + paragraph(rng, "sport", 5))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame(labels + labels[:9] + [(5000, "Law"), (3, "unknown")], "doc_id long, subject string")
    s = spark.createDataFrame([("Law",), ("sport",), (None,)], "subject string")
    got = {}
    for r in subjects.find_subjects(d, l, s).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in range(150, 240)]
    right = sum(got.get(i, set()) == ({truth[i]} - {None}) for i in held)
    assert right >= 0.97 * len(held)
    assert got[902] == {"Law", "sport"} and 900 not in got and 901 not in got
    assert subjects.find_subjects(d.limit(0), l, s).count() == 0
    assert subjects.find_subjects(d, l.limit(0), s).count() == 0


def test_paragraphs():
    assert len(subjects.paragraphs("One two three. Four five six.\n\n• Seven eight\n• Nine tenth")) == 2
    assert subjects.paragraphs(None) == [] and subjects.paragraphs("") == []


def test_every_rule_word_of_a_long_sentence_is_heard():
    many = [f"a{chr(97 + i)}x" for i in range(26)]
    judge = subjects.Judge({**{(w,): {"other": 0.01} for w in many}, ("yield", "zebra"): {"zoo": 9.0}}, {"other": 0.1, "zoo": 0.1})
    says = judge.sentence([*many, "zebra", "yield"])
    assert says["zoo"] > 0.9 > 0.2 > says["other"]


def test_text_without_stops_counts_as_several_sentences():
    judge = subjects.Judge({("court",): {"law": 6.0}}, {"law": 0.2})
    assert judge.document("the court has heard what all people said " * 9)["law"] >= 3
    assert [len(w) for w in subjects.paragraphs("alpha beta gamma. " + "delta " * 48)[0]] == [3, 12, 12, 12, 12]


def test_growth_against_all_bodies():
    """Every rule that brute force over all bodies leaves is mined, with the same counts."""
    from itertools import combinations

    rng = random.Random(4)
    order = "the was cell tower plant root tax bill".split()
    baskets = []
    for _ in range(160):
        s = rng.choice([("bio",), ("net",), ()])
        words = {w for w in order if rng.random() < {"the": 0.9, "was": 0.7, "cell": 0.5}.get(w, 0.15 + 0.4 * (bool(s) and (w in ("plant", "root")) == (s == ("bio",))))}
        baskets.append((tuple(w for w in order if w in words), s))
    mined = {}
    for item in order:
        rows = [(b[: b.index(item)], s, 1) for b, s in baskets if item in b]
        for body, n, heads in subjects._grown(item, rows, 4):
            mined[tuple(sorted(body))] = (n, dict(heads))
    for size in (1, 2, 3):
        for body in combinations(sorted(order), size):
            inside = [s for b, s in baskets if set(body) <= set(b)]
            if len(inside) < 4:
                assert body not in mined or mined[body][0] < 4
            elif body in mined:
                assert mined[body] == (len(inside), {h: k for h in ("bio", "net") if (k := inside.count((h,)))})
            else:  # left out: a part of it is as frequent, or was sure already
                parts = [[s for b, s in baskets if set(p) <= set(b)] for k in range(1, size) for p in combinations(body, k)]
                assert any(len(p) == len(inside) or max(p.count(("bio",)), p.count(("net",))) >= subjects.SURE * (len(p) + 1) for p in parts)


def test_words_that_tell_only_together(spark):
    rows = [(i, 0, ["net"] if i % 2 else ["bio"], ["cell", "tower" if i % 2 else "wall", "seen"]) for i in range(80)]
    rows += [(100 + i, 0, ["bio"] if i % 2 else ["net"], ["tower" if i % 2 else "wall", "built"]) for i in range(80)]
    rules, prior, rank = subjects.mine_rules(spark.createDataFrame(rows, "d long, n int, subjects array<string>, words array<string>"))
    assert rules[("cell", "tower")].keys() == {"net"} and rules[("cell", "wall")].keys() == {"bio"}
    assert ("cell",) not in rules or max(rules[("cell",)].values()) < 0.5
    assert ("cell", "seen", "tower") not in rules and rank["cell"] == 80 and prior == {"net": 0.5, "bio": 0.5}
