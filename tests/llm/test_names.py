import random

import pytest

from quillspan.llm import names


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("cell", [200, 12, 4])
def test_radius_join_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(names, "CELL", cell)
    rng = random.Random(1)
    rows = [(rng.choice("gh"), "".join(rng.choice("abc") for _ in range(rng.randint(2, 7)))) for _ in range(150)] + [(None, "abc"), ("g", None)]
    df = spark.createDataFrame(rows, "g string, v string")
    got = [tuple(r) for r in names.radius_join(df, "g", "v", 2).collect()]
    full = set(r for r in rows if None not in r)
    assert len(got) == len(set(got)) and set(got) == {(g, a, b) for g, a in full for h, b in full if g == h and lev(a, b) <= 2}


def test_cells_are_bounded_and_hold_every_value_once(spark, monkeypatch):
    monkeypatch.setattr(names, "FAN", 3)  # more levels
    rng = random.Random(2)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(4, 8))) for _ in range(120)}
    df = spark.createDataFrame([("g", w) for w in words], "g string, v string")
    cells = names.metric_cells(df, "g", "v", 2).collect()
    homes = [r.v for r in cells if r.home]
    assert sorted(homes) == sorted(words)
    assert max(sum(1 for r in cells if r.home and r.cell == c) for c in {r.cell for r in cells}) <= names.CELL
    n = names.join_counts(df, "g", "v").first()
    assert n["values"] == len(words) and n.cells > 1 and n.found <= n.measured <= n.met


def test_components_contracted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(names, "NODES", 3)
    chain = [(f"n{i:03}", f"n{i + 1:03}", "s") for i in range(60)]
    random.Random(3).shuffle(chain)
    e = spark.createDataFrame(chain, "a string, b string, s string")
    assert {r.root for r in names.components(e, "s").collect()} == {"n000"}


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    assert {r.node: r.root for r in names.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_links(spark):
    same = ["Deborah Garnumont", "Garnumont, Deborah", "GARNUMONT Deborah", "Debbie Garnumont", "Deborha Garnumont", "Garnumont, D.P.", "Dr Deborah P. Garnumont", "Garnumont", "Deborah Gаrnumont", "Deborah G.", "deborah  garnumnot"]
    other = ["Deborah Fennelle", "Samuel Garnov", "Jürgen Tovsjö"]
    rows = [("s", i, n) for i, n in enumerate(same)] + [("s", 100 + i, n) for i, n in enumerate(other)] + [("z", 200, "Deborah Garnumont"), ("s", 300, None), ("s", 301, ""), (None, 302, "Deborah Garnumont")]
    # with two Deborahs of G. in the scope the short form would be open: Fennelle is none
    linked = names.link_names(spark.createDataFrame(rows + rows[:2], "scope string, key long, name string"), "scope", "key", "name")
    person = {r.key: r.person for r in linked.collect()}
    assert len({person[i] for i in range(len(same))}) == 1
    assert len({person[0], person[100], person[101], person[102], person[200], person[300], person[301]}) == 7 and 302 not in person
    pairs = {tuple(r) for r in names.mention_pairs(linked, "scope", "key").collect()}
    assert pairs == {(i, j) for i in range(len(same)) for j in range(i + 1, len(same))}


def test_open_short_forms_stay_apart(spark):
    rows = [("s", 1, "Anna Berg"), ("s", 2, "Paul Berg"), ("s", 3, "Berg"), ("s", 4, "P. Berg")]
    linked = names.link_names(spark.createDataFrame(rows, "scope string, key long, name string"), "scope", "key", "name")
    p = {r.key: r.person for r in linked.collect()}
    assert p[4] == p[2] and len({p[1], p[2], p[3]}) == 3
    assert names.link_names(spark.createDataFrame([], "scope string, key long, name string"), "scope", "key", "name").count() == 0


def test_two_edits_link_long_surnames_with_the_same_given_name(spark):
    rows = [("s", 1, "Orla Plinunez"), ("s", 2, "Orla Plmunez"), ("s", 3, "Tom Plmunez"), ("s", 4, "Ida Verso"), ("s", 5, "Ida Vorsa")]
    linked = names.link_names(spark.createDataFrame(rows, "scope string, key long, name string"), "scope", "key", "name")
    p = {r.key: r.person for r in linked.collect()}
    assert p[1] == p[2] and len({p[1], p[3], p[4], p[5]}) == 4
