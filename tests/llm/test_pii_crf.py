import numpy as np
import pytest

from quillspan.llm import pii_crf as P


def test_candidates():
    found = lambda t: [t[s:e] for s, e, _, _ in P.candidates(t)]
    assert found("write m.lee at corp-group dot example now") == ["m.lee at corp-group dot example"]
    assert found("x-v.ax[at]corvane.co.example.") == ["x-v.ax[at]corvane.co.example"]
    assert found("+44 (0)7700 900 262 or 415-555-0193 ext. 245") == ["+44 (0)7700 900 262", "415-555-0193 ext. 245"]
    assert found("Flat 4, 246 Thornwick Row, Sonnerup QX7 4ZZ, please") == ["Flat 4, 246 Thornwick Row, Sonnerup QX7 4ZZ"]
    assert found("") == []


def test_plain_form_keeps_places():
    t = "ｍ​аil Zoë x"
    plain, at = P.plain_form(t)
    assert plain == "mail Zoë x" and [t[i] for i in at][:2] == ["ｍ", "а"]


def test_marginals_against_enumeration():
    from collections import Counter
    from itertools import product

    f = P.Field(Counter(), set())
    rng = np.random.default_rng(0)
    f.t[f.t > -20] = rng.normal(size=int((f.t > -20).sum()))
    emit = [rng.normal(size=(n, len(P.LABELS))).astype(np.float32) for n in (3, 1, 2)]
    got, _ = f.pass_messages(emit)
    for e, m in zip(emit, got):
        total = np.zeros_like(m)
        for path in product(range(len(P.LABELS)), repeat=len(e)):
            if P.LABELS[path[0]][0] == "I":
                continue
            w = np.exp(sum(e[i, y] for i, y in enumerate(path)) + sum(f.t[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                total[i, y] += w
        assert np.allclose(total / total.sum(1, keepdims=True), m, atol=1e-6)


def test_names_in_lists():
    t = "Ruskumont, Sunil, Yarczak, Alexander, Inés Creloden, B. Thalane"
    assert [t[a:b] for a, b in P.one_by_one(0, len(t), t)] == ["Ruskumont, Sunil", "Yarczak, Alexander", "Inés Creloden", "B. Thalane"]


@pytest.fixture(scope="module")
def tables(spark):
    first = "Anna Paul Greta Omar Lena Ivan Clara Hugo".split()
    last = "Berg Stone Valmor Quist Tarn Ossel Brand Fenn".split()
    blocks, spans = [], []
    for i in range(400):
        n = f"{first[i % 8]} {last[(i // 8) % 8]}"
        m, p = f"{n.split()[0].lower()}{i}@corp.org", f"+1 (503) 555-0{i % 1000:03d}"
        text = [f"The report was sent by {n} to {m} in May.", f"Call {n} under {p} today.", "The board met in June and the report was filed."][i % 3]
        blocks.append((f"d{i % 20}", f"b{i}", text))
        for v, kind in ((n, "PERSON"), (m, "Email Address"), (p, "phone_number")):
            if v in text and i % 7:
                spans.append((f"d{i % 20}", f"b{i}", text.index(v), text.index(v) + len(v), kind, 0.9))
    blocks += [("d0", "null", None), ("d0", "empty", ""), blocks[0]]
    b = spark.createDataFrame(blocks, "document_id string, block_id string, text string")
    e = spark.createDataFrame(spans, "document_id string, block_id string, span_start int, span_end int, entity_type string, confidence double")
    return b, e


def test_field_finds_what_the_records_miss(spark, tables):
    b, e = tables
    text = {r.block_id: r.text for r in b.collect()}
    found = P.find_pii(b, e).cache()
    rows = {(r.block_id, r.entity_type): text[r.block_id][r.span_start : r.span_end] for r in found.collect()}
    missed = [i for i in range(0, 400, 7)]
    for i in missed:
        t = text[f"b{i}"]
        if "@" in t:
            assert rows.get((f"b{i}", "EMAIL")) == t.split(" to ")[1].split(" in ")[0]
        if "+1" in t:
            assert rows.get((f"b{i}", "PHONE")) == t.split("under ")[1].split(" today")[0]
    people = [i for i in range(400) if i % 3 < 2]
    assert sum((f"b{i}", "PERSON") in rows for i in people) >= 0.97 * len(people)
    assert not any(k[0] in ("null", "empty") for k in rows)
    clean = {r.block_id: r.clean_text for r in P.replace_spans(b, found).collect()}
    assert clean["b1"].startswith("Call [PERSON] under [PHONE] today") and clean["null"] is None and clean["empty"] == ""


def test_nothing_to_learn_from(spark, tables):
    b, e = tables
    assert P.find_pii(b, e.limit(0)).count() == 0
    assert P.find_pii(b.limit(0), e).count() == 0


def test_hub_messages_against_enumeration(spark):
    rng = np.random.default_rng(4)
    f = P.Field(__import__("collections").Counter(), set())
    f.skip = np.array([0.3, 1.0, 0.0, 2.0, 0.5, 1.7])
    b = rng.dirichlet(np.ones(P.N_GROUPS), 3)
    heard = rng.normal(size=(3, P.N_GROUPS)) * 0.2
    rows = [("d", f"b{i}", "x", i, b[i].tolist(), heard[i].tolist()) for i in range(3)] + [("d", "b9", "alone", 0, b[0].tolist(), heard[0].tolist())]
    df = spark.createDataFrame(rows, "document_id string, block_id string, form string, token int, belief array<double>, heard array<double>")
    got = {r.block_id: r for r in P._hubs(df, f.skip.tolist(), 0.0).collect()}
    assert set(got) == {"b0", "b1", "b2"}
    psi = np.ones((P.N_GROUPS, P.N_GROUPS)) + np.diag(np.expm1(f.skip))
    own = b / np.exp(heard)
    own /= own.sum(1, keepdims=True)
    for i in range(3):
        rest = np.prod([psi @ own[j] for j in range(3) if j != i], axis=0)  # what the others say of each state of the hub
        message = psi @ (rest / rest.sum())
        assert np.allclose(np.exp(got[f"b{i}"].told), message / message[0], rtol=1e-5)
        after = own[i] * message
        assert abs(got[f"b{i}"].moved - np.abs(after / after.sum() - b[i]).sum() / 2) < 1e-9


def test_decoding_against_enumeration():
    from collections import Counter
    from itertools import product

    f = P.Field(Counter(), set())
    f.doubt = 0.35
    rng = np.random.default_rng(1)
    marg = [rng.dirichlet(np.full(len(P.LABELS), 0.4), n) for n in (1, 3, 2, 3)]
    for m, path in zip(marg, f.decode(marg)):
        worth = np.log(m + 1e-9)
        worth[:, 0] -= f.doubt
        ok = lambda p: P.LABELS[p[0]][0] != "I" and all(f.t[a, b] > -20 for a, b in zip(p, p[1:]))
        best = max(sum(worth[i, y] for i, y in enumerate(p)) for p in product(range(len(P.LABELS)), repeat=len(m)) if ok(p))
        assert ok(path) and abs(sum(worth[i, y] for i, y in enumerate(path)) - best) < 1e-9


def test_a_far_token_alone_makes_a_label_right(spark):
    rng = np.random.default_rng(2)
    name = lambda: "".join(rng.choice(list("bdgklmnrstvz")) + rng.choice(list("aeiou")) for _ in range(3)).capitalize()
    sample = []
    for i in range(300):
        n = name()
        sample.append((f"Dr. {n} signed the paper.", [(4, 4 + len(n), "PERSON")]))
        n = name()
        sample.append((f"{n} was seen in the list.", [(0, len(n), "PERSON")] if i % 4 == 0 else []))
    field = P.Field(__import__("collections").Counter(), {"signed", "the", "paper", "was", "seen", "in", "list"})
    field.train([P.gold_labels(field, t, s, {}) for t, s in sample], 20)
    field.trained = True
    field.skip = np.array([0, 0, 0, 0, 0, 4.0])
    rows = [("d", "b1", "Dr. Zarovu signed the paper."), ("d", "b2", "Zarovu was seen in the list."), ("e", "b3", "Zarovu was seen in the list."), ("d", "b4", "Mirago was seen in the list.")]
    b = spark.createDataFrame(rows, "document_id string, block_id string, text string")
    found = lambda rounds: {(r.block_id, r.entity_type, r.span_start, r.span_end) for r in P.label_blocks(b, field, rounds).collect()}
    near = {("b1", "PERSON", 4, 10)}
    assert found(0) == near and found(P.ROUNDS) == near | {("b2", "PERSON", 0, 6)}


def test_misread_and_small_repeats_are_tied():
    f = P.Field(__import__("collections").Counter(), {"the"})
    text = "Brooks and Bro0ks and brooks met the 4405 the. br.ooks@x.org"
    toks, _, plain, _, cands = f.read(text)
    forms = [form for _, form in f.ties(plain, toks, cands)]
    assert forms.count("brooks") == 3 and "the" not in forms and "44os" in forms
    assert not any(form == "ooks" for form in forms) and "Eooks" in forms


def test_whole_documents_give_what_hubs_over_the_cluster_give(spark, tables, monkeypatch):
    b, e = tables
    field = P.learn(P._sample(b, e))
    field.skip = np.array([0.75, 0.5, 0.5, 0.0, 0.0, 3.0])
    odd = spark.createDataFrame([("d1", "odd", "Bro0ks met Brooks\nand br00ks at a.berg@corp.org, then a . berg at corp dot org"), (None, "none", "Call Anna Berg today."), ("d1", "again", "Anna Berg"), ("d1", "again", "Anna Berg")], b.schema)
    rows = b.unionByName(odd)
    found = lambda rounds: sorted(map(str, P.label_blocks(rows, field, rounds).collect()))
    whole = [found(rounds) for rounds in (0, 1, P.ROUNDS)]
    with monkeypatch.context() as m:
        m.setattr(P, "LOCAL_TEXT", 0)  # every document counts as large
        assert whole == [found(rounds) for rounds in (0, 1, P.ROUNDS)]
    monkeypatch.setattr(P, "CHUNK_TEXT", 1)
    assert whole[2] == found(P.ROUNDS) and len(whole[2]) > 400


def test_bounded_documents_need_no_exchange_a_round(spark, tables):
    b, e = tables
    field = P.learn(P._sample(b, e))
    plan = P.label_blocks(b.filter("document_id is not null"), field)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas") == 1
