import random
import unicodedata

from quillspan.llm.unicode_form import usual_form

SCHEMA = "id string, text string"


def run(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], SCHEMA)
    return {int(r.id): (r.clean_text, r.is_case) for r in usual_form(df, ["id"], "text").collect()}


def test_cases_and_traps(spark):
    rows = [
        ("ｍａｉｌ to а@b", "mail to a@b", True), ("café", "café", True), ("of the", "of the", True), ("f‌ell in", "fell in", True), ("low‐level", "low-level", True), ("ﬁeld 𝟧𝟧", "field 55", True), ("the СОО was", "the COO was", True), ("Мichаel", "Michael", True), ("300 K", "300 K", True),
        ("Ångholm résumé", "Ångholm résumé", False), ("«договор» с отделом", "«договор» с отделом", False), ("Έκθεση", "Έκθεση", False), ("“a” – b… ½ m² 5º ™", "“a” – b… ½ m² 5º ™", False), ("👩‍💻 ok", "👩‍💻 ok", False), ("divi¬\ndend", "divi¬\ndend", False), ("第三版。報告書", "第三版。報告書", False), ("plain", "plain", False), ("", "", False), (None, None, False),
        ("á̧", "á̧".replace("á̧", unicodedata.normalize("NFC", "á̧")), True), ("한", "한", True),
    ]
    got = run(spark, [t for t, _, _ in rows])
    for i, (t, clean, case) in enumerate(rows):
        assert got[i] == (clean, case), (t, got[i])


def test_composition_equals_nfc(spark):
    rng = random.Random(3)
    letters = "aeouAEnçéöǘạ" + "̧̣́̈̂̊"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert got[i][0] == unicodedata.normalize("NFC", t), repr(t)


def test_repeats_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("1", "ｘ", "a", 1, "c")] * 3, "id string, text string, k string, run int, ch string")
    assert [tuple(r) for r in usual_form(df, ["id"], "text").collect()] == [("1", "ｘ", "x", True)]
    assert usual_form(spark.createDataFrame([], SCHEMA), ["id"], "text").count() == 0
    long = "ab " * 20000 + "ｃ"
    assert run(spark, [long])[0] == (long[:-1] + "c", True)
