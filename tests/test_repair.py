import pytest

from quillspan.operators import repair

B = "document_id string, block_id string, block_ord long, text string, extraction_method string, page_number int, slide_number int, image_name string, figure_no int, boxes array<array<int>>"
E = "document_id string, block_id string, span_start int, span_end int, entity_type string, confidence double, detector string"
P = "scope_id string, first_name string, last_name string, middles array<string>, name_initial string"


@pytest.fixture
def lines(spark):
    def make(texts, method="ocr", boxes=None, doc="d", page=1, start=0):
        return spark.createDataFrame([(doc, f"b{start + i}", start + i, t, method, page, None, None, None, boxes[i] if boxes else None) for i, t in enumerate(texts)], B)

    return make


@pytest.fixture
def found(spark):
    return lambda rows: spark.createDataFrame([("d", b, s, e, k, 0.9, "x") for b, s, e, k in rows], E)


@pytest.fixture
def people(spark):
    return lambda *names: spark.createDataFrame([("d", f, last, [], None) for f, last in names], P)


def spans(df, blocks):
    text = {(r.document_id, r.block_id): r.text for r in blocks.collect()}
    return sorted((r.block_id, r.entity_type, text[r.document_id, r.block_id][r.span_start : r.span_end]) for r in df.collect())


def test_initials_of_the_line_above(lines, found, people):
    b = lines(["M", "Corvell", "D", "uarkington", "HR", "Corvell", "by (A. P.", "Corvell)", None])
    e = found([("b1", 0, 7, "PERSON"), ("b5", 0, 7, "PERSON"), ("b7", 0, 7, "PERSON")])
    got = spans(repair.wrapped_initials(b, e, people(("M", "Corvell"), ("D", "Quarkington"))), b)
    assert got == [("b0", "PERSON", "M"), ("b2", "PERSON", "D"), ("b3", "PERSON", "uarkington"), ("b6", "PERSON", "A. P.")]


def test_wrapped_values(lines, found):
    b = lines(["call +1 (212) or", "nothing here", "555-0136 now", "MER- x", "and PH-2214.", "+91 98860", "55107 rest", "+1 14 Mar", "(212) 555-0108"])
    e = found([("b2", 0, 8, "PHONE_NUMBER"), ("b5", 0, 9, "PHONE_NUMBER"), ("b8", 0, 14, "PHONE_NUMBER")])
    got = spans(repair.wrapped_values(b, e), b)
    assert ("b0", "PHONE_NUMBER", "+1 (212)") in got and ("b6", "PHONE_NUMBER", "55107") in got
    assert ("b3", "EMPLOYEE_ID", "MER-") in got and ("b4", "EMPLOYEE_ID", "PH-2214") in got
    assert ("b7", "PHONE_NUMBER", "+1") in got and not any(v.startswith("+1 14") for _, _, v in got)


def test_damaged_mail_and_names(lines, found, people):
    b = lines(["write ann@acmecorp.com", "or enily martinez @acmecerp com now", "see @acmecorp for more", "davis@oacmecorp.com", "by J. Szewezyk and Brand", "H, Vorstermann", "lfeoma Okafor"])
    e = found([("b0", 6, 22, "EMAIL_ADDRESS"), ("b5", 3, 14, "PERSON"), ("b6", 7, 13, "PERSON")])
    got = spans(repair.damaged_emails(b, e), b)
    assert ("b1", "EMAIL_ADDRESS", "enily martinez @acmecerp com") in got and ("b3", "EMAIL_ADDRESS", "davis@oacmecorp.com") in got and not any(k == "b2" for k, _, _ in got)
    assert spans(repair.damaged_surnames(b, people((None, "Szewczyk"), ("A", "Brandt"))), b) == [("b4", "PERSON", "Brand"), ("b4", "PERSON", "Szewezyk")]
    assert spans(repair.initials_before(b, e), b) == [("b5", "PERSON", "H, Vorstermann")]
    assert spans(repair.registered_first_names(b, e, people(("Ifeoma", "Okafor"))), b) == [("b6", "PERSON", "lfeoma Okafor")]
    native = b.selectExpr("document_id", "block_id", "block_ord", "text", "'pdf_native' as extraction_method", "page_number", "slide_number", "image_name", "figure_no", "boxes")
    assert repair.damaged_surnames(native, people((None, "Szewczyk"))).count() == 0 and repair.damaged_emails(native, e).count() == 0


def test_identifiers_and_glued_characters(lines, found):
    b = lines(["Passpon TK4820913", "PAN AQERPR7741L", "host 198.51,100.62", "999.51,100.62", "DOB 0912/1994", "Date of birth:", "28 February 1979", "5555 0121", "Bnghtwe'!l, x", "t lindavist@q.org"])
    got = spans(repair.damaged_identifiers(b), b)
    assert got == [("b0", "GOVERNMENT_ID", "TK4820913"), ("b1", "GOVERNMENT_ID", "AQERPR7741L"), ("b2", "IP_ADDRESS", "198.51,100.62"), ("b4", "DATE_OF_BIRTH", "0912/1994"), ("b6", "DATE_OF_BIRTH", "28 February 1979")]
    e = found([("b7", 1, 9, "PHONE_NUMBER"), ("b8", 0, 7, "PERSON"), ("b9", 2, 17, "EMAIL_ADDRESS")])
    assert spans(repair.attached_characters(b, e), b) == [("b7", "PHONE_NUMBER", "5555 0121"), ("b8", "PERSON", "Bnghtwe'!l"), ("b9", "EMAIL_ADDRESS", "t lindavist@q.org")]


def row(y, *cells):
    """Words and boxes of a line whose cells begin at x: (x, text)."""
    text, boxes = [], []
    for x, cell in cells:
        for w in cell.split(" "):
            text.append(w)
            boxes.append([x, y, x + 10 * len(w), y + 10])
            x += 10 * len(w) + 5
    return " ".join(text), boxes


def test_people_column_of_a_table(lines):
    table = [row(0, (0, "Group name"), (200, "Number of users"), (450, "Created by"), (650, "Created date")), row(20, (0, "Risk"), (200, "12"), (450, "Tobin Read"), (650, "May")), row(40, (0, "Audit"), (200, "3"), (450, "Dayo Seton"), (650, "June")), row(60, (0, "Sync"), (200, "1"), (450, "OneTrust User"), (650, "June")), row(80, (0, "Prose begins here")), row(100, (0, "Other"), (200, "2"), (450, "Mara Quill"), (650, "July"))]
    b = lines([t for t, _ in table], "embedded_image_ocr", [x for _, x in table])
    assert spans(repair.people_columns(b), b) == [("b1", "PERSON", "Tobin Read"), ("b2", "PERSON", "Dayo Seton")]


def test_births_and_figures_by_place(lines, found, spark):
    form = [row(0, (0, "DATE OF BIRTH")), row(12, (0, "28 February 1979")), row(200, (0, "12 May 2001"))]
    b = lines([t for t, _ in form], boxes=[x for _, x in form])
    assert spans(repair.births_below(b), b) == [("b1", "DATE_OF_BIRTH", "28 February 1979")]
    fig = lines(["28 Februa 1979"], "figure_ocr", [row(12, (0, "28 Februa 1979"))[1]], start=50)
    both = b.unionByName(fig)
    e = found([("b50", 0, 14, "DATE_OF_BIRTH")])
    assert spans(repair.figure_duplicates(both, e), both) == [("b1", "DATE_OF_BIRTH", "28 February 1979")]
    people = spark.createDataFrame([], P)
    assert spans(repair.repaired(both, e, people), both) == [("b1", "DATE_OF_BIRTH", "28 February 1979")]
    assert repair.repaired(both.limit(0), e.limit(0), people).count() == 0
