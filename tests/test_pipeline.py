from quillspan.plans import pipeline

B = "document_id string, block_ord long, block_id string, text string, extraction_method string, kind string, page_number int, slide_number int, table_number int, row_number int, column_number int"
F = "document_id string, scope_id string, doc_ord long, ocr_failed_pages array<int>"


def cell(i, t, r, k):
    return ("d", i, str(i), t, "native", "table_cell", None, None, 1, r, k)


def line(i, t, doc="d", method="native"):
    return (doc, i, str(i), t, method, "paragraph", 1, None, None, None, None)


def test_context_and_registry_are_part_of_the_run(spark):
    rows = [
        cell(1, "Mobile", 1, 1), cell(2, "Staff Code", 1, 2), cell(3, "Owner", 1, 3),
        cell(4, "5550123", 2, 1), cell(5, "V8R52A", 2, 2), cell(6, "Tobin Quarrel", 2, 3),
        line(7, "Zelda met Quarrel and T. Quarrel at noon"), line(8, "reach +1"), line(9, "(212) 555-0136 now"),
        line(1, "Tobin Quarrel wrote, no Quarrel was there", "e"), line(1, "Drafted by Orla Fenwick", "g", "embedded_image_ocr"),
    ]
    files = spark.createDataFrame([("d", "s", 1, []), ("e", "s", 2, []), ("g", "s", 3, [])], F)
    result = pipeline.run(spark.createDataFrame(rows, B), files)
    text = {(r.document_id, r.block_id): r.sanitized for r in result.sanitized.collect()}
    assert text["d", "4"] == "[PHONE_001]" and text["d", "5"] == "[EMPLOYEE_ID_001]" and text["d", "6"] == "[PERSON_001]"
    # one person, one token, in whatever form the name stands
    assert text["d", "7"] == "Zelda met [PERSON_001] and [PERSON_001] at noon"
    assert text["d", "8"].startswith("reach [PHONE_")
    # full names only where another document of the scope told the name
    assert text["e", "1"] == "[PERSON_001] wrote, no Quarrel was there"
    status = {r.document_id: (r.status, r.residual_count) for r in result.gate.collect()}
    # tokens under a personnel header are no residuals; a name in image text is for review
    assert status["d"] == ("APPROVED", 0) and status["e"] == ("APPROVED", 0) and status["g"] == ("BLOCKED", 0)
