from quillspan.llm import scans

SCHEMA = "document_id string, block_id string, block_ord long, page_number int, extraction_method string, text string"


def blocks(spark):
    words = "the review board thanked the team for the refinery and the liquid emission of the branch well-known separately listed generator annex cover board what long".split()
    native = [("n", f"n{i}", i, None, "docx_native", " ".join(words)) for i in range(12)]
    scan = []
    for p in range(1, 6):
        head = "Annual Privacy Report" if p != 3 else "Annual Privacy Rep0rt"
        scan += [("s", f"p{p}a", 10 * p, p, "ocr", head + ("\nthe refi-\nnery was long, a well-\nknown branch" if p == 1 else "\nthe board")), ("s", f"p{p}b", 10 * p + 1, p, "ocr", "the team bo@rd listcd" if p == 2 else "more of the gene-" if p == 4 else "Totals\n926\n484" if p == 3 else "the emission" if p == 1 else "what was long"), ("s", f"p{p}c", 10 * p + 2, p, "ocr", f"- {p + 20} -")]
    scan.append(("s", "p5a2", 49, 5, "ocr", "rator in the annex"))
    return spark.createDataFrame(native + scan + scan[:3] + [("s", "x", 99, 9, "ocr", None), ("s", "y", 98, None, None, "the board")], SCHEMA)


def test_defects(spark):
    got = {(r.block_id, r.defect) for r in scans.find_defects(blocks(spark)).collect()}
    assert {b for b, d in got if d == "running_header"} == {f"p{p}a" for p in range(1, 6)}
    assert {b for b, d in got if d == "page_number"} == {f"p{p}c" for p in range(1, 6)}
    assert ("p1a", "hyphenation") in got and ("p4b", "hyphenation") in got and ("p2b", "misread") in got
    assert not any(b in ("x", "y", "p3b") for b, _ in got) and not any(b.startswith("n") for b, _ in got)


def test_repair(spark):
    got = {r.block_id: r.clean_text for r in scans.repaired(blocks(spark)).collect()}
    assert got["p1a"] == "the refinery was long, a well-known branch"
    assert got["p2b"] == "the team board listed" and got["p2c"] == "" and got["p4b"] == "more of the generator" and got["p5a2"] == "in the annex"


def test_edge_lines():
    assert scans.edge_line("Page 20 of 25")[1:] == ([20, 25], True, True)
    assert scans.edge_line("xvii")[1:3] == ([17], True)
    assert scans.edge_line("484")[1:] == ([484], True, False)
    assert scans.edge_line("Service Quality Surnmary")[0] == scans.edge_line("SERVICE QUALITY SUMMARY")[0]


def test_empty(spark):
    assert scans.find_defects(spark.createDataFrame([], SCHEMA)).count() == 0


def test_figures(spark):
    f = spark.createDataFrame([("s", "f", 1, 1, 2, "nery stands", 90.0), ("s", "f", 1, 1, 1, "the refi-", 0.8), ("s", "f", 1, 1, 1, "the refi-", 0.8), ("s", "f", 1, 1, 3, None, None)], "document_id string, block_id string, page_number int, figure_no int, line_no int, text string, confidence double")
    r = scans.repaired_figures(f, blocks(spark)).collect()
    assert [x.clean_text for x in r] == ["the refinery stands"] and 0.8 < r[0].confidence < 0.9
