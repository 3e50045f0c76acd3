import io
import time
import zipfile

import pytest

from quillspan.sources import labels, office
from quillspan.streaming.redaction import redacted_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
P = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    body = P("First") + P("") + "<w:p><w:r><w:t>Ann </w:t></w:r><w:r><w:t>Lee here</w:t></w:r></w:p>" + f"<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>{P('Head')}</w:tc><w:tc>{P('X')}</w:tc></w:tr><w:tr><w:tc>{P('1')}</w:tc><w:tc>{P('2')}</w:tc></w:tr></w:tbl>"
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/header1.xml": f"<w:hdr {W}>{P('Top')}</w:hdr>", "docProps/core.xml": "<c><a>Ann Lee</a></c>"})


def pptx():
    sp = "<p:sp><p:txBody><a:p><a:r><a:t>Hello</a:t></a:r></a:p></p:txBody></p:sp>"
    return package({
        "ppt/slides/slide1.xml": f"<p:sld {A}><p:cSld><p:spTree>{sp}<p:grpSp>{sp}</p:grpSp></p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": '<R><r Target="../notesSlides/notesSlide1.xml"/></R>',
        "ppt/notesSlides/notesSlide1.xml": f"<p:notes {A}><p:txBody><a:p><a:r><a:t>Say it</a:t></a:r></a:p></p:txBody></p:notes>",
    })


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.PPTX").write_bytes(pptx())
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.xyz").write_bytes(b"?")
    rows = office.read_office(spark, str(tmp_path)).collect()
    a = [(r.block_id, r.text) for r in sorted((r for r in rows if r.file_name == "a.docx"), key=lambda r: r.block_ord)]
    assert a == [("paragraph_1", "First"), ("paragraph_3", "Ann Lee here"), ("table_1_r1_c1", "Head"), ("table_1_r1_c3", "X"), ("table_1_r2_c1", "1"), ("table_1_r2_c2", "2"), ("header1_1", "Top")]
    assert [r.text for r in sorted((r for r in rows if r.file_name == "b.PPTX"), key=lambda r: r.block_ord)] == ["Hello", "Hello", "Say it"]
    assert {r.file_name for r in rows if r.error} == {"c.docx", "d.xyz"}


def test_rewrite_across_runs(spark):
    f = spark.createDataFrame([("d", docx()), ("e", docx())], "document_id string, content binary")
    p = spark.createDataFrame([("d", "Ann Lee", "[PERSON_001]")], "document_id string, value string, token string")
    got = {r.document_id: r for r in office.redact_office(f, p).collect()}
    assert got["d"].replaced == 1 and got["d"].left_over == 0 and got["e"].replaced == 0
    texts = [b["text"] for b in office.docx_blocks(bytes(got["d"].content))]
    assert "[PERSON_001] here" in texts and b"Ann" not in zipfile.ZipFile(io.BytesIO(bytes(got["d"].content))).read("docProps/core.xml")


def test_label_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("file,page,location_type,entity_type,value,uncertain,note\na.pdf,1,body,PERSON, Ann ,Yes,\na.pdf,,body,PERSON, ,no,\n")
    rows = labels.read_ground_truth(spark, str(tmp_path / "g.csv")).collect()
    assert [(r.value, r.uncertain, r.page) for r in rows] == [("Ann", True, "1")]
    (tmp_path / "h.csv").write_text("file,page\na,1\n")
    with pytest.raises(ValueError):
        labels.read_ground_truth(spark, str(tmp_path / "h.csv"))
    (tmp_path / "page_03.txt").write_text("# note\nline one\n")
    assert ("line one", 3) in {(r.text, r.page) for r in labels.read_transcriptions(spark, str(tmp_path / "page_03.txt")).collect()}


def test_lines_of_words(spark):
    w = spark.createDataFrame([("d", 1, 1, 1, 1, 2, "world", 30, 5, 20, 8), ("d", 1, 1, 1, 1, 1, "hello", 0, 4, 25, 10), ("d", 1, 1, 1, 1, 3, " ", 60, 4, 5, 5)], "document_id string, page int, block int, par int, line int, ord int, text string, left int, top int, width int, height int")
    r = labels.lines_of_words(w).first()
    assert (r.text, r.x0, r.y0, r.x1, r.y1) == ("hello world", 0, 4, 50, 14)


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("d", "1", "mail a@b.org"), ("d", "2", None)], "document_id string, block_id string, text string")
    df.write.parquet(str(tmp_path / "in"))
    q = redacted_stream(spark, str(tmp_path / "in"), df.schema).writeStream.format("memory").queryName("redacted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 60
    while q.isActive and time.time() < until:
        time.sleep(0.2)
    assert {r.block_id: r.sanitized for r in spark.table("redacted").collect()} == {"1": "mail [EMAIL]", "2": None}
