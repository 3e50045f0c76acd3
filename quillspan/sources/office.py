"""Reading and rewriting DOCX and PPTX packages with the standard library, inside executors."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
SCHEMA = "document_id string, file_name string, file_type string, block_ord long, block_id string, text string, slide_number int, paragraph_number int, extraction_method string, kind string, table_number int, row_number int, column_number int, error string"
_FIELDS = ("block_id", "text", "slide_number", "paragraph_number", "kind", "table_number", "row_number", "column_number")


def _w_text(node: ET.Element) -> str:
    """Text of a paragraph without text boxes and without the fallback copies of drawings."""
    out = []
    for child in node:
        if child.tag in (f"{_MC}Fallback", f"{_W}txbxContent"):
            continue
        if child.tag == f"{_W}t":
            out.append(child.text or "")
        elif child.tag in (f"{_W}tab",):
            out.append("\t")
        elif child.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
        else:
            out.append(_w_text(child))
    return "".join(out)


def _boxes(node: ET.Element) -> Iterator[ET.Element]:
    for child in node:
        if child.tag == f"{_MC}Fallback":
            continue
        if child.tag == f"{_W}txbxContent":
            yield child
        yield from _boxes(child)


def docx_blocks(data: bytes) -> list[dict]:
    """Blocks in reading order: paragraphs and table cells (merged cells once), then text boxes,
    then headers and footers, each part once. Empty elements keep their numbers."""
    z = zipfile.ZipFile(io.BytesIO(data))
    body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out, para, tables = [], 0, 0
    for child in body:
        if child.tag == f"{_W}p":
            para += 1
            if (t := _w_text(child)).strip():
                out.append({"block_id": f"paragraph_{para}", "text": t, "paragraph_number": para, "kind": "paragraph"})
        elif child.tag == f"{_W}tbl":
            tables += 1
            for r, row in enumerate(child.findall(f"{_W}tr"), 1):
                c = 0
                for cell in row.findall(f"{_W}tc"):
                    pr = cell.find(f"{_W}tcPr")
                    span = pr.find(f"{_W}gridSpan") if pr is not None else None
                    merge = pr.find(f"{_W}vMerge") if pr is not None else None
                    c += 1
                    goes_on = merge is not None and merge.get(f"{_W}val", "continue") == "continue"
                    t = "\n".join(_w_text(p) for p in cell.findall(f"{_W}p"))
                    if t.strip() and not goes_on:
                        out.append({"block_id": f"table_{tables}_r{r}_c{c}", "text": t, "kind": "table_cell", "table_number": tables, "row_number": r, "column_number": c})
                    c += int(span.get(f"{_W}val", "1")) - 1 if span is not None else 0
    for n, box in enumerate(_boxes(body), 1):
        t = "\n".join(_w_text(p) for p in box.findall(f"{_W}p"))
        if t.strip():
            out.append({"block_id": f"text_box_{n}", "text": t, "kind": "text_box"})
    for kind in ("header", "footer"):
        for part in sorted(x for x in z.namelist() if re.fullmatch(rf"word/{kind}\d*\.xml", x)):
            for n, p in enumerate(ET.fromstring(z.read(part)).iter(f"{_W}p"), 1):
                if (t := _w_text(p)).strip():
                    out.append({"block_id": f"{part[5:-4]}_{n}", "text": t, "kind": kind})
    return out


def _a_paragraphs(node: ET.Element) -> str:
    return "\n".join("".join((x.text or "") if x.tag == f"{_A}t" else "\n" for x in p.iter() if x.tag in (f"{_A}t", f"{_A}br")) for p in node.findall(f"{_A}p"))


def pptx_blocks(data: bytes) -> list[dict]:
    """Blocks slide by slide: shapes through groups in their order, tables without spanned cells,
    then the speaker's notes, one block a slide."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    out: list[dict] = []
    tables = 0

    def shapes(tree: ET.Element, slide: int, path: str) -> None:
        nonlocal tables
        for i, sp in enumerate(tree, 1):
            if sp.tag == f"{_P}grpSp":
                shapes(sp, slide, f"{path}{i}_")
            elif sp.tag == f"{_P}sp" and (body := sp.find(f"{_P}txBody")) is not None:
                if (t := _a_paragraphs(body)).strip():
                    out.append({"block_id": f"slide_{slide}_shape_{path}{i}", "text": t, "slide_number": slide, "kind": "shape_text"})
            elif sp.tag == f"{_P}graphicFrame" and (tbl := sp.find(f".//{_A}tbl")) is not None:
                tables += 1
                for r, row in enumerate(tbl.findall(f"{_A}tr"), 1):
                    for c, cell in enumerate(row.findall(f"{_A}tc"), 1):
                        if cell.get("hMerge") or cell.get("vMerge") or (body := cell.find(f"{_A}txBody")) is None:
                            continue
                        if (t := _a_paragraphs(body)).strip():
                            out.append({"block_id": f"slide_{slide}_table_{path}{i}_r{r}_c{c}", "text": t, "slide_number": slide, "kind": "table_cell", "table_number": tables, "row_number": r, "column_number": c})

    slides = sorted((int(m[1]), x) for x in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", x)))
    for n, part in slides:
        tree = ET.fromstring(z.read(part)).find(f"{_P}cSld/{_P}spTree")
        if tree is not None:
            shapes(tree, n, "")
        rels = f"ppt/slides/_rels/slide{n}.xml.rels"
        notes = re.search(r'Target="\.\./(notesSlides/[^"]+)"', z.read(rels).decode()) if rels in names else None
        if notes and f"ppt/{notes[1]}" in names:
            t = "\n".join(x for x in (_a_paragraphs(b) for b in ET.fromstring(z.read(f"ppt/{notes[1]}")).iter(f"{_P}txBody")) if x.strip())
            if t.strip():
                out.append({"block_id": f"slide_{n}_notes", "text": t, "slide_number": n, "kind": "notes"})
    return out


READERS = {"docx": docx_blocks, "pptx": pptx_blocks}


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all DOCX and PPTX files under ``path``. A file that can't be read, or of another
    kind, comes out as one row with ``error`` and no text, and fails no other file. A document's id
    is a hash of its path, so files of one name in two folders stay two."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                name = p.rsplit("/", 1)[-1]
                ending = name.rsplit(".", 1)[-1].lower()
                base = {"document_id": hashlib.sha256(p.encode()).hexdigest()[:32], "file_name": name, "file_type": ending}
                try:
                    if ending not in READERS:
                        raise ValueError("unsupported file type")
                    found = READERS[ending](data)
                    rows = [{**base, "block_ord": i, "extraction_method": f"{ending}_native", "error": None, **{k: x.get(k) for k in _FIELDS}} for i, x in enumerate(found, 1)]
                except Exception as e:  # noqa: BLE001  one bad file is a row, not a failed job
                    rows = [{**base, "block_ord": 0, "block_id": None, "error": type(e).__name__}]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype(object).where(lambda d: d.notna(), None)

    return files.mapInPandas(run, SCHEMA)


def rewrite(data: bytes, pairs: list[tuple[str, str]]) -> tuple[bytes, int, int]:
    """The package with every value replaced by its token, in the text nodes of all XML parts also
    across formatting runs; core properties emptied: (package, replacements, left over)."""
    if not pairs:
        return data, 0, 0
    order = sorted(dict(pairs).items(), key=lambda x: -len(x[0]))
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(v) for v, _ in order) + r")(?!\w)")
    token = dict(order)
    src, done, left = zipfile.ZipFile(io.BytesIO(data)), 0, 0
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in src.infolist():
            raw = src.read(item)
            if item.filename == "docProps/core.xml":
                raw = re.sub(rb">[^<>]+<", b"><", raw)
            elif item.filename.endswith(".xml"):
                root = ET.fromstring(raw)
                for p in [x for x in root.iter() if x.tag in (f"{_W}p", f"{_A}p")]:
                    nodes = [t for t in p.iter() if t.tag in (f"{_W}t", f"{_A}t")]
                    text = "".join(t.text or "" for t in nodes)
                    for m in reversed(list(pattern.finditer(text))):
                        done += 1
                        at = 0
                        first = True
                        for t in nodes:
                            s = t.text or ""
                            a, b = max(m.start() - at, 0), min(m.end() - at, len(s))
                            at += len(s)
                            if a < b:
                                t.text = s[:a] + (token[m.group()] if first else "") + s[b:]
                                first = False
                    left += len(pattern.findall("".join(t.text or "" for t in nodes)))
                raw = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
            z.writestr(item, raw)
    return out.getvalue(), done, left


def redact_office(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Packages (document_id, content) rewritten with their document's pairs (document_id, value,
    token): document_id, content, replaced, left_over."""
    p = pairs.groupBy("document_id").agg(F.collect_set(F.struct("value", "token")).alias("pairs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [rewrite(c, [(x["value"], x["token"]) for x in (ps if ps is not None else [])]) for c, ps in zip(b["content"], b["pairs"])]
            yield pd.DataFrame({"document_id": b["document_id"], "content": [g[0] for g in got], "replaced": [g[1] for g in got], "left_over": [g[2] for g in got]})

    return files.select("document_id", "content").join(p, "document_id", "left").mapInPandas(run, "document_id string, content binary, replaced int, left_over int")
