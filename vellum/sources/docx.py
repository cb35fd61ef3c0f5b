"""Scan of DOCX files: body paragraphs and table cells in order, page headers and footers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, stream_index int, text string, source string, table_id string, row int, col int, bold boolean, font_size double, bullet boolean, error string"


def _on(node: ElementTree.Element | None) -> bool:
    """Whether a toggle is on: present without a value, or with one other than 0, false or off."""
    return node is not None and node.get(f"{W}val") not in ("0", "false", "off")


def _paragraph(p: ElementTree.Element) -> dict | None:
    texts, bold, total, sizes = [], 0, 0, []
    for run in p.iter(f"{W}r"):
        text = "".join({f"{W}tab": "\t", f"{W}br": " "}.get(x.tag, x.text or "") for x in run if x.tag in (f"{W}t", f"{W}tab", f"{W}br"))
        texts.append(text)
        n = len("".join(text.split()))
        total += n
        bold += n * _on(run.find(f"{W}rPr/{W}b"))
        if (size := run.find(f"{W}rPr/{W}sz")) is not None:
            sizes.append(float(size.get(f"{W}val", "22")) / 2)
    text = " ".join("".join(texts).split())
    if not text:
        return None
    return {"text": text, "bold": total > 0 and bold / total >= 0.8, "font_size": max(sizes, default=11.0), "bullet": p.find(f"{W}pPr/{W}numPr") is not None}


def _walk(node: ElementTree.Element, at: dict, tables: list[int]) -> Iterator[dict]:
    for child in node:
        if child.tag == f"{W}p":
            if found := _paragraph(child):
                yield at | found
        elif child.tag == f"{W}tbl":
            tables[0] += 1
            own = f"T{tables[0]}"
            for r, row in enumerate(child.findall(f"{W}tr")):
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    yield from _walk(cell, at | {"source": "table", "table_id": own, "row": r, "col": c}, tables)
        else:
            yield from _walk(child, at, tables)


def items_of(content: bytes) -> list[dict]:
    """The text items of one file; raises on what is no DOCX."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [("word/document.xml", "body"), *((n, "header" if "header" in n else "footer") for n in sorted(z.namelist()) if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"))]
        tables = [0]
        return [x for name, source in parts for x in _walk(ElementTree.fromstring(z.read(name)), {"source": source, "table_id": None, "row": None, "col": None}, tables)]


def scan_docx(files: DataFrame) -> DataFrame:
    """Files (path, content) -> their items in order; an unreadable file is one row with the error `corrupt`."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.bool_(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [{"path": path, "stream_index": i, "error": None} | x for i, x in enumerate(items_of(content.as_py() or b""))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = [{"path": path, "error": "corrupt"}]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
