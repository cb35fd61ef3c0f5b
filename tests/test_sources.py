"""Job descriptions and DOCX files."""

import io
import zipfile

from vellum.operators.targets import extract_targets, zones
from vellum.plans.terms import default_terms
from vellum.sources.docx import scan_docx

JD = """Senior Data Engineer
We build things with Python and PowerPoint for teams.
Requirements
SQL and Docker, knowledge of data modelling
Go or R
Nice to have
Kubernetes
Communication"""


def test_zones(spark):
    rows = zones(spark.createDataFrame([("j", JD)], "ctx_id string, text string")).orderBy("line_no").collect()
    assert [r.title for r in rows] == [True] + [False] * 7
    assert [r.required for r in rows] == [False, False, False, True, True, False, False, False]
    assert [r.optional for r in rows] == [False] * 6 + [True, True]


def test_targets(spark):
    rows = extract_targets(spark.createDataFrame([("j", JD), ("none", "...")], "ctx_id string, text string"), default_terms(spark)).collect()
    got = {r.term: (r.category, r.weight) for r in rows}
    assert {r.ctx_id for r in rows} == {"j"}
    assert got["sql"] == ("data", 3) and got["docker"][1] == 3 and got["python"][1] == 2
    assert got["kubernetes"][1] == 1 and got["communication"][1] == 1
    assert got["go"][1] == 2 and got["r"][1] == 2  # never required by the part, which is read in lower case
    assert got["powerpoint"] == ("named", 2) and got["data modelling"] == ("phrase", 3)


def docx(body, **parts):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", f"<w:hdr {ns}>{xml}</w:hdr>")
    return out.getvalue()


def test_docx_items(spark):
    p = lambda t, r="", q="": f"<w:p><w:pPr>{q}</w:pPr><w:r><w:rPr>{r}</w:rPr><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    body = p("Ada  Archer", '<w:b/><w:sz w:val="28"/>') + p("") + p("not bold", '<w:b w:val="0"/>') + p("item", "", "<w:numPr/>") + table
    rows = scan_docx(spark.createDataFrame([("x", bytearray(docx(body, header1=p("top")))), ("y", bytearray(b"PK no")), ("z", None)], "path string, content binary")).collect()
    good = sorted((r for r in rows if r.path == "x"), key=lambda r: r.stream_index)
    assert [(r.text, r.source, r.row, r.col, r.bold, r.font_size, r.bullet) for r in good] == [
        ("Ada Archer", "body", None, None, True, 14.0, False), ("not bold", "body", None, None, False, 11.0, False), ("item", "body", None, None, False, 11.0, True),
        ("a", "table", 0, 0, False, 11.0, False), ("b", "table", 0, 1, False, 11.0, False), ("top", "header", None, None, False, 11.0, False),
    ]
    assert {r.path: r.error for r in rows if r.path != "x"} == {"y": "corrupt", "z": "corrupt"}
