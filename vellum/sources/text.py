"""Scans of plain texts, markup and raw files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions.text import count_words, normal_heading

MAX_BYTES, MIN_CHARS, LINES_A_PAGE = 4 * 1024 * 1024, 40, 55


def file_kind(content: Column, path: Column) -> Column:
    """pdf, docx or text by magic bytes, then by extension; null if unknown."""
    head = F.hex(F.substring(content, 1, 4))
    name = F.lower(path)
    return F.when(head == "25504446", "pdf").when(head.startswith("504B"), "docx").when(name.rlike(r"\.pdf$"), "pdf").when(name.rlike(r"\.docx$"), "docx").when(name.rlike(r"\.(txt|md)$"), "text")


def scan_files(files: DataFrame) -> DataFrame:
    """Files as read by the binaryFile source -> path, kind, text and error; rejected files keep their row with the reason.

    Only text is decoded here; other known kinds are left to extractors of their own.
    """
    kind = file_kind(F.col("content"), F.col("path"))
    text = F.when(kind == "text", F.decode("content", "UTF-8"))
    error = (
        F.when(F.col("length") > MAX_BYTES, "too-large").when(kind.isNull(), "unsupported").when((kind == "text") & (F.length(F.trim(text)) < MIN_CHARS), "empty")
    )
    return files.select("path", kind.alias("kind"), F.when(error.isNull(), text).alias("text"), error.alias("error"))


def scan_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, text): the non-blank lines of each text, trimmed, numbered from 1. A text without any has no row."""
    rows = F.split(F.regexp_replace(F.col(text_col), r"\r\n?", "\n"), "\n")
    trimmed = F.filter(F.transform(rows, lambda r: F.regexp_replace(r, r"^\s+|\s+$", "")), lambda r: r != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(trimmed).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "text")


def page_count(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / LINES_A_PAGE)).alias("pages"))


def with_fonts(lines: DataFrame) -> DataFrame:
    """Lines of a text get the layout that plain text has: one page of body lines, known headings bold."""
    names = [n for s in P.HEADINGS.values() for n in s]
    # Most lines are long, and need no more tests.
    heading = (count_words(F.col("text")) <= 4) & normal_heading(F.col("text")).isin(*names)
    return lines.withColumns({"source": F.lit("body"), "page": F.lit(1), "bold": heading, "font_size": F.when(heading, 12.0).otherwise(11.0)})


def decode_entities(text: Column) -> Column:
    """Decimal and hexadecimal references, then the five named XML entities; the ampersand last."""
    reference = r"&#(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));"
    codes = F.zip_with(F.regexp_extract_all(text, F.lit(reference), F.lit(1)), F.regexp_extract_all(text, F.lit(reference), F.lit(2)), lambda h, d: F.when(h != "", F.conv(h, 16, 10)).otherwise(d).cast("int"))
    chars = F.transform(codes, lambda c: F.when(c.between(1, 0x10FFFF) & ~c.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")).otherwise("\ufffd"))
    text = F.when(text.contains("&#"), F.array_join(F.zip_with(F.split(text, reference, -1), chars, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")).otherwise(text)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


#: The attributes of a tag; a closing bracket inside quotes doesn't end it.
_ATTRIBUTES = r"""(?:\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+)?"""


def tag_texts(html: Column, tag: str) -> Column:
    """The texts of all elements of a tag, in order, without inner tags and with single spaces."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}{_ATTRIBUTES}>(.*?)</{tag}\s*>"), F.lit(1))
    return F.transform(inner, lambda t: decode_entities(F.trim(F.regexp_replace(F.regexp_replace(t, rf"</?[a-zA-Z][a-zA-Z0-9:-]*{_ATTRIBUTES}/?>|<!--.*?-->", ""), r"\s+", " "))))


def link_targets(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
