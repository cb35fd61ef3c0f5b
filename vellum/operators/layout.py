"""What a screening parser loses of a document's layout: regions, columns, tables, boxes, images and order.

items: (doc_id, stream_index, text, page, x, y, w, h, source, table_id, row, col), from any
extractor; source is body, table, header, footer or textbox.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions.text import in_unit
from vellum.operators.geometry import displaced, flattened_tables, two_columns
from vellum.operators.visual import machine_rows

#: Bands of a page that are its header and footer, and texts that a running header or footer has; fixed values.
HEADER_BAND, FOOTER_BAND = 0.055, 0.945
HEADER_TEXT = r"(?i)@|\+?\d[\d\s().-]{7,}|linkedin\.com|github\.com|https?://"
FOOTER_TEXT = r"(?i)^page\s*\d+|^\d+\s*(of|/)\s*\d+$|^\d{1,2}$|@|\+?\d[\d\s().-]{7,}|confidential|résumé|resume|curriculum|linkedin|github"
#: Bytes over which a file is large, and fields of contact that a parser looks for; fixed values.
LARGE, CONTACT_FIELDS = 2 * 1024 * 1024, ("email", "phone", "linkedin", "github")
LOOSE = ("header", "footer", "textbox")


@dataclass(frozen=True)
class Layout:
    """items; images (doc_id, page, description); files (doc_id, file_type, file_size, declared_columns), one row for each document; hold: what to do with the parted pages, which several rules read, such as writing them, if anything."""

    items: DataFrame
    images: DataFrame
    files: DataFrame
    hold: Callable[[DataFrame], DataFrame] | None = None

    @cached_property
    def parted(self) -> DataFrame:
        """(doc_id, page, divider, columns) of the pages that a wide gap parts."""
        pages = two_columns(self.items)
        return pages if self.hold is None else self.hold(pages)


def with_regions(items: DataFrame) -> DataFrame:
    """Items with x, y, w and h within the page and source set by place: what stands in a page's header band and says so, or says the same on another page, is header; likewise footers."""
    boxed = items.withColumns({c: in_unit(F.col(c)) for c in ("x", "y", "w", "h")})
    bare, high = F.trim("text"), (F.col("y") + F.col("h") < HEADER_BAND) & (F.col("source") == "body")
    repeats = boxed.filter(high).groupBy("doc_id", bare.alias("__said")).agg(F.count_distinct("page").alias("__pages")).filter("__pages > 1")
    joined = boxed.withColumn("__text", bare).join(repeats, (boxed["doc_id"] == repeats["doc_id"]) & (F.col("__text") == F.col("__said")), "left").drop(repeats["doc_id"])
    header = high & (bare.rlike(HEADER_TEXT) | F.col("__pages").isNotNull())
    footer = (F.col("y") > FOOTER_BAND) & (F.col("source") == "body") & (bare.rlike(FOOTER_TEXT) | (F.length(bare) < 4))
    return joined.withColumn("source", F.when(header, "header").when(footer, "footer").otherwise(F.col("source"))).drop("__text", "__said", "__pages")


def column_counts(layout: Layout) -> DataFrame:
    """(doc_id, columns): the most columns of a page, or those that the file declares; a row for each document."""
    pages = layout.parted.groupBy("doc_id").agg(F.max("columns").alias("seen"))
    return layout.files.join(pages, "doc_id", "left").select("doc_id", F.greatest(F.lit(1), F.coalesce("seen", F.lit(1)), F.coalesce("declared_columns", F.lit(1))).alias("columns"))


def _in_order(text: Column, by: str, most: int, sep: str, left: int) -> Column:
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.col(by), text.alias("t")))), 1, most)
    return F.left(F.array_join(F.transform(first, lambda x: x["t"]), sep), F.lit(left))


def dropped_elements(layout: Layout) -> DataFrame:
    """(doc_id, kind, place, line_no, n, text, severity): header, footer and textbox texts, tables, columns, and pages with images; place: the table or page."""
    items, at = layout.items, F.min("stream_index").cast("int").alias("line_no")
    joined = _in_order(F.trim("text"), "stream_index", 1 << 20, " · ", 4000)
    loose = items.filter(F.col("source").isin(*LOOSE)).groupBy("doc_id", F.col("source").alias("kind")).agg(F.lit("").alias("place"), at, F.count("*").alias("n"), joined.alias("text"))
    contact = F.col("text").rlike(P.EMAIL) | F.col("text").rlike(P.PHONE)
    loose = loose.withColumn("severity", F.when((F.col("kind") == "textbox") | contact, "high").otherwise("low"))
    tables = items.filter("table_id is not null").groupBy("doc_id", F.lit("table").alias("kind"), F.col("table_id").alias("place")).agg(at, F.count("*").alias("n"), _in_order(F.trim("text"), "stream_index", 6, " | ", 200).alias("text"), F.lit("high").alias("severity"))
    right = items.join(layout.parted.filter("columns = 2"), ["doc_id", "page"]).filter("source = 'body' and x >= divider").groupBy("doc_id").agg(at, F.count("*").alias("n"), _in_order(F.col("text"), "stream_index", 4, " · ", 200).alias("text"))
    many = column_counts(layout).filter("columns > 1").join(right, "doc_id", "left")
    columns = many.select("doc_id", F.lit("column").alias("kind"), F.lit("").alias("place"), F.coalesce("line_no", F.lit(1)).alias("line_no"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("text", F.lit("")).alias("text"), F.lit("high").alias("severity"))
    vector = F.min(F.when(F.col("description").contains("vector"), F.col("description")))
    pages = layout.images.groupBy("doc_id", "page").agg(F.count("*").alias("n"), vector.alias("text"))
    images = pages.select("doc_id", F.when(F.col("text").isNull(), "image").otherwise("vector").alias("kind"), F.col("page").cast("string").alias("place"), F.col("page").cast("int").alias("line_no"), "n", F.coalesce("text", F.lit("")).alias("text"), F.lit("low").alias("severity"))
    return reduce(DataFrame.unionByName, [tables, columns, images], loose)


def reading_issues(layout: Layout) -> DataFrame:
    """(doc_id, kind, n, text): rows that mix columns of a positioned file, columns of another file, tables that are read cell by cell, and an order unlike the page's.

    A file without positions is read in its own order, so its columns are one issue, n the number of columns.
    """
    columns = column_counts(layout)
    dividers = layout.parted.filter("columns = 2").select("doc_id", "page", "divider")
    placed = layout.items.filter("source = 'body'").join(dividers, ["doc_id", "page"], "left").withColumn("column", F.coalesce((F.col("x") >= F.col("divider")).cast("int"), F.lit(0)))
    mangled = machine_rows(placed).filter("mangled").groupBy("doc_id").agg(F.count("*").alias("n"), F.left(F.min_by("text", "row_no"), F.lit(90)).alias("text"))
    several = columns.filter("columns > 1").join(layout.files.select("doc_id", "file_type"), "doc_id")
    interleaved = mangled.join(several.filter("file_type = 'pdf'"), "doc_id").select("doc_id", F.lit("column-interleave").alias("kind"), "n", "text")
    flowed = several.filter("file_type <> 'pdf'").select("doc_id", F.lit("column-interleave").alias("kind"), F.col("columns").cast("long").alias("n"), F.lit("").alias("text"))
    wide = layout.items.filter("table_id is not null").groupBy("doc_id", "table_id").agg(F.count_distinct("col").alias("n")).filter("n > 1")
    first = flattened_tables(layout.items).groupBy("doc_id", "table_id").agg(F.left(F.min_by("text", "row"), F.lit(80)).alias("text"))
    tables = wide.join(first, ["doc_id", "table_id"]).select("doc_id", F.lit("table-flatten").alias("kind"), "n", "text")
    return interleaved.unionByName(flowed).unionByName(tables).unionByName(_out_of_order(layout))


def _out_of_order(layout: Layout) -> DataFrame:
    """The reading issues of one column whose order is unlike the page's."""
    single = column_counts(layout).filter("columns = 1")
    return displaced(layout.items).filter("out_of_order").join(single, "doc_id").select("doc_id", F.lit("out-of-order").alias("kind"), F.col("moved").alias("n"), F.lit("").alias("text"))


def parse_findings(layout: Layout, found: Callable[..., DataFrame], finding: Callable[..., Column]) -> DataFrame:
    """The rules of layout as findings: one pass over what is dropped, one over what is out of order, one over the files."""
    kind, high = F.col("kind"), F.col("severity") == "high"
    numbered = dropped_elements(layout).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("line_no", "place")))
    lost = found(
        numbered,
        finding(kind == "column", "multi-column"),
        finding(kind == "table", "table", order=F.col("ord")),
        finding(kind == "header", "header-text", cost=F.when(high, 15.0).otherwise(5.0), severity=F.when(high, "high").otherwise("low")),
        finding(kind == "footer", "footer-text", cost=F.when(high, 8.0).otherwise(2.0), severity=F.when(high, "medium").otherwise("low")),
        finding(kind == "textbox", "textbox"),
        finding(kind == "image", "image"),
        finding(kind == "vector", "vector-graphics"),
    )
    # The only reading issue that a rule asks for.
    issues = _out_of_order(layout).withColumn("line_no", F.lit(1))
    files = layout.files.withColumn("line_no", F.lit(1))
    return lost.unionByName(found(issues, finding(kind == "out-of-order", "stream-order"))).unionByName(found(files, finding(F.col("file_size") > LARGE, "file-size")))


def lost_contact(layout: Layout) -> DataFrame:
    """(doc_id, field, value, source, line_no): the first of each contact field in headers, footers and text boxes."""
    text = F.col("text")
    first = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    urls = F.regexp_extract_all(F.regexp_replace(text, P.EMAIL, ""), F.lit(P.URL), F.lit(0))
    url = lambda pattern: F.get(F.filter(urls, lambda u: u.rlike(pattern)), F.lit(0))
    values = {"email": first(P.EMAIL), "phone": F.trim(first(P.PHONE)), "linkedin": url(r"(?i)linkedin\.com"), "github": url(r"(?i)git(hub|lab)\.com")}
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), values[f].alias("value")) for f in CONTACT_FIELDS])).alias("f")
    loose = layout.items.filter(F.col("source").isin(*LOOSE)).select("doc_id", "source", F.col("stream_index").cast("int").alias("line_no"), fields).select("doc_id", "source", "line_no", "f.*").filter("value is not null")
    return loose.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "source", "line_no"), "line_no").alias("v")).select("doc_id", "field", "v.*")


def hazards(layout: Layout, contact: DataFrame) -> DataFrame:
    """(doc_id, multi_column, tables, header_contact, images, text_boxes): what costs a document points with each engine. header_contact: a field that the body lacks (contact) stands in a header, footer or text box."""
    has = lambda frame: frame.select("doc_id").distinct()
    absent = reduce(lambda a, f: a | ((F.col("field") == f) & F.col(f"body_{f}").isNull()), CONTACT_FIELDS, F.lit(False))
    lost = lost_contact(layout).join(contact.select("doc_id", *[F.col(f).alias(f"body_{f}") for f in CONTACT_FIELDS]), "doc_id", "left").filter(absent)
    flags = {"tables": has(layout.items.filter("table_id is not null")), "header_contact": has(lost), "images": has(layout.images), "text_boxes": has(layout.items.filter("source = 'textbox'"))}
    out = column_counts(layout).select("doc_id", (F.col("columns") > 1).alias("multi_column"))
    for name, docs in flags.items():
        out = out.join(docs.withColumn(name, F.lit(True)), "doc_id", "left")
    return out.fillna(False, list(flags))


def layout_facts(layout: Layout, lines: DataFrame) -> DataFrame:
    """(doc_id, columns, n_tables, n_cells, n_images, n_boxes, header_text, footer_text, words, chars): one row for each document; words and characters of body and table lines."""
    cell, text = F.col("table_id").isNotNull(), F.trim("text")
    of = lambda source: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("source") == source, F.struct("stream_index", text.alias("t"))))), lambda x: x["t"]), " · ")
    items = layout.items.groupBy("doc_id").agg(F.count_distinct("table_id").alias("n_tables"), F.count_if(cell).alias("n_cells"), F.count_if(F.col("source") == "textbox").alias("n_boxes"), of("header").alias("header_text"), of("footer").alias("footer_text"))
    images = layout.images.groupBy("doc_id").agg(F.count("*").alias("n_images"))
    body = lines.filter(F.col("source").isin("body", "table")).groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum(F.length("text")).alias("chars"))
    joined = column_counts(layout).join(items, "doc_id", "left").join(images, "doc_id", "left").join(body, "doc_id", "left")
    return joined.fillna(0, ["n_tables", "n_cells", "n_boxes", "n_images", "words", "chars"]).fillna("", ["header_text", "footer_text"])
