"""Documents to chunks: lines, furniture, headings, sections, tables, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import sentences

TARGET_TOKENS = 300
TABLE_ROWS = 6
SHORT_LINE = 60
BLOCK_TAGS = "h[1-6]|p|div|nav|footer|header"


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, line_no, line): trimmed lines that are not empty."""
    cut = docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return cut.select(*keep, "line_no", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line")).where("line <> ''")


def furniture(docs: DataFrame, group: str, doc: str, share: float = 0.5) -> DataFrame:
    """(group, line, n_docs): short lines on at least max(2, share of the
    group's pages)."""
    per = docs.groupBy(group).agg(F.count_distinct(doc).alias("pages"))
    short = lines(docs, group, doc).where(F.length("line") <= SHORT_LINE)
    often = short.groupBy(group, "line").agg(F.count_distinct(doc).alias("n_docs"))
    least = F.greatest(F.lit(2), F.ceil(F.col("pages") * share))
    return often.join(per, group).where(F.col("n_docs") >= least).select(group, "line", "n_docs")


def is_page_number(line: Column) -> Column:
    return line.rlike(r"(?i)^(.*\|?\s*)?page\s*\d+$") & (F.length(line) < SHORT_LINE)


def body_lines(docs: DataFrame, group: str, doc: str, share: float = 0.5) -> DataFrame:
    """(group, doc, line_no, line): lines without furniture and page numbers."""
    own = lines(docs, group, doc).where(~is_page_number(F.col("line")))
    return own.join(furniture(docs, group, doc, share).select(group, "line"), [group, "line"], "left_anti").select(group, doc, "line_no", "line")


def body_size(page_lines: DataFrame, *page: str) -> DataFrame:
    """The font size with the most characters on each page; the smaller of
    equals."""
    sizes = page_lines.groupBy(*page, "size").agg(F.sum(F.length("text")).alias("chars"))
    return sizes.groupBy(*page).agg(F.min_by("size", F.struct(-F.col("chars"), F.col("size"))).alias("body"))


def is_heading() -> Column:
    """Over the columns text, size, bold_ratio and body."""
    large = F.col("size") >= F.col("body") + 1.2
    bold = (F.col("bold_ratio") >= 0.8) & (F.length("text") <= SHORT_LINE) & ~F.col("text").endswith(".")
    return large | bold


def html_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, text, size, bold_ratio) from headings, paragraphs,
    divisions and navigation of raw HTML, with or without attributes; sizes
    stand for the tags."""
    block = rf"(?s)<({BLOCK_TAGS})(?:\s[^>]*)?>(.*?)</(?:{BLOCK_TAGS})>"
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(block), 1).alias("tag"), F.regexp_extract_all("html", F.lit(block), 2).alias("inner"))
    cut = pages.select("page_id", F.posexplode(found).alias("line_no", "b"))
    text = F.trim(F.regexp_replace(F.regexp_replace("b.inner", r"<[^>]*>", " "), r"\s+", " "))
    tag = F.col("b.tag")
    size = F.when(tag == "h1", 16.0).when(tag == "h2", 14.0).when(tag.startswith("h") & (tag != "header"), 12.0).when(tag.isin("p", "div"), 9.0).otherwise(7.0)
    bold = F.when(F.col("b.inner").startswith("<b>"), 1.0).otherwise(0.0)
    return cut.select("page_id", "line_no", text.alias("text"), size.alias("size"), bold.alias("bold_ratio")).where("text <> ''")


def sections(typed: DataFrame, *page: str) -> DataFrame:
    """(page, section, line_no, text): body lines under the last heading
    before them. ``typed`` has is_heading."""
    before = Window.partitionBy(*page).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(before)
    return typed.withColumn("section", section).where(~F.col("is_heading")).select(*page, F.coalesce("section", F.lit("")).alias("section"), "line_no", "text")


def pack_sentences(text: Column, target: int = TARGET_TOKENS) -> Column:
    """Chunks of whole sentences: one is closed when the next sentence would
    take it over the target. A fold inside the row."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, sentence: Column) -> Column:
        joined = F.when(acc["open"] == "", sentence).otherwise(F.concat(acc["open"], F.lit(" "), sentence))
        full = (acc["open"] != "") & (F.floor(F.length(joined) / 4) > target)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, sentence).otherwise(joined).alias("open"),
        )

    return F.aggregate(sentences(text), empty, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def chunk_documents(docs: DataFrame, section: Column | None = None, target: int = TARGET_TOKENS) -> DataFrame:
    """(doc_id, chunk_no, chunk_id, offset, text): a document is one page; the
    id is made of document, page and offset, and the offset grows by the
    chunks' lengths with their section line."""
    head = F.concat(section if section is not None else F.lit(""), F.lit("\n"))
    packed = docs.select("doc_id", F.posexplode(pack_sentences(F.col("text"), target)).alias("chunk_no", "body"), head.alias("head"))
    packed = packed.withColumn("chunk", F.concat("head", "body"))
    before = Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("chunk")).over(before), F.lit(0)).cast("long")
    named = F.substring(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("1"), offset.cast("string"))), 1, 12)
    return packed.select("doc_id", "chunk_no", named.alias("chunk_id"), offset.alias("offset"), F.col("chunk").alias("text"))


def page_chunks(pages: DataFrame, order: tuple[str, ...] = (), target: int = TARGET_TOKENS, per: int = TABLE_ROWS) -> DataFrame:
    """(place, doc, page, chunk_no, kind, chunk_id, offset, text) of a corpus of
    documents (doc, page, text) with several pages: on each page its tables come
    first, then its text without them, packed. Ids and offsets are those of
    ``chunk_documents``; the offset restarts with each page. ``place`` puts the
    documents named in ``order`` first, in that order.

    A null document is '-'; an empty page has no chunk."""
    key = F.struct(F.coalesce("doc", F.lit("-")).alias("doc"), "page").alias("doc_id")
    keyed = pages.select(key, F.coalesce("text", F.lit("")).alias("text"))
    tables = table_chunks(table_rows(keyed), per).select("doc_id", F.lit(0).alias("part"), "chunk_no", "text")
    plain = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.contains(x, F.lit("|"))), "\n")
    packed = keyed.select("doc_id", F.posexplode(pack_sentences(plain, target)).alias("chunk_no", "text"))
    packed = packed.select("doc_id", F.lit(1).alias("part"), F.col("chunk_no").cast("long"), F.concat(F.lit("\n"), "text"))
    w = Window.partitionBy("doc_id").orderBy("part", "chunk_no")
    both = tables.union(packed).withColumns({"no": F.row_number().over(w) - 1, "offset": F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})
    doc, page = F.col("doc_id.doc"), F.col("doc_id.page")
    named = F.substring(F.sha1(F.concat_ws("|", doc, page.cast("string"), F.col("offset").cast("string"))), 1, 12)
    place = F.array_position(F.array(*(F.lit(x) for x in order)).cast("array<string>"), doc)
    place = F.when(place > 0, place - 1).otherwise(len(order)).cast("int")
    return both.select(place.alias("place"), doc.alias("doc"), page.alias("page"), F.col("no").alias("chunk_no"), F.when(F.col("part") == 0, "table").otherwise("text").alias("kind"), named.alias("chunk_id"), "offset", "text")


def table_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_no, cells): lines with bars, in order. Rows with a blank
    key go, unless all of a table's would."""
    bars = lines(docs, "doc_id").where(F.contains("line", F.lit("|")))
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    bars = bars.select("doc_id", "line_no", "line", (cells[0] == "").alias("blank"))
    kept = bars.withColumn("any", F.max(~F.col("blank")).over(Window.partitionBy("doc_id"))).where(~F.col("blank") | ~F.col("any"))
    return kept.select("doc_id", "line", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).alias("row_no"))


def table_chunks(rows: DataFrame, per: int = TABLE_ROWS) -> DataFrame:
    """(doc_id, chunk_no, n_rows, text): groups of rows below the repeated
    first row."""
    head = rows.where("row_no = 1").select("doc_id", F.col("line").alias("head"))
    body = rows.where("row_no > 1").withColumn("chunk_no", F.floor((F.col("row_no") - 2) / per).cast("long"))
    grouped = body.groupBy("doc_id", "chunk_no").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("rows"))
    text = F.concat_ws("\n", F.array("head"), F.col("rows.line"))
    return grouped.join(head, "doc_id").select("doc_id", "chunk_no", "n_rows", text.alias("text"))


def conflicts(docs: DataFrame, stale: tuple[str, ...], current: tuple[str, ...]) -> DataFrame:
    """Texts that state both a superseded and a current position."""
    has = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower("text"), w))
    return docs.where(has(stale) & has(current))


def rows_from_spans(spans: DataFrame, header: DataFrame, row_height: float = 4.0) -> DataFrame:
    """(page, row_no, col, text): text pieces with places put into the grid of
    a header. A piece belongs to the column that it starts in, else to the one
    whose left edge is nearest; pieces of a cell are joined by place.

    ``spans``: page, x, y, text; ``header``: page, col, x0, x1. A page has a
    handful of columns, so the join on the page stays narrow."""
    both = spans.join(header, "page")
    away = F.when((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")), 0.0).otherwise(F.abs(F.col("x") - F.col("x0")))
    placed = both.groupBy("page", "x", "y", "text").agg(F.min_by("col", F.struct(away, F.col("col"))).alias("col"))
    row = F.dense_rank().over(Window.partitionBy("page").orderBy(F.floor(F.col("y") / row_height)))
    cells = placed.withColumn("row_no", row).groupBy("page", "row_no", "col").agg(F.array_sort(F.collect_list(F.struct("y", "x", "text"))).alias("p"))
    return cells.select("page", "row_no", "col", F.array_join("p.text", " ").alias("text"))


SLACK = 1.0  # by how much places may miss a row or a column
BAND = 64.0  # height of a band in which spans and rows meet


def whole_rows(rows: DataFrame, slack: float = SLACK) -> DataFrame:
    """``rows`` (page, row_no, y0, y1) without those that lie inside the last
    kept row above them: second finds of lines that a taller row has already.
    A fold over the few rows of each page."""
    each = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("row_no", "y0", "y1"))).alias("r"))
    empty = F.filter("r", lambda x: F.lit(False))

    def step(kept: Column, row: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        inside = F.coalesce((last["y0"] - slack <= row["y0"]) & (row["y1"] <= last["y1"] + slack), F.lit(False))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(row)))

    return each.select("page", F.explode(F.aggregate("r", empty, step)).alias("x")).select("page", "x.*")


def table_grid(spans: DataFrame, rows: DataFrame, header: DataFrame, slack: float = SLACK, band: float = BAND) -> DataFrame:
    """(page, row_no, col, text): the cells of tables whose texts are given by
    their places. ``spans``: page, x, y0, y1, text; ``rows``: page, row_no, y0,
    y1; ``header``: page, col, x0, x1, the columns of every row of the page.

    A span lies in the rows that hold its middle, and in the column that it
    starts in, even where it runs on into the next; in none, in the one whose left
    edge is nearest. The spans of a cell are joined from top to bottom. Rows and
    spans meet by page and by bands of equal height, so that a long page is no
    product of both; a page without a header has no cells."""
    kept = whole_rows(rows, slack)
    bands = lambda lo, hi: F.explode(F.sequence(F.floor(lo / band), F.floor(hi / band)))
    wide = kept.withColumn("band", bands(F.col("y0") - slack, F.col("y1") + slack)).withColumnsRenamed({"y0": "r0", "y1": "r1"})
    middle = (F.col("y0") + F.col("y1")) / 2
    pieces = spans.where("text is not null and trim(text) <> ''").withColumns({"middle": middle, "band": F.floor(middle / band)})
    met = pieces.join(wide, ["page", "band"]).where((F.col("middle") >= F.col("r0") - slack) & (F.col("middle") <= F.col("r1") + slack))
    columns = header.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("col", "x0", "x1"))).alias("h"))
    holds = F.filter("h", lambda c: (c["x0"] - slack <= F.col("x")) & (F.col("x") < c["x1"] + slack))
    nearest = F.array_min(F.transform("h", lambda c: F.struct(F.abs(c["x0"] - F.col("x")).alias("away"), c["col"].alias("col"))))
    cells = met.join(columns, "page").withColumn("col", F.when(F.size(holds) > 0, holds[0]["col"]).otherwise(nearest["col"]))
    cells = cells.groupBy("page", "row_no", "col").agg(F.array_sort(F.collect_list(F.struct("y0", "x", F.trim("text").alias("text")))).alias("p"))
    grid = kept.select("page", "row_no").join(columns, "page").select("page", "row_no", F.explode("h.col").alias("col"))
    return grid.join(cells, ["page", "row_no", "col"], "left").select("page", "row_no", "col", F.coalesce(F.array_join("p.text", " "), F.lit("")).alias("text"))
