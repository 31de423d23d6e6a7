"""Typographic lines of web pages, by a stack of open tags.

A page is read once from its beginning to its end; its lines come out in order,
each with the block that it stands in, how deep that lies, a size that stands
for the tag, and the share of its characters that are bold. Blocks may nest and
may be left open: a paragraph ends where another block begins, an item, cell or
row where the next one does, and an end tag closes what is still open inside.
Character references are resolved; scripts, styles and the head hold no lines.

Cases: a null or empty page has no lines; end tags without a beginning are
ignored; text outside every block is a line of the page itself (tag ``body``);
rows that repeat an id are read each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = "line_no int, tag string, depth int, text string, size double, bold_ratio double"

# Tags that make a block, and the sizes that they stand for.
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
SIZES = {"h1": 16.0, "h2": 14.0, "h3": 12.0, "h4": 12.0, "h5": 12.0, "h6": 12.0}
MARGINS = ("nav", "footer", "header", "aside")  # everything inside is small
BODY_SIZE, MARGIN_SIZE = 9.0, 7.0
SILENT = ("head", "script", "style", "template", "noscript")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: A tag ends open ones of these kinds, up to the nearest of the second group.
ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}


def line_reader() -> Callable[[str], list[tuple]]:
    """read(html) -> [(tag, depth, text, size, bold_ratio), ...]; it carries its own tables to the tasks."""
    import re
    from html.parser import HTMLParser

    blocks, sizes, margins, silent, void, ends = frozenset(BLOCKS), SIZES, frozenset(MARGINS), frozenset(SILENT), frozenset(VOID), ENDS
    body, margin = BODY_SIZE, MARGIN_SIZE
    heavy = re.compile(r"(?i)font-weight\s*:\s*(bold|bolder|[6-9]00)")

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.open: list[tuple[str, bool]] = []  # tag, bold
            self.pieces: list[tuple[str, bool]] = []
            self.lines: list[tuple] = []

        def flush(self) -> None:
            if not self.pieces:
                return
            text = " ".join("".join(t for t, _ in self.pieces).split())
            if text:
                own = [t for t, _ in self.open if t in blocks]
                solid = [len("".join(t.split())) for t, _ in self.pieces]
                bold = sum(n for n, (_, b) in zip(solid, self.pieces, strict=True) if b) / sum(solid)
                size = margin if any(t in margins for t in own) else next((sizes[t] for t in reversed(own) if t in sizes), body)
                self.lines.append((own[-1] if own else "body", len([t for t in own if t != "body"]), text, size, bold))
            self.pieces = []

        def close_to(self, at: int) -> None:
            self.flush()
            del self.open[at:]

        def handle_starttag(self, tag: str, attrs: list) -> None:
            if tag == "br":
                self.flush()
            if tag in void:
                return
            if tag in blocks:
                self.flush()
                tags = [t for t, _ in self.open]
                if "p" in tags:  # a paragraph holds no block
                    self.close_to(len(tags) - 1 - tags[::-1].index("p"))
                if tag in ends:
                    kinds, border = ends[tag]
                    first = None
                    for k in range(len(self.open) - 1, -1, -1):
                        if self.open[k][0] in border:
                            break
                        first = k if self.open[k][0] in kinds else first
                    if first is not None:
                        self.close_to(first)
            bold = tag in ("b", "strong") or any(k == "style" and v and heavy.search(v) for k, v in attrs)
            self.open.append((tag, bold))

        def handle_endtag(self, tag: str) -> None:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    if any(t in blocks for t, _ in self.open[k:]):
                        self.flush()
                    del self.open[k:]
                    return

        def handle_data(self, data: str) -> None:
            if not any(t in silent for t, _ in self.open):
                self.pieces.append((data, any(b for _, b in self.open)))

    def read(html: str) -> list[tuple]:
        reader = Reader()
        reader.feed(html)
        reader.close()
        reader.flush()
        return reader.lines

    return read


def page_lines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, line_no, tag, depth, text, size, bold_ratio) of all pages."""
    kind = pages.schema[id_col].dataType.simpleString()
    make, schema = line_reader, SCHEMA
    names = [id_col, *(x.split()[0] for x in schema.split(", "))]
    read = make()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64())
        for batch in batches:
            owner, rows = [], []
            for i, html in enumerate(batch.column(1).to_pylist()):
                for k, line in enumerate(read(html or "")):
                    owner.append(i)
                    rows.append((k, *line))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            ids = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(run, f"{id_col} {kind}, {schema}")
