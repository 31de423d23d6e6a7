"""Lines of web pages by the stack of open tags."""

import pytest

from lakewright.operators import chunking as C
from lakewright.sources.pages import line_reader, page_lines

READ = line_reader()
PAGES = [
    ("<p>a <b>b</b></p><p>c", [("p", 1, "a b", 9.0, 0.5), ("p", 1, "c", 9.0, 0.0)]),
    ("<p><b>open<br><p>next</p>", [("p", 1, "open", 9.0, 1.0), ("p", 1, "next", 9.0, 0.0)]),
    ("<div>x<div>y<p>z</div>w</div>v", [("div", 1, "x", 9.0, 0.0), ("div", 2, "y", 9.0, 0.0), ("p", 3, "z", 9.0, 0.0), ("div", 1, "w", 9.0, 0.0), ("body", 0, "v", 9.0, 0.0)]),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", [("li", 2, "1", 9.0, 0.0), ("li", 2, "2", 9.0, 0.0), ("li", 4, "3", 9.0, 0.0), ("li", 2, "4", 9.0, 0.0)]),
    ("<table><tr><th>h<td>1<tr><td>2 <td>3</table>t", [("th", 3, "h", 9.0, 0.0), ("td", 3, "1", 9.0, 0.0), ("td", 3, "2", 9.0, 0.0), ("td", 3, "3", 9.0, 0.0), ("body", 0, "t", 9.0, 0.0)]),
    ("<head><title>no</title></head><body><script>var t='</p>';</script><style>p{}</style><!-- no --><h1>T &amp; U</h1><h3>s</h3></body>", [("h1", 1, "T & U", 16.0, 0.0), ("h3", 1, "s", 12.0, 0.0)]),
    ('<p style="font-weight: 700">bold</p><p style="color:red">plain</p>', [("p", 1, "bold", 9.0, 1.0), ("p", 1, "plain", 9.0, 0.0)]),
    ("<nav><h2>menu</h2></nav></div></p>after<br>break", [("h2", 2, "menu", 7.0, 0.0), ("body", 0, "after", 9.0, 0.0), ("body", 0, "break", 9.0, 0.0)]),
    ("", []),
    (None, []),
    ("<", [("body", 0, "<", 9.0, 0.0)]),
]


@pytest.mark.parametrize(("html", "lines"), PAGES)
def test_lines(html, lines):
    assert READ(html or "") == lines


def test_pages_as_rows(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "page_id int, html string").repartition(3)
    got = {}
    for r in page_lines(df).orderBy("page_id", "line_no").collect():
        got.setdefault(r["page_id"], []).append(tuple(r)[2:])
    assert got == {i: lines for i, (_, lines) in enumerate(PAGES) if lines}
    assert page_lines(df.limit(0)).count() == 0


def test_headings_from_lines(spark):
    html = "<h1>Title</h1><p>Long enough body text here.<p><b>Bold lead</b><p>More body text, also long.<div>Tail."
    lines = page_lines(spark.createDataFrame([(1, html)], "page_id int, html string"))
    typed = lines.join(C.body_size(lines, "page_id"), "page_id").withColumn("is_heading", C.is_heading())
    assert [r["text"] for r in typed.where("is_heading").orderBy("line_no").collect()] == ["Title", "Bold lead"]
    assert {r["section"] for r in C.sections(typed, "page_id").collect()} == {"Title", "Bold lead"}
