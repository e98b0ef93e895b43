"""Tables in HTML and plain text on worked examples, held against the standard library's tokenizer."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from archivolt.functions import grids as g


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.row, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.row, self.cell = self.row if self.row is not None else [], ""
        elif tag == "br" and self.cell is not None:
            self.cell += "\n"

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.row is not None and self.cell is not None:
            self.row.append(self.cell.strip())
            self.cell = None
        elif tag == "tr":
            self.out += [self.row] if self.row else []
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell += data


HTML = [
    "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>",
    "<table><tr><td>Line 1<br/>Line 2</td></tr></table>",
    "<tr><td>a<table><tr><td>in</td></tr></table>b</td></tr>",
    "<TR><TD>x<td>y</tr><tr></tr><td>no row</td><tr><td>open",
    "<tr><td title=\"a>b\">&lt;b&gt;&amp;lt; &#65;&#x4e2d; &bogus; & </td><td/><td>z</td></tr>",
    "<tr><td><script>if (a < b) { '</td>' }</script><!-- <td> -->t</td></tr>",
    "plain text", "", None, "<tr><td>\0 s </td></tr>", "a < b <tr><td>1 < 2</td></tr>",
]


@pytest.mark.parametrize("text", HTML)
def test_html(spark, text):
    plain = Plain()
    plain.feed(text or "")
    plain.close()
    want = [[c.replace("\0", "").strip() for c in row] for row in plain.out] or [[""]]
    assert spark.createDataFrame([(text,)], "h string").select(g.html_rows(F.col("h")).alias("r")).first().r == want


def test_plain_and_any(spark):
    rows = ["a  b\n c\td ", "a b\nc  d", "only one line  here", "", None, "x\ty\n\n z\t\tw", "| a | b |\n|---|---|\n| 1 | 2 |", "<table><tr><td> </td></tr></table>"]
    got = [r.t for r in spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, c string").orderBy("k").select(g.table_rows(F.col("c")).alias("t")).collect()]
    assert got == [[["a", "b"], ["c", "d"]], None, None, None, None, [["x", "y", ""], ["z", "", "w"]], [["a", "b"], ["1", "2"]], None]


def test_markdown_html(spark):
    df = spark.createDataFrame([("| a | b |\n|---|---|\n| 1 | 2 |",), ("no",)], "c string")
    assert [r.h for r in df.select(g.markdown_html(F.col("c")).alias("h")).collect()] == ["<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", ""]
