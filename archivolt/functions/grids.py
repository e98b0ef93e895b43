"""Tables in HTML, Markdown and plain text, as column expressions that stay in the JVM: one fold over the tokens of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import markdown_rows, table_text
from .text import coerced, once

# The tokens of a page (scripts and styles whole, comments, tags, entities, text), and entities by name.
TOKENS = r"""(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|</?[a-z](?:"[^"]*"|'[^']*'|[^'">])*>|&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z]{2,8});|[^<&]+|[<&]"""
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "©", "reg": "®", "middot": "·", "ndash": "–", "mdash": "—", "hellip": "…", "times": "×"}
ROW, CELL = "array<string>", "array<array<string>>"


def tag_name(token: Column) -> Column:
    """The name of a tag with / before it at its end, as in the token, lower case; empty for what is no tag."""
    return F.lower(F.regexp_extract(token, r"^<(/?[A-Za-z][^\s/>]*)", 1))


def _character(code: Column) -> Column:
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(code.isNotNull(), "\uFFFD")


def said(token: Column) -> Column:
    """What a token adds to a text: nothing for a tag or comment, a script's or style's inside, an entity's character."""
    name = F.regexp_extract(token, r"^&([a-zA-Z]{2,8});$", 1)
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair)), name)
    number, hexed = (F.regexp_extract(token, p, 1) for p in (r"^&#([0-9]{1,7});$", r"^&#[xX]([0-9a-fA-F]{1,6});$"))
    code = F.coalesce(F.nullif(number, F.lit("")).cast("long"), F.conv(F.nullif(hexed, F.lit("")), 16, 10).cast("long"))
    out = F.when(token.rlike(r"(?is)^<(?:script|style)\b.*</"), F.regexp_extract(token, r"(?is)^<[^>]*>(.*)</[^<]*$", 1))
    return out.when(token.rlike("^<(?:!--|/?[A-Za-z])"), "").when(F.startswith(token, F.lit("&")), F.coalesce(known, _character(code), token)).otherwise(token)


def html_rows(html: Column) -> Column:
    """C-32: the cells of all rows of a page, nested tables and unclosed tags included; one blank cell without any.

    A cell goes to the row that is open when it is closed. A row without cells is none; one that is not closed is lost.
    """
    none = F.lit(None)
    start = F.struct(F.array().cast(CELL).alias("rows"), none.cast(ROW).alias("row"), none.cast("string").alias("cell"))
    state = lambda rows, row, cell: F.struct(rows.alias("rows"), row.alias("row"), cell.alias("cell"))
    clean = lambda c: coerced(F.replace(c, F.lit("\0"), F.lit("")))

    def step(s: Column, x: Column) -> Column:
        name, rows, row, cell = x["name"], s["rows"], s["row"], s["cell"]
        empty, blank = F.array().cast(ROW), F.lit("")
        closed = F.array_append(F.coalesce(row, empty), F.lit(""))
        is_cell = name.isin("td", "th")
        out = F.when((name == "tr") & x["single"], state(rows, none.cast(ROW), cell)).when(name == "tr", state(rows, empty, cell))
        out = out.when(is_cell & x["single"], state(rows, closed, none.cast("string"))).when(is_cell, state(rows, F.coalesce(row, empty), blank))
        out = out.when((name == "br") & cell.isNotNull(), state(rows, row, F.concat(cell, F.lit("\n"))))
        out = out.when(name.isin("/td", "/th") & row.isNotNull() & cell.isNotNull(), state(rows, F.array_append(row, clean(cell)), none.cast("string")))
        out = out.when(name == "/tr", state(F.when(F.size(row) > 0, F.array_append(rows, row)).otherwise(rows), none.cast(ROW), cell))
        return out.when((x["text"] != "") & cell.isNotNull(), state(rows, row, F.concat(cell, x["text"]))).otherwise(s)

    tokens = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKENS), F.lit(0))
    read = F.transform(tokens, lambda t: F.struct(tag_name(t).alias("name"), F.endswith(t, F.lit("/>")).alias("single"), said(t).alias("text")))
    rows = F.aggregate(read, start, step, lambda s: s["rows"])
    return F.when(F.size(rows) > 0, rows).otherwise(F.array(F.array(F.lit(""))))


def is_html_table(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.contains(low, F.lit("<table")) | (F.contains(low, F.lit("<tr")) & (F.contains(low, F.lit("<td")) | F.contains(low, F.lit("<th"))))


def with_content(rows: Column) -> Column:
    """Rows of a table that says something; else null."""
    return once(rows, lambda r: F.when(F.exists(F.flatten(r), lambda x: F.coalesce(coerced(x) != "", F.lit(False))), r))


def plain_rows(c: Column) -> Column:
    """C-33: lines of two cells or more, parted by tabs or by two blanks or more, filled up to the widest; null for other texts."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|[\n\r]"), coerced), lambda x: x != "")
    spaced = lambda x: F.filter(F.split(x, r"\s{2,}"), lambda y: y != "")
    rows = F.transform(lines, lambda x: F.when(F.contains(x, F.lit("\t")), F.transform(F.split(x, "\t"), coerced)).otherwise(spaced(x)))
    wide = F.array_max(F.transform(rows, F.size))
    filled = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))))
    return with_content(F.when((F.size(rows) >= 2) & F.forall(rows, lambda r: F.size(r) >= 2), filled))


def table_rows(c: Column) -> Column:
    """C-32, C-33: the cells of a text that is a table in HTML, Markdown or plain text; null for other texts."""
    return F.when(is_html_table(c), with_content(html_rows(c))).otherwise(F.coalesce(with_content(markdown_rows(c)), plain_rows(c)))


def _bar_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(coerced(c), "\r\n|[\n\r]"), coerced), lambda x: F.contains(x, F.lit("|")))


def _divides(x: Column) -> Column:
    return x.rlike(r"^[|\s\-:]+$")


def _bar_cells(x: Column) -> Column:
    """The cells between the bars of a line; a blank one before the first or after the last bar is none."""
    cells = F.transform(F.split(x, r"\|"), coerced)
    return F.filter(cells, lambda y, k: ~((y == "") & ((k == 0) | (k == F.size(F.split(x, r"\|")) - 1))))


def bar_rows(c: Column) -> Column:
    """The cells of all lines with bars but dividers; one blank cell without any."""
    rows = F.filter(F.transform(F.filter(_bar_lines(c), lambda x: ~_divides(x)), _bar_cells), lambda r: F.size(r) > 0)
    return F.when(F.size(rows) > 0, rows).otherwise(F.array(F.array(F.lit(""))))


def markdown_html(c: Column) -> Column:
    """C-33: a Markdown table as HTML, lines before the divider as heads; empty without rows."""
    lines = _bar_lines(c)
    first = F.array_position(F.transform(lines, lambda x: _divides(x).cast("int")), 1)

    def row(x: Column, i: Column) -> Column:
        tag = F.when((first > 0) & (i >= first), "td").otherwise("th")
        inside = F.array_join(F.transform(_bar_cells(x), lambda y: F.concat(F.lit("<"), tag, F.lit(">"), y, F.lit("</"), tag, F.lit(">"))), "")
        return F.when(~_divides(x) & (F.size(_bar_cells(x)) > 0), F.concat(F.lit("<tr>"), inside, F.lit("</tr>")))

    rows = F.filter(F.transform(lines, row), lambda x: x.isNotNull())
    return F.when(F.size(rows) > 0, F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))).otherwise("")


__all__ = ["bar_rows", "html_rows", "is_html_table", "markdown_html", "plain_rows", "table_rows", "table_text", "with_content"]
