"""Texts of seals and scores of tables, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grids import html_rows, is_html_table, table_text, with_content
from .text import coerced, compact, once

# Most lines and characters of a seal's text, marks of running text, words and digits of seals, marks that speak against one.
LINES, LONG_TEXT, SENTENCE = 4, 48, "[，。；、]"
SEAL_WORDS, SEAL_DIGITS, AGAINST = "(章|印|公司|专用|合同|财务|法人|有限|委员会|办公室)", r"\d{6,}", "[，。；、,.;!?]"
#: What a reading of lines must be better by to win over the text that is there.
BETTER = 0.2


def seal_text(c: Column) -> Column:
    """C-52: the lines of a seal's text without blanks at their ends; empty for what is too long to be one."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|[\n\r]"), coerced), lambda x: x != "")
    short = lambda ls, joined: F.when((F.size(ls) > LINES) | ((F.length(joined) > LONG_TEXT) & joined.rlike(SENTENCE)), "").otherwise(joined)
    return once(lines, lambda ls: once(F.array_join(ls, "\n"), lambda joined: short(ls, joined)))


def score_of_text(text: Column) -> Column:
    """The score of what seal_text gives."""
    lines = F.split(text, "\n")
    points = lambda test, n: F.when(test, n).otherwise(0.0)

    def of(bare: Column) -> Column:
        score = F.least(F.length(bare), F.lit(24)) / 12 + F.when(F.size(lines) <= 3, 0.6).otherwise(0.3) + points(text.rlike(SEAL_WORDS), 0.8) + points(bare.rlike(SEAL_DIGITS), 0.35)
        return score - points(F.exists(lines, lambda x: F.length(compact(x)) > 18), 0.35) - points(F.length(bare) > 36, 0.45) - points(text.rlike(AGAINST), 0.65)

    return F.when(text == "", -1.0).otherwise(once(compact(text), of))


def seal_score(c: Column) -> Column:
    """C-52: how likely a text is a seal's; -1 for none."""
    return once(seal_text(c), score_of_text)


def better_seal(own: Column, read: Column) -> Column:
    """C-52: the text that is there, unless it is none or what was read is better by more than BETTER."""
    a, b = seal_text(own), seal_text(read)
    return F.when(a == "", b).when((b != "") & (seal_score(b) > seal_score(a) + BETTER), b).otherwise(a)


def best_seal(contents: Column) -> Column:
    """C-52 over the readings of one seal (an array, null ones empty), in their order: the text that is there stays, unless it is none or the next one is better by more than BETTER.

    Every reading is looked at once: the text that stays is its own seal_text, and keeps its score.
    """
    read = F.transform(F.transform(contents, lambda c: F.coalesce(c, F.lit(""))), lambda c: once(seal_text(c), lambda t: F.struct(c.alias("own"), t.alias("text"), score_of_text(t).alias("score"))))

    def better(a: Column, b: Column) -> Column:
        kept = lambda x: F.struct(x["text"].alias("own"), x["text"].alias("text"), x["score"].alias("score"))
        wins = (b["text"] != "") & ((a["text"] == "") | (b["score"] > a["score"] + BETTER))
        return F.when(wins, kept(b)).when(a["text"] != "", kept(a)).otherwise(a)

    return once(read, lambda r: F.aggregate(F.slice(r, F.lit(2), F.size(r)), F.get(r, F.lit(0)), better, lambda s: s["own"]))


def table_of(cells: Column, html: Column) -> Column:
    """The cells of a table region: its own, else those of its HTML; null if neither says anything."""
    return F.coalesce(with_content(cells), F.when(is_html_table(html), with_content(html_rows(html))))


def _said(rows: Column, content: Column) -> Column:
    return F.when(rows.isNotNull(), compact(table_text(rows))).otherwise(compact(content))


def _told(rows: Column, html: Column, said: Column) -> Column:
    filled = F.size(F.filter(F.flatten(rows), lambda x: coerced(x) != ""))
    part = lambda n, most, weight: F.least(n, F.lit(most)) * weight
    of_cells = F.when(rows.isNotNull(), part(filled, 60, 0.12) + part(F.size(rows), 20, 0.08) + part(F.array_max(F.transform(rows, F.size)), 12, 0.14)).otherwise(0.0)
    return of_cells + F.when(is_html_table(html), 1.5).otherwise(0.0) + F.least(F.length(said), F.lit(180)) / 90


def table_told(cells: Column, html: Column, content: Column) -> Column:
    """(said, score) of a table, whose rows are found once."""
    return once(table_of(cells, html), lambda rows: once(_said(rows, content), lambda said: F.struct(said.alias("said"), _told(rows, html, said).alias("score"))))


def table_said(cells: Column, html: Column, content: Column) -> Column:
    """What a table says without white space: its cells, else its content."""
    return table_told(cells, html, content)["said"]


def table_score(cells: Column, html: Column, content: Column) -> Column:
    """C-53: how much a table region tells: filled cells, rows, columns, HTML and text, each up to a limit."""
    return table_told(cells, html, content)["score"]
