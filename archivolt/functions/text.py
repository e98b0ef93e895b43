"""Scalar functions over texts, file names, dates and fingerprints, as column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators that normalising drops, and patterns of file names, dates and page numbers.
SEPARATORS = r"[\s,.;:!?\-_/\\，。；：！？（）()《》【】\[\]]+"
SEPARATORS_EVALUATION = r"[\s,.;:!?\-_/\\，。；：！？（）()《》【】\[\]、]+"
TAG = r"<[^>]+>"
PAGE_FILE = r"(?i)^(.+)-(\d{3})\.(?:png|jpe?g|bmp|tiff?|webp)$"
SEQUENCE = (r"第\s*(\d+)\s*(?:册|卷|部分|篇)", r"(?i)(?:part|vol|volume|册|卷|p)[\s_-]*(\d+)", r"(\d{1,4})\D*$")
DATE = r"(\d{4})\s*(?:年|[./-])\s*(\d{1,2})\s*(?:月|[./-])\s*(\d{1,2})\s*日?"
PAGE_NUMBER = r"^(?:第?\s*\d+\s*页|共?\s*\d+\s*页|[-—－]+\s*\d+\s*[-—－]+|\d+\s*/\s*\d+)$"


def coerced(c: Column) -> Column:
    """C-01: text without white space at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it: branches of CASE, AND and OR share nothing by themselves."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def rounded(c: Column, digits: int = 4) -> Column:
    """A number of 0 or more with so many digits: its product with a power of ten, half up, as in the SQL.

    Spark's own round goes by the shortest decimal text: of 0.45994999999999997 it makes 0.4599, though the product is 4599.5.
    """
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def rounded_by_decimal(c: Column, digits: int = 4, places: int = 17) -> Column:
    """A number of 0 to 90 with so many digits, half up, by its decimal of 17 places, as the SQL casts it: the product with a power of ten is rounded first.

    So noise of sums in the last places doesn't decide a half; Spark's own cast goes by the shortest decimal text.
    """
    whole = lambda v: F.floor(v) + (v - F.floor(v) >= 0.5).cast("long")
    step = 10 ** (places - digits)
    return F.call_function("div", once(c * float(10**places), whole) + F.lit(step // 2), F.lit(step)) / float(10**digits)


def normalised(c: Column, pattern: str = SEPARATORS) -> Column:
    """C-02 and, with SEPARATORS_EVALUATION, C-03."""
    return F.lower(F.regexp_replace(coerced(c), pattern, ""))


def word_characters(c: Column) -> Column:
    """C-04: letters, digits and underscores of any script, lower case."""
    return F.lower(F.regexp_replace(coerced(c), r"[^\p{L}\p{N}_]+", ""))


def compact(c: Column) -> Column:
    """C-05."""
    return F.regexp_replace(coerced(c), r"\s+", "")


def without_tags(c: Column) -> Column:
    """C-06."""
    return F.regexp_replace(coerced(c), TAG, " ")


def visible(c: Column, n: int, last: bool = False) -> Column:
    """C-07: the first or last n characters of the visible text."""
    plain = F.regexp_replace(without_tags(c), r"\s+", " ")
    return F.trim(F.right(plain, F.lit(n)) if last else F.left(plain, F.lit(n)))


def title_hint(c: Column, n: int = 80) -> Column:
    """C-08: the start of the first line that is not blank; empty if there is none."""
    lines = F.transform(F.split(without_tags(c), r"[\r\n]+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.left(F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit("")), F.lit(n))


def family(c: Column, rules: list[tuple[str, tuple[str, ...], int]]) -> Column:
    """C-09: the first family of which at least so many keywords occur; empty if none."""
    out = None
    for name, keywords, least in rules:
        hits = sum((F.contains(c, F.lit(k)).cast("int") for k in keywords), F.lit(0))
        out = F.when(hits >= least, name) if out is None else out.when(hits >= least, name)
    return out.otherwise("")


# The words of each family, in the order they are tried, and how many of them must occur.
FAMILIES = (
    ("budget", ("预算书", "预算汇总", "预算表", "造价预算", "造价书", "造价"), 1),
    ("contract", ("合同", "协议", "补充协议"), 1),
    ("minutes", ("会议纪要", "会议记录", "会议决定", "会议议定事项"), 1),
    ("contract", ("甲方", "乙方", "本合同", "付款方式", "质保金", "质保期", "开户行", "帐号", "验收合格"), 3),
    ("minutes", ("会议传达", "会议强调", "会议要求", "会议指出", "纪要如下", "出席", "请假"), 2),
    ("quote", ("报价",), 1),
    ("drawing", ("平面图", "立面图", "剖面图", "尺寸图", "细节说明图", "图号"), 1),
    ("instruction", ("施工说明", "设计说明", "说明"), 1),
    ("license", ("营业执照",), 1),
    ("certificate", ("资质证书", "证书"), 1),
    ("catalog", ("目录",), 1),
)


def document_family(title: Column, text: Column, most: int = 2000) -> Column:
    """C-09: the family of a title, else of the start of a text; empty if neither tells."""
    of = lambda c: once(coerced(c), lambda t: family(t, list(FAMILIES)))
    return F.coalesce(F.nullif(of(title), F.lit("")), of(F.left(coerced(text), F.lit(most))))


def masked(c: Column, first: int = 8, last: int = 6) -> Column:
    """C-62: a secret's ends; a short one as stars."""
    s = coerced(c)
    stars = F.repeat(F.lit("*"), F.least(F.length(s), F.lit(8)))
    return F.when(s == "", "<empty>").when(F.length(s) <= first + last, stars).otherwise(F.concat(F.left(s, F.lit(first)), F.lit("..."), F.right(s, F.lit(last))))


# Names of regions of another reader and what they are here.
REGIONS = {"chart": "chart", "doc_title": "doc_title", "footer": "footer", "footer_image": "image", "formula_number": "number", "head_tail": "other_text", "header": "header", "header_image": "image", "image": "image", "number": "number", "paragraph_title": "paragraph_title", "seal": "seal", "table": "table", "title": "paragraph_title"}


def region_type(label: Column, has_table: Column) -> Column:
    """C-54: table, seal, or the label in lower case; text without one."""
    s = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(F.coalesce(has_table, F.lit(False)) | s.isin("table", "table_body"), "table").when(s.contains("seal") | s.contains("stamp"), "seal").when(s == "", "text").otherwise(s)


def foreign_region(label: Column) -> Column:
    """C-54: the type of another reader's region; those not named are text."""
    out = F.lit("text")
    for k, v in REGIONS.items():
        out = F.when(F.lower(label) == k, v).otherwise(out)
    return out


def text_similarity(a: Column, b: Column, ratio: Column | None = None) -> Column:
    """C-14: 1 for equal texts, 0.92 if one holds the other, else their ratio (0 if it is not given); 0 for an empty one."""
    some = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(~some, 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.92).otherwise(ratio if ratio is not None else F.lit(0.0))


def entities(c: Column, patterns: list[str], least: int = 4, most: int = 48) -> Column:
    """C-11: distinct normalised matches of group 1 of the patterns, sorted."""
    found = once(without_tags(c), lambda t: F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in patterns)))
    found = F.transform(found, lambda x: F.left(F.lower(F.regexp_replace(x, SEPARATORS, "")), F.lit(most)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) >= least)))


def grams(c: Column) -> Column:
    """C-12: distinct character pairs, or triples from 24 characters on; a shorter text is its own gram.

    One pass of an empty look-ahead, not a substring per position, which would be quadratic in a long text.
    """
    of = lambda s, n: F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    make = lambda s: F.when(s == "", F.array().cast("array<string>")).when(F.length(s) <= 2, F.array(s)).otherwise(F.array_distinct(F.when(F.length(s) < 24, of(s, 2)).otherwise(of(s, 3))))
    return once(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", "")), make)


def jaccard(a: Column, b: Column) -> Column:
    """U-01: of two arrays of distinct values, 4 digits; null if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), rounded(both / (F.size(a) + F.size(b) - both)))


def page_prefix(name: Column) -> Column:
    """C-15: null if the name isn't that of a page image."""
    return F.nullif(F.regexp_extract(name, PAGE_FILE, 1), F.lit(""))


def page_number(name: Column) -> Column:
    """C-15."""
    return F.nullif(F.regexp_extract(name, PAGE_FILE, 2), F.lit("")).cast("long")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def sequence_number(path: Column) -> Column:
    """C-16: the first pattern that matches the stem gives the number."""
    return F.coalesce(*(F.nullif(F.regexp_extract(stem(path), p, 1), F.lit("")) for p in SEQUENCE)).cast("long")


def series_key(path: Column) -> Column:
    """C-17: the parent folder and the stem without its page suffix, both normalised."""
    bare = F.regexp_replace(stem(path), r"(?i)(?:[_-]?page[_-]?\d+|[_-]?\d{1,4})$", "")
    parent = F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")
    key = F.concat(normalised(parent), F.lit("|"), normalised(F.when(bare == "", stem(path)).otherwise(bare)))
    return F.when(key == "|", "").otherwise(key)


def number_prefix(c: Column) -> Column:
    """C-18."""
    return F.left(F.regexp_replace(F.coalesce(c, F.lit("")), r"\d+", ""), F.lit(12))


def dates(c: Column) -> Column:
    """C-23: distinct ISO dates in order; a day up to 31 is taken in any month."""

    def found(text: Column) -> Column:
        part = lambda k: F.regexp_extract_all(text, F.lit(DATE), F.lit(k))
        all3 = F.arrays_zip(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))
        valid = F.filter(all3, lambda x: x["y"].cast("int").between(1900, 2100) & x["m"].cast("int").between(1, 12) & x["d"].cast("int").between(1, 31))
        return F.array_distinct(F.transform(valid, lambda x: F.concat_ws("-", x["y"], F.lpad(x["m"], 2, "0"), F.lpad(x["d"], 2, "0"))))

    return once(c, found)


def is_page_number(c: Column) -> Column:
    """C-24."""
    return coerced(c).rlike(PAGE_NUMBER)


def timeout_seconds(pages: Column, chars: Column) -> Column:
    """C-39."""
    return F.when((pages >= 6) | (chars >= 4000), 180).when((pages >= 3) | (chars >= 2000), 120).otherwise(60)


def chunks(c: Column, size: int = 600, step: int = 480) -> Column:
    """C-41: the paragraphs of a text; those of over `size` characters as overlapping windows."""
    paragraphs = F.filter(F.transform(F.split(coerced(c), r"\n\s*\n+"), coerced), lambda x: x != "")
    windows = lambda p: F.greatest(F.lit(0), F.ceil((F.length(p) - size) / step)).cast("int")
    cut = F.flatten(F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), windows(p)), lambda i: coerced(p.substr(i * step + 1, F.lit(size))))))
    return F.filter(cut, lambda x: x != "")


def tokens(c: Column) -> Column:
    """C-45: lower-case runs of ASCII letters and digits or CJK characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9\x{4e00}-\x{9fff}]+)"), F.lit(1))


def hamming(a: Column, b: Column) -> Column:
    """C-46."""
    return F.bit_count(a.bitwiseXOR(b))


def profile_distance(rows: tuple[Column, Column], cols: tuple[Column, Column], ink: tuple[Column, Column], digits: Callable[[Column], Column] = lambda c: F.round(c, 4)) -> Column:
    """C-47: mean of the row, column and ink gaps, 4 digits; the ink gap alone where a profile is missing."""
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    sizes = [F.size(x) > 0 for x in (*rows, *cols)]
    inks = F.abs(ink[0] - ink[1])
    return F.when(sizes[0] & sizes[1] & sizes[2] & sizes[3], digits((gap(*rows) + gap(*cols) + inks) / 3)).otherwise(inks)


def change_score(ph: Column, layout: Column, profile: Column, text: Column, threshold: int) -> Column:
    """C-48 (A.6): how far two pages differ, 4 digits; text is their similarity or null."""
    lim, prof = max(threshold + 4, 12), max(0.14, min(0.32, threshold / 40))
    part = lambda c, top: F.least(F.lit(1.0), c / top)
    return F.round(part(ph, max(1.0, threshold * 1.75)) * 0.55 + part(layout, max(1.0, lim * 1.3)) * 0.25 + part(profile, max(0.01, prof * 1.25)) * 0.20 + F.coalesce(1 - text, F.lit(0.0)) * 0.15, 4)


def page_splits(ph: Column, layout: Column, profile: Column, text: Column, threshold: int, text_threshold: float = 0.35) -> Column:
    """C-48: whether a new document starts."""
    lim, prof = max(threshold + 4, 12), max(0.14, min(0.32, threshold / 40))
    more = (layout > lim) | (profile > prof) | F.coalesce(text < text_threshold, F.lit(False)) | (change_score(ph, layout, profile, text, threshold) >= 0.95)
    return (ph > threshold) & more


def marked(c: Column, word: str) -> Column:
    """C-60: markup escaped, then hits of a word marked, whatever their case."""
    import re

    safe = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(safe, f"(?i)({re.escape(word)})", "<mark>$1</mark>")


def overlap_on_smaller(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """C-50: shared area of two rectangles (x1, y1, x2, y2) over the smaller one's area; 0 without area."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    area = lambda r: F.greatest(r[2] - r[0], F.lit(0.0)) * F.greatest(r[3] - r[1], F.lit(0.0))
    small = F.least(area(a), area(b))
    return F.when(small > 0, side(0, 2) * side(1, 3) / small).otherwise(0.0)
