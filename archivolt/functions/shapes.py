"""Results of readers, JSON of unknown shape, as pages of one shape: VARIANT values, nothing is exploded or shuffled.

A value that can't be what it must be makes its document malformed: its pages are null and `error` says where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grids import html_rows, table_text
from .text import compact, coerced

#: Nested deeper than this, metadata is left out.
DEPTH = 5
LINE = "struct<line_num:int,text:string,confidence:double,bbox:array<double>,bbox_type:string>"


def once(value: Column, use) -> Column:
    """use(value), with value worked out and written once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def items(v: Column) -> Column:
    """The elements of an array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def entries(v: Column) -> Column:
    """The members of an object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def member(obj: Column, name: str) -> Column:
    """Null where the object lacks it; a JSON null stays a value."""
    return F.try_element_at(obj, F.lit(name))


def number(v: Column) -> Column:
    """A number, or a text that is one; null for anything else."""
    return F.try_variant_get(v, "$", "double")


def is_null(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def plain(v: Column) -> Column:
    """A text without white space at its ends and NUL; null, false and zero are ''."""
    s = F.when(items(v).isNull() & entries(v).isNull(), F.try_variant_get(v, "$", "string"))
    kind = F.when(s.isNotNull(), F.schema_of_variant(v))
    return coerced(F.when((kind == "STRING") | ~s.isin("0", "0.0", "false"), F.replace(s, F.lit("\0"), F.lit(""))))


def nothing(v: Column) -> Column:
    """What is empty in the sense of readers: null, '', 0, false, [] and {}."""
    return is_null(v) | F.coalesce(F.size(items(v)) == 0, F.size(entries(v)) == 0, F.try_variant_get(v, "$", "string").isin("", "0", "0.0", "false"), F.lit(False))


def place(v: Column) -> Column:
    """C-30: struct<bbox,bbox_type,ok>: four numbers of a rectangle, or x and y of each point of a polygon one after the other."""
    none = F.array().cast("array<double>")
    out = lambda x, kind, ok: F.struct(x.alias("bbox"), F.lit(kind).alias("bbox_type"), ok.alias("ok"))
    whole = lambda x: F.coalesce(F.forall(x, lambda y: y.isNotNull()), F.lit(False))
    given = lambda kind: lambda x: out(x, kind, whole(x))
    point = lambda p: F.when(p.isNull(), F.array(F.lit(None).cast("double"))).when(F.size(p) >= 2, F.array(number(F.get(p, F.lit(0))), number(F.get(p, F.lit(1))))).otherwise(none)

    def read(v: Column) -> Column:
        a = items(v)
        of_points = F.coalesce(F.size(items(F.get(a, F.lit(0)))) >= 0, F.lit(False))
        poly = once(F.flatten(F.transform(a, lambda p: once(items(p), point))), given("poly"))
        rect = once(F.transform(F.slice(a, 1, 4), number), given("rect"))
        return F.when(nothing(v), out(none, "rect", F.lit(True))).when(of_points, poly).when(F.size(a) >= 4, rect).otherwise(out(none, "rect", F.lit(False)))

    return once(v, read)


def whole_number(obj: Column, name: str, otherwise: Column) -> Column:
    """An object's whole number, cut towards zero; `otherwise` where it has no such member; null where that is no number."""
    v = member(obj, name)
    whole = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "int")).otherwise(number(v).cast("int"))
    return F.when(v.isNull(), otherwise).when(~is_null(v), whole)


def line(v: Column, at: Column) -> Column:
    """A line of text; its confidence is 0 where that is no number. struct<line,ok>."""

    def read(x: Column) -> Column:
        o, where, num = x["o"], x["where"], x["num"]
        fields = F.struct(num.alias("line_num"), plain(member(o, "text")).alias("text"), F.round(F.coalesce(number(member(o, "confidence")), F.lit(0.0)), 4).alias("confidence"), where["bbox"].alias("bbox"), where["bbox_type"].alias("bbox_type"))
        return F.struct(fields.alias("line"), (o.isNotNull() & where["ok"] & num.isNotNull()).alias("ok"))

    parts = lambda o: F.struct(o.alias("o"), place(member(o, "bbox")).alias("where"), whole_number(o, "line_num", at + 1).alias("num"))
    return once(once(entries(v), parts), read)


def metadata(v: Column, depth: int = 0) -> Column:
    """JSON of a value without nulls and what is nested deeper than DEPTH, texts without white space at their ends; null if nothing is left."""
    if depth > DEPTH:
        return F.lit(None).cast("string")
    quoted = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")
    text = F.when(F.schema_of_variant(v) == "STRING", quoted(coerced(F.replace(F.try_variant_get(v, "$", "string"), F.lit("\0"), F.lit("")))))
    # elements of an array are members without a name, so that one expression a level serves both
    inside = F.coalesce(F.map_entries(entries(v)), F.transform(items(v), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))))
    named = lambda e: once(metadata(e["value"], depth + 1), lambda m: F.when(e["key"].isNull(), m).otherwise(F.concat(quoted(e["key"]), F.lit(":"), m)))
    joined = F.array_join(F.filter(F.transform(inside, named), lambda y: y.isNotNull()), ",")
    nested = F.concat(F.when(entries(v).isNull(), "[").otherwise("{"), joined, F.when(entries(v).isNull(), "]").otherwise("}"))
    return F.when(is_null(v), None).otherwise(F.coalesce(nested, text, F.to_json(v)))


def object_metadata(v: Column) -> Column:
    """The metadata of an object that has any; else null."""
    return once(F.when(entries(v).isNotNull(), metadata(v)), lambda m: F.when(m != "{}", m))


def table_cells(v: Column) -> Column:
    """The rows of table_data: a row that is no array is one cell, none at all one blank cell. Null for what is no array."""
    rows = F.transform(items(v), lambda r: F.coalesce(F.transform(items(r), plain), F.array(plain(r))))
    return F.when(F.size(rows) > 0, rows).when(items(v).isNotNull() | is_null(v), F.array(F.array(F.lit(""))))


def region_parts(v: Column) -> Column:
    """What a region's object holds, each part read by itself: struct<o,kind,own,around,content,read,html,cells>."""
    html = lambda o: coerced(F.try_variant_get(member(o, "html"), "$", "string"))

    def parts(o: Column) -> Column:
        kind = F.coalesce(F.nullif(F.when(F.map_contains_key(o, "type"), plain(member(o, "type"))).otherwise("text"), F.lit("")), F.lit("text"))
        around = place(F.when(F.map_contains_key(o, "layout_bbox"), member(o, "layout_bbox")).otherwise(member(o, "bbox")))
        # elements that are no objects go, but keep their place, which numbers the others
        read = F.filter(F.transform(items(member(o, "region_lines")), lambda x, i: F.struct(entries(x).isNotNull().alias("is"), line(x, i).alias("l"))), lambda x: x["is"])
        return F.struct(o.alias("o"), kind.alias("kind"), place(member(o, "bbox")).alias("own"), around.alias("around"), plain(member(o, "content")).alias("content"), F.transform(read, lambda x: x["l"]).alias("read"), html(o).alias("html"), table_cells(member(o, "table_data")).alias("cells"))

    return once(entries(v), parts)


def region(p: Column, of_html: Column, meta: Column) -> Column:
    """A region of its parts, the cells of its HTML and its metadata. struct<region,ok>.

    Lines of another text than its content are stale and go; HTML that says something else than its cells goes.
    """
    no_lines, blank = F.array().cast(f"array<{LINE}>"), F.array(F.array(F.lit("")))
    is_table, given = p["kind"] == "table", member(p["o"], "table_data")
    lines = F.coalesce(F.transform(p["read"], lambda x: x["line"]), no_lines)
    told = F.when(is_table, F.when(is_null(given), F.coalesce(of_html, blank)).otherwise(p["cells"]))
    said = compact(F.array_join(F.filter(F.transform(lines, lambda x: x["text"]), lambda x: x != ""), "\n"))
    stale = ~is_table & (p["content"] != "") & (said != "") & (said != compact(p["content"]))
    own, kind = p["own"], F.try_variant_get(member(p["o"], "bbox_type"), "$", "string")
    fields = F.struct(
        p["kind"].alias("type"), own["bbox"].alias("bbox"), F.when(F.size(own["bbox"]) > 0, F.coalesce(kind, own["bbox_type"])).otherwise(own["bbox_type"]).alias("bbox_type"),
        F.when(F.size(p["around"]["bbox"]) > 0, p["around"]["bbox"]).otherwise(own["bbox"]).alias("layout_bbox"), F.when(is_table, table_text(told)).otherwise(p["content"]).alias("content"),
        F.when(stale, no_lines).otherwise(lines).alias("region_lines"), told.alias("table_data"), F.when(is_table & (told == of_html), p["html"]).alias("html"), meta.alias("agent_meta"),
    )
    ok = p["o"].isNotNull() & own["ok"] & p["around"]["ok"] & F.coalesce(F.forall(p["read"], lambda x: x["ok"]), F.lit(True)) & (~is_table | told.isNotNull())
    return F.struct(fields.alias("region"), ok.alias("ok"))


def normalised_pages(rows: DataFrame, json: str) -> DataFrame:
    """C-30: rows with pages and error, from a column of JSON: an array of pages or one page.

    error: 'json' for text that is no JSON, 'page 2' for the first page that can't be read; pages are null then. A step a
    column, so that each is worked out once; all stay in one stage.
    """
    none = F.array().cast("array<variant>")

    def split(v: Column, i: Column) -> Column:
        listed = lambda o, name: F.when(F.map_contains_key(o, name), items(member(o, name))).when(o.isNotNull(), none)
        return once(entries(v), lambda o: F.struct(o.alias("o"), listed(o, "regions").alias("regions"), listed(o, "lines").alias("lines"), whole_number(o, "page_num", i + 1).alias("num")))

    each = lambda f: F.transform("__p", lambda p: F.transform(p["regions"], f))
    at = lambda c, i, k: F.get(F.get(c, i), k)
    out = rows.withColumn("__v", F.try_parse_json(json))
    out = out.withColumn("__p", F.transform(F.coalesce(items(F.col("__v")), F.array("__v")), split))
    out = out.withColumn("__r", each(region_parts)).withColumn("__m", each(lambda r: object_metadata(member(entries(r), "agent_meta"))))
    out = out.withColumn("__h", F.transform("__r", lambda p: F.transform(p, lambda r: F.when((r["kind"] == "table") & (r["html"] != ""), html_rows(r["html"])))))
    out = out.withColumn("__l", F.transform("__p", lambda p: F.transform(p["lines"], line))).withColumn("__pm", F.transform("__p", lambda p: object_metadata(member(p["o"], "agent_meta"))))
    out = out.withColumn("__r", F.transform("__r", lambda p, i: F.transform(p, lambda r, k: region(r, at("__h", i, k), at("__m", i, k)))))

    def page(p: Column, i: Column) -> Column:
        regions, lines = F.get("__r", i), F.get("__l", i)
        good = lambda x: F.coalesce(F.forall(x, lambda y: y["ok"]), F.lit(False))
        fields = F.struct(p["num"].alias("page_num"), F.transform(regions, lambda x: x["region"]).alias("regions"), F.transform(lines, lambda x: x["line"]).alias("lines"), F.get("__pm", i).alias("agent_meta"))
        return F.struct(fields.alias("page"), (p["o"].isNotNull() & p["num"].isNotNull() & good(regions) & good(lines)).alias("ok"))

    out = out.withColumn("__q", F.transform("__p", page))
    first = F.array_position(F.transform("__q", lambda x: x["ok"]), False)
    error = F.when(F.col("__v").isNull(), "json").when(first > 0, F.concat(F.lit("page "), first.cast("string")))
    return out.withColumn("error", error).withColumn("pages", F.when(F.col("error").isNull(), F.transform("__q", lambda x: x["page"]))).select(*rows.columns, "pages", "error")


def points(v: Column, depth: int = 4) -> Column:
    """C-51: x, y pairs of a polygon, however deep its points are nested in arrays and objects, to `depth`; what is no number is 0."""
    none = F.array().cast("array<struct<x:double,y:double>>")
    if depth < 0:
        return none
    zero = lambda x: F.coalesce(number(x), F.lit(0.0))
    pair = lambda x, y: F.array(F.struct(zero(x).alias("x"), zero(y).alias("y")))
    scalar = lambda x: items(x).isNull() & entries(x).isNull()
    a, o = items(v), entries(v)
    inner = F.flatten(F.transform(F.coalesce(a, F.map_values(o)), lambda y: points(y, depth - 1)))
    two = (F.size(a) >= 2) & scalar(F.get(a, F.lit(0))) & scalar(F.get(a, F.lit(1)))
    out = F.when(two, pair(F.get(a, F.lit(0)), F.get(a, F.lit(1)))).when(F.map_contains_key(o, "x") & F.map_contains_key(o, "y"), pair(member(o, "x"), member(o, "y")))
    return F.coalesce(out, inner, none)


def rectangle(found: Column) -> Column:
    """The rectangle around points, [x1, y1, x2, y2]; empty without any."""

    def around(p: Column) -> Column:
        xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
        return F.when(F.size(p) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(F.array().cast("array<double>"))

    return once(found, around)


def location(v: Column) -> Column:
    """C-51: [x1, y1, x2, y2] of a place given as an object of sizes or sides, four numbers (left, top, width, height), eight, or nested points; else empty."""
    a, o = items(v), entries(v)
    zero = lambda x: F.coalesce(number(x), F.lit(0.0))
    side = lambda *names: zero(F.coalesce(*(member(o, n) for n in names)))
    x, y, w, h = side("x", "left"), side("y", "top"), side("w", "width"), side("h", "height")
    right, bottom = F.coalesce(number(member(o, "right")), x), F.coalesce(number(member(o, "bottom")), y)
    none = F.array().cast("array<double>")
    n = F.transform(a, zero)
    of_object = F.when((w > 0) & (h > 0), F.array(x, y, x + w, y + h)).when((right > x) & (bottom > y), F.array(x, y, right, bottom)).otherwise(none)
    at = lambda k: F.get(n, F.lit(k))
    nested = items(F.get(a, F.lit(0))).isNotNull() | entries(F.get(a, F.lit(0))).isNotNull()
    eight = rectangle(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(n, 2 * i).alias("x"), F.get(n, 2 * i + 1).alias("y"))))
    of_array = F.when(nested, rectangle(points(v))).when(F.size(a) >= 8, eight).when((F.size(a) >= 4) & (at(2) > 0) & (at(3) > 0), F.array(at(0), at(1), at(0) + at(2), at(1) + at(3))).otherwise(none)
    return F.when(o.isNotNull(), of_object).when(a.isNotNull(), of_array).otherwise(none)
