"""Results of other readers on worked examples."""

import json

from pyspark.sql import functions as F

from archivolt.functions import readers as r
from archivolt.functions import shapes


def regions(spark, page):
    df = spark.createDataFrame([(json.dumps({"pages": [page]}),)], "j string")
    return r.foreign_documents(df, "j").first().pages[0].regions


def test_nested_and_bad_places(spark):
    page = {
        "layouts": [
            {"layout_id": "1", "type": "text", "position": [[[10, 20], [110, 20], [110, 60], [10, 60]]], "text": " t ", "span_boxes": [{"text": "s", "location": [[[12, 22], [50, 22], [50, 36], [12, 36]]]}]},
            {"layout_id": "2", "type": "text", "position": [0, 0, 100, 40], "text": "x", "span_boxes": [{"text": "A", "location": [10, 10, 30, 15]}, {"text": "B", "location": [[["bad"]]]}, {"text": " "}]},
            "no object",
        ]
    }
    a, b = regions(spark, page)
    assert a.bbox == [10.0, 20.0, 110.0, 60.0] and a.content == "t" and a.region_lines[0].bbox == [12.0, 22.0, 50.0, 36.0]
    assert b.bbox == [0.0, 0.0, 100.0, 40.0] and [(s.text, s.bbox) for s in b.region_lines] == [("A", [10.0, 10.0, 40.0, 25.0]), ("B", [])]


def test_tables_and_images_by_id(spark):
    page = {
        "layouts": [{"layout_id": "a", "type": "table", "text": "gone"}, {"layout_id": "b", "type": "table"}, {"layout_id": "c", "type": "image", "text": "gone"}, {"layout_id": "x", "type": "Title", "text": "kept"}, {"type": "table", "text": "no id"}],
        "tables": [{"layout_id": "a", "cells": [{"text": "old"}], "matrix": [[0]]}, {"layout_id": "a", "cells": [{"text": "h"}, {"text": "1"}, {"text": None}], "matrix": [[0, 0], [1, "2"], [9, None]]}, {"layout_id": "b", "markdown": "| m | n |\n|---|---|\n| ![i](u) | 2 |"}, {"cells": []}],
        "images": [{"layout_id": "c"}],
    }
    a, b, c, x, n = regions(spark, page)
    assert (a.type, a.content, a.table_data, a.html) == ("table", "", [["h", ""], ["1", ""]], None)
    assert b.table_data == [["m", "n"], ["", "2"]] and b.html.startswith("<table><tr><th>m</th>")
    assert (c.type, c.content, x.type, x.content, n.content, n.table_data) == ("image", "", "paragraph_title", "kept", "no id", None)


def test_documents(spark):
    two = {"pages": [{"page_num": 4, "layouts": [{"type": "table", "layout_id": "t"}, {"text": "a"}], "tables": [{"layout_id": "t"}]}, {"layouts": [{"text": "b"}]}]}
    df = spark.createDataFrame([(1, json.dumps(two)), (2, "{"), (3, None), (4, '{"pages": [{}]}')], "id int, j string")
    got = {x.id: (x.page_count, [p.page_num for p in x.pages], x.full_text) for x in r.foreign_documents(df, "j").collect()}
    assert got == {1: (2, [5, 1], "--- 第 1 页 ---\n[表格]\na\n\n--- 第 2 页 ---\nb"), 2: (1, [1], ""), 3: (1, [1], ""), 4: (1, [1], "")}


def test_markdown_page(spark):
    text = "# Head **x**\nsecond [a](b)\n \n| a | b |\n|---|---|\n| 1 | - 2 |\n\n![i](u)\n\r\n- item"
    p = spark.createDataFrame([(text,), (None,)], "t string").select(r.markdown_page(F.col("t")).alias("p")).collect()
    a, table, item = p[0].p.regions
    assert (a.type, a.content, a.region_lines) == ("text", "Head x\nsecond a", ["Head x", "second a"])
    assert (table.type, table.content, table.table_data) == ("table", "a\tb\n1\t- 2", [["a", "b"], ["1", "- 2"]]) and table.region_lines == ["a b", "1 - 2"] and "<td>1</td>" in table.html
    assert item.content == "item" and p[0].p.lines == ["Head x", "second a", "a b", "1 - 2", "item"] and p[1].p.regions == []


def test_office_lines(spark):
    result = {"results": [
        {"words": [{"word": "a", "words_location": {"left": 1, "top": 2, "width": 3, "height": 4}}, {"words": " b", "poly_location": [{"x": 9, "y": 1}, {"x": 12, "y": 5}]}, "c"], "line_probability": {"average": 0.91234}},
        {"words": {"word": "one", "location": [1, 1, 2, 2]}, "probability": [0.5, 0, {"score": 0.7}]}, {"words": " plain ", "location": {"left": 5, "top": 5, "right": 9, "bottom": 8}}, {"words": " "}, {"words": [], "word": "x"}, {"word": "w"},
    ]}
    v = F.try_parse_json(F.lit(json.dumps(result)))
    got = spark.range(1).select(v.alias("v")).select(r.office_lines(shapes.entries(F.col("v"))).alias("l")).first().l
    assert [(x.line_num, x.text, x.confidence, x.bbox) for x in got] == [(1, "abc", 0.9123, [1.0, 1.0, 12.0, 6.0]), (2, "one", 0.6, [1.0, 1.0, 1.0, 1.0]), (3, "plain", 0.0, [5.0, 5.0, 9.0, 8.0]), (6, "w", 0.0, [])]
