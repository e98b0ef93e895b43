"""Pages of readers on worked examples, odd and malformed ones included."""

import json

import pytest
from pyspark.sql import functions as F

from archivolt.functions import shapes as x
from archivolt.functions.layout import page_text


def pages(spark, value):
    r = spark.createDataFrame([(value if isinstance(value, str) or value is None else json.dumps(value),)], "j string").transform(x.normalised_pages, "j").first()
    return ([y.asDict(True) for y in r.pages] if r.pages is not None else None), r.error


def test_html_becomes_cells(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>"
    (p,), error = pages(spark, [{"page_num": 1, "regions": [{"type": "table", "bbox": [0, 0, 100, 100], "html": html}]}])
    r = p["regions"][0]
    assert error is None and r["table_data"] == [["A", "B"], ["1", "2"]] and r["html"] == html and r["content"] == "A\tB\n1\t2"
    df = spark.createDataFrame([(json.dumps([{"regions": [{"type": "table", "html": html}]}]),)], "j string")
    assert "A\tB" in x.normalised_pages(df, "j").select(page_text(F.col("pages")).alias("t")).first().t


def test_cells_win_over_html(spark):
    (p,), _ = pages(spark, {"regions": [{"type": "table", "table_data": [["a", 1.5], "b", [None, 0]], "html": "<table><tr><td>old</td></tr></table>"}]})
    r = p["regions"][0]
    assert r["table_data"] == [["a", "1.5"], ["b"], ["", ""]] and r["html"] is None and r["content"] == "a\t1.5\nb"
    assert pages(spark, {"regions": [{"type": "table"}]})[0][0]["regions"][0]["table_data"] == [[""]]


def test_lines(spark):
    lines = [{"text": " a b ", "confidence": "0.98765", "bbox": [[1, 2], [3, 4, 5], [6]]}, "no object", {"line_num": "7", "text": None, "confidence": "x"}]
    (p,), _ = pages(spark, [{"regions": [{"content": "ab", "region_lines": lines}, {"content": "other", "region_lines": lines}]}])
    kept, stale = p["regions"]
    assert kept["region_lines"] == [
        {"line_num": 1, "text": "a b", "confidence": 0.9877, "bbox": [1.0, 2.0, 3.0, 4.0], "bbox_type": "poly"},
        {"line_num": 7, "text": "", "confidence": 0.0, "bbox": [], "bbox_type": "rect"},
    ]
    assert stale["region_lines"] == [] and stale["content"] == "other" and stale["type"] == "text"


def test_places_and_numbers(spark):
    (a, b), _ = pages(spark, [{"page_num": 3.9, "regions": [{"bbox": [1, "2", 3, 4, 5], "layout_bbox": [], "bbox_type": "own"}]}, {"lines": [{"bbox": []}, {"bbox": None, "text": 0}]}])
    r = a["regions"][0]
    assert (a["page_num"], r["bbox"], r["layout_bbox"], r["bbox_type"]) == (3, [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0], "own")
    assert b["page_num"] == 2 and [(y["line_num"], y["text"]) for y in b["lines"]] == [(1, ""), (2, "")]


@pytest.mark.parametrize("value,error", [("{", "json"), (None, "json"), ([{}, 5], "page 2"), ([{"regions": ["x"]}], "page 1"), ([{"regions": [{"bbox": [1, 2]}]}], "page 1"), ([{"regions": [{"bbox": ["a", 2, 3, 4]}]}], "page 1"), ([{"regions": None}], "page 1"), ([{"page_num": "1.5"}], "page 1"), ([{"page_num": None}], "page 1"), ([{"lines": [[]]}], "page 1"), ([{"regions": [{"type": "table", "table_data": "x"}]}], "page 1")])
def test_malformed(spark, value, error):
    assert pages(spark, value) == (None, error)


def test_metadata(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": 1}, "g": 2}}}}}
    got = lambda m: pages(spark, [{"agent_meta": m}])[0][0]["agent_meta"]
    assert json.loads(got({"s": " x\0 ", "n": None, "l": [1, None, "q\"\n"], "t": True, "f": 1.5})) == {"s": "x", "l": [1, "q\""], "t": True, "f": 1.5}
    assert json.loads(got(deep)) == {"a": {"b": {"c": {"d": {"e": {}, "g": 2}}}}}
    assert got({}) is None and got([1]) is None and got({"n": None}) is None
    assert pages(spark, [])[0] == []


LOCATIONS = [
    ({"x": 1, "y": 2, "w": 3, "h": 4}, [1, 2, 4, 6]), ({"left": "1", "top": 2, "right": 5, "bottom": 6}, [1, 2, 5, 6]), ({"left": 1}, []), ([10, 10, 30, 15], [10, 10, 40, 25]), ([10, 10, 0, 15], []), ([1, 2, 3], []),
    ([1, 2, 9, 2, 9, 8, 1, 8, 99], [1, 2, 9, 8]), ([[[10, 20], [110, 20], [110, 60], [10, 60]]], [10, 20, 110, 60]), ([{"x": 5, "y": 1}, {"x": 2, "y": 7}], [2, 1, 5, 7]), ([[["bad"]]], []), ([{"p": [[1, 2], [3, 4]]}], [1, 2, 3, 4]), ("text", []), (None, []), ([], []),
]


@pytest.mark.parametrize("value,want", LOCATIONS)
def test_location(spark, value, want):
    v = F.try_parse_json(F.lit(json.dumps(value)))
    assert spark.range(1).select(x.location(v).alias("r")).first().r == want
