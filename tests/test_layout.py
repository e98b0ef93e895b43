"""Worked examples of nested pages, layouts, tables and excerpts."""

from pyspark.sql import functions as F

from archivolt.functions import layout as x


def value(spark, sql, f):
    return spark.sql(f"SELECT {sql}").select(f.alias("v")).first().v


def test_page_text(spark):
    kind = "array<struct<regions: array<struct<content: string>>, lines: array<struct<text: string>>>>"
    text = lambda pages: spark.createDataFrame([(pages,)], f"p {kind}").select(x.page_text(F.col("p")).alias("v")).first().v
    assert text([([(" a ",), ("",), ("b",)], [("no",)])]) == "a\nb"
    assert text([([("",), (None,)], [("x",), (" ",)]), ([], []), (None, None), ([("z",)], None)]) == "--- Page 1 ---\nx\n\n--- Page 4 ---\nz"
    assert text([]) == text(None) == ""


def test_gathered(spark):
    sql = "array('a', 'b', 'c') AS l, array(2, 0, 2, -1, 9, null) AS i, cast(array() AS array<int>) AS none"
    assert value(spark, sql, x.gathered(F.col("l"), F.col("i"))) == ["c", "a"]
    assert value(spark, sql, x.gathered(F.col("l"), F.col("none"))) == []


def test_looked_up(spark):
    sql = "array(named_struct('layout_id', 'p'), named_struct('layout_id', 'q')) AS l, array(named_struct('layout_id', 'p', 'v', 1), named_struct('layout_id', 'p', 'v', 2)) AS t"
    assert [r.item and r.item.v for r in value(spark, sql, x.looked_up(F.col("l"), F.col("t")))] == [2, None]


def test_cell_rows(spark):
    sql = "array('a', ' b  c ', '<img src=x>', null, 'd') AS c, array(array(0, 0, 1), array(0, 2, 3), array(4, 9, null)) AS m, array(array(2, 3)) AS blank, array('s', 's', 's') AS same, array(array(0, 1, 2)) AS row"
    assert value(spark, sql, x.cell_rows(F.col("c"), F.col("m"))) == [["a", "", "b c"], ["d", "", ""]]
    assert value(spark, sql, x.cell_rows(F.col("c"), F.col("blank"))) == [[""]]
    assert value(spark, sql, x.cell_rows(F.col("same"), F.col("row"))) == [["s", "", ""]]


def test_candidates(spark):
    sql = "array(' a', 'a', '', 'b') AS t, array('') AS n"
    assert value(spark, sql, x.candidates_text(F.col("t"), F.col("n"))) == "标题候选：\n- a\n- b"
    assert value(spark, sql, x.candidates_text(F.col("n"), F.col("n"))) == ""


def plain_excerpt(text, extra, most):
    clean = "\n".join(s.strip() for s in text.split("\n") if s.strip())
    if len(clean) <= most and not extra:
        return clean
    room = max(most - len(extra) - 260, 360)
    a, b, c = max(int(room * 0.45), 200), max(int(room * 0.2), 120), max(int(room * 0.35), 200)
    at = max(len(clean) // 2 - b // 2, 0)
    said = f"{x.PARTS[0]}\n{clean[:a]}\n\n{x.PARTS[1]}\n{clean[at:at + b]}\n\n{x.PARTS[2]}\n{clean[-c:]}".strip()
    return (f"{extra}\n\n{x.WHOLE}\n{said}" if extra else said)[:most]


def test_excerpt(spark):
    rows = [(" \n".join(f"line {i * i}" for i in range(n)), extra) for n in (0, 1, 40, 90, 400) for extra in ("", "head", "long " * 90)]
    got = spark.createDataFrame(rows, "t string, e string").select("t", "e", *(x.excerpt(F.col("t"), F.col("e"), m).alias(f"m{m}") for m in (300, 900))).collect()
    assert value(spark, "'--- 第 2 页 ---\\n a \\n' AS t", x.excerpt(F.col("t"), F.lit(""), 300)) == "a"
    for r in got:
        assert r.m300 == plain_excerpt(r.t, r.e, 300) and r.m900 == plain_excerpt(r.t, r.e, 900)


def test_spilled(spark):
    for n, apart in ((3, False), (4, True)):
        got = x.spilled(F.lit("é" * (n // 2) + "a" * (n % 2)), 3)
        assert value(spark, "1", got["apart"]) is apart and (value(spark, "1", got["sha256"]) is not None) is apart
