"""Regions and seals that say the same twice: worked examples, and how they are dealt to Python."""

from pyspark.sql import functions as F

from archivolt.functions import seals as x
from archivolt.operators import layout_regions as r

SEALS = "page_id long, region_id int, detected boolean, content string, x1 double, y1 double, x2 double, y2 double"


def test_merged_seals(spark):
    rows = [
        (1, 0, False, None, 0.0, 0.0, 10.0, 10.0), (1, 1, False, "a,b", 100.0, 0.0, 110.0, 10.0), (1, 2, True, "某某公司", 1.0, 0.0, 11.0, 10.0), (1, 3, True, "某", 0.0, 0.0, 10.0, 10.0),
        (1, 4, True, "某某有限公司章", 100.0, 0.0, 110.0, 10.0), (1, 5, True, "x", 50.0, 0.0, 60.0, 10.0), (2, 7, True, None, None, 0.0, 1.0, 1.0), (2, 8, True, " ", None, 0.0, 1.0, 1.0),
    ]
    found = r.merged_seals(spark.createDataFrame(rows, SEALS))
    assert sorted(tuple(v) for v in found.collect()) == [(1, 0, "某某公司"), (1, 1, "某某有限公司章"), (1, 5, "x"), (2, 7, ""), (2, 8, " ")]


def test_kept_regions(spark):
    kind = "page_id long, region_id int, type string, content string, x1 double, y1 double, x2 double, y2 double, said string, score double"
    rows = [
        (1, 0, "table", "", 0.0, 0.0, 10.0, 10.0, "abc", 1.0), (1, 1, "text", "a b", 0.0, 0.0, 5.0, 5.0, None, None), (1, 2, "table", "", 0.0, 0.0, 10.0, 10.0, "abcd", 2.0),
        (1, 3, "text", "z", 0.0, 0.0, 5.0, 5.0, None, None), (1, 4, "figure", None, None, None, None, None, None, None), (2, 0, "table", "", None, 0.0, 1.0, 1.0, None, None),
    ]
    found = r.kept_regions(spark.createDataFrame(rows, kind))
    assert sorted(tuple(v) for v in found.collect()) == [(1, 2, 0), (1, 3, 1), (1, 4, 2), (2, 0, 0)]


def test_pages_are_dealt_in_batches(spark):
    seals = spark.range(50).selectExpr("id AS page_id", "0 AS region_id", "false AS detected", "'s' AS content", "0D AS x1", "0D AS y1", "1D AS x2", "1D AS y2")
    regions = seals.selectExpr("*", "'table' AS type", "'s' AS said", "1D AS score")
    for df in (r.merged_seals(seals), r.kept_regions(regions)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and "Join" not in plan and df.count() == 50


def test_best_seal_is_the_fold_of_better_seals(spark):
    texts = ["", None, " 章 ", "某某公司", "1234567", "a,b", "长" * 40, "x\n\ny", "合同专用章\n某某有限公司", "1\n2\n3\n4\n5"]
    rows = [(i, [texts[(i * 3 + k * (1 + i % 4)) % len(texts)] for k in range(1 + i % 4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, c array<string>").withColumn("c4", F.concat("c", F.array_repeat(F.lit(""), 4 - F.size("c"))))
    own = F.coalesce(F.get("c4", F.lit(0)), F.lit(""))
    df = df.withColumn("plain", own)
    for k in range(1, 4):
        best = x.better_seal(F.col("plain"), F.coalesce(F.get("c4", F.lit(k)), F.lit("")))
        df = df.withColumn("plain", F.when((F.size("c") > k) & (best != ""), best).otherwise(F.col("plain"))).localCheckpoint()
    assert [v.a for v in df.select(x.best_seal(F.col("c")).alias("a")).collect()] == [v.plain for v in df.collect()]
