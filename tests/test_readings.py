"""Only unsure pages are read again, each once a round."""

from pyspark.sql import functions as F

from archivolt.operators import readings as r
from archivolt.operators.review import review_route, two_digits


def test_good_pages_are_read_once(spark):
    rounds = []

    def reader(pages):
        rounds.append(sorted((x.id, x.strategy, x.retries) for x in pages.collect()))
        return pages.withColumn("confidence", F.expr("CASE WHEN id = 1 THEN 0.9D WHEN id = 2 AND strategy = 'opencv_document' THEN 0.85D WHEN id = 4 THEN null ELSE 0.2D END"))

    df = spark.createDataFrame([(1, None), (2, " "), (3, "sharpen"), (4, "unknown")], "id int, strategy string")
    got = {x.id: (x.strategy, x.retries, x.confidence) for x in r.read_until_sure(df, reader).collect()}
    assert got == {1: ("none", 0, 0.9), 2: ("opencv_document", 1, 0.85), 3: ("enhance_contrast", 2, 0.2), 4: ("enhance_contrast", 2, None)}
    assert rounds == [[(1, "none", 0), (2, "none", 0), (3, "sharpen", 0), (4, "unknown", 0)], [(2, "opencv_document", 1), (3, "opencv_document", 1), (4, "opencv_document", 1)], [(3, "enhance_contrast", 2), (4, "enhance_contrast", 2)]]
    rounds.clear()
    assert r.read_until_sure(df.filter("id = 1"), reader).count() == 1 and len(rounds) == 1
    assert r.read_until_sure(df.limit(0), reader).count() == 0


def test_results(spark):
    kind = "task_id int, page_num int, text string, confidence double, retries int, issues array<string>, fields map<string,string>"
    rows = [
        (1, 2, " b ", 0.9, 0, [], {"doc_no": "A 1", "date": "2020"}), (1, 1, "a", 0.8, 1, ["签名模糊", " ", "签名模糊"], {"doc_no": "A1"}), (1, 3, "", None, None, None, None),
        (2, 1, "one", 1.5, 0, None, {"date": "2021", "doc_no": "x"}), (2, 2, None, 0.9, 2, None, {"date": "2022"}), (3, 1, "whole", 0.95, 0, None, {"title": " t ", "odd": "x"}),
    ]
    got = {x.task_id: x for x in r.archived(spark.createDataFrame(rows, kind)).collect()}
    assert got[1].full_text == "--- Page 1 ---\na\n\n--- Page 2 ---\nb" and got[1].issues == ["签名模糊"] and got[1].pages_with_issues == [1] and got[1].retry_pages == [1]
    assert (got[1].average_confidence, got[1].min_confidence, got[1].max_confidence, got[1].conflict_count, got[1].doc_no) == (0.5667, 0.0, 0.9, 0, "A1")
    assert got[1].human_review and not got[1].archive_saved
    assert got[2].conflict_count == 1 and got[2].review_status == "pending_human_review" and got[2].full_text == "--- Page 1 ---\none"
    assert got[3].archive_saved and got[3].review_status == "approved" and (got[3].title, got[3].doc_no, got[3].full_text) == ("t", "", "whole")


def test_two_digits_go_by_the_binary_value(spark):
    values = [k / 1000 for k in range(1001)] + [0.125, 0.375, 0.845, 1e-5]
    got = [x.t for x in spark.createDataFrame([(v,) for v in values], "v double").select(two_digits(F.col("v")).alias("t")).collect()]
    assert got == [f"{v:.2f}" for v in values] and got[835] == "0.83"  # Java's format gives 0.84
    route = review_route(F.array(F.lit("doc_no")), F.array().cast("array<string>"), F.lit(0.835))
    assert spark.range(1).select(route["review_reason"]).first()[0].endswith("总体置信度 0.83 落在人工审核区间")
