"""Titles, responsible parties and the eight fields on worked examples."""

from pyspark.sql import functions as F

from archivolt.operators import archive, scored

KIND = "id long, page_index int, page_total int, y_ratio double, x1 double, y1 double, x2 double, y2 double, height double, text string, kind string, source string, seq int"


def items(spark, *rows):
    """(id, text, y1, height, kind, page, pages) on a page of 1,000 points, all from regions."""
    out = [(i, page, pages, y / 1000, 0.0, float(y), 100.0, float(y + h), float(h), text, kind, "region", k) for k, (i, text, y, h, kind, page, pages) in enumerate(rows)]
    return spark.createDataFrame(out, KIND)


def test_gap_depends_on_the_line_above(spark):
    """Forty points below a line of 30 is one title, below one of 20 it is not."""
    df = items(spark, (1, "关于印发管理", 100, 30, "doc_title", 0, 1), (1, "办法的通知", 170, 30, "doc_title", 0, 1), (2, "关于印发管理", 100, 20, "doc_title", 0, 1), (2, "办法的通知的通知", 160, 20, "doc_title", 0, 1))
    assert {r.id: r.title for r in archive.titles(df).collect()} == {1: "关于印发管理办法的通知", 2: "办法的通知的通知"}


def test_what_is_no_title(spark):
    df = items(spark, (1, "甲方：某某公司", 10, 10, "doc_title", 0, 1), (1, "第一条 通知", 10, 10, "doc_title", 0, 1), (1, "第3页", 10, 10, "doc_title", 0, 1), (1, "渝发〔2015〕3号", 10, 10, "doc_title", 0, 1), (1, "2015年3月4日", 10, 10, "doc_title", 0, 1), (1, "机密", 10, 10, "doc_title", 0, 1), (1, "关于通知的通知", 600, 10, "doc_title", 0, 1), (1, "关于通知的通知", 10, 10, "doc_title", 1, 2))
    assert archive.titles(df).count() == 0


def test_first_of_equal_groups_and_six_of_them(spark):
    same = [(1, "关于甲的通知", y, 1, "text", 0, 1) for y in range(0, 350, 50)]
    df = items(spark, *same, (2, "关于甲的通知", 0, 1, "text", 0, 1), (2, "关于乙的通知", 100, 1, "text", 0, 1), *[(3, "关于甲的通知", y, 1, "text", 0, 1) for y in range(0, 300, 50)], (3, "关于最好的会议纪要通知", 320, 1, "doc_title", 0, 1))
    got = {r.id: r.title for r in archive.titles(df).collect()}
    assert got == {1: "关于甲的通知", 2: "关于甲的通知", 3: "关于甲的通知"}  # the seventh group is not looked at


def test_organisations(spark):
    from pyspark.sql import functions as F

    texts = {"甲方：某某建设集团有限公司 地址": ["某某建设集团有限公司"], "市档案局（公章）印发": ["市档案局"], "重庆市人民政府办公室关于做好工作的通知": ["重庆市人民政府办公室"], "通知": [], "": []}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", archive.organisations(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in got} == texts


def test_eight_fields(spark):
    df = items(spark, (1, "关于印发档案管理办法的通知", 100, 20, "doc_title", 0, 2), (1, "渝档发〔2020〕7号", 60, 20, "text", 0, 2), (1, "机密", 20, 20, "text", 0, 2), (1, "重庆市档案局", 700, 20, "seal", 1, 2), (1, "2020年3月5日", 800, 20, "text", 1, 2), (1, "关于印发档案管理办法的 通知", 101, 20, "text", 0, 2))
    texts = spark.createDataFrame([(1, "a/WS·2024·D10-0311-7.jpg", "", 2), (2, "x.txt", "--- 第 1 页 ---\n某某学会文件\n关于开展调研的通知。\n渝学发[2019]12号\n公开 2019.4.3", None), (3, None, None, 0)], "id long, filename string, full_text string, page_count int")
    got = {r.id: tuple(r)[1:] for r in archive.eight_fields(df, texts).collect()}
    assert got[1] == ("WS·2024·D10-0311-7", "渝档发〔2020〕7号", "重庆市档案局", "关于印发档案管理办法的通知", "2020-03-05", "2", "机密", "")
    assert got[2][1] == "渝学发〔2019〕12号" and got[2][4:] == ("2019-04-03", "", "公开", "") and "关于开展调研的通知" in got[2][3]
    assert got[3] == ("", "", "", "", "", "", "", "")


def test_items_and_lines_are_made_once(spark):
    df = items(spark, (1, "关于印发档案管理办法的通知", 100, 20, "doc_title", 0, 2))
    texts = spark.createDataFrame([(1, "x.txt", "关于", 2), (2, "y.txt", None, 1)], "id long, filename string, full_text string, page_count int")
    plan = archive.eight_fields(df, texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and plan.count("split(coalesce(full_text") == 1  # only names are exploded; only lines are split


def test_names_only_where_one_can_end(spark):
    assert {w[-1] for w in archive.ORGANISATIONS} | {w[-1] for w in archive.PARTY_ENDS.split("|")} == set(archive.LAST[1:-1])
    assert all(pattern.endswith(scored.NUMBER_END + ")") for pattern in scored.DOC_NUMBERS)
    got = spark.createDataFrame([("x" * 30000,), (None,), ("没有名字",)], "t string").select(archive.organisations(F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == [[], [], []]


def test_distinct_items(spark):
    df = items(spark, (1, "a b", 18, 1, "t", 0, 1), (1, "ab", 18, 1, "t", 0, 1), (1, "ab", 30, 1, "t", 0, 1), (1, "ab", 29, 1, "t", 0, 1), (1, "ab", 18, 1, "t", 1, 2))
    # 18 / 12 and 30 / 12 are halves: both round to 2
    assert sorted((r.page_index, r.seq) for r in scored.distinct_items(df).collect()) == [(0, 0), (1, 4)]
