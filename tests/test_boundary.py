"""Scores against worked examples, segmentation against all segmentations."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from archivolt.functions import text as x
from archivolt.operators import boundary
from archivolt.plans import boundaries


def total(pages, cuts):
    table, out, start = boundary.gains(pages), 0.0, 0
    for end in [*cuts, len(pages)]:
        if end - start > boundary.LONGEST:
            return None
        out += table[end - 1][end - 1 - start]
        start = end
    return out


def test_best_cuts_beat_all_others():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 9)
        pages = [{"family": rng.choice(["", "budget", "quote"]), "entities": rng.sample("abc", rng.randint(0, 2)), "page_no": i + rng.randint(0, 1) * 20, "score": rng.random(), "strong_split": rng.random() < 0.2, "attachment": rng.random() < 0.3, "closed": rng.random() < 0.3} for i in range(n)]
        marks = boundary.best_cuts(pages)
        own = total(pages, [i for i in range(1, n) if marks[i] != marks[i - 1]])
        best = max(total(pages, [i + 1 for i in range(n - 1) if m >> i & 1]) for m in range(1 << n - 1))
        assert own == pytest.approx(best)
    assert max(boundary.best_cuts([{**pages[0], "score": 0.9, "strong_split": False, "page_no": i} for i in range(25)])) == 3


def rows(spark, *pages):
    cols = "batch_id string, prefix string, page_no long, id long, full_text string, title_hint string, family string, visual double"
    return boundary.prepared(spark.createDataFrame([("b", "p", *p) for p in pages], cols))


def test_scores(spark):
    p = rows(spark, (1, 1, "合同正文 abcdef", "采购合同", "contract", None), (2, 2, "第二条 其余 zzzz", "采购合同", "contract", None), (4, 3, "附件 报价", "报价表", "quote", 0.1), (5, 4, None, "", "", 0.95))
    got = {r.left_id: r for r in boundary.scored(p).collect()}
    # equal titles, same continuing family, neighbours, a continuation: .15 + .12 + .08 + .18 + .16 + .06 + .18
    assert got[1].score == pytest.approx(0.93) and got[1].merge and not got[1].strong_split
    # visual .1 (.03), a continuation (.16), gap 2 (-.12), other family (-.22), attachment (-.18), no link (-.12)
    assert got[2].score == pytest.approx(0.02) and got[2].strong_split
    # visual .95 (.285), the same layout without any other sign (.46)
    assert got[3].score == pytest.approx(0.745) and got[3].merge


def test_groups(spark):
    p = rows(spark, *((i, i, f"第{i}条 内容", "采购合同", "contract", 0.9) for i in range(1, 4)), (4, 4, "附件一 其他", "附件一", "quote", 0.0))
    d = boundary.scored(p)
    got = [(r.first_page, r.last_page, r.group_no) for r in boundary.groups(boundary.segmented(p, d), d).orderBy("first_page").collect()]
    assert got == [(1, 3, 1), (4, 4, 2)]


def test_empty_table(spark):
    d = boundary.scored(rows(spark))
    assert d.count() == 0


def test_rounding_goes_by_the_product(spark):
    values = [0.45994999999999997, 0.9473499999999999, 0.44734999999999997, 0.58735, 0.00125, 0.03125, 0.0, 1.0]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(x.rounded(F.col("v")).alias("v")).collect()]
    assert got == [v[0] for v in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 4)", [values]).fetchall()]
    assert got[:3] == [0.46, 0.9474, 0.4474]  # Spark's round gives 0.4599, 0.9473, 0.4473


def test_texts_do_not_meet_by_batch(spark):
    plan = boundaries.scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("row_number") :]
    assert "full_text" not in window.split("\n")[0] and plan.rindex("AS signature") > plan.index("row_number")  # below the numbering
