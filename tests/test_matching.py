"""Candidate pairs against all pairs of a batch."""

import random
from unittest import mock

import pandas as pd
import pytest
from pyspark.sql import functions as F

from archivolt.functions import blocks
from archivolt.functions.blocks import gestalt, ratio
from archivolt.operators import matching as m

KIND = "batch_id string, id long, created_at long, doc_no_norm string, doc_no_prefix string, title_norm string, filename_norm string, date_norm string, responsible_norm string, series_key string, sequence long, visual_prefix string, visual_page_no long, family string, boundary_group string, boundary_confidence double"


def decided(pairs):
    like = lambda c: F.when((F.col(f"l.{c}") == F.col(f"r.{c}")) & (F.col(f"l.{c}") != ""), 1.0).otherwise(gestalt(F.col(f"l.{c}"), F.col(f"r.{c}")))
    return m.decided(pairs, like("title_norm"), like("filename_norm"))


def results(candidates, pairs):
    found = decided(m.between(candidates, pairs)).cache()
    asked = sorted((r.l.id, r.r.id, r.accept) for r in found.filter("ask").collect())
    return asked, {r.id: (r.document, r.members) for r in m.merged(candidates, found).collect()}


def all_pairs(candidates):
    one = candidates.select("batch_id", F.struct(*m.COLUMNS).alias("l"))
    return one.join(one.withColumnRenamed("l", "r"), "batch_id").filter("l.idx < r.idx")


def test_one_title_and_two_dates(spark):
    """Four rows of one title with dates 1, 2, 1, 2: the first and third, and the second and fourth, are one."""
    rows = [("b", k, k, None, None, "one title", None, f"d{k % 2}", None, None, None, None, None, None, None, None) for k in range(1, 5)]
    c = m.indexed(spark.createDataFrame(rows, KIND))
    assert results(c, m.candidate_pairs(c)) == results(c, all_pairs(c))
    assert {k: v[0] for k, v in results(c, m.candidate_pairs(c))[1].items()} == {1: 1, 2: 2, 3: 1, 4: 2}


@pytest.mark.parametrize("seed", range(2))
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    titles = ["annual plan of the works department", "annual plan of the works departments", "annual plan for the works department", "minutes of may", "minutes of may 2", "a", "b", "minutes of june", None, ""]
    rows = [
        (f"b{k % 3}", k, rng.randrange(9), pick(None, "", "", "n1", "n2", f"n{k}"), pick(None, "", "p"), pick(*titles), pick("f", "file one", "file two", f"x{k}", None), pick(None, "", "d1", "d2"), pick(None, "r1", "r2"), pick(None, "", "", "s1", "s2"), pick(None, rng.randrange(12)), pick(None, "", "v1"), pick(None, rng.randrange(12)), pick(None, "contract", "other"), pick(None, "", "", "g1", "g2", f"g{k}"), 0.9)
        for k in range(120)
    ]
    c = m.indexed(spark.createDataFrame(rows, KIND))
    assert results(c, m.candidate_pairs(c)) == results(c, all_pairs(c))


def test_title_keys(spark):
    """Two titles of a ratio of ALIKE or more share a key, whatever is edited."""
    rng = random.Random(5)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abcd 日") for _ in range(rng.randint(1, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        if b and ratio(a, "".join(b)) >= m.ALIKE:
            pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").select(F.size(F.array_intersect(m.title_keys(F.col("a")), m.title_keys(F.col("b")))).alias("n"))
    assert len(pairs) > 500 and df.filter("n = 0").count() == 0


def test_keys_of_titles_are_made_once_and_pairs_meet_once(spark):
    keys = m.title_keys(F.col("t"))
    rows = spark.createDataFrame([("minutes of the council of the city",), ("aaaa",), ("x",)], "t string").select(keys.alias("k")).collect()
    assert [len(set(r.k)) == len(r.k) for r in rows] == [True] * 3 and rows[2].k == ["x#0"]
    seen = []
    text = [("a", "abcdefgh", "abcdefgx")] * 50
    with mock.patch.object(blocks, "ratio", side_effect=lambda a, b, c: seen.append(a) or 0.5):
        assert [x for s in blocks._ratios(iter([(pd.Series([t[1] for t in text]), pd.Series([t[2] for t in text]))])) for x in s] == [0.5] * 50
    assert len(seen) == 1  # before: 50


def _written(spark, rows, kind, home):
    """A table as read back: its columns repeat, so its files are far smaller than its rows."""
    spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(str(home))
    return spark.read.schema(kind).parquet(str(home))


def test_pairs_do_not_pass_the_driver(spark, tmp_path):
    rows = [(f"b{k % 9}", k, k, None, None, f"title {k % 5}", "f", "d", "r", "s", k, "v", k, None, None, None) for k in range(90)]
    c = _written(spark, [(*r, r[1]) for r in rows], f"{KIND}, idx long", tmp_path / "rows")
    for found in (m.candidate_pairs(c), m.between(c, m.candidate_pairs(c))):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # before: rows of keys, ends and ranks
