"""The matching-blocks ratio against the standard library's, and its SQL."""

import random
from difflib import SequenceMatcher

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt.functions.blocks import gestalt, ratio, ratio_sql


@settings(max_examples=400, deadline=None)
@given(st.text("abcé日", max_size=40), st.text("abcé日😀", max_size=40))
def test_ratio(a, b):
    assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def long_pairs():
    rng = random.Random(3)
    for n in (150, 199, 200, 260, 900):
        b = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") + ("日" if rng.random() < 0.01 else "") for _ in range(n))
        yield "".join(c for c in b if rng.random() < 0.8), b
        yield "".join(rng.choice("abcdefgh 日月") for _ in range(60)), b


def test_common_characters_of_long_texts():
    for a, b in long_pairs():
        assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_column_and_sql(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(("the", "of", "report", "annual", "日", "plan")) for _ in range(n))
    rows = [(k, words(rng.randint(1, 9)), words(rng.randint(1, 9))) for k in range(60)] + [(100 + k, a, b) for k, (a, b) in enumerate(long_pairs()) if len(b) < 400]
    want = {k: SequenceMatcher(None, a, b).ratio() for k, a, b in rows}
    df = spark.createDataFrame([*rows, (900, None, "x"), (901, "x", "")], "k int, a string, b string").select("k", gestalt(F.col("a"), F.col("b")).alias("r"))
    assert {r.k: r.r for r in df.collect()} == want | {900: 0.0, 901: 0.0}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (p INT, a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    assert {k: v for k, v in con.execute(f"WITH RECURSIVE {ratio_sql('t')} SELECT p, ratio FROM ratios").fetchall()} == want
