"""Nearest rows of every query vector, however few questions a task scores at a time."""

import numpy as np

from archivolt.operators import retrieval


def test_questions_are_scored_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4 + i % 2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = lambda: sorted(tuple(r) for r in retrieval.nearest_of_all(df.filter("vec_id % 3 = 0"), df, "vec_id", "embedding", 5).collect())
    whole = near()
    monkeypatch.setattr(retrieval, "AT_ONCE", 3)
    assert near() == whole and len({r[0] for r in whole}) > 3
