import numpy as np

from archivolt.llm import embedding_dedup as op


def brute(rows, least=0.93):
    ok = [e is not None and label is not None and None not in e and bool(np.all(np.isfinite(e))) and any(e) for _, e, label in rows]
    x = [np.array(e, float) / np.linalg.norm(e) if f else None for f, (_, e, _) in zip(ok, rows)]
    links, comp = [0] * len(rows), [r[0] for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for _ in rows:
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, comp))


def check(df, **options):
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(map(tuple, op.near_duplicates(df, **options).collect())) == brute(rows)


def test_embeddings(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), block=64)


def test_clusters_and_odd(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((4, 12))
    rows = [(k, [float(np.float32(v)) for v in centre[k % 4] + 0.12 * rng.standard_normal(12)], k % 2) for k in range(90)]
    rows += [(100 + k, [1.0] * 12, 0) for k in range(5)] + [(110, [2.0] * 12, 0), (111, [1.0] * 5, 0), (112, [3.0] * 5, 0)]
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 12, 0), (203, [1.0, None], 0), (204, [float("nan")] * 12, 0), (205, [float("inf")] * 12, 0), (206, [1.0] * 12, None), (207, [1e-30] * 12, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    check(df, block=8)
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_bound_loses_nothing():
    rng = np.random.default_rng(4)
    r = op.rotation(64)
    for _ in range(300):
        o = rng.standard_normal(64)
        o /= np.linalg.norm(o)
        p = rng.standard_normal(64)
        p -= (p @ o) * o
        q = 0.93 * o + np.sqrt(1 - 0.93**2) * p / np.linalg.norm(p)
        a = np.abs(o @ r).sum() / 8
        estimate = np.sign(o @ r) @ (q @ r) / 8 / a
        assert estimate >= 0.93 - np.sqrt(1 - a * a) / a * np.sqrt(1 - 0.93**2) - 1e-9
