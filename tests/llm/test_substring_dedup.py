import hashlib
import random

from archivolt.llm import substring_dedup as op


def brute(rows, n=13):
    first = {}
    cut = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in cut:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, op.deduplicate(df).collect())) == brute(rows)


def test_documents(docs):
    check(docs)


def test_passages(spark):
    rnd = random.Random(5)
    few = [f"w{k}" for k in range(6)]
    passages = [" ".join(rnd.choice(few) for _ in range(n)) for n in (12, 13, 14, 30, 200)]
    rows = []
    for d in range(120):
        parts = [" ".join(rnd.choice(few) for _ in range(rnd.randrange(30))) for _ in range(3)]
        rows.append((d * 3 % 120, f"{parts[0]} {rnd.choice(passages)}\t{parts[1]}\n{rnd.choice(passages)} {parts[2]}"))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))


def test_every_length_of_a_run(spark):
    """One word over and over: paths of all lengths up to the longest, and longer ones."""
    rows = [(d, " ".join(["w"] * n)) for d, n in enumerate([200, 76, 75, 74, 77, 13, 12, 140, 141])]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd(odd, none):
    check(odd)
    assert op.deduplicate(none).count() == 0
