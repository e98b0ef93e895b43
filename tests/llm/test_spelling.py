import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from archivolt.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= 6
    return {w: k for w, k in n.items() if k >= 5}


def brute(n):
    around = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(around[w]), n[form[w]] if w in form else 0) for w in n)


def result(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def oracle(df):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toArrow())
    return sorted((w, f or "", r, n, k, g or 0) for w, f, r, n, k, g in con.execute(spelling.SQL).fetchall())


def test_documents(docs):
    assert result(spelling.variants(docs)) == oracle(docs) != []


def test_odd(odd, none):
    assert result(spelling.variants(odd)) == brute(brute_words([(r.doc_id, r.text) for r in odd.collect()])) == oracle(odd)
    assert result(spelling.variants(none)) == []


def made(seed):
    """Few letters, so that almost everything is near to something, chains of forms, long words and letters beyond ASCII."""
    rng = random.Random(seed)
    letters = ["abc", "abéÿ", "xy"][seed % 3]
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(200)}
    words |= {w[:3] + "z" + w[3:] for w in list(words)[:40]} | {"q" * k for k in range(6, 15)} | {"long" * 300, "long" * 300 + "g", "long" * 299 + "lang"}
    return [(k, f"{w} " * rng.choice((5, 5, 6, 30, 200, 1100))) for k, w in enumerate(sorted(words))] + [(None, None), (None, "Qqqqqq! QQQQQQ")]


@pytest.mark.parametrize("seed", range(3))
def test_blocks_of_few_words(spark, monkeypatch, seed):
    monkeypatch.setattr(spelling, "BLOCK", 4)
    monkeypatch.setattr(spelling.blocks, "__defaults__", (4,))
    monkeypatch.setattr(spelling, "CELLS", 200)
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(spelling.variants(df)) == brute(brute_words(rows))


def test_each_pair_once_and_blocks_bounded(spark):
    words = sorted(brute_words(made(0)))
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [(r.word, r.near) for r in spelling.links(df).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if near(a, b))
    cells = spelling.blocks(df, 2).groupBy("m", "path", "key", "r").count().collect()
    assert all(r["count"] <= 2 or r.r == 1 for r in cells) and any(r.r == 1 for r in cells)


def test_blocks_across_batches():
    """A block that ends in a later batch is scanned whole."""
    words = ["abcdef", "abcdeg", "abcdeh", "abcdei"]
    rows = pa.table({"word": words, "n": [5] * 4, "m": pa.array([6] * 4, pa.int32()), "path": ["p"] * 4, "key": ["abc|"] * 4})
    for size in (1, 2, 3, 4):
        out = pa.Table.from_batches(list(spelling._scanned(iter(rows.to_batches(max_chunksize=size)))))
        assert out.num_rows == 12
