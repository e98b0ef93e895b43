import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.llm import divergence


def brute(rows):
    """The contract, group by group and term by term."""
    there, docs_of, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        there[lang].add(source)
        docs_of[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in there.items():
        kept = [t for t, n in docs_of[lang].items() if n >= 3]
        whole = sum((Counter(counts[lang, s]) for s in sources), Counter())

        def share(of):
            base = sum(of[t] for t in kept) + len(kept)
            return {t: 1 + 1000000000 * (of[t] + 1) // base for t in kept}

        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s], "term": [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= 200:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def result(df):
    return sorted(map(tuple, divergence.audit(df).collect()))


def oracle(df):
    con = duckdb.connect()
    con.register("documents", df.select("text", "lang", "source").toArrow())
    return sorted(con.execute(divergence.SQL).fetchall())


def test_documents(docs):
    got = result(docs)
    assert got == oracle(docs) and got == brute([(r.text, r.lang, r.source) for r in docs.collect()])


def test_odd(odd, none):
    assert result(odd) == brute([(r.text, r.lang, r.source) for r in odd.collect()]) == oracle(odd)
    assert result(none) == []


def test_many_equal_columns(spark, monkeypatch):
    """Over 200 terms of one vector, ties broken by UTF-8, blocks of few vectors, a language without kept terms."""
    tied = " ".join("".join("abcdefghij"[int(d)] for d in f"{k:03}") for k in range(450))
    rows = [(tied, "en", "a")] * 3 + [("é zebra Zebra ß", "en", "b")] * 4 + [("zebra apple", "en", "c")] * 5 + [("", "en", "d"), (None, None, None), ("lone words", "xx", "a"), ("other", "xx", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "CELLS", 8)
    assert result(df) == brute(rows) == oracle(df)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**15), st.integers(1, 9 * 10**15))
def test_shares_are_exact(count, base):
    base = max(base, count + 1)
    assert divergence.shares(np.array([[count]]), np.array([[base]]))[0, 0] == 1 + 10**9 * (count + 1) // base


@pytest.mark.parametrize("n,base", [(0, 1), (9, 10), (10**13, 3 * 10**13 + 7), (0, 10**15)])
def test_share_in_spark(spark, n, base):
    df = spark.createDataFrame([(n, base)], "n long, base long")
    assert df.select(divergence.share(df.n, df.base)).first()[0] == 1 + 10**9 * (n + 1) // base
