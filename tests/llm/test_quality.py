import duckdb
import pytest
from pyspark.sql import functions as F

from archivolt.llm import quality


def plain(text):
    """The contract's measures, by counting."""
    text = text or ""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)} if len(windows) < 2000 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, covered if covered is None else len(covered)


def same(got, oracle_rows):
    assert sorted(map(str, got)) == sorted(map(str, oracle_rows))


def oracle(df):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toArrow())
    return con.execute(quality.SQL).fetchall()


def result(df):
    return [tuple(r) for r in quality.judged(df).drop("host").collect()]


def test_documents(docs):
    same(result(docs), oracle(docs))


def test_odd(odd, none):
    same(result(odd), oracle(odd))
    assert result(none) == []


@pytest.mark.parametrize("text", ["a a a a", "a b c a b c", "a b c d a b c", " x\ty\nz\x0bz\fz\rz z\n\n x\ty\n x\ty", "é#ß * 日本 <b>\nq\nq\n q\n", "a b\n" * 400, "one two", "", None])
def test_measures(spark, text):
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    r = quality.measured(df).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text)


def test_equal_hashes_are_compared_by_words(spark):
    # 33 bits of hash cannot tell all windows of a long text apart; words must
    words = " ".join(str(k) for k in range(150_000))
    df = spark.createDataFrame([(1, words + " 7 8 9", "s")], "doc_id long, text string, source string")
    assert quality.measured(df).first().n_repeat_words == 6


def prose(k):
    return " ".join(f"word{(k * 31 + j) % 997}" for j in range(60))


def test_hosts(spark):
    """A host of nearly only failures is rejected, a small one with one failure is not, symbols bind where they are a habit."""
    rows = [(f"bad{k}", "too short", "bad") for k in range(40)] + [("bad-clean", prose(1), "bad")]
    rows += [(f"good{k}", prose(k), "good") for k in range(200)] + [("good-symbols", prose(3) + " #" * 20, "good")]
    rows += [("tiny", "short", "tiny")] + [("tiny-clean", prose(4), "tiny"), ("tiny-clean2", prose(6), "tiny")]
    rows += [(f"code{k}", prose(k) + " <" * 30, "code") for k in range(40)] + [("code-clean", prose(5), "code")]
    rows += [("no-host", prose(9) + " #" * 30, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got = {r.doc_id: (r.kept, r.host_verdict) for r in quality.judged(df).collect()}
    assert got["bad-clean"] == (False, "rejected") and got["good0"] == (True, "trusted") and got["good-symbols"] == (True, "trusted")
    assert got["tiny"][0] is False and got["tiny-clean"] == (True, "trusted")
    assert got["code0"] == (False, "strict") and got["code-clean"] == (True, "strict") and got["no-host"] == (True, "none")
    same(result(df), oracle(df))


def test_prior_pulls_small_hosts_more(spark):
    rows = [("a", True)] * 2 + [("b", True)] * 200 + [("b", False)] * 200 + [("c", False)] * 400
    df = spark.createDataFrame(rows, "host string, few_words boolean").select("*", *(F.lit(False).alias(r) for r in quality.RULES if r != "few_words"))
    got = {r.host: r for r in quality.host_rates(df).filter("rule = 'few_words'").collect()}
    assert 0.25 < got["a"].shrunk < 0.95 and abs(got["b"].shrunk - 0.5) < 0.02 and got["c"].shrunk < 0.02
    assert (got["a"].n, got["a"].failed) == (2, 2)


def test_no_python(spark, docs):
    assert not any(x in quality.judged(docs)._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
