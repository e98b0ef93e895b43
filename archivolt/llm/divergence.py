"""Operator 12: how far the sources of a language are apart in their words, with equal count columns evaluated once.

Terms that occur equally often in every source of their language have one sparse vector of counts; rare terms, most of a
vocabulary, share few. Every pair of sources is evaluated once for each distinct vector and weighed by its number of terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the contract: what a term is, the documents it must be in, the scale of shares, the terms shown of a group.
TERM, LEAST_DOCUMENTS, SCALE, SHOWN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", 3, 1_000_000_000, 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries of the count matrix that one task holds.
CELLS = 1 << 17


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the rows that hold it. Null lang, source and text are ''."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(own("lang"), own("source"), F.regexp_extract_all(F.translate(own("text"), UPPER, LOWER), F.lit(TERM), F.lit(0)).alias("ts"))
    part = lambda ts, n, d: F.struct(ts.alias("ts"), F.lit(n).alias("n"), F.lit(d).alias("d"))
    rows = rows.select("lang", "source", F.inline(F.array(part(F.col("ts"), 1, 0), part(F.array_distinct("ts"), 0, 1))))
    rows = rows.select("lang", "source", F.explode("ts").alias("term"), "n", "d")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("docs"))


def vectors(counts: DataFrame) -> DataFrame:
    """(lang, term, vector): kept terms with their sparse counts by source, array<struct<source,n>> in the sources' order."""
    entry = F.struct("source", "n")
    kept = counts.groupBy("lang", "term").agg(F.array_sort(F.collect_list(entry)).alias("vector"), F.sum("docs").alias("docs"))
    return kept.filter(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term", "vector")


def groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, base, lang_base): every occurring pair, base its count over kept terms plus their number, lang_base likewise of the language."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    there = docs.select(own("lang"), own("source")).distinct()
    total = terms.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("all"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = there.join(total, ["lang", "source"], "left").join(size, "lang", "left")
    return rows.select("lang", "source", (none("total") + none("v")).alias("base"), (none("all") + none("v")).alias("lang_base"))


def shares(counts: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / base), exact below bases of 9 x 10^15: the quotient is made in three steps of a thousand."""
    rest, out = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, bases.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // bases, rest % bases
    return out + 1


def _pairs(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """All pairs of a language's sources over one block of distinct vectors."""
    sources, bases = right["source"].combine_chunks(), right["base"].to_numpy()
    k, wide = len(sources), left.num_rows
    sums = np.zeros((k, k), np.int64)
    if wide:
        lists = left["vector"].combine_chunks()
        row = np.repeat(np.arange(wide), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        counts = np.zeros((wide, k), np.int64)
        counts[row, pc.index_in(flat.field("source"), value_set=sources).to_numpy(zero_copy_only=False)] = flat.field("n").to_numpy(zero_copy_only=False)
        p, times = shares(counts, bases[None, :]), left["times"].to_numpy()
        for a in range(k):
            apart = p[:, a : a + 1] - p
            sums[a] = times @ (apart * apart // p)
    a, b = np.nonzero(~np.eye(k, dtype=bool))
    return pa.table({"lang": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(a)), "source": sources.take(pa.array(a)), "item": sources.take(pa.array(b)), "value": pa.array(sums[a, b])})


def pairs(distinct: DataFrame, of: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every two sources of a language, 0 where no term is kept.

    distinct: (lang, vector, times). A language's vectors are dealt to blocks whose matrix of counts has CELLS entries at
    most, so a language of most rows is many tasks'; each block meets the sources of its language once. A task emits one
    sum for each pair whatever the number of its terms. Sums fit a long while a language keeps less than 10^9 terms, as
    shares add up to SCALE plus two a term.
    """
    width = of.groupBy("lang").agg(F.count("*").alias("k"))
    deal = width.join(distinct.groupBy("lang").agg(F.count("*").alias("d")), "lang", "left")
    # written, so that Spark knows its size and can split a language of most rows between tasks of the joins
    deal = table(deal.select("lang", F.greatest(F.lit(1), F.ceil(F.coalesce("d", F.lit(0)) * F.col("k") / CELLS)).cast("int").alias("blocks")))
    left = distinct.join(deal, "lang").select("lang", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int").alias("block"), "vector", "times")
    right = of.join(deal, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "base")
    each = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(_pairs, "lang string, source string, item string, value long")
    return each.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def share(n: Column, base: Column) -> Column:
    return F.expr("1L") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), base.cast("decimal(20,0)"))


def typical(terms: DataFrame, distinct: DataFrame, of: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): the SHOWN terms that a source has most above its language.

    A vector's terms tie in every source, so it is evaluated once; of the vectors a source ranks within SHOWN, its SHOWN
    least terms are all that can be shown. Both cuts are exact, and made in each task before rows move.
    """
    every = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    each = distinct.select("lang", "vector", every.alias("every"), F.inline("vector")).join(of, ["lang", "source"])
    p, q = share(F.col("n"), F.col("base")), share(F.col("every"), F.col("lang_base"))
    each = each.select("lang", "source", "vector", p.alias("p"), q.alias("q")).filter("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div q"))
    top = each.withColumn("__r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).filter(F.col("__r") <= SHOWN)
    first = terms.withColumn("__r", F.row_number().over(Window.partitionBy("lang", "vector").orderBy("term"))).filter(F.col("__r") <= SHOWN)
    rows = top.drop("__r").join(first.drop("__r"), ["lang", "vector"]).select("lang", "source", F.col("term").alias("item"), "value")
    return ranked(rows).filter(F.col("rank") <= SHOWN)


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has every two sources of a language, 'term' each source's own words.

    Rows are counted one by one, whatever their doc_id; an empty table has no rows. A language without kept terms has
    pairs of value 0 and no terms.
    """
    docs = docs.select("lang", "source", "text")
    terms = table(vectors(counted(docs)))
    of = table(groups(docs, terms))
    distinct = table(terms.groupBy("lang", "vector").agg(F.count("*").alias("times")))
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(ranked(pairs(distinct, of)), "pair").union(part(typical(terms, distinct, of), "term"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
e AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM e GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT e.lang, e.source, e.term, count(*) AS n FROM e JOIN k ON k.lang = e.lang AND k.term = e.term GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON t.lang = d.lang AND t.source = d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (g.total + v.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // (v.total + v.v) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
QUALIFY part = 'pair' OR rank <= 200
"""
