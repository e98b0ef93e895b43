"""Operator 11: rules on texts, judged with the host they come from. JVM expressions only.

Each row gets its rule counts; failures are added up by host; a beta prior fitted over all hosts shrinks each host's rates;
and the hosts' verdicts are joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Rules that reject a row by themselves.
BASE = ("few_words", "repeats")
#: Rules that reject a row only where its host breaks them as a habit.
SOFT = ("symbols", "same_lines", "word_length")
#: A host whose shrunk rate of a base rule is that high is rejected whole; one whose shrunk rate of a soft rule is that high makes the rule binding.
HOST_LIMIT, HABIT_LIMIT = 0.5, 0.2
#: The prior weighs as much as so many rows, at least and at most.
WEIGHT = (1.0, 10_000.0)


def _without(text: Column, dropped: str) -> Column:
    return F.length(F.translate(text, dropped, ""))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) of each row; a null text is empty.

    Windows are sorted as one long each, 33 bits of hash and the place, so neighbours that agree are the only ones whose
    words are compared; the sort takes n log n however often a text repeats itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        "doc_id", F.col(host).cast("string").alias("host"), words.alias("__w"), lines.alias("__l"),
        _without(text, SPACES).cast("long").alias("word_chars"), (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
    )
    word = lambda i: F.get("__w", i)
    starts = F.when(F.size("__w") >= 3, F.sequence(F.lit(0), F.size("__w") - 3)).otherwise(F.array().cast("array<int>"))
    key = lambda i: F.shiftleft(F.xxhash64(word(i), word(i + 1), word(i + 2)), 31).bitwiseOR(i.cast("long"))
    rows = rows.withColumn("__k", F.sort_array(F.transform(starts, key)))
    hash_at = lambda j: F.shiftright(F.get("__k", j), 31)
    like_next = lambda at: lambda x, j: F.coalesce(at(j) == at(j - 1), F.lit(False)) | F.coalesce(at(j) == at(j + 1), F.lit(False))
    rows = rows.withColumn("__c", F.filter("__k", like_next(hash_at)))
    place = lambda k: k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    window = lambda k: F.struct(F.array(*(word(place(k) + d) for d in range(3))).alias("words"), place(k).alias("at"))
    rows = rows.withColumn("__s", F.when(F.size("__c") > 0, F.sort_array(F.transform("__c", window))))
    rows = rows.withColumn("__p", F.sort_array(F.transform(F.filter("__s", like_next(lambda j: F.get("__s", j)["words"])), lambda s: s["at"])))
    covered = F.aggregate(F.transform("__p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__p", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "doc_id", "host", F.size("__w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.size("__l").cast("long").alias("n_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


#: What breaks each rule.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
}


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, rule, n, failed, shrunk): a host's rate of each rule under a beta prior fitted to all hosts by moments.

    rows: host and one column of each rule, true where broken. The prior's mean is the rate of all rows; its weight comes
    from how much more the hosts differ than chance would have it (the intraclass correlation), within WEIGHT. Rows
    without a host belong to none. Rows are counted by host in each task first, so a host of most rows is no one task's.
    """
    counts = rows.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(F.col(r)).alias(r) for r in RULES))
    counts = counts.select("host", "n", F.explode(F.create_map(*(x for r in RULES for x in (F.lit(r), F.col(r))))).alias("rule", "failed"))
    k, n = F.col("failed").cast("double"), F.col("n").cast("double")
    of_rule = counts.groupBy("rule").agg(F.sum(k).alias("k"), F.sum(n).alias("all"), F.sum(n * n).alias("squares"), F.sum(k * k / n).alias("spread"), F.count("*").alias("hosts"))
    mean, others = F.col("k") / F.col("all"), F.col("hosts") - 1
    chance = mean * (1 - mean)
    alike = (F.try_divide(F.col("spread") - F.col("all") * mean * mean, chance) - others) / F.nullif(F.col("all") - F.col("squares") / F.col("all") - others, F.lit(0.0))
    weight = F.when(alike > 0, F.greatest(F.lit(WEIGHT[0]), F.least(F.lit(WEIGHT[1]), (1 - alike) / alike))).otherwise(F.lit(WEIGHT[1]))
    prior = of_rule.select("rule", mean.alias("mean"), weight.alias("weight"))
    shrunk = (k + F.col("mean") * F.col("weight")) / (n + F.col("weight"))
    return counts.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failed", shrunk.alias("shrunk"))  # as many rows as rules


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, host, the measures, base_failed, failed (names of broken rules), host_verdict and kept.

    A row that breaks a base rule goes. Another goes if its host is rejected (shrunk rate of a base rule at HOST_LIMIT or
    more), or if it breaks a soft rule that its host breaks by habit (shrunk rate at HABIT_LIMIT or more). Rows without a
    host have host_verdict 'none' and go by base rules only. Rows that repeat, or have no doc_id, are rows of their own.
    """
    rows = measured(docs.select(*dict.fromkeys(("doc_id", "text", host))), host)
    rows = table(rows.select("*", *(F.expr(how).alias(r) for r, how in RULES.items())))
    rates = host_rates(rows)
    # written, so that Spark knows its size and can split a host of most rows between tasks of the join
    hosts = table(rates.groupBy("host").agg(
        F.bool_or(F.col("rule").isin(*BASE) & (F.col("shrunk") >= HOST_LIMIT)).alias("__rejected"),
        *(F.bool_or((F.col("rule") == r) & (F.col("shrunk") >= HABIT_LIMIT)).alias(f"__habit_{r}") for r in SOFT),
    ))
    both = rows.join(hosts, "host", "left")
    base = F.col(BASE[0]) | F.col(BASE[1])
    habit = F.lit(False)
    for r in SOFT:
        habit = habit | (F.col(r) & F.coalesce(F.col(f"__habit_{r}"), F.lit(False)))
    rejected = F.coalesce(F.col("__rejected"), F.lit(False))
    verdict = F.when(F.col("host").isNull(), "none").when(rejected, "rejected").when(F.greatest(*(F.col(f"__habit_{r}") for r in SOFT)), "strict").otherwise("trusted")
    return both.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        F.concat_ws(",", *(F.when(F.col(r), F.lit(r)) for r in RULES)).alias("failed"), verdict.alias("host_verdict"), (~base & ~rejected & ~habit).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+2], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM rep) GROUP BY r),
m AS (SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON cov.r = w.r),
f AS (SELECT *, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS same_lines,
  n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 10 * n_words) AS word_length FROM m),
c AS (SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (broken) AS DOUBLE) AS k FROM (UNPIVOT (SELECT source, few_words, repeats, symbols, same_lines, word_length FROM f WHERE source IS NOT NULL) ON few_words, repeats, symbols, same_lines, word_length INTO NAME rule VALUE broken) GROUP BY ALL),
p AS (SELECT rule, sum(k) / sum(n) AS mu, sum(k * k / n) AS spread, sum(n) AS tot, sum(n * n) AS sq, count(*) - 1 AS others FROM c GROUP BY rule),
a AS (SELECT rule, mu, ((spread - tot * mu * mu) / nullif(mu * (1 - mu), 0) - others) / nullif(tot - sq / tot - others, 0) AS alike FROM p),
s AS (SELECT c.source, c.rule, (k + mu * wt) / (n + wt) AS shrunk FROM c JOIN (SELECT rule, mu, CASE WHEN alike > 0 THEN greatest(1.0, least(10000.0, (1 - alike) / alike)) ELSE 10000.0 END AS wt FROM a) q ON q.rule = c.rule),
h AS (SELECT source, bool_or(rule IN ('few_words', 'repeats') AND shrunk >= 0.5) AS rejected, bool_or(rule = 'symbols' AND shrunk >= 0.2) AS h1, bool_or(rule = 'same_lines' AND shrunk >= 0.2) AS h2, bool_or(rule = 'word_length' AND shrunk >= 0.2) AS h3 FROM s GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
  concat_ws(',', CASE WHEN few_words THEN 'few_words' END, CASE WHEN repeats THEN 'repeats' END, CASE WHEN symbols THEN 'symbols' END, CASE WHEN same_lines THEN 'same_lines' END, CASE WHEN word_length THEN 'word_length' END) AS failed,
  CASE WHEN f.source IS NULL THEN 'none' WHEN rejected THEN 'rejected' WHEN h1 OR h2 OR h3 THEN 'strict' ELSE 'trusted' END AS host_verdict,
  NOT (few_words OR repeats) AND NOT coalesce(rejected, false) AND NOT coalesce(symbols AND h1, false) AND NOT coalesce(same_lines AND h2, false) AND NOT coalesce(word_length AND h3, false) AS kept
FROM f LEFT JOIN h ON h.source = f.source
"""
