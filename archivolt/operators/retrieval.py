"""Search: vectors, record texts and evidence chunks for one question."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.blocks import gestalt
from archivolt.functions.text import chunks, coerced, tokens, word_characters
from archivolt.operators.columns import FIELDS


# A lexical search for k records reads the newest 25 k of them, 100 at least.
NEWEST_EACH, NEWEST_LEAST = 25, 100


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """T-04: the k rows of greatest cosine to one vector (ties: the smallest key); each task keeps k rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = F.try_divide(_dot(F.col(vector), q), F.sqrt(_dot(F.col(vector), F.col(vector))) * F.sqrt(_dot(q, q)))
    return rows.filter(F.col(vector).isNotNull()).select(key, F.round(score, 4).alias("score")).filter("score is not null").orderBy(F.desc("score"), key).limit(k)


#: Vectors of a block of questions, and of a block of rows that it meets in one task.
ASKED, MET = 2048, 16384
#: Questions whose scores a task holds at a time.
AT_ONCE = 64


def nearest_of_all(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """T-04 for many: (query, key, score, rank): the k rows of greatest cosine to each query vector (ties: the smallest key), itself included.

    Queries and rows are dealt to blocks; each two meet once, in one matrix product, which keeps k rows a query; a task
    holds the scores of AT_ONCE queries of it. Vectors that are null, of another size than the query's, zero or not finite are near to nothing.
    """
    sound = lambda df: df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull()))
    asked, met = sound(queries).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")), sound(rows).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = lambda df, size: max(1, -(-df.count() // size))
    a, b = blocks(asked, ASKED), blocks(met, MET)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.select("id", "v", own(a).alias("a"), each(b).alias("b")).groupBy("a", "b")
    right = met.select("id", "v", own(b).alias("b"), each(a).alias("a")).groupBy("a", "b")
    kind = dict(rows.dtypes)[key]

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        out = []
        if one.num_rows and other.num_rows:
            ids, order = other["id"].to_numpy(), np.argsort(other["id"].to_numpy(), kind="stable")
            ids, sizes, values = ids[order], pc.list_value_length(other["v"]).to_numpy()[order], other["v"].take(pa.array(order))
            of = pc.list_value_length(one["v"]).to_numpy()
            for size in np.unique(of):
                mine, theirs = np.flatnonzero(of == size), np.flatnonzero(sizes == size)
                flat = lambda column, at: pc.list_flatten(column.take(pa.array(at))).to_numpy().reshape(-1, size)
                q, x = flat(one["v"], mine), flat(values, theirs)
                of_q, of_x = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
                for i in range(0, len(mine), AT_ONCE):
                    part = slice(i, i + AT_ONCE)
                    with np.errstate(all="ignore"):
                        score = np.round(q[part] @ x.T / of_q[part, None] / of_x, 4)
                    score[~np.isfinite(score)] = -np.inf
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    at = np.arange(len(score))[:, None]
                    keep = np.isfinite(score[at, best])
                    out.append(pa.table({"query": one["id"].take(pa.array(np.repeat(mine[part], keep.sum(1)))), "id": pa.array(ids[theirs[best[keep]]]), "score": pa.array(score[at, best][keep])}))
        return pa.concat_tables(out) if out else pa.table({"query": one["id"].slice(0, 0), "id": one["id"].slice(0, 0), "score": pa.array([], pa.float64())})

    found = left.cogroup(right).applyInArrow(meet, f"query {kind}, id {kind}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select("query", F.col("id").alias(key), "score", "rank")


def overlap(text: Column, query: str) -> Column:
    """U-02: share of the query's tokens that a text has."""
    wanted = sorted(set(re.findall(r"[a-z0-9一-鿿]+", query.lower())))
    return F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, wanted)))) / max(len(wanted), 1)


def lexical(rows: DataFrame, key: str, text: str, query: str, k: int, time: str | None = None, batch: str | None = None, exclude: str = "", fuzzy: bool = True) -> DataFrame:
    """T-05 (A.7): k records by 0.7 of the token overlap and 0.3 of the matching-blocks ratio of the query and the text; none without score.

    Only the newest NEWEST_EACH * k records are looked at (by `time`, then key; 100 at least), of other batches than
    `exclude`; records without a batch stay. The cut is the operator's own, so that a query reads no more however large
    the table is; each task keeps that many rows. Blank texts have no score; ties go to the greater key.
    """
    if exclude and batch:
        rows = rows.filter(F.col(batch).isNull() | (F.col(batch) != exclude))
    rows = rows.orderBy(F.desc(time or key), F.desc(key)).limit(max(NEWEST_EACH * k, NEWEST_LEAST))
    score = overlap(F.col(text), query) * 0.7
    if fuzzy:
        score = score + gestalt(F.lit(query.lower()), F.lower(text)) * 0.3
    score = F.when(F.size(tokens(F.lit(query))) > 0, F.round(score, 6)).otherwise(0.0)
    rows = rows.filter(coerced(F.col(text)) != "").select(key, score.alias("score"))
    return rows.filter("score > 0").orderBy(F.desc("score"), F.desc(key)).limit(k)


def term_weight(term: str) -> float:
    """C-42: longer terms weigh more; digits by whether there are four."""
    if re.fullmatch(r"[0-9]+", term):
        return 1.0 if len(term) >= 4 else 0.6
    ascii_word = re.fullmatch(r"[A-Za-z0-9_]+", term) is not None
    return min(2.0, 0.6 + 0.18 * len(term)) if ascii_word else min(2.6, 0.45 + 0.35 * len(term))


def question_terms(question: str) -> list[str]:
    """C-40 for one question, on the driver: ASCII words in order, then CJK runs."""
    words = [w.lower() for w in re.findall(r"[A-Za-z0-9_]+", question) if len(w) >= 2 or w.isdigit()]
    return list(dict.fromkeys(words + re.findall(r"[一-鿿]{2,}", question)))


def scored_chunks(tasks: DataFrame, key: str, text: str, meta: str, question: str) -> DataFrame:
    """C-43 (A.8): every chunk of every task with its score and hits; terms are literals, so nothing is joined."""
    terms = question_terms(question)
    whole = "".join(re.findall(r"\w+", question)).lower()
    rows = tasks.select(key, word_characters(F.col(meta)).alias("__m"), F.posexplode(chunks(F.col(text))).alias("chunk_index", "chunk"))
    rows = rows.withColumn("__t", word_characters(F.col("chunk")))
    total = max(sum(map(term_weight, terms)), 1.0)
    has = lambda c, t: F.contains(F.col(c), F.lit(t))
    hits = lambda c: sum((has(c, t).cast("int") for t in terms), F.lit(0))
    weight = lambda c: sum((F.when(has(c, t), term_weight(t)).otherwise(0.0) for t in terms), F.lit(0.0)) / total
    phrase = F.lit(False)
    for t in [whole] * (0 < len(whole) <= 32) + [t for t in terms if len(t) >= 4]:
        phrase = phrase | has("__t", t)
    scored = rows.select(key, "chunk_index", "chunk", hits("__t").alias("keyword_hits"), phrase.cast("int").alias("phrase_hit"), hits("__m").alias("metadata_hits"), weight("__t").alias("__k"), weight("__m").alias("__w"), (F.col("__t") == "").alias("__e"))
    score = F.round(F.least(F.lit(1.0), F.col("__k") * 0.55 + F.col("phrase_hit") * 0.25 + F.col("__w") * 0.2), 6)
    return scored.withColumn("score", F.when(F.col("__e") | F.lit(not terms), 0.0).otherwise(score)).drop("__k", "__w", "__e")


def evidence(scored: DataFrame, key: str, k: int = 8, per_task: int = 2) -> DataFrame:
    """G-18, T-06, W-05: the k best chunks, at most two of a task before others fill up; chunks without score only if none has any.

    A task can give k chunks at most, so each keeps its best k before the single ordered cut to k rows.
    """
    order = [F.desc("score"), F.desc("phrase_hit"), F.desc("keyword_hits"), F.desc("metadata_hits"), F.col(key), F.col("chunk_index")]
    some = scored.agg(F.coalesce(F.bool_or(F.col("score") > 0), F.lit(False)).alias("__some"))  # one row
    kept = scored.crossJoin(F.broadcast(some)).filter(~F.col("__some") | (F.col("score") > 0))
    ranked = kept.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__r") <= k)
    best = ranked.withColumn("tier", F.when(F.col("__r") <= per_task, 0).otherwise(1)).orderBy("tier", *order).limit(k)
    return best.select(key, "chunk_index", "score", "keyword_hits", "phrase_hit", "metadata_hits", "tier")


def evidence_snippet(text: Column, terms: list[str], most: int = 240) -> Column:
    """C-44: `most` characters around the longest term that occurs, with marks where the text is cut; the start if none occurs."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    n, at = F.length(clean), F.lit(0)
    for t in sorted(terms, key=len):  # the last one that is found is the longest
        hit = F.locate(t.lower(), F.lower(clean))
        at = F.when(hit > 0, hit).otherwise(at)
    start = F.greatest(F.lit(0), at - 1 - most // 2)
    start = F.when(F.least(n, start + most) - start < most, F.greatest(F.lit(0), F.least(n, start + most) - most)).otherwise(start)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(clean, start + 1, F.lit(most)), F.when(start + most < n, "...").otherwise(""))
    return F.when(n <= most, clean).when(at == 0, F.concat(F.left(clean, F.lit(most)), F.lit("..."))).otherwise(cut)


def citations(items: Column, count: Column) -> Column:
    """C-37: the whole numbers from 1 to count among an array of texts, each once, in order; a text may hold one in brackets or after a dot."""
    number = F.transform(items, lambda x: F.regexp_extract(F.trim(F.coalesce(x, F.lit(""))), r"^\[?(\d{1,9})(?:\.0*)?\]?$", 1))
    whole = F.transform(F.filter(number, lambda x: x != ""), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(whole, lambda x: (x >= 1) & (x <= count)))


def model_fields(payload: Column) -> Column:
    """C-38: a model's JSON as the eight fields and their evidence, all texts without blanks at the ends; what is absent is empty."""
    fields = ", ".join(f"{f}: string" for f in FIELDS)
    raw = F.from_json(payload, f"struct<{fields}, evidence: struct<{fields}>>")
    return F.struct(*(coerced(raw[f]).alias(f) for f in FIELDS), F.struct(*(coerced(raw["evidence"][f]).alias(f) for f in FIELDS)).alias("evidence"))


def salvaged(text: Column) -> Column:
    """C-36: the JSON object in a model's text: without its thoughts and fences, from the first brace to the last; null without one."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>|```(?:json)?", "")
    found = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.when(F.from_json(found, "map<string, string>").isNotNull() & (found != ""), found)


def search(rows: DataFrame, key: str, vector: str, text: str, query: list[float] | None, question: str, k: int, **cut) -> DataFrame:
    """G-20: the nearest records; without a query vector, the best by words (`cut`: time, batch and exclude of lexical). source says which."""
    if query is not None:
        return nearest(rows, key, vector, query, k).withColumn("source", F.lit("vector"))
    return lexical(rows, key, text, question, k, **cut).withColumn("source", F.lit("lexical"))


def samples(rows: DataFrame, group: str, order: str, most: int = 12) -> DataFrame:
    """T-11: the first rows of each group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= most).drop("__k")


# Evidence below this score is not answered from, levels of support, and what is said then.
REJECT, SUPPORT, UNSURE = 0.12, ("supported", "partial", "insufficient"), "无法确认：当前批次证据不足以支撑可靠结论。"


def answered(top_score: Column, answer: Column, support: Column, confidence: Column, cited: Column, count: Column) -> dict[str, Column]:
    """G-19: answer, support level, confidence and citations of a question; what a model said is given by columns.

    Without evidence (null score) all are null; weak evidence and insufficient support give the answer that says so.
    """
    weak = top_score < REJECT
    level = F.lower(coerced(support))
    level = F.when(weak | ~level.isin(*SUPPORT), "insufficient").otherwise(level)
    none = level == "insufficient"
    some = lambda c: F.when(top_score.isNotNull(), c)
    return {
        "answer": some(F.when(none | (coerced(answer) == ""), UNSURE).otherwise(coerced(answer))),
        "support_level": some(level),
        "confidence": some(F.when(weak, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)))))),
        "citations": some(F.when(none, F.array().cast("array<int>")).otherwise(citations(cited, count))),
    }
