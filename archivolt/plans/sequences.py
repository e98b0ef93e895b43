"""Queries of sequences, graphs, rewrites and search, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archivolt.functions.blocks import ratio_sql
from archivolt.operators import graph, retrieval
from archivolt.operators import sequences as q
from archivolt.plans.data import PAGES, TASKS, pages, read, tasks
from archivolt.plans.texts import QUERIES as TEXTS

SCORES = "id * 37 % 100 / 100.0"
TRUTH = "CASE WHEN id % 5 = 0 THEN '' ELSE concat('doc', CAST(floor(id / 4) AS INT)) END"
RECORD, TIME = "CASE WHEN id % 9 = 0 THEN ' ' ELSE coalesce(full_text, '') END", "id * 7919 % 1000"
QUESTION = "token secret 2024 license"


def _decisions(s, d):
    return pages(s, d).selectExpr("batch_id", "id", "CASE WHEN id % 5 < 3 THEN 0.9D ELSE 0.1D * (id % 7) END AS score", "CASE WHEN id % 11 = 0 THEN 'drawing' ELSE 'contract' END AS left_family", "CASE WHEN id % 13 = 0 THEN '' ELSE 'contract' END AS right_family", "id % 17 = 0 AS strong_split")


def similarity(s, d):
    return q.adjacent_similarity(pages(s, d), "batch_id", "id", "full_text")


def smooth(s, d):
    return q.smoothed(_decisions(s, d), "batch_id", "id").select("batch_id", "id", "smoothed")


def segments(s, d):
    return q.segments(pages(s, d), "batch_id", "id", F.col("id") % 4 == 1).select("batch_id", "id", "segment")


def islands(s, d):
    return q.islands(pages(s, d), "batch_id", "page_no", F.lit(1)).select("batch_id", "page_no", "segment")


def numbered(s, d):
    t = tasks(s, d).selectExpr("batch_id", "lang AS prefix", "id % 3 AS first_page", "id")
    return q.numbered_groups(t, "batch_id", "prefix", "first_page")


def keep_first(s, d):
    return q.first_rows(tasks(s, d).select(F.md5("full_text").alias("digest"), "id", "batch_id"), ["digest"], "id")


def latest_name(s, d):
    return q.first_rows(tasks(s, d).selectExpr("concat(lang, n_chars % 50) AS filename", "id", "batch_id"), ["filename"], "id", last=True)


def gaps(s, d):
    return q.page_gaps(pages(s, d), "batch_id", "page_no")


def distance(s, d):
    return q.previous_distance(pages(s, d).withColumn("h", F.col("id") * 2654435761), "batch_id", "page_no", "h").select("batch_id", "page_no", "distance")


def labels(s, d):
    return q.feedback_labels(pages(s, d), pages(s, d).selectExpr("id", f"{TRUTH} AS doc_key"), "batch_id", "page_no")


def override(s, d):
    g = pages(s, d).selectExpr("id", "concat(batch_id, ':', CAST(floor(page_no / 3) AS INT)) AS group_id", "page_no")
    return q.truth_override(g, pages(s, d).filter("id % 3 = 0").selectExpr("id", f"{TRUTH} AS doc_key"))


def staleness(s, d):
    return q.stale(tasks(s, d).filter("id % 7 <> 0").select("id"), read(s, d, "labels").selectExpr("doc_id AS id"), "id")


def replaced(s, d):
    t = tasks(s, d).select("id", "batch_id", "lang")
    return q.replaced_batches(t, t.filter("batch_id in ('src1', 'src2') and id % 40 < 20").withColumn("lang", F.lit("xx")), "batch_id")


def filled(s, d):
    t = tasks(s, d).selectExpr("id", "CASE WHEN id % 3 = 0 THEN ' ' WHEN id % 3 = 1 THEN NULL ELSE batch_id END AS batch_id")
    return q.filled_from(t, tasks(s, d).filter("id % 2 = 0").selectExpr("id", "lang AS batch_id"), "id", ["batch_id"])


def invalid(s, d):
    return q.invalid_truth(read(s, d, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS doc_key"), tasks(s, d), "id")


def linked(s, d):
    e = read(s, d, "orders").selectExpr("o_orderkey AS a", "-o_custkey AS b")
    e = e.unionByName(read(s, d, "customer").selectExpr("-c_custkey AS a", "-(c_custkey div 5 * 5) AS b"))
    return graph.components(e.selectExpr("explode(array(a, b)) AS id").distinct(), e)


def as_of(s, d):
    e = read(s, d, "events").selectExpr("user_id AS k", "ts AS t", "event_id AS id", "value")
    return q.as_of(e.filter("id % 10 = 0").drop("value"), e.filter("id % 10 <> 0"), "k", "t", "value").select("id", "value")


def nearest(s, d):
    e = read(s, d, "embeddings")
    first = e.filter("vec_id = 0").select("embedding").first()[0]
    return retrieval.nearest(e, "vec_id", "embedding", first, 10)


def nearest_of_all(s, d):
    e = read(s, d, "embeddings")
    return retrieval.nearest_of_all(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)


QUERY = "That erblest, the her!"


def _records(s, d):
    """Documents as records: the newest by time and id, in batches, some in none and some blank."""
    return tasks(s, d).selectExpr("id", "CASE WHEN id % 7 > 0 THEN batch_id END AS batch_id", f"{RECORD} AS text", f"{TIME} AS created_at")


def lexical(s, d):
    return retrieval.lexical(_records(s, d), "id", "text", QUERY, 10, "created_at", "batch_id", "src1", fuzzy=False)


def fuzzy(s, d):
    return retrieval.lexical(_records(s, d), "id", "text", QUERY, 10, "created_at", "batch_id", "src1")


def searched(s, d):
    rows = _records(s, d).withColumn("v", F.lit(None).cast("array<float>"))
    return retrieval.search(rows, "id", "v", "text", None, QUERY, 3, time="created_at", batch="batch_id", exclude="src3")


def evidence(s, d):
    return retrieval.evidence(retrieval.scored_chunks(tasks(s, d), "id", "full_text", "lang", QUESTION), "id").withColumn("chunk_index", F.col("chunk_index").cast("long")).select("id", "chunk_index", "score", "keyword_hits", "phrase_hit", "metadata_hits", "tier")


def page_of_tasks(s, d):
    return tasks(s, d).filter(F.col("file_path").startswith("/in/src1")).orderBy(F.desc("id")).offset(5).limit(20).select("id", "file_path")


def history(s, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read(s, d, "conversations").withColumn("k", F.row_number().over(w)).filter("k between 2 and 3").select("conv_id", "turn", "role")


def pair_families(s, d):
    f = read(s, d, "orders").selectExpr("o_orderkey AS l", "o_custkey AS r", "o_orderkey AS fid")
    t = tasks(s, d)
    a, b = t.selectExpr("id AS l", "batch_id AS lp", "lang AS left_family"), t.selectExpr("id AS r", "batch_id AS rp", "lang AS right_family")
    return f.join(a, "l").join(b, "r").filter("lp = rp").select("fid", "left_family", "right_family")


def eligible(s, d):
    t = tasks(s, d).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'done' ELSE 'failed' END AS status", "CASE WHEN id % 5 = 0 THEN ' ' ELSE full_text END AS full_text", "CASE WHEN id % 2 = 0 THEN concat(batch_id, '-001.jpg') ELSE 'a.pdf' END AS filename")
    visual = F.col("filename").rlike(r"(?i)^.+-\d{3}\.(jpg|png)$")
    merge = (F.col("status") == "done") & ((F.trim("full_text") != "") | visual)
    return t.select("id", merge.alias("merge"), (merge | visual).alias("boundary"), ((F.col("status") == "done") & F.col("full_text").isNotNull() & (F.trim("full_text") != "")).alias("qa"))


def shared_pairs(s, d):
    e = read(s, d, "orders")
    return e.selectExpr("o_custkey % 50 AS a", "o_orderkey % 20 AS b").intersect(read(s, d, "lineitem").selectExpr("l_orderkey % 50 AS a", "l_orderkey % 37 AS b"))


def sliding(s, d):
    e = read(s, d, "events")
    return e.groupBy(F.window("ts", "1 day", "12 hours"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def cube(s, d):
    return tasks(s, d).cube("batch_id", "lang").agg(F.count("*").alias("tasks"), F.sum("n_chars").alias("chars"))


_CHARS = lambda c: rf"list_distinct(list_transform(range(1, length({c})), lambda i: substring({c}, i, 2)))"
_CHUNKS = TEXTS["C-41_chunks"][1].replace("md5(chunk)", "chunk").replace("md5(c) AS chunk", "c AS chunk")
_TERMS = retrieval.question_terms(QUESTION)
_TOTAL = sum(map(retrieval.term_weight, _TERMS))
_HITS = lambda c: " + ".join(f"contains({c}, '{t}')::INT" for t in _TERMS)
_WEIGHT = lambda c: "(" + " + ".join(f"CASE WHEN contains({c}, '{t}') THEN {retrieval.term_weight(t)}::DOUBLE ELSE 0.0::DOUBLE END" for t in _TERMS) + f") / {_TOTAL}::DOUBLE"
_PHRASE = " OR ".join(f"contains(t, '{t}')" for t in ["".join(QUESTION.split()), *(t for t in _TERMS if len(t) >= 4)])

_TOKENS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9\\x{{4e00}}-\\x{{9fff}}]+'))"
_LEXICAL = lambda k, batch: f"""n AS (SELECT * FROM (SELECT id, CASE WHEN id % 7 > 0 THEN batch_id END AS batch_id, {RECORD} AS text, {TIME} AS created_at FROM {TASKS}) WHERE batch_id IS NULL OR batch_id <> '{batch}' ORDER BY created_at DESC, id DESC LIMIT {max(25 * k, 100)}),
  o AS (SELECT *, len(list_intersect({_TOKENS('text')}, {_TOKENS(f"'{QUERY}'")})) / len({_TOKENS(f"'{QUERY}'")}) AS o FROM n WHERE trim(text) <> '')"""  # noqa: E731
_SCORED = f"""q AS (SELECT id AS p, lower('{QUERY}') AS a, lower(text) AS b FROM o), {ratio_sql('q')}, z AS (SELECT id, round(o * 0.7::DOUBLE + ratio * 0.3::DOUBLE, 6) AS score FROM o JOIN ratios ON p = id)"""

QUERIES = {
    "W-13_adjacent_similarity": (similarity, rf"WITH t AS (SELECT batch_id, id, length(full_text) AS n, regexp_replace(full_text, '[ \n\r\t]', '', 'g') AS x FROM {PAGES}), g AS (SELECT batch_id, id, n, {_CHARS('x')} AS g FROM t), p AS (SELECT batch_id, id AS left_id, lead(id) OVER w AS right_id, n AS na, lead(n) OVER w AS nb, g AS a, lead(g) OVER w AS b FROM g WINDOW w AS (PARTITION BY batch_id ORDER BY id)), s AS (SELECT *, CASE WHEN na < 10 OR nb < 10 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS s FROM p WHERE right_id IS NOT NULL) SELECT batch_id, left_id, right_id, round(s, 4) AS similarity, s > 0.08 AS linked FROM s"),
    "W-02_smoothing": (smooth, f"WITH s AS (SELECT batch_id, id, CASE WHEN id % 5 < 3 THEN 0.9::DOUBLE ELSE 0.1::DOUBLE * (id % 7) END AS score, CASE WHEN id % 11 = 0 THEN 'drawing' ELSE 'contract' END AS l, CASE WHEN id % 13 = 0 THEN '' ELSE 'contract' END AS r FROM {PAGES}), n AS (SELECT *, lag(score) OVER w AS b, lead(score) OVER w AS a, lag(l) OVER w AS f FROM s WINDOW w AS (PARTITION BY batch_id ORDER BY id)) SELECT batch_id, id, CASE WHEN score < 0.58 AND b >= 0.78 AND a >= 0.78 AND f = l AND l = r AND id % 17 <> 0 THEN round(least(0.79::DOUBLE, score + 0.16::DOUBLE), 4) ELSE score END AS smoothed FROM n"),
    "W-03_split_segments": (segments, f"SELECT batch_id, id, CAST(sum(CASE WHEN k = 1 OR id % 4 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY id) AS BIGINT) AS segment FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS k FROM {PAGES})"),
    "W-09_islands": (islands, f"SELECT batch_id, page_no, CAST(sum(CASE WHEN p IS NULL OR page_no - p > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY page_no) AS BIGINT) AS segment FROM (SELECT *, lag(page_no) OVER (PARTITION BY batch_id ORDER BY page_no) AS p FROM {PAGES})"),
    "W-04_group_numbers": (numbered, f"SELECT batch_id, lang AS prefix, id % 3 AS first_page, id, dense_rank() OVER (PARTITION BY batch_id ORDER BY lang, id % 3) AS number FROM {TASKS}"),
    "W-06_keep_first": (keep_first, f"SELECT md5(full_text) AS digest, min(id) AS id, arg_min(batch_id, id) AS batch_id FROM {TASKS} GROUP BY digest"),
    "W-07_latest_per_filename": (latest_name, f"SELECT lang || n_chars % 50 AS filename, max(id) AS id, arg_max(batch_id, id) AS batch_id FROM {TASKS} GROUP BY filename"),
    "W-08_U-08_page_gaps": (gaps, f"SELECT batch_id, g AS missing FROM (SELECT batch_id, unnest(generate_series(min(page_no), max(page_no))) AS g FROM {PAGES} GROUP BY batch_id) x WHERE NOT EXISTS (SELECT 1 FROM {PAGES} p WHERE p.batch_id = x.batch_id AND p.page_no = g)"),
    "W-12_previous_distance": (distance, f"SELECT batch_id, page_no, CAST(bit_count(xor(id * 2654435761, lag(id) OVER (PARTITION BY batch_id ORDER BY page_no) * 2654435761)) AS BIGINT) AS distance FROM {PAGES}"),
    "G-23_feedback_labels": (labels, f"WITH t AS (SELECT batch_id, id, {TRUTH} AS k, lead(id) OVER w AS b FROM {PAGES} WINDOW w AS (PARTITION BY batch_id ORDER BY page_no, id)), p AS (SELECT t.batch_id, t.id, t.b, t.k, u.k AS l FROM t JOIN t u ON u.id = t.b) SELECT batch_id, least(id, b) AS left_id, greatest(id, b) AS right_id, CASE WHEN k = l THEN 'same' ELSE 'different' END AS label FROM p WHERE k <> '' AND l <> ''"),
    "J-21_G-24_truth_override": (override, f"WITH t AS (SELECT page_no, CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN 'truth' ELSE 'auto' END AS kind, CASE WHEN id % 3 = 0 AND id % 5 <> 0 THEN {TRUTH} ELSE concat(batch_id, ':', CAST(floor(page_no / 3) AS INT)) END AS group_key FROM {PAGES}) SELECT kind, group_key, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS tasks FROM t GROUP BY ALL"),
    "U-05_G-25_staleness": (staleness, "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'cached' ELSE 'current' END AS only_in FROM (SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT doc_id AS id FROM labels) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL"),
    "K-07_replaced_batches": (replaced, f"SELECT id, batch_id, CASE WHEN batch_id IN ('src1', 'src2') THEN 'xx' ELSE lang END AS lang FROM {TASKS} WHERE batch_id NOT IN ('src1', 'src2') OR id % 40 < 20"),
    "J-19_D-05_filled_batch": (filled, f"SELECT id, CASE WHEN id % 3 = 2 THEN batch_id WHEN id % 2 = 0 THEN lang END AS batch_id FROM {TASKS}"),
    "J-20_truth_validation": (invalid, "SELECT o_orderkey AS id, o_orderstatus AS doc_key FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)"),
    "G-01_components": (linked, "WITH RECURSIVE p AS (SELECT o_orderkey AS a, -o_custkey AS b FROM orders UNION SELECT -c_custkey, -(c_custkey // 5 * 5) FROM customer), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), c(id, m) AS (SELECT a, a FROM e UNION SELECT e.b, c.m FROM c JOIN e ON e.a = c.id WHERE c.m < e.b) SELECT id, min(m) AS component FROM c GROUP BY id"),
    "X-as_of_join": (as_of, "SELECT l.event_id AS id, r.value FROM (SELECT * FROM events WHERE event_id % 10 = 0) l ASOF LEFT JOIN (SELECT * FROM events WHERE event_id % 10 <> 0) r ON l.user_id = r.user_id AND l.ts >= r.ts"),
    "T-04_vector_topk": (nearest, "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 4) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10"),
    "T-04_all_queries": (nearest_of_all, "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.e, b.e), 4) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 4) DESC, b.vec_id) AS INT) AS rank FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.e) = len(b.e) QUALIFY rank <= 10"),
    "T-05_U-02_lexical_overlap": (lexical, f"WITH {_LEXICAL(10, 'src1')} SELECT id, round(o * 0.7::DOUBLE, 6) AS score FROM o WHERE o > 0 ORDER BY score DESC, id DESC LIMIT 10"),
    "T-05_fuzzy": (fuzzy, f"WITH RECURSIVE {_LEXICAL(10, 'src1')}, {_SCORED} SELECT id, score FROM z WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 10"),
    "G-20_search": (searched, f"WITH RECURSIVE {_LEXICAL(3, 'src3')}, {_SCORED} SELECT id, score, 'lexical' AS source FROM z WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 3"),
    "G-18_C-43_T-06_W-05_evidence": (evidence, rf"WITH c AS (SELECT k.id, pos, lower(regexp_replace(chunk, '[^\p{{L}}\p{{N}}_]+', '', 'g')) AS t, lang AS m FROM ({_CHUNKS}) k JOIN documents ON doc_id = k.id), s AS (SELECT id, pos AS chunk_index, {_HITS('t')} AS keyword_hits, ({_PHRASE})::INT AS phrase_hit, {_HITS('m')} AS metadata_hits, CASE WHEN t = '' THEN 0 ELSE round(least(1.0::DOUBLE, {_WEIGHT('t')} * 0.55::DOUBLE + ({_PHRASE})::INT * 0.25::DOUBLE + {_WEIGHT('m')} * 0.2::DOUBLE), 6) END AS score FROM c), r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY score DESC, phrase_hit DESC, keyword_hits DESC, metadata_hits DESC, chunk_index) <= 2 THEN 0 ELSE 1 END AS tier FROM s WHERE score > 0) SELECT id, chunk_index, score, keyword_hits, phrase_hit, metadata_hits, tier FROM r ORDER BY tier, score DESC, phrase_hit DESC, keyword_hits DESC, metadata_hits DESC, id, chunk_index LIMIT 8"),
    "T-01_task_page": (page_of_tasks, f"SELECT id, file_path FROM {TASKS} WHERE starts_with(file_path, '/in/src1') ORDER BY id DESC LIMIT 20 OFFSET 5"),
    "T-03_history_page": (history, "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k BETWEEN 2 AND 3"),
    "J-02_feedback_pairs": (pair_families, "SELECT o_orderkey AS fid, a.lang AS left_family, b.lang AS right_family FROM orders JOIN documents a ON a.doc_id = o_orderkey JOIN documents b ON b.doc_id = o_custkey WHERE a.source = b.source"),
    "F-10_F-11_F-16_eligible": (eligible, f"WITH t AS (SELECT id, id % 3 = 0 AS done, id % 5 <> 0 AND trim(full_text) <> '' AS txt, id % 2 = 0 AS visual FROM {TASKS}) SELECT id, done AND (txt OR visual) AS merge, (done AND (txt OR visual)) OR visual AS boundary, done AND txt AS qa FROM t"),
    "U-03_shared_pairs": (shared_pairs, "SELECT o_custkey % 50 AS a, o_orderkey % 20 AS b FROM orders INTERSECT SELECT l_orderkey % 50, l_orderkey % 37 FROM lineitem"),
    "X-sliding_windows": (sliding, "SELECT time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOURS * k AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL"),
    "X-cube": (cube, f"SELECT batch_id, lang, count(*) AS tasks, CAST(sum(n_chars) AS BIGINT) AS chars FROM {TASKS} GROUP BY CUBE (batch_id, lang)"),
}
