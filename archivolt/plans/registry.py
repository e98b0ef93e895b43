"""Queries over the driver's tables, and their SQL. Documents stand for tasks, sources for batches, customers for submitters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import columns as c
from archivolt.operators import listing
from archivolt.operators import tables as t
from archivolt.plans import archive, boundaries, callbacks, fingerprints, grids, layouts, listings, readers, readings, reviews, rollups, sequences, services, shapes, texts
from archivolt.plans.data import TASKS
from archivolt.plans.data import read as _read
from archivolt.plans.data import tasks as _tasks


def p03(s, d):
    r = _read(s, d, "customer")
    r = r.withColumn("seg", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")))
    return r.select("c_custkey", c.record_text(["c_name", "seg", "c_name"], True).alias("search_text"), c.record_text(["c_name", "seg", "c_name"], False).alias("embed_text"))


def p04(s, d):
    return _tasks(s, d).select("id", c.snippet(F.col("full_text"), "token").alias("snippet"))


def p06(s, d):
    r = _read(s, d, "part").withColumn("v", F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.col("p_name")))
    return r.select("p_partkey", c.review_flag(F.col("v")).alias("flag"))


def p07(s, d):
    return _tasks(s, d).select("id", c.parent_folder(F.col("file_path")).alias("folder"))


def p10(s, d):
    return _tasks(s, d).select("id", c.shortened(F.col("full_text"), 1000).alias("title"))


def p11(s, d):
    return _tasks(s, d).withColumn("b", F.when(F.col("id") % 4 == 0, " ").when(F.col("id") % 4 == 1, None).otherwise(F.col("batch_id"))).select("id", c.submission_id(F.col("b"), F.col("id")).alias("submission_id"))


def p15(s, d):
    return _tasks(s, d).groupBy("batch_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("batch_id", c.group_filename(F.col("batch_id"), F.col("a"), F.col("b")).alias("filename"))


def p17(s, d):
    return _read(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("done"), F.count("*").alias("total")).select("l_orderkey", c.percent(F.col("done"), F.col("total")).alias("percent"))


def f01(s, d):
    return _tasks(s, d).filter(c.in_folder(F.col("file_path"), "/in/src1/")).select("id", "file_path")


def f05(s, d):
    return _tasks(s, d).filter(c.has_keyword("TOKEN =", F.col("file_path"), F.col("full_text"))).select("id")


def f07(s, d):
    r = _tasks(s, d).withColumn("batch_id", F.when(F.col("id") % 7 != 0, F.col("batch_id")))
    return r.filter(c.not_in_batch(F.col("batch_id"), "src0")).select("id", "batch_id")


def f13(s, d):
    o = _read(s, d, "orders")
    mine = listing.submitted_between(F.col("o_orderpriority"), "1-URGENT", F.col("o_orderdate"), "1995-03-01 00:00:00", "1995-06-01 00:00:00")
    return o.filter(mine).select("o_orderkey", "o_custkey")


def j01(s, d):
    return _tasks(s, d).join(_read(s, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "batch_id")


def j03(s, d):
    return _tasks(s, d).join(_read(s, d, "labels").withColumnRenamed("doc_id", "id"), "id", "left").select("id", "quality", "toxic")


def j04(s, d):
    r = _tasks(s, d)
    return t.attach_lists(r.select("batch_id").distinct(), r, "batch_id", "lang").select("batch_id", F.array_join("values", ",").alias("langs"))


def j05(s, d):
    ids = _read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("position"))
    tasks = _tasks(s, d).select("id", F.lit("done").alias("status"))
    return t.status_of(ids, tasks).select("id", "position", "status", "error")


def j07(s, d):
    return t.adjacent(_tasks(s, d), "batch_id", "id", "n_chars")


def j09(s, d):
    r = _tasks(s, d)
    return t.pair_scores(r.select("id", F.col("batch_id").alias("group")), r.select("id", F.col("lang").alias("group")))


def j18(s, d):
    ids = _read(s, d, "labels").select(F.col("doc_id").alias("id"))
    return _tasks(s, d).join(ids, "id", "left_semi").filter("trim(batch_id) <> ''").select("batch_id").distinct()


def k06(s, d):
    r = _read(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").alias("at"))
    new = r.filter("c_custkey % 2 = 0").select("c_custkey", F.concat("c_name", F.lit("'")).alias("c_name"), F.lit("").alias("c_mktsegment"), "at")
    return t.upsert(r, new, "c_custkey", "at").select("c_custkey", "c_name", "c_mktsegment")


def d01(s, d):
    gone = _tasks(s, d).filter("lang = 'fr'").select("id")
    return t.without(_read(s, d, "labels").withColumnRenamed("doc_id", "id"), gone, "id")


def d02(s, d):
    return _tasks(s, d).filter(~c.in_folder(F.col("file_path"), "/in/src0")).select("id")


def _rollup(s, d):
    return _tasks(s, d).groupBy("batch_id").agg(F.count("*").alias("tasks"), F.sum("n_chars").alias("chars"), F.count(F.when(F.col("lang") == "en", 1)).alias("english"))


ALL: dict[str, tuple[Callable, str]] = {
    "P-03_record_text": (p03, "SELECT c_custkey, c_name || ' ' || seg || ' ' || c_name AS search_text, concat_ws(' ', c_name, nullif(seg, ''), c_name) AS embed_text FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS seg FROM customer)"),
    "P-04_search_snippet": (p04, f"SELECT id, CASE WHEN a > 0 THEN CASE WHEN f > 1 THEN '...' ELSE '' END || replace(substring(full_text, f, a - f + 55), chr(10), ' ') || CASE WHEN a + 54 < length(full_text) THEN '...' ELSE '' END END AS snippet FROM (SELECT *, greatest(a - 50, 1) AS f FROM (SELECT *, instr(lower(full_text), 'token') AS a FROM {TASKS}))"),
    "P-06_review_flag": (p06, "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR trim(p_name) = '' THEN 'review' ELSE 'accepted' END AS flag FROM part"),
    "P-07_parent_folder": (p07, f"SELECT id, '/in/' || batch_id AS folder FROM {TASKS}"),
    "P-10_length_limit": (p10, f"SELECT id, CASE WHEN length(full_text) > 1000 THEN left(full_text, 997) || '...' ELSE full_text END AS title FROM {TASKS}"),
    "P-11_submission_id": (p11, f"SELECT id, CASE WHEN id % 4 < 2 THEN 'single:' || id ELSE 'batch:' || batch_id END AS submission_id FROM {TASKS}"),
    "P-15_group_filename": (p15, f"SELECT batch_id, printf('%s-%03d-%03d.pdf', batch_id, min(id), max(id)) AS filename FROM {TASKS} GROUP BY batch_id"),
    "P-17_progress_percent": (p17, "SELECT l_orderkey, round(count(*) FILTER (l_linestatus = 'F') * 100.0::DOUBLE / count(*), 2) AS percent FROM lineitem GROUP BY l_orderkey"),
    "F-01_folder_prefix": (f01, f"SELECT id, file_path FROM {TASKS} WHERE starts_with(file_path, '/in/src1/')"),
    "F-05_keyword": (f05, f"SELECT id FROM {TASKS} WHERE contains(lower(full_text), 'token =') OR contains(lower(file_path), 'token =')"),
    "F-07_other_batches": (f07, f"SELECT id, CASE WHEN id % 7 <> 0 THEN batch_id END AS batch_id FROM {TASKS} WHERE id % 7 = 0 OR batch_id <> 'src0'"),
    "F-13_date_range": (f13, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-06-01' AND o_orderpriority = '1-URGENT'"),
    "J-01_semi_join": (j01, f"SELECT id, batch_id FROM {TASKS} WHERE id IN (SELECT doc_id FROM labels)"),
    "J-03_feedback": (j03, f"SELECT id, quality, toxic FROM {TASKS} LEFT JOIN labels ON doc_id = id"),
    "J-04_folder_batches": (j04, f"SELECT batch_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM {TASKS} GROUP BY batch_id"),
    "J-05_progress": (j05, "SELECT o_orderkey AS id, o_custkey AS position, CASE WHEN doc_id IS NULL THEN 'failed' ELSE 'done' END AS status, CASE WHEN doc_id IS NULL THEN 'Task not found.' ELSE '' END AS error FROM orders LEFT JOIN documents ON doc_id = o_orderkey"),
    "J-07_adjacent": (j07, f"SELECT * FROM (SELECT batch_id, id AS left_id, lead(id) OVER w AS right_id, n_chars AS left_value, lead(n_chars) OVER w AS right_value FROM {TASKS} WINDOW w AS (PARTITION BY batch_id ORDER BY id)) WHERE right_id IS NOT NULL"),
    "J-09_pair_scores": (j09, f"WITH r AS (SELECT id, batch_id AS p, lang AS t FROM {TASKS}), n AS (SELECT CAST((SELECT sum(c * (c - 1) // 2) FROM (SELECT count(*) AS c FROM r GROUP BY p, t)) AS BIGINT) AS tp, CAST((SELECT sum(c * (c - 1) // 2) FROM (SELECT count(*) AS c FROM r GROUP BY p)) AS BIGINT) AS pp, CAST((SELECT sum(c * (c - 1) // 2) FROM (SELECT count(*) AS c FROM r GROUP BY t)) AS BIGINT) AS tt) SELECT tp, pp AS predicted_pairs, tt AS truth_pairs, round(tp / pp, 6) AS precision, round(tp / tt, 6) AS recall, round(2 * round(tp / pp, 6) * round(tp / tt, 6) / (round(tp / pp, 6) + round(tp / tt, 6)), 6) AS f1 FROM n"),
    "J-18_batches_of_tasks": (j18, f"SELECT DISTINCT batch_id FROM {TASKS} WHERE id IN (SELECT doc_id FROM labels) AND trim(batch_id) <> ''"),
    "K-06_upsert": (k06, "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '''' ELSE c_name END AS c_name, c_mktsegment FROM customer"),
    "D-01_delete_cascade": (d01, "SELECT doc_id AS id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')"),
    "D-02_delete_folder": (d02, "SELECT doc_id AS id FROM documents WHERE source <> 'src0'"),
    "A-batch_rollup": (_rollup, f"SELECT batch_id, count(*) AS tasks, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (lang = 'en') AS english FROM {TASKS} GROUP BY batch_id"),
}

ALL |= texts.QUERIES | rollups.QUERIES | sequences.QUERIES | boundaries.QUERIES | reviews.QUERIES | listings.QUERIES | services.QUERIES | archive.QUERIES | grids.QUERIES | shapes.QUERIES | layouts.QUERIES | callbacks.QUERIES | fingerprints.QUERIES | readings.QUERIES | readers.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in ALL.items() if q}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup of tasks by batch."""
    return _rollup(spark, sf_dir)
