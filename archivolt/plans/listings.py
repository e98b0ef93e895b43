"""Queries of lists, evaluation, matching, answers and places, beside their SQL. Tasks get made-up fields by id, in SQL of both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import text as x
from archivolt.operators import evaluation as e
from archivolt.operators import listing as o
from archivolt.functions.blocks import gestalt, ratio_sql
from archivolt.operators import matching as m
from archivolt.operators import retrieval, spatial
from archivolt.plans.data import TASKS, read, tasks

NAME = "CASE id % 7 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE concat(batch_id, '-', id, '.pdf') END"
USER = "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('u', id % 3) END"
STATUS = "CASE id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'RUNNING' ELSE 'queued' END"
AT = "CASE WHEN id % 11 <> 0 THEN make_timestamp_ntz(2024, 1, CAST(1 + id % 28 AS INT), CAST(id % 24 AS INT), 0, 0) END"
AT_SQL = "CASE WHEN id % 11 <> 0 THEN make_timestamp(2024, 1, 1 + id % 28, id % 24, 0, 0) END"
GROUP = "concat('g', CAST(floor(id / 3) AS INT))"
TRUTH = "CASE WHEN id % 7 = 0 THEN '' ELSE concat('doc', CAST(floor(id / 4) AS INT)) END"


def _t(s, d):
    return tasks(s, d).selectExpr("id", "batch_id", "file_path", "full_text", "lang", "n_chars", f"{NAME} AS filename", f"{USER} AS user", f"{STATUS} AS status", f"{AT} AS created_at", "CASE id % 3 WHEN 0 THEN 'layout' ELSE 'vl' END AS mode")


T = f"(SELECT id, batch_id, file_path, full_text, lang, n_chars, {NAME} AS filename, {USER} AS usr, {STATUS} AS status, {AT_SQL} AS created_at, CASE id % 3 WHEN 0 THEN 'layout' ELSE 'vl' END AS mode FROM {TASKS})"


def summaries(s, d):
    t = _t(s, d).withColumn("payload", F.when(F.col("id") % 6 == 0, "x")).withColumn("review_status", F.lit(None).cast("string"))
    return o.summary(t).select("id", "filename", "batch_id", "mode", "status")


def names(s, d):
    t = _t(s, d)
    name = F.when(F.col("id") % 9 == 0, "own name")
    day, number = F.to_date(F.lit("2024-05-06")), F.when(F.col("id") % 2 == 0, F.col("id") % 4)
    return t.select("id", o.submission_name(name, F.col("user"), day, number, F.col("filename")).alias("name"))


def renamed(s, d):
    return o.renamed(tasks(s, d).selectExpr("id", "batch_id AS `档号`", "lang AS `题名`"))


def evidence_dropped(s, d):
    t = tasks(s, d).select("id", F.struct("lang", F.col("batch_id").alias("evidence")).alias("fields"))
    return o.without_evidence(t, "fields", False).select("id", F.to_json("fields").alias("fields"))


def filters(s, d):
    t = _t(s, d).withColumn("b", F.expr("CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE batch_id END"))
    p = F.col("file_path")
    return t.select("id", o.folder_like(p, "/in/src1").alias("folder"), o.folder_like(p, " ").alias("any_folder"), F.coalesce(o.equals_or_any(F.col("b"), "src2"), F.lit(False)).alias("batch"), o.equals_or_any(F.col("b"), "").alias("any_batch"), o.within_roots(p, ["/in/src3/", "/in/src4/"]).alias("allowed"), o.unassigned(F.col("b")).alias("unassigned"))


def of_ids(s, d):
    ids = read(s, d, "labels").select(F.col("doc_id").alias("id"))
    return o.of_ids(tasks(s, d), ids, "id").select("id", "lang")


def with_vectors(s, d):
    v = read(s, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 > 0, F.col("embedding")))
    return v.filter(o.has_vector(F.col("embedding"))).select("vec_id")


def faceted(s, d):
    return o.facets(_t(s, d), "2024-01-03", "2024-01-20", ("done", "failed"), ("vl",)).select("id", "status")


def counted(s, d):
    return o.total(tasks(s, d).filter(o.folder_like(F.col("file_path"), "/in/src1")))


def oldest_page(s, d):
    return o.page(_t(s, d), [F.asc_nulls_first("created_at"), F.asc("id")], 2, 15).select("id")


def newest_page(s, d):
    return o.page(_t(s, d), o.newest_first("created_at", "id"), 0, 10).select("id")


def ordered(s, d):
    return o.ordered_groups(_t(s, d).selectExpr("id", "concat(lang, id % 5) AS g"), "g", "id")


def kept(s, d):
    return o.deleted(_t(s, d), "src1").select("id")


def feedback(s, d):
    t = tasks(s, d).selectExpr("id", "CASE WHEN id % 2 = 0 THEN ' Helpful' ELSE 'not_helpful' END AS rating", "CASE WHEN id % 2 = 0 THEN ' ' ELSE concat(' r', id) END AS reason")
    return o.checked_feedback(t)


def records(s, d):
    t = tasks(s, d).selectExpr("id", "lang", "CASE WHEN id % 3 = 0 THEN 'helpful' END AS rating", "CASE WHEN id % 3 = 0 THEN batch_id END AS reason")
    return o.record(t, ["id", "lang"], ["rating", "reason"]).select("id", "lang", F.to_json("feedback").alias("feedback"))


def _predicted(s, d):
    return tasks(s, d).selectExpr("id", f"{GROUP} AS `group`").filter("id % 13 <> 5")


def _truth(s, d):
    return tasks(s, d).selectExpr("id", f"{TRUTH} AS doc")


def truth(s, d):
    return e.truth_metrics(_predicted(s, d), _truth(s, d))


def mapped(s, d):
    return e.mapped(_predicted(s, d), _truth(s, d)).withColumnRenamed("group", "group_id")


def reader_confidence(s, d):
    lines = F.when(F.col("id") % 3 == 0, F.array(F.col("id") % 7 / 5.0, F.lit(None).cast("double"))).otherwise(F.array().cast("array<double>"))
    more = F.when(F.col("id") % 4 == 0, F.array(F.col("id") % 9 / 10.0))
    return tasks(s, d).select("id", e.reader_confidence(lines, more, F.when(F.col("id") % 5 > 0, F.col("full_text"))).alias("confidence"))


def distinct_in_order(s, d):
    return e.ordered_distinct(tasks(s, d), "batch_id", "id", "lang").select("batch_id", F.array_join("values", ",").alias("langs"))


def merged_texts(s, d):
    t = tasks(s, d).selectExpr("id", f"{GROUP} AS doc", "full_text", "lang AS filename", "id % 4 - 1 AS page_count")
    return e.merged_text(t, "doc", "id").select("doc", F.md5("merged_text").alias("merged_text"), "page_count")


def overall(s, d):
    return e.overall_threshold(tasks(s, d).groupBy("batch_id").agg((F.count("*") % 19).alias("threshold")))


def updated(s, d):
    return e.latest_update((read(s, d, "orders"), "o_orderdate"), (read(s, d, "lineitem"), "l_shipdate"))


def versions(s, d):
    rows = tasks(s, d).select("batch_id", "id", "lang")
    return e.version(rows, "batch_id", ["id", "lang"])


def summaries_of_pages(s, d):
    t = tasks(s, d).selectExpr(f"{GROUP} AS doc", "CASE WHEN id % 4 > 0 THEN id % 14 / 10.0D END AS confidence", "CASE WHEN id % 3 > 0 THEN array(lang, concat('i', id % 2)) END AS issues")
    return e.page_summary(t, "doc").select("doc", "confidence", "pages", F.array_join("issues", ",").alias("issues"))


def counters(s, d):
    t = tasks(s, d).selectExpr("batch_id", "id % 3 = 0 AS done", "id % 4 > 0 AS eligible")
    g = tasks(s, d).filter("batch_id <> 'src1'").select("batch_id", F.expr(GROUP)).distinct()
    return e.counters(t, g)


def titled(s, d):
    g = tasks(s, d).selectExpr("concat('g', id) AS group_id")
    docs = tasks(s, d).selectExpr("concat('g', id) AS group_id", "CASE WHEN id % 3 = 0 THEN lang END AS recommended_title", "CASE WHEN id % 2 = 0 THEN ' ' ELSE batch_id END AS llm_title", "CASE WHEN id % 4 = 0 THEN 'rule' END AS rule_title")
    return e.group_documents(g, docs).select("group_id", "display_title")


# What a model says of a pair.
SAME, SURE = "(left_id + right_id) % 3 = 0", "CAST((left_id * 7 + right_id) % 40 + 60 AS DOUBLE) / 100"

# Candidates of a batch of a hundred tasks: numbers, titles, dates and series that recur.
CANDIDATES = """id, concat('b', CAST(floor(id / 100) AS INT)) AS batch_id, {at} AS created_at,
  CASE WHEN id % 6 = 0 THEN concat('no', CAST(floor(id / 24) AS INT)) WHEN id % 6 = 3 THEN concat('no', id) ELSE '' END AS doc_no_norm, CASE WHEN id % 5 = 0 THEN 'p' ELSE '' END AS doc_no_prefix,
  CASE WHEN id % 4 = 0 THEN '' ELSE concat(CASE WHEN floor(id / 8) % 3 = 0 THEN 'annual budget of the city archive ' WHEN floor(id / 8) % 3 = 1 THEN 'minutes' ELSE 'title of a page' END, CAST(floor(id / 8) AS INT)) END AS title_norm, concat('f', id % 9) AS filename_norm, CASE WHEN id % 3 = 0 THEN '' ELSE concat('2024', id % 2) END AS date_norm,
  CASE WHEN id % 7 = 0 THEN '' ELSE 'r' END AS responsible_norm, CASE WHEN id % 10 < 3 THEN concat('s', CAST(floor(id / 10) AS INT)) ELSE '' END AS series_key, CASE WHEN id % 10 < 3 THEN id % 10 END AS sequence,
  CASE WHEN id % 20 > 15 THEN concat('v', CAST(floor(id / 20) AS INT)) ELSE '' END AS visual_prefix, CASE WHEN id % 20 > 15 THEN id % 20 END AS visual_page_no,
  CASE id % 20 WHEN 18 THEN 'contract' WHEN 19 THEN 'contract' ELSE '' END AS family, CASE WHEN id % 50 < 2 THEN concat('bg', CAST(floor(id / 50) AS INT)) ELSE '' END AS boundary_group, 0.9{double} AS boundary_confidence"""


def _candidates(s, d):
    t = tasks(s, d).selectExpr(*_split(CANDIDATES.format(at=AT, double="D")))
    return m.indexed(t.withColumn("sequence", F.col("sequence").cast("long")).withColumn("visual_page_no", F.col("visual_page_no").cast("long")))


def _split(text: str) -> list[str]:
    """The expressions of a select list: commas inside brackets do not part them."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[at:k])
            at = k + 1
    return [*out, text[at:]]


def _decided(s, d):
    c = m.written(_candidates(s, d))  # read by every kind of key
    pairs = m.between(c, m.candidate_pairs(c))
    a, b = F.col("l.title_norm"), F.col("r.title_norm")
    return m.decided(pairs, F.when((a == b) & (a != ""), 1.0).otherwise(gestalt(a, b)), (F.col("l.filename_norm") == F.col("r.filename_norm")).cast("double"))


def indexes(s, d):
    return _candidates(s, d).select("batch_id", "id", "idx")


def decisions(s, d):
    """The pairs that are asked about; yes-pairs show in the merge."""
    return _decided(s, d).filter("ask").select("batch_id", F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), "decision", "confidence", "accept", F.col("between").alias("page_between"))


def merged(s, d):
    c = _candidates(s, d)
    # links and questions are read off one table, so that no pair is decided twice
    found = m.written(_decided(s, d).select(F.struct("l.id").alias("l"), F.struct("r.id").alias("r"), "decision", "ask", "accept"))
    answers = found.filter("ask").select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id")).selectExpr("left_id", "right_id", f"{SAME} AS same", f"{SURE} AS confidence")
    return m.merged(c, found, answers)


def snippets(s, d):
    return tasks(s, d).select("id", F.md5(retrieval.evidence_snippet(F.col("full_text"), ["secret", "token", "license"])).alias("snippet"))


def cited(s, d):
    items = F.array(F.concat(F.lit("["), F.col("id") % 9, F.lit("]")), F.lit(" 2 "), F.lit("x"), F.lit("3.0"), (F.col("id") % 4).cast("string"), F.lit(None).cast("string"))
    return tasks(s, d).select("id", F.array_join(retrieval.citations(items, (F.col("id") % 6).cast("int")), ",").alias("citations"))


def outputs(s, d):
    raw = F.concat(F.lit('{"title": " '), F.col("lang"), F.lit('", "pages": "'), F.col("id"), F.lit('", "evidence": {"title": "e"}, "other": 1}'))
    fields = retrieval.model_fields(retrieval.salvaged(F.concat(F.lit("<think>{}</think>text ```json\n"), raw, F.lit("\n``` end"))))
    return tasks(s, d).select("id", fields.alias("f")).select("id", "f.title", "f.pages", "f.remarks", F.col("f.evidence.title").alias("evidence_title"))


def samples(s, d):
    return retrieval.samples(tasks(s, d).select("batch_id", "id"), "batch_id", "id", 12)


def masks(s, d):
    return tasks(s, d).select("id", x.masked(F.expr("CASE id % 4 WHEN 0 THEN ' ' WHEN 1 THEN lang WHEN 2 THEN file_path END")).alias("masked"), x.region_type(F.expr("CASE id % 5 WHEN 0 THEN ' Table_Body ' WHEN 1 THEN 'Red-Stamp' WHEN 2 THEN ' ' WHEN 3 THEN 'Title' END"), F.col("id") % 11 == 0).alias("region"), x.foreign_region(F.expr("CASE id % 3 WHEN 0 THEN 'Title' WHEN 1 THEN 'footer_image' ELSE 'abstract' END")).alias("foreign_region"))


HEAD = "CASE id % 8 WHEN 0 THEN '造价预算' WHEN 1 THEN '甲方 乙方 付款方式' WHEN 2 THEN '出席 请假' WHEN 3 THEN '说明' WHEN 4 THEN '甲方' WHEN 5 THEN '资质证书' ELSE '' END"


def families(s, d):
    return tasks(s, d).select("id", x.document_family(F.expr(HEAD), F.expr("CASE WHEN id % 16 > 7 THEN concat(full_text, '目录') ELSE concat('目录', full_text) END")).alias("family"))


# Pages of five lines and two regions.
BOX = "CAST({} AS DOUBLE)"
REGIONS = "SELECT p_partkey AS page_id, CAST(r AS INT) AS region_id, concat('w', CAST(p_partkey % 5 AS INT), 'x', CAST(r AS INT)) AS content, CAST(r * 40 AS DOUBLE) AS x1, 0.0{d} AS y1, CAST(r * 40 + 45 AS DOUBLE) AS x2, CAST(30 + p_partkey % 20 AS DOUBLE) AS y2 FROM part, {rs}"
LINES = "SELECT p_partkey AS page_id, CAST(n AS INT) AS line_no, CASE WHEN n = 4 THEN ' ' ELSE concat('w', CAST((p_partkey + n) % 5 AS INT), 'x', CAST(n % 2 AS INT), CASE WHEN p_partkey % 3 = 0 THEN 'tail' ELSE '' END) END AS text, CAST(n * 17 AS DOUBLE) AS x1, CAST(n * 8 AS DOUBLE) AS y1, CAST(n * 17 + 30 AS DOUBLE) AS x2, CAST(n * 8 + 6 + p_partkey % 7 AS DOUBLE) AS y2 FROM part, {rs}"


def _boxes(s, d, text: str, n: int):
    read(s, d, "part").createOrReplaceTempView("part")
    name = "r" if n == 2 else "n"
    return s.sql(text.format(d="D", rs=f"(SELECT explode(sequence(0, {n - 1})) AS {name})"))


def region_lines(s, d):
    return spatial.region_lines(_boxes(s, d, REGIONS, 2), _boxes(s, d, LINES, 5))


def seals(s, d):
    return spatial.seal_texts(_boxes(s, d, REGIONS, 2), _boxes(s, d, LINES, 5))


_REGIONS, _LINES = REGIONS.format(d="::DOUBLE", rs="(SELECT unnest([0, 1]) AS r)"), LINES.format(rs="(SELECT unnest([0, 1, 2, 3, 4]) AS n)")
_NEAR = f"""(SELECT * FROM (SELECT r.*, l.line_no, l.text, l.x1 AS lx1, l.y1 AS ly1, l.x2 AS lx2, l.y2 AS ly2, greatest(0, least(r.x2, l.x2) - greatest(r.x1, l.x1)) * greatest(0, least(r.y2, l.y2) - greatest(r.y1, l.y1)) / ((l.x2 - l.x1) * (l.y2 - l.y1)) AS share
  FROM ({_REGIONS}) r JOIN ({_LINES}) l ON r.page_id = l.page_id WHERE trim(l.text) <> '') WHERE share >= 0.26 OR ((lx1 + lx2) / 2 BETWEEN x1 AND x2 AND (ly1 + ly2) / 2 BETWEEN y1 AND y2))"""
_P = "(SELECT id, GROUPS AS g FROM TASKS WHERE id % 13 <> 5)".replace("GROUPS", GROUP).replace("TASKS", TASKS)
_D = f"(SELECT id, {TRUTH} AS doc FROM {TASKS} WHERE {TRUTH} <> '')"
_B = f"(SELECT id, g, doc FROM {_P} JOIN {_D} USING (id))"
_PAIRS = lambda by: f"(SELECT coalesce(sum(c * (c - 1) // 2), 0)::BIGINT FROM (SELECT count(*) AS c FROM {_B} GROUP BY {by}))"
_DOM = f"(SELECT g, doc, c, row_number() OVER (PARTITION BY g ORDER BY c DESC, doc) AS k, sum(c) OVER (PARTITION BY g) AS n FROM (SELECT g, doc, count(*) AS c FROM {_B} GROUP BY ALL))"
_FAMILY = lambda c: "CASE " + " ".join(f"WHEN {' + '.join(f'contains({c}, {k!r})::INT' for k in ks)} >= {n} THEN {f!r}" for f, ks, n in x.FAMILIES) + " ELSE '' END"
_CAND = f"(SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY coalesce(visual_page_no, sequence, 1000000000), created_at NULLS FIRST, id) AS idx FROM (SELECT {CANDIDATES.format(at=AT_SQL, double='::DOUBLE')} FROM {TASKS}))"
_EQ = lambda f: f"(l.{f} <> '' AND l.{f} = r.{f})"
_DECIDED = f"""
WITH RECURSIVE c AS {_CAND}, q AS (SELECT a.batch_id, a.id AS l_id, b.id AS r_id FROM c a JOIN c b ON a.batch_id = b.batch_id AND a.idx < b.idx),
tp AS (SELECT DISTINCT l.title_norm AS a, r.title_norm AS b, l.title_norm || '|' || r.title_norm AS p FROM q JOIN c l ON l.id = l_id JOIN c r ON r.id = r_id WHERE l.title_norm <> '' AND r.title_norm <> '' AND l.title_norm <> r.title_norm), {ratio_sql('tp')},
j AS (SELECT q.batch_id, l_id, r_id, l, r, coalesce(l.visual_prefix <> '' AND l.visual_prefix = r.visual_prefix AND abs(l.visual_page_no - r.visual_page_no) <= 1, false) AS adjacent, CASE WHEN l.title_norm = '' OR r.title_norm = '' THEN 0.0 WHEN l.title_norm = r.title_norm THEN 1.0 ELSE ratio END AS t, CASE WHEN l.filename_norm = r.filename_norm THEN 1.0 ELSE 0.0 END AS n,
  EXISTS (SELECT 1 FROM c z WHERE z.batch_id = q.batch_id AND z.visual_prefix = l.visual_prefix AND l.visual_prefix = r.visual_prefix AND l.visual_prefix <> '' AND z.visual_page_no > least(l.visual_page_no, r.visual_page_no) AND z.visual_page_no < greatest(l.visual_page_no, r.visual_page_no)) AS betw
  FROM q JOIN c l ON l.id = l_id JOIN c r ON r.id = r_id LEFT JOIN ratios ON ratios.p = l.title_norm || '|' || r.title_norm),
o AS (SELECT *, CASE WHEN {_EQ('boundary_group')} THEN 'yes|0.9' WHEN adjacent AND {_EQ('family')} AND l.family = 'contract' THEN 'yes|0.86' WHEN {_EQ('doc_no_norm')} THEN 'yes|1.0' WHEN l.doc_no_norm <> '' AND r.doc_no_norm <> '' THEN 'no|0.0'
  WHEN {_EQ('series_key')} AND abs(l.sequence - r.sequence) <= 2 THEN 'undecided|0.0' WHEN t >= 0.97 AND {_EQ('date_norm')} THEN 'yes|0.97' WHEN t >= 0.97 AND {_EQ('responsible_norm')} THEN 'yes|0.94'
  WHEN l.title_norm <> '' AND r.title_norm <> '' AND t <= 0.35 AND l.date_norm <> '' AND r.date_norm <> '' AND l.date_norm <> r.date_norm THEN 'no|0.0'
  WHEN t >= 0.62 OR n = 1 OR {_EQ('date_norm')} OR {_EQ('responsible_norm')} OR {_EQ('doc_no_prefix')} THEN 'undecided|0.0' ELSE 'no|0.0' END AS rule FROM j),
decided AS (SELECT batch_id, l_id AS left_id, r_id AS right_id, string_split(rule, '|')[1] AS decision, CAST(string_split(rule, '|')[2] AS DOUBLE) AS confidence,
  string_split(rule, '|')[1] = 'undecided' AND NOT betw AND CASE WHEN coalesce(l.visual_prefix <> '' AND l.visual_prefix = r.visual_prefix AND abs(l.visual_page_no - r.visual_page_no) <= 2, false) THEN TRUE WHEN {_EQ('series_key')} THEN abs(l.sequence - r.sequence) <= 2
    ELSE (r.idx - l.idx <= 1 AND (t >= 0.62 OR (n = 1 AND ({_EQ('date_norm')} OR {_EQ('responsible_norm')} OR {_EQ('doc_no_prefix')})) OR ({_EQ('date_norm')} AND ({_EQ('responsible_norm')} OR {_EQ('doc_no_prefix')})))) OR (t >= 0.9 AND ({_EQ('date_norm')} OR {_EQ('responsible_norm')} OR n = 1)) END AS ask,
  CASE WHEN adjacent THEN 0.82::DOUBLE WHEN {_EQ('series_key')} AND r.idx - l.idx <= 1 THEN 0.84::DOUBLE ELSE 0.9::DOUBLE END AS accept, betw AS page_between FROM o)
"""

QUERIES = {
    "P-01_F-19_summaries": (summaries, f"SELECT id, filename, batch_id, mode, CASE WHEN status = 'RUNNING' THEN CASE WHEN id % 6 = 0 THEN 'human_review' ELSE 'processing' END WHEN status = 'queued' THEN 'pending' ELSE status END AS status FROM {T}"),
    "P-05_renamed": (renamed, f"SELECT id, batch_id AS archive_no, lang AS title FROM {TASKS}"),
    "P-12_submission_names": (names, f"SELECT id, CASE WHEN id % 9 = 0 THEN 'own name' WHEN id % 2 = 0 THEN CASE WHEN trim(coalesce(usr, '')) = '' THEN '匿名用户' ELSE usr END || '-20240506-第' || greatest(1, id % 4) || '次提交' WHEN trim(coalesce(filename, '')) <> '' THEN filename ELSE CASE WHEN trim(coalesce(usr, '')) = '' THEN '匿名用户' ELSE usr END || '-20240506-历史任务' END AS name FROM {T}"),
    "P-13_records": (records, f"""SELECT id, lang, CASE WHEN id % 3 = 0 THEN '{{"rating":"helpful","reason":"' || batch_id || '"}}' END AS feedback FROM {TASKS}"""),
    "P-16_evidence": (evidence_dropped, f"""SELECT id, '{{"lang":"' || lang || '"}}' AS fields FROM {TASKS}"""),
    "F-02_F-03_F-12_F-14_filters": (filters, f"SELECT id, starts_with(file_path, '/in/src1') AS folder, TRUE AS any_folder, id % 4 > 1 AND batch_id = 'src2' AS batch, TRUE AS any_batch, regexp_matches(file_path, '^/in/src[34](/|$)') AS allowed, id % 4 < 2 AS unassigned FROM {TASKS}"),
    "F-08_vectors": (with_vectors, "SELECT vec_id FROM embeddings WHERE vec_id % 3 > 0 AND embedding IS NOT NULL"),
    "F-09_ids": (of_ids, f"SELECT id, lang FROM {TASKS} WHERE id IN (SELECT doc_id FROM labels)"),
    "F-20_facets": (faceted, f"SELECT id, status FROM {T} WHERE created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-21' AND status IN ('done', 'failed') AND mode = 'vl'"),
    "A-01_total": (counted, f"SELECT count(*) AS total FROM {TASKS} WHERE starts_with(file_path, '/in/src1')"),
    "T-02_oldest_page": (oldest_page, f"SELECT id FROM {T} ORDER BY created_at NULLS FIRST, id LIMIT 15 OFFSET 15"),
    "T-09_T-12_newest_page": (newest_page, f"SELECT id FROM {T} ORDER BY created_at DESC NULLS LAST, id LIMIT 10"),
    "T-10_A-34_groups": (ordered, f"SELECT *, row_number() OVER (ORDER BY first_member, g) AS position FROM (SELECT concat(lang, id % 5) AS g, min(id) AS first_member, count(*) AS members FROM {TASKS} GROUP BY g)"),
    "D-04_deleted": (kept, f"SELECT id FROM {TASKS} WHERE batch_id IS DISTINCT FROM 'src1'"),
    "D-07_feedback": (feedback, f"SELECT id, CASE WHEN id % 2 = 0 THEN 'helpful' ELSE 'not_helpful' END AS rating, CASE WHEN id % 2 = 1 THEN 'r' || id END AS reason FROM {TASKS}"),
    "U-04_mapped": (mapped, f"SELECT id, g AS group_id, doc FROM {_B}"),
    "G-21_A-12_A-15_truth": (truth, f"""WITH n AS (SELECT (SELECT count(DISTINCT id) FROM {_D}) AS truth_task_count, (SELECT count(*) FROM {_P}) AS predicted_task_count, (SELECT count(*) FROM {_B}) AS mapped_task_count, (SELECT count(DISTINCT doc) FROM {_DOM} WHERE k = 1) AS mapped_document_count,
      {_PAIRS('g, doc')} AS tp, {_PAIRS('g')} AS predicted_pairs, {_PAIRS('doc')} AS truth_pairs, (SELECT round(sum(c) / sum(n), 6) FROM {_DOM} WHERE k = 1) AS task_assignment_accuracy), s AS (SELECT *, round(tp / predicted_pairs, 6) AS precision, round(tp / truth_pairs, 6) AS recall FROM n) SELECT *, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM s"""),
    "A-19_reader_confidence": (reader_confidence, f"SELECT id, CASE WHEN id % 12 = 0 THEN round((least(1.0, id % 7 / 5.0::DOUBLE) + 0 + id % 9 / 10.0::DOUBLE) / 3, 4) WHEN id % 3 = 0 THEN round(least(1.0, id % 7 / 5.0::DOUBLE) / 2, 4) WHEN id % 4 = 0 THEN round(id % 9 / 10.0::DOUBLE, 4) WHEN id % 5 > 0 AND trim(full_text) <> '' THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM {TASKS}"),
    "A-22_distinct_in_order": (distinct_in_order, f"SELECT batch_id, string_agg(lang, ',' ORDER BY a, lang) AS langs FROM (SELECT batch_id, lang, min(id) AS a FROM {TASKS} WHERE lang <> '' GROUP BY ALL) GROUP BY batch_id"),
    "A-23_merged_text": (merged_texts, f"SELECT doc, md5(string_agg(part, chr(10) || chr(10) ORDER BY id)) AS merged_text, CAST(sum(greatest(0, id % 4 - 1)) AS BIGINT) AS page_count FROM (SELECT id, {GROUP} AS doc, '--- 文件片段开始: ' || lang || ' (task_id=' || id || ') ---' || chr(10) || coalesce(full_text, '') || chr(10) || '--- 文件片段结束: ' || lang || ' (task_id=' || id || ') ---' AS part FROM {TASKS}) GROUP BY doc"),
    "A-25_overall_threshold": (overall, f"SELECT CAST(round_even(avg(c), 0) AS BIGINT) AS threshold FROM (SELECT count(*) % 19 AS c FROM {TASKS} GROUP BY batch_id)"),
    "A-27_latest_update": (updated, "SELECT greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS latest_update"),
    "A-30_version": (versions, f"""SELECT batch_id, left(sha1(string_agg(h, ',' ORDER BY h)), 16) AS version FROM (SELECT batch_id, sha1('{{"id":' || id || ',"lang":"' || lang || '"}}') AS h FROM {TASKS}) GROUP BY batch_id"""),
    "A-31_page_summary": (summaries_of_pages, f"SELECT {GROUP} AS doc, round(avg(CASE WHEN id % 4 > 0 THEN round(least(1.0, id % 14 / 10.0::DOUBLE), 4) ELSE 0.0 END), 4) AS confidence, count(*) AS pages, coalesce(array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN id % 3 > 0 THEN [lang, concat('i', id % 2)] ELSE [] END)))), ','), '') AS issues FROM {TASKS} GROUP BY doc"),
    "A-33_counters": (counters, f"SELECT batch_id, count(*) AS total_tasks, count(*) FILTER (id % 3 = 0) AS done_tasks, count(*) FILTER (id % 4 > 0) AS eligible_tasks, count(*) FILTER (id % 4 = 0) AS skipped_tasks, CASE WHEN batch_id = 'src1' THEN 0 ELSE count(DISTINCT {GROUP}) END AS groups_count FROM {TASKS} GROUP BY batch_id"),
    "J-11_P-14_documents": (titled, f"SELECT concat('g', id) AS group_id, CASE WHEN id % 3 = 0 THEN lang WHEN id % 2 = 1 THEN batch_id WHEN id % 4 = 0 THEN 'rule' ELSE concat('g', id) END AS display_title FROM {TASKS}"),
    "W-10_T-07_candidate_index": (indexes, f"SELECT batch_id, id, idx FROM {_CAND}"),
    "J-06_J-08_G-06_G-07_pair_ladder": (decisions, f"{_DECIDED} SELECT * EXCLUDE (ask) FROM decided WHERE ask"),
    "G-08_merged_candidates": (merged, f"{_DECIDED}, y AS (SELECT * FROM decided WHERE decision = 'yes' OR (ask AND {SAME} AND {SURE} >= accept)), e AS (SELECT left_id AS a, right_id AS b FROM y UNION SELECT right_id, left_id FROM y), w(id, z) AS (SELECT id, id FROM c UNION SELECT e.b, w.z FROM w JOIN e ON e.a = w.id WHERE w.z < e.b), f AS (SELECT id, min(z) AS document FROM w GROUP BY id) SELECT batch_id, id, document, count(*) OVER (PARTITION BY document) AS members FROM c JOIN f USING (id)"),
    "C-44_snippets": (snippets, rf"WITH c AS (SELECT id, trim(regexp_replace(coalesce(full_text, ''), '\s+', ' ', 'g')) AS t FROM {TASKS}), a AS (SELECT *, length(t) AS n, CASE WHEN contains(lower(t), 'license') THEN instr(lower(t), 'license') WHEN contains(lower(t), 'secret') THEN instr(lower(t), 'secret') ELSE instr(lower(t), 'token') END AS p FROM c), b AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE greatest(0, least(n - 240, greatest(0, p - 121))) END AS s FROM a) SELECT id, md5(CASE WHEN n <= 240 THEN t ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || substring(t, s + 1, 240) || CASE WHEN s + 240 < n THEN '...' ELSE '' END END) AS snippet FROM b"),
    "C-37_citations": (cited, f"SELECT id, array_to_string(list_filter([id % 9] || CASE WHEN id % 9 <> 2 THEN [2] ELSE [] END || CASE WHEN id % 9 <> 3 THEN [3] ELSE [] END || CASE WHEN id % 4 NOT IN (2, 3) AND id % 4 <> id % 9 THEN [id % 4] ELSE [] END, lambda v: v BETWEEN 1 AND id % 6), ',') AS citations FROM {TASKS}"),
    "C-36_C-38_model_output": (outputs, f"SELECT id, lang AS title, CAST(id AS VARCHAR) AS pages, '' AS remarks, 'e' AS evidence_title FROM {TASKS}"),
    "T-11_samples": (samples, f"SELECT batch_id, id FROM (SELECT batch_id, id, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS k FROM {TASKS}) WHERE k <= 12"),
    "C-54_C-62_regions_masks": (masks, f"SELECT id, CASE id % 4 WHEN 1 THEN repeat('*', least(8, length(lang))) WHEN 2 THEN CASE WHEN length(file_path) <= 14 THEN '********' ELSE left(file_path, 8) || '...' || right(file_path, 6) END ELSE '<empty>' END AS masked, CASE WHEN id % 11 = 0 OR id % 5 = 0 THEN 'table' WHEN id % 5 = 1 THEN 'seal' WHEN id % 5 = 3 THEN 'title' ELSE 'text' END AS region, CASE id % 3 WHEN 0 THEN 'paragraph_title' WHEN 1 THEN 'image' ELSE 'text' END AS foreign_region FROM {TASKS}"),
    "C-09_families": (families, f"SELECT id, coalesce(nullif({_FAMILY(HEAD)}, ''), {_FAMILY('left(b, 2000)')}) AS family FROM (SELECT id, CASE WHEN id % 16 > 7 THEN trim(concat(full_text, '目录'), ' ' || chr(10) || chr(9) || chr(13)) ELSE concat('目录', full_text) END AS b FROM {TASKS})"),
    "J-13a_C-14_region_lines": (region_lines, f"""WITH a AS (SELECT *, CASE WHEN content = text THEN 1.0 WHEN contains(content, text) OR contains(text, content) THEN 0.92 ELSE 0.0 END AS lik FROM {_NEAR}), b AS (SELECT *, bool_or(lik >= 0.72) OVER w AS m, bool_or(share >= 0.45) OVER w AS s FROM a WINDOW w AS (PARTITION BY page_id, region_id)),
      c AS (SELECT *, row_number() OVER (PARTITION BY page_id, region_id ORDER BY CASE WHEN m THEN CASE WHEN lik >= 0.72 THEN lik ELSE -1 END ELSE 0 END DESC, share DESC, line_no) AS k FROM b) SELECT page_id, region_id, line_no FROM c WHERE CASE WHEN m THEN k = 1 WHEN s THEN share >= 0.45 ELSE k = 1 END"""),
    "J-13b_seal_texts": (seals, f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY page_id, region_id, text ORDER BY share DESC, line_no) AS d FROM {_NEAR}), b AS (SELECT *, row_number() OVER (PARTITION BY page_id, region_id ORDER BY share DESC, line_no) AS k FROM a WHERE d = 1) SELECT page_id, region_id, string_agg(text, chr(10) ORDER BY k) AS content FROM b WHERE k <= 4 GROUP BY ALL"""),
}
