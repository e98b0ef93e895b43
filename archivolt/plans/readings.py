"""Queries of repeated readings and of the results of tasks, beside their SQL. Four documents are the pages of a task; a page is read the surer the more of it are letters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from archivolt.operators import readings as r
from archivolt.plans.data import TASKS, tasks
from archivolt.plans.reviews import ISSUE, ISSUES

# SQL of both engines; what is read after each way of preparing a page.
PREPARED = ("{t}", "regexp_replace({t}, '[0-9]', ''{g})", "regexp_replace({t}, '[^a-zA-Z ]', ''{g})")
SHARE = "round(length(regexp_replace({p}, '[^a-zA-Z]', ''{g})) / CAST(greatest(1, length(regexp_replace({p}, '[ \\n]', ''{g}))) AS DOUBLE) - id % 13 / 40.0{d}, 4)"
NUMBER, TITLE = "CASE id % 5 WHEN 0 THEN ' A 1' WHEN 1 THEN 'A1' WHEN 2 THEN batch_id ELSE ' ' END", "CASE WHEN id % 3 = 0 THEN concat('t', lang) ELSE concat('t ', lang) END"


# What of a page counts after each way of preparing it: its characters but spaces, these without digits, letters alone.
COUNTED = ("solid", "solid - digits", "letters")


_BYTE = np.arange(256)
_LETTER, _DIGIT = (_BYTE | 32 >= ord("a")) & (_BYTE | 32 <= ord("z")) & (_BYTE < 128), (_BYTE >= ord("0")) & (_BYTE <= ord("9"))
_SOLID = (_BYTE & 0xC0 != 0x80) & (_BYTE != ord(" ")) & (_BYTE != ord("\n"))  # first bytes of characters


def characters(batches):
    """How many letters and digits (ASCII) and characters but spaces and line breaks a text has; many times faster than replacing them by an expression."""
    for batch in batches:
        text = batch.column("full_text").fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data, out = np.frombuffer(text.buffers()[2] or b"", np.uint8), np.zeros((3, len(text)), np.int32)
        i = 0
        while i < len(text):  # about a megabyte at a time
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1)
            at = offsets[i : j + 1] - offsets[i]
            for k, kind in enumerate((_LETTER, _DIGIT, _SOLID)):
                sums = np.r_[0, np.cumsum(kind[data[offsets[i] : offsets[j]]])]
                out[k, i:j] = sums[at[1:]] - sums[at[:-1]]
            i = j
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "batch_id", "lang")), *map(pa.array, out)], names=["id", "batch_id", "lang", "letters", "digits", "solid"])


def _reader(pages):
    out = F.lit(None).cast("double")
    for k, counted in enumerate(COUNTED):
        share = F.expr(f"round(letters / CAST(greatest(1, {counted}) AS DOUBLE) - id % 13 / 40.0D, 4)")
        out = F.when(F.col("strategy") == r.STRATEGIES[k], share).otherwise(out)
    return pages.withColumn("confidence", out)


def _read(s, d):
    """The readings of pages, without their texts: each text is gone through once, and what it has of each kind is what rounds write and read."""
    names = "id long, batch_id string, lang string, letters int, digits int, solid int"
    counted = tasks(s, d).select("id", "batch_id", "lang", "full_text").mapInArrow(characters, names)
    return r.read_until_sure(counted, _reader)


def reread(s, d):
    return _read(s, d).select("id", "strategy", F.col("retries").cast("int").alias("retries"), "confidence")


def results(s, d):
    fields = F.create_map(F.lit("doc_no"), F.expr(NUMBER), F.lit("title"), F.expr(TITLE), F.lit("date"), F.lit("2020"), F.lit("other"), F.lit("x"))
    texts = tasks(s, d).select("id", "full_text")
    pages = _read(s, d).join(texts.hint("merge"), "id").select(F.expr("id div 4").alias("task_id"), (F.col("id") % 4 + 1).cast("int").alias("page_num"), F.col("full_text").alias("text"), "confidence", "retries", F.when(F.expr(ISSUE).isNotNull(), F.array(F.expr(ISSUE), F.lit(" "), F.expr(ISSUE))).alias("issues"), fields.alias("fields"))
    out = r.archived(pages)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("task_id", F.col("page_count").cast("long").alias("page_count"), F.md5(F.col("full_text").cast("binary")).alias("full_text"), "average_confidence", "min_confidence", "max_confidence", *map(joined, ("retry_pages", "pages_with_issues", "issues")), "doc_no", "title", "date", F.col("conflict_count").cast("long").alias("conflict_count"), "human_review", "review_status", "review_reason", "archive_saved")


_C = lambda k: SHARE.format(p=PREPARED[k].format(t="coalesce(full_text, '')", g=", 'g'"), g=", 'g'", d="::DOUBLE").replace("[ \\n]", "[ \\n]")
_R = f"""c AS (SELECT *, {_C(0)} AS c0, {_C(1)} AS c1, {_C(2)} AS c2 FROM {TASKS}),
  k AS (SELECT *, CASE WHEN c0 >= 0.85 THEN 0 WHEN c1 >= 0.85 THEN 1 ELSE 2 END AS retries FROM c), r AS (SELECT *, CASE retries WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS confidence, CASE retries WHEN 0 THEN 'none' WHEN 1 THEN 'opencv_document' ELSE 'enhance_contrast' END AS strategy FROM k)"""
_TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
RESULTS = f"""
WITH {_R}, i AS (SELECT id, {ISSUE} AS issue FROM {TASKS}), b AS (SELECT id, blocking FROM {ISSUES}),
p AS (SELECT r.id // 4 AS task_id, r.id % 4 + 1 AS page, {_TRIM("coalesce(full_text, '')")} AS text, confidence AS raw, round(greatest(0.0, least(1.0, confidence)), 4) AS c, retries, {_TRIM('issue')} AS issue, issue IS NOT NULL AS has, coalesce(blocking, false) AS blocking, {NUMBER} AS doc_no, {TITLE} AS title FROM (SELECT r.*, issue, blocking FROM r JOIN i USING (id) JOIN b USING (id)) r),
v AS (SELECT task_id, page, raw, f, trim(v) AS v FROM (SELECT task_id, page, raw, 'doc_no' AS f, doc_no AS v FROM p UNION ALL SELECT task_id, page, raw, 'title', title FROM p UNION ALL SELECT task_id, page, raw, 'date', '2020' FROM p) WHERE trim(v) <> ''),
w AS (SELECT task_id, f, replace(v, ' ', '') AS key, CASE WHEN f = 'title' THEN arg_min(v, (-length(v), page)) ELSE arg_min(v, page) END AS spelt, count(*) AS n, round(sum(raw), 9) AS score, max(raw) AS top, min(page) AS head FROM v GROUP BY task_id, f, replace(v, ' ', '')),
m AS (SELECT task_id, f, arg_max(spelt, (n, score, top, length(spelt), -head)) AS v, count(*) AS k FROM w GROUP BY task_id, f),
e AS (SELECT task_id, max(v) FILTER (f = 'doc_no') AS doc_no, max(v) FILTER (f = 'title') AS title, max(v) FILTER (f = 'date') AS date, count(*) FILTER (f <> 'title' AND k > 1) AS conflicts, string_agg(f, ', ' ORDER BY f) FILTER (f <> 'title' AND k > 1) AS clash FROM m GROUP BY task_id),
s AS (SELECT task_id, issue, min(page) AS head, bool_or(blocking) AS stops FROM p WHERE has AND issue <> '' GROUP BY task_id, issue),
q AS (SELECT task_id, string_agg(issue, ',' ORDER BY head) AS issues, arg_min(issue, head) FILTER (stops) AS stop FROM s GROUP BY task_id),
g AS (SELECT task_id, count(*) AS page_count, string_agg(text, '' ORDER BY page) AS one, string_agg('--- Page ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page) FILTER (text <> '') AS many, CAST((2 * CAST(sum(CAST(round(c * 10000) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 10000 AS average_confidence, min(c) AS min_confidence, max(c) AS max_confidence,
  coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (retries > 0), '') AS retry_pages, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (has), '') AS pages_with_issues FROM p GROUP BY task_id)
SELECT g.task_id, page_count, md5(CASE WHEN page_count > 1 THEN coalesce(many, '') ELSE one END) AS full_text, average_confidence, min_confidence, max_confidence, retry_pages, pages_with_issues, coalesce(issues, '') AS issues, coalesce(doc_no, '') AS doc_no, title, date, conflicts AS conflict_count, conflicts > 0 OR stop IS NOT NULL AS human_review,
  CASE WHEN conflicts = 0 AND stop IS NULL THEN 'approved' WHEN conflicts > 0 OR average_confidence >= 0.6 THEN 'pending_human_review' ELSE 'required' END AS review_status,
  concat_ws('；', '跨页关键字段冲突：' || clash, stop, CASE WHEN conflicts = 0 AND stop IS NULL THEN NULL WHEN average_confidence < 0.6 THEN printf('总体置信度 %.2f 低于 0.60', average_confidence) WHEN average_confidence <= 0.85 THEN printf('总体置信度 %.2f 落在人工审核区间', average_confidence) END) AS review_reason,
  NOT (conflicts > 0 OR stop IS NOT NULL) AS archive_saved
FROM g LEFT JOIN e ON e.task_id = g.task_id LEFT JOIN q ON q.task_id = g.task_id
"""

QUERIES = {"G-14_read_again": (reread, f"WITH {_R} SELECT id, strategy, CAST(retries AS INT) AS retries, confidence FROM r"), "G-17_task_results": (results, RESULTS)}
