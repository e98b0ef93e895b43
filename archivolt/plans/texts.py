"""Queries of the scalar functions, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import text as x
from archivolt.plans.data import PAGES, TASKS, pages, read, tasks

STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
RULES = [("budget", ("ciudad", "Stadt"), 1), ("contract", ("the", "and", "of"), 3), ("minutes", ("der", "le", "que"), 2)]
NAME = "(CASE WHEN id % 3 = 0 THEN batch_id || '-' || lpad(CAST(page_no AS VARCHAR), 3, '0') || '.JPG' WHEN id % 3 = 1 THEN 'vol_' || page_no || '.pdf' ELSE '/in/' || batch_id || '/scan' || id || '.png' END)"
GRAMS = "(SELECT *, CASE WHEN s = '' THEN []::VARCHAR[] WHEN length(s) <= 2 THEN [s] WHEN length(s) < 24 THEN list_distinct(list_transform(range(1, length(s)), lambda i: substring(s, i, 2))) ELSE list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))) END AS g FROM (SELECT *, lower(regexp_replace(full_text, '[^\\p{L}\\p{N}]', '', 'g')) AS s FROM " + PAGES + "))"


def _named(s, d):
    return pages(s, d).withColumn("name", F.expr(NAME.replace("VARCHAR", "STRING").replace("lpad(CAST(page_no AS STRING), 3, '0')", "lpad(page_no, 3, '0')")))


def normal(s, d):
    c = F.col("full_text")
    return tasks(s, d).select("id", F.md5(x.normalised(c)).alias("norm"), F.md5(x.normalised(c, x.SEPARATORS_EVALUATION)).alias("evaluation"), F.md5(x.compact(c)).alias("compact"), x.word_characters(F.col("file_path")).alias("words"))


def strip(s, d):
    c = F.col("html")
    return read(s, d, "pages").select("page_id", F.md5(x.without_tags(c)).alias("plain"), x.visible(c, 240).alias("first"), x.visible(c, 240, True).alias("last"), x.title_hint(c).alias("title"))


def families(s, d):
    return tasks(s, d).select("id", x.family(F.col("full_text"), RULES).alias("family"))


def found_entities(s, d):
    return tasks(s, d).select("id", F.array_join(x.entities(F.col("full_text"), [r"([A-Z][a-z]{3,20})", r"(\d{4,12})"]), ",").alias("entities"))


def gram_counts(s, d):
    return pages(s, d).select("id", F.size(x.grams(F.col("full_text"))).cast("long").alias("grams"))


def file_names(s, d):
    n = F.col("name")
    return _named(s, d).select("id", x.page_prefix(n).alias("prefix"), x.page_number(n).alias("page"), x.sequence_number(n).alias("sequence"), x.series_key(n).alias("series"), x.number_prefix(n).alias("number_prefix"))


def found_dates(s, d):
    text = F.concat(F.date_format("o_orderdate", "yyyy-M-d"), F.lit(" x "), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" 2024.13.1 "), F.col("o_orderkey").cast("string"))
    return read(s, d, "orders").select("o_orderkey", F.array_join(x.dates(text), ",").alias("dates"))


def page_marks(s, d):
    mark = F.when(F.col("id") % 3 == 0, F.concat(F.lit("- "), F.col("id"), F.lit(" -"))).when(F.col("id") % 3 == 1, F.concat(F.col("id"), F.lit(" / 9"))).otherwise(F.col("batch_id"))
    return tasks(s, d).select("id", x.is_page_number(mark).alias("is_number"), x.timeout_seconds(F.col("id") % 8, F.col("n_chars")).cast("long").alias("seconds"))


def chunked(s, d):
    return tasks(s, d).select("id", F.posexplode(x.chunks(F.col("full_text"))).alias("pos", "chunk")).select("id", F.col("pos").cast("long").alias("pos"), F.md5("chunk").alias("chunk"))


def hashes(s, d):
    t = F.col("full_text")
    return tasks(s, d).select("id", F.sha2(t, 256).alias("sha256"), F.sha1(t).alias("sha1"), F.md5(t).alias("md5"))


def distances(s, d):
    a, b = F.col("p_partkey"), F.col("p_partkey") * 37
    v = lambda c: F.array(*((c % m / F.lit(float(m))) for m in (3, 5, 7)))
    return read(s, d, "part").select("p_partkey", x.hamming(a, b).cast("long").alias("bits"), x.profile_distance((v(a), v(b)), (v(b), v(a)), (a % 11 / 11.0, b % 13 / 13.0)).alias("distance"))


def splits(s, d):
    k = F.col("p_partkey")
    cols = (k % 64, k % 97, k % 50 / 100.0, F.when(k % 4 > 0, k % 10 / 10.0))
    return read(s, d, "part").select("p_partkey", x.change_score(*cols, 10).alias("change"), x.page_splits(*cols, 10).alias("splits"))


def marks(s, d):
    return tasks(s, d).select("id", F.md5(x.marked(F.col("full_text"), "token")).alias("marked"))


def rectangles(s, d):
    k = F.col("p_partkey")
    a, b = (k % 10 / 1.0, k % 7 / 1.0, k % 10 + 5.0, k % 7 + 4.0), (k % 6 / 1.0, k % 9 / 1.0, k % 6 + 3.0, k % 9 + k % 3 / 1.0)
    return read(s, d, "part").select("p_partkey", F.round(x.overlap_on_smaller(a, b), 6).alias("overlap"))


_NORM = lambda c, extra="": rf"lower(regexp_replace({c}, '[\s,.;:!?\-_/\\，。；：！？（）()《》【】\[\]{extra}]+', '', 'g'))"
_FAMILY = "CASE " + " ".join(f"WHEN {' + '.join(f'contains(full_text, {k!r})::INT' for k in ks)} >= {n} THEN {f!r}" for f, ks, n in RULES) + " ELSE '' END"
_STEM = r"regexp_replace(regexp_extract(name, '([^/]*)$', 1), '\.[^.]*$', '')"
_PROFILE = lambda a: f"[{a} % 3 / 3.0::DOUBLE, {a} % 5 / 5.0::DOUBLE, {a} % 7 / 7.0::DOUBLE]"

QUERIES = {
    "C-01_C-05_normalise": (normal, f"SELECT id, md5({_NORM('full_text')}) AS norm, md5({_NORM('full_text', '、')}) AS evaluation, md5(regexp_replace(full_text, '\\s+', '', 'g')) AS compact, lower(regexp_replace(file_path, '[^\\w]+', '', 'g')) AS words FROM {TASKS}"),
    "C-06_C-08_visible_text": (strip, rf"WITH p AS (SELECT page_id, regexp_replace({STRIPPED.format('html')}, '<[^>]+>', ' ', 'g') AS t FROM pages), q AS (SELECT *, regexp_replace(t, '\s+', ' ', 'g') AS v FROM p) SELECT page_id, md5(t) AS plain, trim(left(v, 240)) AS first, trim(right(v, 240)) AS last, left(coalesce(list_filter(list_transform(regexp_split_to_array(t, '[\r\n]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')[1], ''), 80) AS title FROM q"),
    "C-09_family": (families, f"SELECT id, {_FAMILY} AS family FROM {TASKS}"),
    "C-11_entities": (found_entities, rf"SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(full_text, '<[^>]+>', ' ', 'g'), '([A-Z][a-z]{{3,20}})', 1).list_concat(regexp_extract_all(regexp_replace(full_text, '<[^>]+>', ' ', 'g'), '(\d{{4,12}})', 1)).list_transform(lambda x: lower(x)), lambda x: length(x) >= 4))), ','), '') AS entities FROM {TASKS}"),
    "C-12_grams": (gram_counts, f"SELECT id, CAST(len(g) AS BIGINT) AS grams FROM {GRAMS}"),
    "C-15_C-18_file_names": (file_names, rf"WITH n AS (SELECT id, {NAME} AS name FROM {PAGES}), m AS (SELECT *, {_STEM} AS stem FROM n), o AS (SELECT *, regexp_replace(stem, '(?i)(?:[_-]?page[_-]?\d+|[_-]?\d{{1,4}})$', '') AS bare FROM m) SELECT id, nullif(regexp_extract(name, '(?i)^(.+)-(\d{{3}})\.(?:png|jpg)$', 1), '') AS prefix, CAST(nullif(regexp_extract(name, '(?i)^(.+)-(\d{{3}})\.(?:png|jpg)$', 2), '') AS BIGINT) AS page, CAST(coalesce(nullif(regexp_extract(stem, '(?i)(?:part|vol|volume|p)[\s_-]*(\d+)', 1), ''), nullif(regexp_extract(stem, '(\d{{1,4}})\D*$', 1), '')) AS BIGINT) AS sequence, {_NORM("regexp_replace(name, '/?[^/]*$', '')")} || '|' || {_NORM("CASE WHEN bare = '' THEN stem ELSE bare END")} AS series, left(regexp_replace(name, '\d+', '', 'g'), 12) AS number_prefix FROM o"),
    "C-23_dates": (found_dates, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dates FROM orders"),
    "C-24_C-39_page_marks": (page_marks, f"SELECT id, id % 3 < 2 AS is_number, CAST(CASE WHEN id % 8 >= 6 OR n_chars >= 4000 THEN 180 WHEN id % 8 >= 3 OR n_chars >= 2000 THEN 120 ELSE 60 END AS BIGINT) AS seconds FROM {TASKS}"),
    "C-41_chunks": (chunked, rf"WITH p AS (SELECT id, generate_subscripts(a, 1) AS k, unnest(a) AS p FROM (SELECT id, list_filter(list_transform(regexp_split_to_array({STRIPPED.format('full_text')}, '\n\s*\n+'), lambda x: {STRIPPED.format('x')}), lambda x: x <> '') AS a FROM {TASKS})), w AS (SELECT id, k, p, unnest(range(0, greatest(0, CAST(ceil((length(p) - 600) / 480) AS BIGINT)) + 1)) AS i FROM p), c AS (SELECT id, k, i, {STRIPPED.format('substring(p, i * 480 + 1, 600)')} AS c FROM w) SELECT id, row_number() OVER (PARTITION BY id ORDER BY k, i) - 1 AS pos, md5(c) AS chunk FROM c WHERE c <> ''"),
    "C-46_C-47_distances": (distances, f"SELECT p_partkey, CAST(bit_count(xor(p_partkey, p_partkey * 37)) AS BIGINT) AS bits, round((2 * list_sum(list_transform(list_zip({_PROFILE('p_partkey')}, {_PROFILE('(p_partkey * 37)')}), lambda z: abs(z[1] - z[2]))) / 3 + abs(p_partkey % 11 / 11.0::DOUBLE - (p_partkey * 37) % 13 / 13.0::DOUBLE)) / 3, 4) AS distance FROM part"),
    "C-48_page_split": (splits, "WITH c AS (SELECT p_partkey, p_partkey % 64 AS h, p_partkey % 97 AS l, p_partkey % 50 / 100.0::DOUBLE AS f, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 10 / 10.0::DOUBLE END AS t FROM part), e AS (SELECT *, round(least(1.0::DOUBLE, h / 17.5::DOUBLE) * 0.55::DOUBLE + least(1.0::DOUBLE, l / (14 * 1.3::DOUBLE)) * 0.25::DOUBLE + least(1.0::DOUBLE, f / (0.25 * 1.25)::DOUBLE) * 0.2::DOUBLE + coalesce(1 - t, 0.0::DOUBLE) * 0.15::DOUBLE, 4) AS change FROM c) SELECT p_partkey, change, h > 10 AND (l > 14 OR f > 0.25 OR coalesce(t < 0.35, false) OR change >= 0.95) AS splits FROM e"),
    "C-50_rectangles": (rectangles, "WITH r AS (SELECT p_partkey AS k, k % 10 AS a, k % 7 AS b, k % 6 AS c, k % 9 AS e, k % 3 AS h FROM part) SELECT k AS p_partkey, CASE WHEN h > 0 THEN round(greatest(least(a + 5, c + 3) - greatest(a, c), 0) * greatest(least(b + 4, e + h) - greatest(b, e), 0) / least(20.0::DOUBLE, 3.0::DOUBLE * h), 6) ELSE 0.0::DOUBLE END AS overlap FROM r"),
    "C-59_hashes": (hashes, f"SELECT id, sha256(full_text) AS sha256, sha1(full_text) AS sha1, md5(full_text) AS md5 FROM {TASKS}"),
    "C-60_marked": (marks, f"SELECT id, md5(regexp_replace(replace(replace(replace(full_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(token)', '<mark>\\1</mark>', 'g')) AS marked FROM {TASKS}"),
}
