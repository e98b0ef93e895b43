"""Queries of page fingerprints, beside their SQL. Pages are the texts' bytes as images of 32 x 32 pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.operators import fingerprints as f
from archivolt.plans.data import tasks

THRESHOLD = 10


def _marks(s, d):
    return f.fingerprints(f.frames(tasks(s, d), "id", "full_text"))


def marks(s, d):
    bits = lambda c: F.lpad(F.bin(c), 64, "0")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.4f", x)), ",")
    size = F.col("frame") * 400 + 900
    return _marks(s, d).select("id", "frame", bits("phash").alias("phash"), F.array_join(F.transform("layout", bits), "").alias("layout"), "ink", text("row_profile").alias("row_profile"), text("col_profile").alias("col_profile"), f.complexity(F.col("deviation"), F.lit(1000), size).alias("complexity"))


def splits(s, d):
    # the last two of its four digits depend on the order of sums where they are halves
    return f.compared(_marks(s, d), "id", "frame", THRESHOLD).withColumn("profile_distance", F.floor(F.col("profile_distance") * 100 + 0.26).cast("int"))


_MARKS = f"""n AS (SELECT doc_id AS id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
  b AS (SELECT id, unnest(h) AS x, generate_subscripts(h, 1) - 1 AS o FROM n), k AS (SELECT id, greatest(1, CAST(ceil(len(h) / 1024) AS BIGINT)) * 1024 AS n, len(h) AS own FROM n),
  px AS (SELECT id, o // 1024 AS frame, o % 1024 // 32 AS r, o % 32 AS c, CAST(('0x' || x)::INT AS DOUBLE) AS v FROM b UNION ALL SELECT id, o // 1024, o % 1024 // 32, o % 32, 255.0::DOUBLE FROM (SELECT id, unnest(range(own, n)) AS o FROM k)),
  t AS (SELECT u, c, CASE WHEN u = 0 THEN sqrt(1 / 32) ELSE sqrt(2 / 32) END * cos((2 * c + 1) * u * (pi() / 64)) AS w FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(32)) AS c)),
  d1 AS (SELECT id, frame, u, px.c, sum(w * v) AS v FROM px JOIN t ON t.c = px.r GROUP BY ALL), d2 AS (SELECT id, frame, d1.u, t.u AS z, round(sum(w * v), 6) AS v FROM d1 JOIN t ON t.c = d1.c GROUP BY ALL),
  dm AS (SELECT id, frame, median(v) AS m FROM d2 WHERE u + z > 0 GROUP BY ALL), ph AS (SELECT id, frame, string_agg(CASE WHEN v > m THEN '1' ELSE '0' END, '' ORDER BY u, z) AS phash FROM d2 JOIN dm USING (id, frame) GROUP BY ALL),
  lo AS (SELECT id, frame, min(v) AS lo, max(v) AS hi, stddev_pop(v) AS deviation FROM px GROUP BY ALL), st AS (SELECT id, frame, r, c, CASE WHEN hi > lo THEN trunc(v * (255.0::DOUBLE / (hi - lo)) + -lo * (255.0::DOUBLE / (hi - lo))) ELSE v END AS v FROM px JOIN lo USING (id, frame)),
  li AS (SELECT id, frame, least({f.INK[1]}, greatest({f.INK[0]}, median(v) - {f.BELOW_MEDIAN})) AS lim FROM st GROUP BY ALL), bi AS (SELECT id, frame, r, c, (v < lim)::INT AS i FROM st JOIN li USING (id, frame)),
  ik AS (SELECT id, frame, round_even(sum(i) / 1024, 6) AS ink FROM bi GROUP BY ALL),
  rp AS (SELECT id, frame, list(p ORDER BY q) AS rows_ FROM (SELECT id, frame, r // 2 AS q, round_even(sum(i) / 64, 4) AS p FROM bi GROUP BY ALL) GROUP BY ALL), cp AS (SELECT id, frame, list(p ORDER BY q) AS cols_ FROM (SELECT id, frame, c // 2 AS q, round_even(sum(i) / 64, 4) AS p FROM bi GROUP BY ALL) GROUP BY ALL),
  la AS (SELECT id, frame, string_agg(CASE WHEN s / 4 > greatest({f.LEAST_DENSITY}::DOUBLE, ink * {f.DENSITY_SHARE}::DOUBLE) THEN '1' ELSE '0' END, '' ORDER BY y, x) AS layout FROM (SELECT id, frame, r // 2 AS y, c // 2 AS x, sum(i) AS s FROM bi GROUP BY ALL) JOIN ik USING (id, frame) GROUP BY ALL),
  ma AS (SELECT id, CAST(frame AS INT) AS frame, phash, layout, ink, rows_, cols_, deviation FROM ph JOIN la USING (id, frame) JOIN ik USING (id, frame) JOIN rp USING (id, frame) JOIN cp USING (id, frame) JOIN lo USING (id, frame))"""
_GAP = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))) / 16"
_BITS = lambda a, b, n: f"CAST(list_sum(list_transform(range(1, {n + 1}), lambda z: (substr({a}, z, 1) <> substr({b}, z, 1))::INT)) AS INT)"
_LIMIT, _PROFILE = max(THRESHOLD + 4, 12), max(0.14, min(0.32, THRESHOLD / 40))

QUERIES = {
    "C-49_C-57_fingerprints": (marks, f"WITH {_MARKS} SELECT id, frame, phash, layout, ink, array_to_string(list_transform(rows_, lambda z: printf('%.4f', z)), ',') AS row_profile, array_to_string(list_transform(cols_, lambda z: printf('%.4f', z)), ',') AS col_profile, round(least(1.0::DOUBLE, least(deviation / 96.0, 1.0::DOUBLE) * 0.45::DOUBLE + least(1000 * (frame * 400 + 900) / 7680000.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE + CASE WHEN frame * 400 + 900 > 1200 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END), 4) AS complexity FROM ma"),
    "C-48_C-49_page_starts": (splits, f"""WITH {_MARKS}, l AS (SELECT *, lag(phash) OVER w AS p1, lag(layout) OVER w AS p2, lag(ink) OVER w AS p3, lag(rows_) OVER w AS p4, lag(cols_) OVER w AS p5 FROM ma WINDOW w AS (PARTITION BY id ORDER BY frame)),
      g AS (SELECT id, frame, {_BITS('phash', 'p1', 64)} AS phash_distance, {_BITS('layout', 'p2', 256)} AS layout_distance, CAST(round(CAST(({_GAP('rows_', 'p4')} + {_GAP('cols_', 'p5')} + abs(ink - p3)) / 3 AS DECIMAL(38, 17)), 4) AS DOUBLE) AS profile_distance FROM l)
      SELECT id, frame, phash_distance, layout_distance, CAST(floor(profile_distance * 100 + 0.26::DOUBLE) AS INT) AS profile_distance, coalesce(phash_distance > {THRESHOLD} AND (layout_distance > {_LIMIT} OR profile_distance > {_PROFILE}::DOUBLE OR round(least(1.0::DOUBLE, phash_distance / {max(1.0, THRESHOLD * 1.75)}) * 0.55::DOUBLE + least(1.0::DOUBLE, layout_distance / {max(1.0, _LIMIT * 1.3)}) * 0.25::DOUBLE + least(1.0::DOUBLE, profile_distance / {max(0.01, _PROFILE * 1.25)}) * 0.20::DOUBLE, 4) >= 0.95), false) AS starts FROM g"""),
}
