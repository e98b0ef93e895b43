"""Queries of the thirteen operators and of the pipeline, and their SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from . import divergence, embedding_dedup, language_id, line_dedup, media, ngram_join, packing, quality, secrets, sentence_pieces, spelling, substring_dedup, toxicity


def queries():
    import corpus_pipeline

    return {
        "op1_secret_scan": secrets.query,
        "op2_sentence_pieces": sentence_pieces.query,
        "op3_packing": packing.query,
        "op4_ngram_jaccard_join": ngram_join.query,
        "op5_language_id": language_id.query,
        "op6_media_columns": media.query,
        "op7_embedding_near_dedup": embedding_dedup.query,
        "op8_line_dedup": line_dedup.query,
        "op9_toxicity": toxicity.query,
        "op10_substring_dedup": substring_dedup.query,
        "op11_quality_rules": quality.query,
        "op12_source_divergence": divergence.query,
        "op13_spelling_variants": spelling.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"op4_ngram_jaccard_join": JACCARD, "op10_substring_dedup": SUBSTRINGS, "op7_embedding_near_dedup": EMBEDDINGS, "op11_quality_rules": quality.SQL, "op12_source_divergence": divergence.SQL, "op13_spelling_variants": spelling.SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


SUBSTRINGS = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
low AS (SELECT k, min(doc_id) AS first_id FROM win GROUP BY k HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(win.i, win.i + 13)) AS p FROM win JOIN low ON win.k = low.k AND low.first_id < win.doc_id),
each AS (SELECT doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, x -> CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, x -> x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, e.vec_id) AS component_id, e.vec_id = coalesce(comp.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN comp ON comp.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, r, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS s FROM w),
e AS (SELECT r, unnest(s) AS k FROM g),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM e a JOIN e b ON a.k = b.k AND a.r <> b.r GROUP BY ALL),
link AS (SELECT p.a, p.b FROM p JOIN g x ON x.r = p.a JOIN g y ON y.r = p.b WHERE p.n >= 0.8 * (len(x.s) + len(y.s) - p.n) - 1e-9),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT reach.a AS r, min(g.doc_id) AS c FROM reach JOIN g ON g.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT g.doc_id, least(g.doc_id, coalesce(low.c, g.doc_id)) AS class_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links FROM g LEFT JOIN low ON low.r = g.r LEFT JOIN n ON n.r = g.r
"""
