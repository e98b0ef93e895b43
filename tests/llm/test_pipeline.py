import re
from collections import Counter

import corpus_pipeline
from archivolt.llm import packing
from pyspark.sql import functions as F


def test_stages_agree_with_run(spark):
    """Toxic texts, repeated lines, near copies and secrets go; clean documents reach the sequences whole."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
        docs = kept
    rows = {r.doc_id: len(packing.token_ids(r.text)) for r in docs.collect()}
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == rows


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_every_row_is_accounted_for(spark, odd, none, tmp_path):
    """Null and repeated ids, clashing columns, an empty table: each row is kept, or goes for a reason of its stage."""
    long = " ".join(f"w{k}" for k in range(60))
    more = [(None, "token=abcdefghijklmnop x", "en", "a", 1), (None, "clean one", None, None, None), (None, None, "en", "a", 1), (7, long, "en", "a", 1), (7, f"{long} tail", "en", "b", 1), (7, "token=abcdefghijklmnop y", "en", "a", 1)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(("score", "spans", "lines", "key", "n_lines", "rid", "bands", "toxic_score"))))
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for k, df in enumerate((docs, none)):
        sf = f"{tmp_path}/{k}"
        labels.write.parquet(f"{sf}/labels.parquet")
        df.write.parquet(f"{sf}/documents.parquet")
        now = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, after = now.collect(), (kept := stage(spark, now, sf).cache()).collect()
            assert kept.columns == now.columns, name
            ids = lambda rows: Counter(r.doc_id for r in rows)
            if name != "n-gram Jaccard join":  # no text is toxic here; lines and secrets are cut from rows that stay
                assert ids(before) == ids(after), name
            else:
                gone = Counter((r.doc_id, r.text) for r in before) - Counter((r.doc_id, r.text) for r in after)
                there = [shingles(r.text) for r in after]
                for _, text in gone:
                    own = shingles(text)
                    assert own and any(len(own & s) >= 0.8 * len(own | s) for s in there), text
            now = kept
        assert not any(re.search(r"token=[a-z]{12}", r.text or "") for r in now.collect())
        want = Counter()
        for r in now.collect():
            want[r.doc_id] += len(packing.token_ids(r.text))
        got = corpus_pipeline.run(spark, sf).groupBy("doc_id").sum("length").collect()
        assert {r[0]: r[1] for r in got} == dict(want)
