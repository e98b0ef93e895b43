"""Batches of long texts are bounded, and hashes of long arrays are made in turns."""

import numpy as np
import pyarrow as pa

from archivolt.llm import common, line_dedup, ngram_join, packing, toxicity


def test_long_texts_come_in_small_batches(spark):
    rows = spark.range(40).selectExpr("id AS doc_id", "repeat('some words of a long text ', 20000) AS text").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    common.small_batches(spark)
    found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert len(found) > 1 and max(found) < 6 << 20 and sum(found) >= 40 * 26 * 20000


def test_operators_ask_for_small_batches(spark, docs):
    for make in (
        lambda: packing.pack(docs),
        lambda: toxicity.score(docs, toxicity.Model([], [])),
        lambda: line_dedup.deduplicate(docs.limit(20)),
        lambda: ngram_join.near_duplicates(docs.limit(20)),
    ):
        spark.conf.unset(common.BATCH_BYTES)
        make()
        assert spark.conf.get(common.BATCH_BYTES) == common.BYTES


def test_hashes_of_spans_in_turns():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 30_000).astype(np.uint8)
    starts = rng.integers(0, 29_000, 500)
    ends = starts + rng.integers(0, 900, 500)
    assert (common.span_hashes(buf, starts, ends, 1000) == common.span_hashes(buf, starts, ends)).all()


def test_powers_of_long_arrays_are_not_kept():
    common._powers.cache_clear()
    at = np.arange(0, 4_000_000, 8)
    common.span_hashes(np.ones(4_000_000, np.uint8), at, at + 7)
    assert common._powers.cache_info().currsize == 1 and len(common._powers(20)[0]) == 1 << 20 and common._powers.cache_info().hits


def test_freed_memory_is_given_back_at_the_end(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert list(common.tidy(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3] and given == [1]


def test_tasks_of_candidates(spark):
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [line_dedup._shares(spark, n) for n in (0, 1, 4097)] == [1, 1, min(2, most)]
    assert line_dedup._shares(spark, 1 << 26) == 1 << 10
