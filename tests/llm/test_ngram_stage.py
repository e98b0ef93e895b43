from archivolt.llm import ngram_join as op


def test_stage_loses_no_clean_row_by_its_id(spark):
    """Groups are of rows by text: a row goes only as a copy of one that stays, whatever the ids."""
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(6, "x"), (7, "x"), (7, "other words here"), (None, "clean without an id"), (None, "clean too"), (None, ""), (None, ""), (3, text), (None, text), (None, text + " tail"), (4, "twice"), (4, "twice")]
    got = sorted((r.doc_id or 0, r.text) for r in op.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert got == sorted([(6, "x"), (7, "other words here"), (0, "clean without an id"), (0, "clean too"), (0, ""), (0, ""), (3, text), (4, "twice")])


def test_null_ids_keep_their_links(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(None, text), (None, text + " tail"), (5, text + " end"), (None, "alone in the world of texts")]
    got = sorted(map(str, op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(["Row(doc_id=None, class_id=5, n_links=2)"] * 2 + ["Row(doc_id=5, class_id=5, n_links=2)", "Row(doc_id=None, class_id=None, n_links=0)"])


def test_recall_of_bands(spark):
    """Pairs near the threshold, found against all pairs: the share that the bands miss."""
    import random

    rnd = random.Random(5)
    rows = []
    for k in range(150):
        base = [f"w{rnd.randrange(5000)}" for _ in range(100)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:95], *(f"v{rnd.randrange(5000)}" for _ in range(5))]))]
    got = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.999).filter("n_links = 1").count()
    assert got >= 0.99 * len(rows)
