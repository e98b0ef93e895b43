"""Pages are gone through once: what rounds of readings write holds no text, and the counts are those of the replacements."""

from pyspark.sql import functions as F

from archivolt.plans import readings as p


def test_counts_are_those_of_the_replacements(spark):
    texts = ["", None, " \n ", "aZ9 \n@[`{é日😀", "x" * 100, "\t-- 12 %\r", "0" * 50 + " a", "long text 7\n" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, full_text string").selectExpr("id", "'b' AS batch_id", "'en' AS lang", "full_text").coalesce(1)
    counted = df.mapInArrow(p.characters, "id long, batch_id string, lang string, letters int, digits int, solid int").join(df.select("id", "full_text"), "id")
    without = lambda what: F.length(F.regexp_replace(F.coalesce("full_text", F.lit("")), what, ""))
    assert counted.filter((F.col("letters") != without("[^a-zA-Z]")) | (F.col("solid") != without("[ \n]")) | (F.col("digits") != without("[^0-9]"))).count() == 0
    for k, how in enumerate(p.PREPARED):
        share = F.expr(p.SHARE.format(p=how.format(t="coalesce(full_text, '')", g=""), g="", d="D"))
        read = p._reader(counted.withColumn("strategy", F.lit(p.r.STRATEGIES[k])))
        assert read.filter(~F.col("confidence").eqNullSafe(share)).count() == 0 and counted.count() == len(texts)


def test_rounds_hold_no_text(spark):
    assert "full_text" not in p._read(spark, "/root/testdata/sf0.001").columns
