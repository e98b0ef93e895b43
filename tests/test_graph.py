"""Components of written links, and the merge by them."""

from pyspark.sql import functions as F

from archivolt.operators import graph
from archivolt.operators import matching as m


def test_links_do_not_pass_the_driver(spark):
    """A written table's files are smaller than its rows, so no join by its bytes may send them through the driver."""
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a % 10 <> 9")
    c = spark.range(40).selectExpr("id", "'b' AS batch_id")
    pairs = edges.select(F.struct(F.col("a").alias("id")).alias("l"), F.struct(F.col("b").alias("id")).alias("r"), F.lit("yes").alias("decision"))
    found, merged = graph.components(c.select("id"), edges), m.merged(c, pairs)
    for df in (found, merged):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()  # before: the components
    assert {r.id: r.component for r in found.collect()} == {k: k // 10 * 10 for k in range(40)}
    assert {(r.document, r.members) for r in merged.collect()} == {(k, 10) for k in (0, 10, 20, 30)}
