"""Connected components of an undirected graph (G-01)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _written(df: DataFrame) -> DataFrame:
    """A table in the cluster's shared folder: lineage is cut, a lost executor loses nothing. Only a local session may leave it unset."""
    spark = df.sparkSession
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        home = "file://" + tempfile.mkdtemp(prefix="archivolt-")
        spark.conf.set("spark.checkpoint.dir", home)
    path = f"{home.rstrip('/')}/archivolt-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links reach.

    Each round replaces every edge by edges to the smallest neighbour, first of the larger ends, then of the smaller
    ones, until nothing changes: a number of rounds logarithmic in the number of vertices, and no gathered groups. A
    vertex with very many neighbours is a skewed key of the joins, which Spark splits where adaptive execution is on. The
    joins are by sorted keys, as the bytes of the written edges say little of what Spark would send through the driver.
    """
    e = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi").distinct()
    e, before = _written(e), None
    while True:
        both = e.select(F.col("hi").alias("v"), F.col("lo").alias("n")).unionByName(e.select(F.col("lo").alias("v"), F.col("hi").alias("n")))
        least = both.groupBy("v").agg(F.min("n").alias("m")).withColumn("m", F.least("v", "m"))
        large = both.join(least.hint("merge"), "v").filter("n > v").select(F.col("m").alias("lo"), F.col("n").alias("hi")).filter("lo <> hi").distinct()
        down = large.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m"))
        small = large.join(down.hint("merge"), F.col("hi") == F.col("v")).select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("x")).select("x.*").filter("lo <> hi").distinct()
        e = _written(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return vertices.join(e.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("component")).hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
