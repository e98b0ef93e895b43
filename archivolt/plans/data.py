"""The driver's tables in the shape of page tasks. Documents stand for tasks, sources for batches and sequence prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("/in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("batch_id"), path.alias("file_path"), F.col("text").alias("full_text"), "lang", "n_chars")


TASKS = "(SELECT doc_id AS id, source AS batch_id, '/in/' || source || '/' || doc_id || '.txt' AS file_path, text AS full_text, lang, n_chars FROM documents)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(tasks(spark, sf_dir))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows numbered within their batch; every ninth number is left out, so that there are gaps."""
    n = rows.withColumn("n", F.row_number().over(Window.partitionBy("batch_id").orderBy("id")).cast("long"))
    return n.withColumn("page_no", F.expr("n + (n + 4) div 8")).drop("n")


PAGES = f"(SELECT * EXCLUDE (n), n + (n + 4) // 8 AS page_no FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS n FROM {TASKS}))"


def status() -> str:
    """SQL of both engines: a task's status from its id."""
    return "CASE id % 5 WHEN 0 THEN ' Completed ' WHEN 1 THEN 'queued' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'failed' ELSE 'Odd' END"
