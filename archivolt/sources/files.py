"""Folder scans and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions.text import page_number, page_prefix
from archivolt.operators.columns import FIELDS
from archivolt.operators.sequences import page_gaps

#: Fixed value: the extensions taken in.
EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp", "pdf")
LIMIT = 50 * 1024 * 1024


def folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, limit: int = LIMIT) -> DataFrame:
    """S-02, F-15: files below a folder by name, path and size. Contents aren't read, as no column asks for them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.filter((F.col("length") <= limit) & F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*extensions)).select(name.alias("name"), "path", F.col("length").alias("size"))


def page_sequences(files: DataFrame) -> DataFrame:
    """S-03: page images by prefix and page; a page that occurs twice is an error."""
    pages = files.select(page_prefix(F.col("name")).alias("prefix"), page_number(F.col("name")).alias("page_no"), "path").filter("prefix is not null")
    grouped = pages.groupBy("prefix", "page_no").agg(F.min("path").alias("path"), F.count("*").alias("__n"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("page occurs twice: "), "path"))).otherwise(F.col("path"))
    return grouped.select("prefix", "page_no", checked.alias("path"))


def missing_pages(files: DataFrame) -> DataFrame:
    """S-03: (prefix, missing): the page numbers that a sequence's files leave out."""
    return page_gaps(page_sequences(files), "prefix", "page_no")


def verified(spark: SparkSession, paths: str, expected: DataFrame) -> DataFrame:
    """S-06: contents whose SHA-256 is the expected one (path, sha256); another digest is an error."""
    files = spark.read.format("binaryFile").load(paths).join(expected, "path")
    digest = F.sha2("content", 256)
    return files.select("path", F.when(digest == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "path"))).alias("content"))


def export_archive(rows: DataFrame, path: str) -> None:
    """K-02: the eight archive columns as CSV with a header."""
    rows.select(*FIELDS).write.mode("overwrite").option("header", "true").csv(path)


def append_archive(rows: DataFrame, path: str) -> None:
    """K-03: more rows for an archive's files."""
    rows.select(*FIELDS).write.mode("append").option("header", "true").csv(path)


def clear_archive(spark: SparkSession, path: str) -> None:
    """K-03: an archive with its header and no rows."""
    spark.createDataFrame([], ", ".join(f"{f} string" for f in FIELDS)).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def export_tasks(rows: DataFrame, path: str, form: str = "txt") -> None:
    """K-04: tasks (filename, full_text, ...) as text, each under its file name, or as JSON lines with all columns."""
    if form not in ("txt", "json"):
        raise ValueError("form must be txt or json")
    if form == "json":
        rows.write.mode("overwrite").json(path)
    else:
        rows.select(F.concat_ws("\n", F.concat(F.lit("# "), "filename"), F.coalesce("full_text", F.lit("")))).write.mode("overwrite").text(path)


def import_archive(spark: SparkSession, path: str) -> DataFrame:
    """S-04 for CSV: archive columns, without rows that are blank throughout."""
    rows = spark.read.option("header", "true").csv(path)
    some = F.concat_ws("", *(F.trim(F.coalesce(F.col(c), F.lit(""))) for c in FIELDS if c in rows.columns)) != ""
    return rows.filter(some)


def report(groups: DataFrame, path: str) -> None:
    """K-01: nested rows as JSON lines."""
    groups.write.mode("overwrite").json(path)


def replace_batches(rows: DataFrame, path: str, batch: str = "batch_id") -> None:
    """K-07 as a sink: only the partitions of the batches in rows are overwritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)
