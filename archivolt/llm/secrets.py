"""Operator 1: secrets in texts, weighed by how many repositories and owners share a value. JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kind, pattern, and the least length of what must be that long (the value for assign, else the match).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": (ASSIGN, 12), "access": (r"AKIA[A-Z0-9]{14,}", 18), "hex": (r"[0-9a-f]{16,}", 16), "opaque": (r"[A-Za-z0-9+/_-]{24,}", 24)}
BASE = ("assign", "access", "hex")
#: A value held by so many owners, or by so many repositories, is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 25


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start,rank,end,kind,value>> of one kind: positions are summed over the pieces between matches."""
    pattern, least = PATTERNS[kind]
    rank = list(PATTERNS).index(kind)
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else hits
    part = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["gap"])
        last = first + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(first.alias("start"), F.lit(rank).alias("rank"), last.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(last.alias("at"), F.when(F.length(x["value"]) >= least, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(part, start, step, lambda acc: acc["out"])).otherwise(empty)


def find(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """(doc_id, owner, repository, base, opaque), and rid where docs has it: the spans of each row.

    A null text is empty. An opaque span is a long mixed-case run with digits that no base span overlaps.
    """
    rid = [c for c in ("rid",) if c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*rid, "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), *(_spans(text, k).alias(k) for k in PATTERNS))
    base = F.array_sort(F.concat(*BASE))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("base", base).withColumn("opaque", F.filter("opaque", lambda s: mixed(s) & free(s)))
    return rows.select(*rid, "doc_id", "owner", "repository", "base", "opaque")


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, n_repositories, n_owners, n_spans, verdict) of every candidate value of the corpus.

    copied: many owners, or many repositories of whatever owners; shared: two owners; live: one owner; unowned: a value of
    few repositories, none of which has an owner. Null owners and repositories are not counted. Distinct pairs are
    aggregated first, so a value that a third of the corpus holds reaches each reducer as few rows.
    """
    each = found.select("owner", "repository", F.explode(F.concat("base", "opaque")).alias("s")).select("owner", "repository", F.sha2(F.col("s.value"), 256).alias("value_hash"))
    each = each.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
    each = each.groupBy("value_hash", "owner").agg(F.count("repository").alias("repositories"), F.sum("n").alias("n"))
    each = each.groupBy("value_hash").agg(F.sum("repositories").alias("n_repositories"), F.count("owner").alias("n_owners"), F.sum("n").alias("n_spans"))
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES)
    verdict = F.when(copied, "copied").when(F.col("n_owners") == 2, "shared").when(F.col("n_owners") == 1, "live").otherwise("unowned")
    return each.withColumn("verdict", verdict)


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def judged(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """The written table of find() with its kept spans (spans), counts of base spans by verdict, and the widest spread of a value.

    rid: the row's number; taken from docs where it has one.
    """
    found = find(docs, owner, repository)
    found = table(found if "rid" in docs.columns else found.withColumn("rid", F.monotonically_increasing_id()))
    verdicts = ownership(found).select("value_hash", "verdict", "n_owners", "n_repositories")
    spans = found.select("rid", F.explode(F.concat("base", "opaque")).alias("s")).withColumn("value_hash", F.sha2(F.col("s.value"), 256))
    # few rows of the verdicts' side a value; a value that many texts hold is a skewed key of the other side, which Spark splits
    each = spans.join(verdicts, "value_hash")
    is_base = F.col("s.rank") < len(BASE)
    per_row = each.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(is_base | (F.col("verdict") != "copied"), F.col("s")))).alias("spans"),
        F.count(F.when(is_base & F.col("verdict").isin("live", "unowned"), 1)).alias("n_live"),
        F.count(F.when(is_base & (F.col("verdict") == "copied"), 1)).alias("n_copied"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repositories").alias("most_repositories"),
    )
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(per_row, "rid", "left").select("rid", "doc_id", "base", "spans", *map(count, ("n_live", "n_copied", "most_owners", "most_repositories")))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per row of docs: the contract's columns, then n_live and n_copied (base spans by verdict), most_owners and
    most_repositories (of the row's most widely held value).

    Base spans always stay. The corpus-wide count adds an opaque span where its value is not copied. Spans are code
    points, end exclusive; empty and null texts have none. Rows that repeat a doc_id, or have none, are rows of their own.
    """
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rows = judged(docs.select(*dict.fromkeys(("doc_id", "text", owner, repository))), owner, repository)
    digest, spans = F.sha2(_joined(F.col("base")).cast("binary"), 256), F.coalesce(_joined(F.col("spans")), F.lit(""))
    return rows.select("doc_id", *(count(k) for k in BASE), digest.alias("base_sha256"), spans.alias("spans"), "n_live", "n_copied", "most_owners", "most_repositories")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes a placeholder over every kept span; all documents stay, whatever their ids. Overlapping spans get one placeholder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary")))
    found = table(find(docs.select(key.alias("rid"), "doc_id", "text", "source")).filter("size(base) > 0 OR size(opaque) > 0"))
    # what is cut depends on the text and on the verdicts of its values alone, so equal texts are looked at once
    one = found.groupBy("rid").agg(F.first("base").alias("base"), F.first("opaque").alias("opaque"))
    values = one.select("rid", F.explode("opaque").alias("s")).withColumn("value_hash", F.sha2(F.col("s.value"), 256))
    free = values.join(ownership(found).filter("verdict <> 'copied'").select("value_hash"), "value_hash", "left_semi").groupBy("rid").agg(F.collect_list("s").alias("free"))
    spans = one.join(free, "rid", "left").select(F.col("rid").alias("__key"), F.array_sort(F.concat("base", F.coalesce("free", F.slice("opaque", 1, 0)))).alias("__spans"))
    # written, so that Spark knows its size and can split a text that most rows have
    rows = docs.withColumn("__key", key).join(table(spans.filter("size(__spans) > 0")), "__key", "left")

    def cut(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[secret]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return rows.withColumn("text", F.when(F.size("__spans") > 0, clean).otherwise(F.col("text"))).select(*docs.columns)
