"""Lines and regions of pages by place. Joins are within a page, whose lines and regions are few; nothing crosses pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import compact, text_similarity

# Share of a line inside a region, the same where no text matches, likeness of texts, and lengths of contents.
INSIDE, MOSTLY_INSIDE, LIKE, SHORT = 0.26, 0.45, 0.72, 32
SEAL_LINES, SEAL_LONGEST = 4, 28
SIDES = ("x1", "y1", "x2", "y2")


def _area(r: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{r}x2") - F.col(f"{r}x1")) * F.greatest(F.lit(0.0), F.col(f"{r}y2") - F.col(f"{r}y1"))


def near_lines(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines whose centre is in a region of their page, or of which at least INSIDE is; share: how much of the line.

    regions: page_id, region_id, content, x1, y1, x2, y2; lines: page_id, line_no, text, x1, y1, x2, y2. Blank lines are left out.
    """
    own = lines.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("page_id", "line_no", "text", *(F.col(s).alias(f"l_{s}") for s in SIDES))
    both = regions.join(own, "page_id")
    side = lambda k: F.greatest(F.lit(0.0), F.least(F.col(f"{k}2"), F.col(f"l_{k}2")) - F.greatest(F.col(f"{k}1"), F.col(f"l_{k}1")))
    share = side("x") * side("y") / F.when(_area("l_") > 0, _area("l_")).otherwise(1.0)
    cx, cy = (F.col("l_x1") + F.col("l_x2")) / 2, (F.col("l_y1") + F.col("l_y2")) / 2
    inside = cx.between(F.col("x1"), F.col("x2")) & cy.between(F.col("y1"), F.col("y2"))
    return both.withColumn("share", share).filter(inside | (F.col("share") >= INSIDE))


def region_lines(regions: DataFrame, lines: DataFrame, ratio=None) -> DataFrame:
    """J-13a: (page_id, region_id, line_no): the lines that make up a region.

    Those near it whose text is like its content: of a short content the likest one, else all of them. Where none is like
    it: those mostly inside, else of a short content the one most inside, else all. ratio: a function of two text columns
    for texts of which neither holds the other.
    """
    rows = near_lines(regions, lines).withColumn("c", compact(F.col("content"))).withColumn("t", compact(F.col("text")))
    rows = rows.withColumn("like", text_similarity(F.col("c"), F.col("t"), ratio(F.col("c"), F.col("t")) if ratio else None))
    one = Window.partitionBy("page_id", "region_id")
    rows = rows.withColumn("matches", F.max(F.col("like") >= LIKE).over(one)).withColumn("mostly", F.max(F.col("share") >= MOSTLY_INSIDE).over(one))
    rank = F.row_number().over(one.orderBy(F.desc(F.when(F.col("matches"), F.when(F.col("like") >= LIKE, F.col("like")).otherwise(-1.0)).otherwise(0.0)), F.desc("share"), "line_no"))
    short = F.length("c") <= SHORT
    kept = F.when(F.col("matches"), F.when(short, rank == 1).otherwise(F.col("like") >= LIKE))
    kept = kept.when(F.col("mostly"), F.col("share") >= MOSTLY_INSIDE).when(short, rank == 1).otherwise(True)
    return rows.withColumn("kept", kept).filter("kept").select("page_id", "region_id", "line_no")


def seal_texts(seals: DataFrame, lines: DataFrame) -> DataFrame:
    """J-13b: (page_id, region_id, content): up to four different texts of the lines in a seal, those most inside first."""
    rows = near_lines(seals, lines).withColumn("t", compact(F.col("text")))
    n, wide, high = F.length("t"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    lw, lh = F.col("l_x2") - F.col("l_x1"), F.col("l_y2") - F.col("l_y1")
    wrong = ((lw > wide * 1.2) & (wide > 0) & (n > 12)) | ((lh > high * 0.65) & (high > 0) & (n > 16)) | (n > SEAL_LONGEST) | ((n > 18) & F.col("text").rlike("[，。；、]"))
    rows = rows.filter((n > 0) & ~wrong).groupBy("page_id", "region_id", "t").agg(F.min_by(F.struct("text", "share", "line_no"), F.struct((-F.col("share")).alias("s"), "line_no")).alias("b"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "region_id").orderBy(F.desc("b.share"), "b.line_no"))).filter(F.col("k") <= SEAL_LINES)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.trim("b.text").alias("text")))), lambda x: x["text"]), "\n")
    return ranked.groupBy("page_id", "region_id").agg(texts.alias("content"))
