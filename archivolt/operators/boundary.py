"""Document boundaries in page sequences: scores of neighbours, best segmentation, groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import text as x
from archivolt.functions.blocks import gestalt
from archivolt.operators.sequences import smoothed

# Thresholds of a score, families whose pages continue, and the longest segment.
MERGE, AMBIGUOUS, SPLIT, BASELINE = 0.72, 0.46, 0.34, 0.58
BIAS = 0.18
CONTINUING = ("budget", "contract", "drawing", "minutes")
LONGEST = 10
#: Characters of a page's normalised text that are compared.
COMPARED = 3000
# Patterns and words by which a page continues one before, begins an attachment or ends a document.
CONTINUES = r"^\s*(?:第[一二三四五六七八九十百零\d]+条|[（(]?[一二三四五六七八九十百零\d]+[）).、]|\d+[.)、])"
CONTINUES_WORDS = ("验收合格", "剩余", "质保金", "付款方式", "若乙方", "甲方通过", "乙方应当", "权在", "会议强调", "会议要求", "会议传达", "出席", "请假")
ATTACHES = ("附件", "附表", "附图", "实施要求", "验收单", "确认单", "营业执照", "资质证书", "报价表")
CLOSES = ("签字盖章后生效", "本合同及附件", "本协议及附件", "合同附件", "均具有同等法律效力", "可向甲方所在地人民法院提起诉讼")
ENTITIES = [r"(?:甲方|乙方|丙方|项目名称|工程名称|项目编号|工程地点|户名|开户行)[:：]?\s*([^\n，。；;]{2,48})", r"([\x{4e00}-\x{9fff}A-Za-z0-9（）()·\-.]{4,48}(?:有限公司|集团|银行|支行|剧院|学校|学院|中心|事务所))"]


def _any(c: Column, words: tuple[str, ...], test=F.contains) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | test(c, F.lit(w))
    return out


def starts_continuation(c: Column, words: tuple[str, ...] = CONTINUES_WORDS) -> Column:
    """C-10."""
    return x.once(x.visible(c, 80), lambda head: head.rlike(CONTINUES) | _any(head, words))


def starts_attachment(c: Column, words: tuple[str, ...] = ATTACHES) -> Column:
    """C-10."""
    return x.once(x.visible(c, 40), lambda head: _any(head, words, F.startswith))


def ends_closed(c: Column, words: tuple[str, ...] = CLOSES) -> Column:
    """C-10."""
    return x.once(x.visible(c, 240, True), lambda end: _any(end, words))


def prepared(pages: DataFrame, entities: list[str] = ENTITIES) -> DataFrame:
    """Adds what scoring needs to pages (batch_id, prefix, page_no, id, full_text, title_hint, family)."""
    plain, whole = F.col("__plain"), F.col("__whole")
    rows = pages.withColumn("__plain", x.without_tags(F.col("full_text"))).withColumn("__whole", F.concat_ws(" ", "title_hint", plain))
    return rows.select(*pages.columns, x.normalised(plain).alias("signature"), x.entities(whole, entities).alias("entities"), starts_attachment(whole).alias("attachment"), starts_continuation(F.when(plain != "", plain).otherwise(F.col("title_hint"))).alias("continuation"), ends_closed(plain).alias("closed"), x.normalised(F.col("title_hint")).alias("title_norm"))


def _field_overlap(a: str, b: str) -> Column:
    known = lambda f: (F.coalesce(F.col(f"{a}.{f}"), F.lit("")) != "") & (F.coalesce(F.col(f"{b}.{f}"), F.lit("")) != "")
    same = lambda f: (F.col(f"{a}.{f}") == F.col(f"{b}.{f}")).cast("double")
    number = F.when(known("doc_no_norm"), same("doc_no_norm")).when(known("doc_no_prefix"), same("doc_no_prefix"))
    tests = F.array_compact(F.array(number, *(F.when(known(f), same(f)) for f in ("responsible_norm", "date_norm"))))
    return F.when(F.size(tests) > 0, x.rounded(F.aggregate(tests, F.lit(0.0), lambda s, v: s + v) / F.size(tests))).otherwise(0.0)


def scored(pages: DataFrame, exact_title: bool = False) -> DataFrame:
    """G-03 (A.1): one row for each two neighbours of a sequence, with score, merge, ambiguous and strong_split.

    pages: the columns of prepared(), and optionally visual (similarity to the page before), bias (A.2), doc_no_norm,
    doc_no_prefix, responsible_norm and date_norm. exact_title puts equality in place of the matching-blocks ratio.
    """
    for c, kind in (("visual", "double"), ("bias", "double"), ("doc_no_norm", "string"), ("doc_no_prefix", "string"), ("responsible_norm", "string"), ("date_norm", "string")):
        if c not in pages.columns:
            pages = pages.withColumn(c, F.lit(None).cast(kind))
    w = Window.partitionBy("batch_id", "prefix").orderBy("r.page_no", "r.id")
    # grams are made once a page, not once as left and once as right
    pages = pages.withColumn("grams", x.grams(F.left("signature", F.lit(COMPARED))))
    row = F.struct("page_no", "id", "grams", "entities", "attachment", "continuation", "closed", "title_norm", "family", "visual", "bias", "doc_no_norm", "doc_no_prefix", "responsible_norm", "date_norm")
    p = pages.select("batch_id", "prefix", row.alias("r")).withColumn("l", F.lag("r").over(w)).filter("l is not null")
    gap = F.greatest(F.lit(1), F.col("r.page_no") - F.col("l.page_no"))
    title = F.when((F.col("l.title_norm") == "") | (F.col("r.title_norm") == ""), 0.0)
    title = title.otherwise((F.col("l.title_norm") == F.col("r.title_norm")).cast("double")) if exact_title else x.rounded(gestalt(F.col("l.title_norm"), F.col("r.title_norm")))
    p = p.select("batch_id", "prefix", "l", "r", gap.alias("gap"), F.coalesce("r.visual", F.lit(0.5)).alias("v"), F.coalesce(x.jaccard(F.col("l.grams"), F.col("r.grams")), F.lit(0.0)).alias("t"), title.alias("h"), F.coalesce(x.jaccard(F.col("l.entities"), F.col("r.entities")), F.lit(0.0)).alias("e"), _field_overlap("l", "r").alias("f"))
    fl, fr = F.coalesce("l.family", F.lit("")), F.coalesce("r.family", F.lit(""))
    same = (fl != "") & (fl == fr)
    cont, near, att = same & fl.isin(*CONTINUING), F.col("gap") == 1, F.col("r.attachment")
    v, t, h, e, f = map(F.col, "vthef")
    weak = (t <= 0.05) & (h <= 0.05) & (e <= 0.05) & (f <= 0.05)
    ends = att & F.col("l.closed")
    when = lambda test, value: F.when(test, value).otherwise(0.0)
    score = v * 0.30 + t * 0.18 + h * 0.12 + e * 0.16 + f * 0.12 + when(same, 0.08) + when(cont, 0.18) + when(e >= 0.25, 0.10)
    score = score + when(near & (v >= 0.92) & ~att, F.when(weak, 0.46).otherwise(0.10)) + when(F.col("l.continuation") | F.col("r.continuation"), 0.16)
    score = score + F.when(h >= 0.62, 0.06).when(cont & near & (h >= 0.15), 0.08).otherwise(0.0) + when(cont & near & ~att, 0.18)
    score = score - when(~near, F.least(F.lit(0.24), (F.col("gap") - 1) * 0.12)) - when((fl != "") & (fr != "") & (fl != fr), 0.22) - when(ends, 0.32) - when(att & ~same, 0.18)
    score = score - when((v <= 0.18) & (e <= 0.05) & (t <= 0.05) & ~(cont & near), 0.12) + F.coalesce("r.bias", F.lit(0.0))
    out = p.select("batch_id", "prefix", F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), F.col("l.page_no").alias("left_page"), F.col("r.page_no").alias("right_page"), fl.alias("left_family"), fr.alias("right_family"), x.rounded(F.greatest(F.lit(0.02), F.least(F.lit(0.98), score))).alias("score"), ends.alias("ends"))
    return out.withColumn("strong_split", (F.col("score") <= SPLIT) | F.col("ends")).drop("ends").withColumn("merge", F.col("score") >= MERGE).withColumn("ambiguous", F.col("score").between(AMBIGUOUS, MERGE) & ~F.col("merge"))


def with_bias(pages: DataFrame, priors: DataFrame) -> DataFrame:
    """G-04 (A.2): adds bias to the pages of a sequence: what feedback says of the change from the page before to this one.

    priors: kind, left_family, right_family, page_gap, bias, as rollups.with_bias gives them; few rows, one a family and gap.
    """
    w = Window.partitionBy("batch_id", "prefix").orderBy("page_no", "id")
    gap = F.greatest(F.lit(1), F.col("page_no") - F.lag("page_no").over(w)).cast("long")
    rows = pages.withColumn("__gap", gap).withColumn("__left", F.lag(F.coalesce("family", F.lit(""))).over(w))
    right = F.coalesce("family", F.lit(""))
    kind = F.when((F.col("__left") != "") & (F.col("__left") == right), "family").when((F.col("__left") != "") & (right != ""), "transition")
    own = priors.filter("kind <> 'gap'").select(F.col("kind").alias("__kind"), F.col("left_family").alias("__left"), F.col("right_family").alias("__right"), F.col("page_gap").cast("long").alias("__gap"), F.col("bias").alias("__own"))
    any_ = priors.filter("kind = 'gap'").select(F.col("page_gap").cast("long").alias("__gap"), F.col("bias").alias("__any"))
    rows = rows.withColumn("__kind", kind).withColumn("__right", right).join(own, ["__kind", "__left", "__right", "__gap"], "left").join(any_, "__gap", "left")
    total = F.coalesce("__own", F.lit(0.0)) + F.coalesce("__any", F.lit(0.0))
    out = rows.withColumn("bias", F.when(F.col("__gap").isNotNull(), F.round(F.greatest(F.lit(-BIAS), F.least(F.lit(BIAS), total)), 4)))
    return out.drop("__gap", "__left", "__right", "__kind", "__own", "__any")


def decided(decisions: DataFrame) -> DataFrame:
    """G-05: the scores after smoothing (W-02), with merge and ambiguous made anew from them."""
    rows = smoothed(decisions, ["batch_id", "prefix"], "left_page")
    rows = rows.withColumn("score", F.col("smoothed")).drop("smoothed")
    return rows.withColumn("merge", F.col("score") >= MERGE).withColumn("ambiguous", F.col("score").between(AMBIGUOUS, MERGE) & ~F.col("merge"))


def gains(pages: list[dict]) -> list[list[float]]:
    """A.4: gain[end][k] of the segment of k + 1 pages that ends at `end`. A page's score is that with the page before."""
    out = []
    for end, last in enumerate(pages):
        row, inner, minus, steps, families = [0.0], 0.0, 0.0, True, [last["family"]] if last["family"] else []
        for start in range(end - 1, max(-1, end - LONGEST), -1):
            after = pages[start + 1]
            inner += after["score"] - BASELINE
            minus += 0.32 * after["strong_split"] + 0.35 * (after["attachment"] and pages[start]["closed"])
            steps = steps and after["page_no"] - pages[start]["page_no"] == 1
            families += [pages[start]["family"]] if pages[start]["family"] else []
            gain = inner - minus + 0.05 * steps
            if len(families) >= 2:
                if len(set(families)) > 1:
                    gain -= 0.18
                elif families[0] in CONTINUING:
                    gain += min(0.30, 0.05 * (end - start))
            if set(pages[start]["entities"]) & set(last["entities"]):
                gain += 0.08
            row.append(round(gain, 4))
        out.append(row)
    return out


def best_cuts(pages: list[dict]) -> list[int]:
    """The segment number of each page, from 1, for the largest sum of gains; of equal sums the longest last segment."""
    table, best, begin = gains(pages), [0.0], [0]
    for end in range(1, len(pages) + 1):
        options = table[end - 1]
        k = max(range(len(options)), key=lambda k: (best[end - 1 - k] + options[k], k))
        best.append(best[end - 1 - k] + options[k])
        begin.append(end - 1 - k)
    starts, at = [], len(pages)
    while at > 0:
        at = begin[at]
        starts.append(at)
    marks, out = set(starts), []
    for i in range(len(pages)):
        out.append((out[-1] if out else 0) + (i in marks))
    return out


def segmented(pages: DataFrame, decisions: DataFrame) -> DataFrame:
    """G-02: the best segmentation of every sequence; (batch_id, prefix, id, page_no, segment).

    One call per sequence, with a step a page and LONGEST segments a step.
    """
    rows = pages.join(decisions.select("batch_id", "prefix", F.col("right_id").alias("id"), "score", "strong_split").hint("merge"), ["batch_id", "prefix", "id"], "left")
    rows = rows.select("batch_id", "prefix", "id", "page_no", F.coalesce("family", F.lit("")).alias("family"), "entities", "attachment", "closed", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("strong_split", F.lit(False)).alias("strong_split"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_no", "id"])
        return pdf[["batch_id", "prefix", "id", "page_no"]].assign(segment=best_cuts(pdf.to_dict("records")))

    return rows.groupBy("batch_id", "prefix").applyInPandas(cut, "batch_id string, prefix string, id long, page_no long, segment long")


def groups(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """G-05, A-21, A-29, W-04: one row per segment: bounds, pages, mean inner score (1.0 for one page), running number."""
    inner = segments.alias("s").join(decisions.alias("d").hint("merge"), (F.col("s.id") == F.col("d.right_id")) & (F.col("s.batch_id") == F.col("d.batch_id")), "left")
    first = F.row_number().over(Window.partitionBy("batch_id", "prefix", "segment").orderBy("page_no", "id")) == 1
    rows = inner.select("s.*", "d.score").withColumn("score", F.when(~first, F.col("score")))
    out = rows.groupBy("batch_id", "prefix", "segment").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count("*").alias("pages"), F.round(F.coalesce(F.avg("score"), F.lit(1.0)), 4).alias("confidence"))
    return out.withColumn("group_no", F.row_number().over(Window.partitionBy("batch_id").orderBy("prefix", "first_page")).cast("long"))
