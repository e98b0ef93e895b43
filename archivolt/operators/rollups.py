"""Aggregations over tasks, archive fields and feedback. Each combines before it shuffles; none gathers an unbounded group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import compact, normalised, SEPARATORS_EVALUATION
from archivolt.operators.columns import FIELDS, blank

#: Fields whose pages must agree, and the buckets of page latency in seconds.
CRITICAL = ("archive_no", "doc_no", "responsible", "date", "classification")
LATENCY = (0.25, 0.5, 1, 2, 5, 10, 20, 30, 60, 120, 300)


def normal_status(c: Column) -> Column:
    """P-08: one of pending, processing, human_review, done, failed; other words as they are, in lower case."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s.isin("", "pending", "queued"), "pending").when(s.isin("worker_accepted", "running", "processing"), "processing").when(s.isin("completed", "done"), "done").otherwise(s)


def effective_status(c: Column, payload: Column, review: Column) -> Column:
    """P-09: a task in work that waits for a person is in human_review."""
    waits = payload.isNotNull() | F.coalesce(F.lower(F.trim(review)).isin("pending_human_review", "required"), F.lit(False))
    return F.when((normal_status(c) == "processing") & waits, "human_review").otherwise(normal_status(c))


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """A-05: tasks by state; a state of no other column counts as processing."""
    s = F.coalesce(F.col(status), F.lit("pending"))
    named = {k: F.count_if(s == k) for k in ("done", "failed", "pending")}
    total = F.count(F.lit(1))
    return rows.agg(total.alias("total"), *(v.alias(f"{k}_count") for k, v in named.items()), (total - named["done"] - named["failed"] - named["pending"]).alias("processing_count"))


def latest(rows: DataFrame, by: str, time: str, key: str) -> DataFrame:
    """A-02, A-03: rows by folder, with the newest time and the row it belongs to (ties: the smallest key)."""
    first = F.min_by(key, F.struct((-F.unix_micros(F.col(time).cast("timestamp"))).alias("t"), F.col(key)))
    return rows.groupBy(by).agg(F.count("*").alias("count"), F.max(time).alias("last_time"), first.alias("latest_task_id"))


def submissions(rows: DataFrame, submission: str, name: str, key: str, time: str | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    """A-04: rows by submission, with the first value in key order that isn't blank of the name and of other columns, and the newest time.

    The latest row is that of the newest time; without a time column, of the greatest key.
    """
    first = lambda c: F.min_by(c, F.when(~blank(F.col(c)), F.col(key))).alias(c if c != name else "name")
    newest = [F.max_by(key, F.struct(time, key)).alias("latest_task_id"), F.max(time).alias("last_time")] if time else [F.max(key).alias("latest_task_id")]
    return rows.groupBy(submission).agg(F.count("*").alias("count"), *map(first, (name, *others)), *newest)


def rate(part: Column, total: Column, empty: float = 0.0) -> Column:
    return F.when(total > 0, F.round(part / total, 6)).otherwise(empty)


def calendar_rates(rows: DataFrame, day: str, good: str, last_day: str, days: int = 7) -> DataFrame:
    """A-07: the last days, those without feedback as zeros."""
    spark = rows.sparkSession
    wanted = spark.range(days).select(F.date_sub(F.to_date(F.lit(last_day)), F.col("id").cast("int")).alias("d"))
    seen = rows.filter(F.col(day).between(F.date_sub(F.to_date(F.lit(last_day)), days - 1), F.to_date(F.lit(last_day)))).groupBy(F.col(day).alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col(good)).alias("g"))
    n, g = F.coalesce("n", F.lit(0)), F.coalesce("g", F.lit(0))
    return wanted.join(seen, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("date"), n.alias("feedback_count"), g.alias("helpful_count"), rate(g, n).alias("helpful_rate"))


def priors(samples: DataFrame) -> DataFrame:
    """A-08: counts of same and different by gap, by family and gap, and by change of family and gap, in one pass.

    samples: page_gap, left_family, right_family, label. Each sample counts for its gap and, if both families are
    known, for one of the other kinds.
    """
    known = ~blank(F.col("left_family")) & ~blank(F.col("right_family"))
    none = F.lit("")
    by_gap = F.struct(F.lit("gap").alias("kind"), none.alias("left_family"), none.alias("right_family"))
    by_family = F.struct(F.when(F.col("left_family") == F.col("right_family"), "family").otherwise("transition").alias("kind"), F.col("left_family").alias("left_family"), F.col("right_family").alias("right_family"))
    kinds = F.explode(F.when(known, F.array(by_gap, by_family)).otherwise(F.array(by_gap)))
    label = F.lower(F.trim("label"))
    rows = samples.filter(label.isin("same", "different")).select(F.greatest(F.lit(1), "page_gap").alias("page_gap"), label.alias("label"), kinds.alias("k"))
    return rows.groupBy("k.kind", "k.left_family", "k.right_family", "page_gap").agg(F.count_if(F.col("label") == "same").alias("same"), F.count_if(F.col("label") == "different").alias("different"))


def bias(same: Column, different: Column, least: int, most: float) -> Column:
    """A-09: from -most to most, by the share of same; 0 for fewer than `least` samples."""
    total = same + different
    return F.when(total < least, 0.0).otherwise(F.round(F.greatest(F.lit(-most), F.least(F.lit(most), (F.try_divide(same, total) - 0.5) * 2 * most)), 4))


def with_bias(prior: DataFrame) -> DataFrame:
    """A-09 for each kind of prior, with the kind's own least sample count and bound."""
    kind, args = F.col("kind"), (F.col("same"), F.col("different"))
    return prior.withColumn("bias", F.when(kind == "family", bias(*args, 2, 0.16)).when(kind == "transition", bias(*args, 2, 0.14)).otherwise(bias(*args, 4, 0.06)))


def long_fields(docs: DataFrame, key: list[str], targets: tuple[str, ...] = ("rule", "llm")) -> DataFrame:
    """One row per document and field; column target_field of docs becomes column target."""
    items = [F.struct(F.lit(f).alias("field"), *(F.coalesce(F.col(f"{t}_{f}").cast("string"), F.lit("")).alias(t) for t in targets)) for f in FIELDS]
    return docs.select(*key, F.explode(F.array(*items)).alias("x")).select(*key, "x.*")


def merged_fields(fields: DataFrame, page_count: str) -> DataFrame:
    """G-10 (A.13): adds recommended and conflict to rows of (field, rule, llm)."""
    r, m = F.trim("rule"), F.trim("llm")
    differ = compact(r) != compact(m)
    paged = F.when(F.coalesce(F.col(page_count), F.lit(0)) != 0, F.col(page_count).cast("string")).when(r != "", r).otherwise(m)
    best = F.when(F.col("field") == "pages", paged).when(~differ & (r != ""), r).when(~differ, m).when(r == "", m).when(m == "", r).otherwise("")
    clash = F.when(F.col("field") == "pages", (m != "") & (compact(m) != compact(paged))).otherwise(differ & (r != "") & (m != ""))
    return fields.withColumn("recommended", best).withColumn("conflict", clash)


def agreement(fields: DataFrame, key: str) -> DataFrame:
    """A-32: fields on which both readers agree, white space aside."""
    same = compact(F.col("rule")) == compact(F.col("llm"))
    names = F.array_sort(F.collect_list(F.when(~same, F.col("field"))))  # eight fields at most
    return fields.groupBy(key).agg(F.count_if(same).alias("matched"), F.round(F.count_if(same) / F.count("*"), 4).alias("ratio"), F.array_join(names, ",").alias("mismatched"))


def fill_rates(fields: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """A-10 and A-11: share of filled fields of each target, and of conflicts."""
    return fields.agg(*(rate(F.count_if(~blank(F.col(t))), F.count("*")).alias(f"{t}_fill") for t in targets), F.count_if("conflict").alias("conflict_fields"), rate(F.count_if("conflict"), F.count("*")).alias("conflict_rate"))


def dominant(pairs: DataFrame, group: str, doc: str) -> DataFrame:
    """A-13: the commonest truth document of each group (ties: the smallest key), its rows and all rows."""
    sizes = pairs.filter(F.col(doc).isNotNull()).groupBy(group, doc).count()
    return sizes.groupBy(group).agg(F.min_by(doc, F.struct((-F.col("count")).alias("n"), F.col(doc))).alias("dominant_doc"), F.max("count").alias("correct"), F.sum("count").alias("total"))


def field_accuracy(fields: DataFrame, truth: DataFrame, key: str, targets: tuple[str, ...]) -> DataFrame:
    """A-14: equality with the truth, normalised, by target and field; field null is the whole of a target."""
    both = fields.join(truth, [key, "field"])
    same = lambda t: normalised(F.col(t), SEPARATORS_EVALUATION) == normalised(F.col("truth"), SEPARATORS_EVALUATION)
    items = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), same(t).alias("ok")) for t in targets))).alias("x")
    return both.select("field", items).select("field", "x.*").groupingSets([[F.col("target"), F.col("field")], [F.col("target")]], "target", "field").agg(F.count_if("ok").alias("correct"), F.count("*").alias("total"), F.round(F.count_if("ok") / F.count("*"), 6).alias("accuracy"))


def page_votes(values: DataFrame, group: str) -> DataFrame:
    """A-16: the value of each field that most pages give; then by summed and largest confidence, length, first page.

    values: group, page, field, value, confidence. A title keeps its longest spelling.
    """
    text = F.trim("value")
    rows = values.filter(text != "").withColumn("__key", compact(text)).withColumn("value", text)
    spelt = F.when(F.first("field") == "title", F.min_by("value", F.struct((-F.length("value")).alias("n"), F.col("page")))).otherwise(F.min_by("value", "page"))
    sizes = rows.groupBy(group, "field", "__key").agg(spelt.alias("value"), F.count("*").alias("n"), F.round(F.sum("confidence"), 9).alias("score"), F.max("confidence").alias("top"), F.min("page").alias("page"))
    order = F.struct("n", "score", "top", F.length("value").alias("len"), (-F.col("page")).alias("page"))
    return sizes.groupBy(group, "field").agg(F.max_by("value", order).alias("value"), F.max("n").alias("votes"))


def conflicts(values: DataFrame, group: str) -> DataFrame:
    """A-17: whether the pages of a group agree on each critical field; missing where none of them gives it."""
    said = F.nullif(compact(F.col("value")), F.lit(""))
    sizes = values.filter(F.col("field").isin(*CRITICAL)).groupBy(group, "field").agg(F.count_distinct(said).alias("n_values"))
    return sizes.withColumn("state", F.when(F.col("n_values") > 1, "conflict").when(F.col("n_values") == 1, "aligned").otherwise("missing"))


def page_quality(pages: DataFrame, group: str) -> DataFrame:
    """A-18, A-28: confidence and retries of a group's pages; a null confidence is 0."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return pages.groupBy(group).agg(F.count("*").alias("page_count"), F.round(F.avg(c), 4).alias("average"), F.min(c).alias("lowest"), F.max(c).alias("highest"), F.count_if(F.col("retries") > 0).alias("with_retry"), F.max("retries").alias("max_retry"))


def merged_usage(rows: DataFrame, group: str, usage: str) -> DataFrame:
    """A-20: numeric entries of maps, summed by group and name."""
    return rows.select(group, F.explode(usage).alias("name", "value")).groupBy(group, "name").agg(F.sum("value").alias("value"))


def thresholds(rows: DataFrame, prefix: str, distance: str, least: int = 8, most: int = 18) -> DataFrame:
    """A-24: a threshold for each sequence from its sorted page distances; A-25 averages them.

    Distances are counted by value first, so a sequence needs one row for each of its distinct distances.
    """
    w = Window.partitionBy(prefix).orderBy(distance)
    sizes = rows.filter(F.col(distance).isNotNull()).groupBy(prefix, distance).count().withColumn("gap", F.lead(distance).over(w) - F.col(distance))
    wide = F.min_by(F.struct(F.col(distance).alias("at"), "gap"), F.struct((-F.coalesce("gap", F.lit(-1))).alias("g"), F.col(distance)))
    n, x = F.sum("count"), F.sum(F.col("count") * F.col(distance))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("count") * F.col(distance) * F.col(distance)) / n - (x / n) * (x / n)))
    facts = sizes.groupBy(prefix).agg(n.alias("n"), F.min(distance).alias("one"), wide.alias("wide"), spread.alias("spread"), F.percentile(distance, F.lit(0.5), F.col("count")).alias("median"))
    mid = F.bround(F.col("wide.at") + F.col("wide.gap") / 2.0, 0)
    guess = F.when(F.col("n") == 1, F.col("one") + 2).when(F.col("wide.gap") >= 3, mid).otherwise(F.bround(F.col("median") + F.greatest(F.lit(2.0), F.col("spread") * 1.25), 0))
    return facts.select(prefix, F.greatest(F.lit(least), F.least(F.lit(most), guess)).cast("long").alias("threshold"))


def submissions_of_day(rows: DataFrame, user: str, time: str, submission: str, hours: int = 8) -> DataFrame:
    """A-26: distinct submissions of a user on a local day."""
    return rows.groupBy(user, F.to_date(F.col(time) + F.expr(f"INTERVAL {hours} HOURS")).alias("day")).agg(F.count_distinct(submission).alias("submissions"))


def latency_histogram(rows: DataFrame, label: str, seconds: str) -> DataFrame:
    """K-10, R-09: observations up to each bucket's bound, by label; the last bucket has no bound."""
    counts = [F.count_if(F.col(seconds) <= b).alias(f"le_{b}".replace(".", "_")) for b in LATENCY]
    return rows.groupBy(label).agg(*counts, F.count("*").alias("total"), F.round(F.sum(seconds), 2).alias("seconds"))


def over_limit(rows: DataFrame, client: str, time: str, limit: int, seconds: int = 60) -> DataFrame:
    """R-05: requests in each fixed window of a client, and how many are refused."""
    w = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)
    return rows.groupBy(client, w.alias("window_no")).agg(F.count("*").alias("requests")).withColumn("refused", F.greatest(F.lit(0), F.col("requests") - limit))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """U-06, U-09: rows of frames whose columns differ; absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merged_entries(rows: DataFrame, group: str, usage: str, order: str) -> DataFrame:
    """A-20 for maps of texts: numbers summed by group and name, of other entries the first one by `order`."""
    each = rows.select(group, order, F.explode(usage).alias("name", "value")).withColumn("number", F.expr("try_cast(value AS double)"))
    sums = each.groupBy(group, "name").agg(F.sum("number").alias("total"), F.min_by("value", F.when(F.col("number").isNull() & F.col("value").isNotNull(), F.col(order))).alias("first"))
    return sums.select(group, "name", F.col("total").alias("number"), F.when(F.col("total").isNull(), F.col("first")).alias("text"))
