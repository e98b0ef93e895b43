"""Which candidates of a batch are one document: the candidate pairs that a rule can decide, the rule ladder, and the merge.

A rule says yes, or asks, only for two that are near in the batch's order, near in a page sequence or a file series, share a
document number, a boundary group or a title with its date or party, or have titles that are alike. Pairs that may be asked are
made in full. What shares a number, a group, or a title and date is one by the rule itself, so each meets only the first and the
last of its key: yes-links connect.

Rows of a batch meet by sorted keys (hint "merge"): a written table of them is so small by its files' bytes that Spark would
send its rows, many times as many bytes, through the driver to all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.blocks import gestalt
from archivolt.functions.text import once
from archivolt.operators.graph import _written as written
from archivolt.operators.graph import components
from archivolt.operators.listing import candidate_order

# Similarities and confidences of the ladder, distances, and families whose pages continue over layouts.
TITLE_STRONG, TITLE_HINT, TITLE_FAR, FILENAME_HINT = 0.97, 0.62, 0.35, 0.78
ACCEPT, ACCEPT_ADJACENT, ACCEPT_SERIES = 0.90, 0.82, 0.84
SERIES_DISTANCE, NEAR_DISTANCE = 2, 1
# Likeness of titles, and of file names beside them, from which on two that are not near are asked about.
ALIKE, ALIKE_FILES = 0.9, 0.7
MULTI_LAYOUT = ("budget", "contract", "minutes")
COLUMNS = ("id", "idx", "doc_no_norm", "doc_no_prefix", "title_norm", "filename_norm", "date_norm", "responsible_norm", "series_key", "sequence", "visual_prefix", "visual_page_no", "family", "boundary_group", "boundary_confidence")


def indexed(candidates: DataFrame) -> DataFrame:
    """W-10, T-07: candidates numbered from 1 in the batch's order."""
    w = Window.partitionBy("batch_id").orderBy(*candidate_order("visual_page_no", "sequence", "created_at", "id"))
    return candidates.withColumn("idx", F.row_number().over(w).cast("long"))


def _known(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.coalesce(F.col(n).cast("string"), F.lit("")) != "")
    return out


def title_keys(title: Column) -> Column:
    """Keys of which two titles of a ratio of ALIKE or more share one: the first of their pairs of characters in the order of a hash.

    Such titles are 0.1 of both lengths apart at most, an edit changes two pairs, so they share at least 0.6 of a title's
    length less one of its pairs; the rest and one more are enough to meet. A title of one character is its own key.
    """
    n = F.length(title)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.substring(title, i, F.lit(2)))
    count = lambda own: F.transform(own, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(own, F.lit(1), i), lambda h: h == g)).cast("string")))
    ranked = F.array_sort(F.transform(once(grams, count), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    most = n - 1 - F.greatest(F.lit(1), F.ceil(n * (2 * ALIKE - 1.2) - 1).cast("int")) + 1
    return F.transform(F.slice(ranked, F.lit(1), F.greatest(F.lit(1), most)), lambda x: x["g"])


def _within(rows: DataFrame, kind: str, test: Column, number: str, far: int, *parts: str) -> tuple[DataFrame, DataFrame]:
    """Two sides whose keys meet if parts are equal and the numbers are at most `far` apart."""
    key = lambda n: F.concat_ws("\x1f", F.lit(kind), *(F.col(f"r.{p}").cast("string") for p in parts), n.cast("string"))
    own = rows.filter(test)
    moved = own.select("batch_id", F.col("r").alias("o"), F.explode(F.array(*(F.lit(d) for d in range(-far, far + 1)))).alias("d"))
    moved = moved.select("batch_id", "o", F.concat_ws("\x1f", F.lit(kind), *(F.col(f"o.{p}").cast("string") for p in parts), (F.col(f"o.{number}") + F.col("d")).cast("string")).alias("key"))
    return own.select("batch_id", "r", key(F.col(f"r.{number}")).alias("key")), moved


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    """J-06: (batch_id, l, r): the pairs, l before r, that a rule may link or ask about; l and r are structs of COLUMNS.

    Left out are pairs that every rule refuses, and yes-pairs whose two are linked through the first or last of their key.
    A row whose file series lies within SERIES_DISTANCE of both of these, with other numbers, is asked about and not linked.
    """
    known = lambda *names: reduce(lambda a, n: a & (F.coalesce(F.col(f"r.{n}").cast("string"), F.lit("")) != ""), names, F.lit(True))
    rows = candidates.select("batch_id", F.struct(*COLUMNS).alias("r"))
    near = [
        _within(rows, "near", F.lit(True), "idx", SERIES_DISTANCE), _within(rows, "pages", known("visual_prefix", "visual_page_no"), "visual_page_no", SERIES_DISTANCE, "visual_prefix"),
        _within(rows, "series", known("series_key", "sequence"), "sequence", SERIES_DISTANCE, "series_key"),
    ]
    left, right = (reduce(DataFrame.unionByName, side) for side in zip(*near))
    found = left.join(right.hint("merge"), ["batch_id", "key"]).filter(F.col("r.idx") > F.col("o.idx")).select("batch_id", F.col("o").alias("l"), "r")

    key = lambda kind, *parts: F.when(known(*parts), F.concat_ws("\x1f", F.lit(kind), *(F.col(f"r.{p}") for p in parts)))
    keys = F.array_compact(F.array(key("group", "boundary_group"), key("doc", "doc_no_norm"), key("date", "title_norm", "date_norm"), key("party", "title_norm", "responsible_norm")))
    held = rows.select("batch_id", "r", F.explode(keys).alias("key"))
    # two numbers refuse what a title and date would link, so titles are held by rows without a number
    holds = F.col("key").rlike("^(?:group|doc)\x1f") | ~known("doc_no_norm")
    ends = written(held.filter(holds).groupBy("batch_id", "key").agg(F.min_by("r", "r.idx").alias("a"), F.max_by("r", "r.idx").alias("b")))
    held = held.join(ends.hint("merge"), ["batch_id", "key"]).select("batch_id", "r", F.explode(F.array("a", "b")).alias("o")).filter(F.col("o.id") != F.col("r.id"))
    swap = F.col("o.idx") < F.col("r.idx")
    found = found.unionByName(held.select("batch_id", F.when(swap, F.col("o")).otherwise(F.col("r")).alias("l"), F.when(swap, F.col("r")).otherwise(F.col("o")).alias("r")))

    titled = rows.filter(known("title_norm")).withColumn("keys", title_keys(F.col("r.title_norm"))).select("batch_id", "r", "keys", F.explode("keys").alias("key"))
    others = titled.select("batch_id", F.col("r").alias("o"), F.col("keys").alias("o_keys"), "key")
    share = lambda name: (F.col(f"r.{name}") == F.col(f"o.{name}")) & (F.coalesce(F.col(f"r.{name}"), F.lit("")) != "")
    sizes = lambda name, least: 2 * F.least(F.length(f"r.{name}"), F.length(f"o.{name}")) >= least * (F.length(f"r.{name}") + F.length(f"o.{name}")) - 1e-9
    same = F.coalesce(share("date_norm") | share("responsible_norm"), F.lit(False))
    # two meet at the first of the keys they share, so that no pair is made twice and none is looked for among all
    first = F.get(F.array_intersect("keys", "o_keys"), F.lit(0)) == F.col("key")
    alike = titled.join(others.hint("merge"), ["batch_id", "key"]).filter((F.col("r.idx") > F.col("o.idx")) & sizes("title_norm", ALIKE) & (same | F.coalesce(sizes("filename_norm", ALIKE_FILES), F.lit(False))) & first)
    equal = F.col("r.title_norm") == F.col("o.title_norm")
    alike = alike.filter(~(equal & same)).select("batch_id", F.col("o").alias("l"), "r")
    alike = alike.filter(F.when(F.col("l.title_norm") == F.col("r.title_norm"), True).otherwise(gestalt(F.col("l.title_norm"), F.col("r.title_norm")) >= ALIKE))
    pairs = found.unionByName(alike).withColumn("__l", F.col("l.idx")).withColumn("__r", F.col("r.idx"))
    return pairs.dropDuplicates(["batch_id", "__l", "__r"]).select("batch_id", "l", "r")


def _same(name: str) -> Column:
    a, b = F.coalesce(F.col(f"l.{name}"), F.lit("")), F.coalesce(F.col(f"r.{name}"), F.lit(""))
    return (a != "") & (a == b)


def _differ(name: str) -> Column:
    a, b = F.coalesce(F.col(f"l.{name}"), F.lit("")), F.coalesce(F.col(f"r.{name}"), F.lit(""))
    return (a != "") & (b != "") & (a != b)


def _gap(name: str) -> Column:
    return F.abs(F.col(f"l.{name}") - F.col(f"r.{name}"))


def between(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """J-08: adds `between`: whether the batch has a page of the same sequence strictly between the two.

    Pages of a sequence are numbered in order; there is one between if the two numbers are farther apart than one.
    """
    w = Window.partitionBy("batch_id", "visual_prefix").orderBy("visual_page_no")
    ranks = candidates.filter(_known("visual_prefix", "visual_page_no")).select("batch_id", "id", F.dense_rank().over(w).alias("rank"))
    left, right = ranks.select("batch_id", F.col("id").alias("l_id"), F.col("rank").alias("l_rank")), ranks.select("batch_id", F.col("id").alias("r_id"), F.col("rank").alias("r_rank"))
    rows = pairs.withColumn("l_id", F.col("l.id")).withColumn("r_id", F.col("r.id")).join(left.hint("merge"), ["batch_id", "l_id"], "left").join(right.hint("merge"), ["batch_id", "r_id"], "left")
    found = _same("visual_prefix") & (F.abs(F.col("l_rank") - F.col("r_rank")) > 1)
    return rows.withColumn("between", F.coalesce(found, F.lit(False))).drop("l_id", "r_id", "l_rank", "r_rank")


def decided(pairs: DataFrame, title: Column, filename: Column) -> DataFrame:
    """G-06, G-07 (A.5): adds decision (yes, no, undecided), confidence, ask (whether a model is asked) and accept (from which confidence on).

    title, filename: similarities of the two, 0 where either is blank. The first rule that holds decides. Pairs may have
    pair_score and pair_ambiguous, what the boundaries say of two neighbouring pages.
    """
    for c, kind in (("pair_score", "double"), ("pair_ambiguous", "boolean"), ("between", "boolean")):
        if c not in pairs.columns:
            pairs = pairs.withColumn(c, F.lit(None).cast(kind))
    rows = pairs.withColumn("t", F.coalesce(title, F.lit(0.0))).withColumn("n", F.coalesce(filename, F.lit(0.0)))
    adjacent = F.coalesce(_same("visual_prefix") & (_gap("visual_page_no") <= 1), F.lit(False))
    grouped = (F.coalesce("l.boundary_group", F.lit("")) != "") & (F.coalesce("r.boundary_group", F.lit("")) != "")
    layouts = adjacent & _same("family") & F.coalesce(F.col("l.family").isin(*MULTI_LAYOUT), F.lit(False))
    series = F.coalesce(_same("series_key") & (_gap("sequence") <= SERIES_DISTANCE), F.lit(False))
    titled = (F.coalesce("l.title_norm", F.lit("")) != "") & (F.coalesce("r.title_norm", F.lit("")) != "")
    t, n = F.col("t"), F.col("n")
    hints = (t >= TITLE_HINT) | (n >= FILENAME_HINT) | _same("date_norm") | _same("responsible_norm") | _same("doc_no_prefix")
    one = lambda decision, value: F.struct(F.lit(decision).alias("decision"), (value if isinstance(value, Column) else F.lit(float(value))).alias("confidence"))
    rule = F.when(grouped & _same("boundary_group"), one("yes", F.coalesce("l.boundary_confidence", F.lit(0.92))))
    rule = rule.when(grouped & adjacent & F.coalesce("pair_ambiguous", F.lit(False)), one("undecided", F.coalesce("pair_score", F.lit(0.0))))
    rule = rule.when(grouped & adjacent & F.col("pair_score").isNotNull(), one("no", 0.0)).when(layouts, one("yes", 0.86))
    rule = rule.when(_same("doc_no_norm"), one("yes", 1.0)).when(_differ("doc_no_norm"), one("no", 0.0)).when(series, one("undecided", 0.0))
    rule = rule.when(titled & (t >= TITLE_STRONG) & _same("date_norm"), one("yes", 0.97)).when(titled & (t >= TITLE_STRONG) & _same("responsible_norm"), one("yes", 0.94))
    rule = rule.when(titled & (t <= TITLE_FAR) & _differ("date_norm"), one("no", 0.0)).when(hints, one("undecided", 0.0)).otherwise(one("no", 0.0))
    distance = F.col("r.idx") - F.col("l.idx")
    gate = F.when(F.coalesce(_same("visual_prefix") & (_gap("visual_page_no") <= SERIES_DISTANCE), F.lit(False)), True)
    gate = gate.when(_same("series_key"), F.coalesce(_gap("sequence") <= SERIES_DISTANCE, distance <= SERIES_DISTANCE))
    close = (t >= TITLE_HINT) | ((n >= FILENAME_HINT) & (_same("date_norm") | _same("responsible_norm") | _same("doc_no_prefix"))) | (_same("date_norm") & (_same("responsible_norm") | _same("doc_no_prefix")))
    far = (t >= ALIKE) & (_same("date_norm") | _same("responsible_norm") | (n >= ALIKE_FILES))
    gate = gate.otherwise(((distance <= NEAR_DISTANCE) & close) | far)
    accept = F.when(adjacent, ACCEPT_ADJACENT).when(_same("series_key") & (distance <= 1), ACCEPT_SERIES).otherwise(ACCEPT)
    rows = rows.withColumn("rule", rule)
    ask = (F.col("rule.decision") == "undecided") & ~F.coalesce("between", F.lit(False)) & gate
    return rows.select(*pairs.columns, "rule.decision", "rule.confidence", ask.alias("ask"), accept.alias("accept")).drop("t", "n")


def merged(candidates: DataFrame, decisions: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """G-08: (batch_id, id, document, members): candidates linked by a yes, or by an answer (left_id, right_id, same, confidence) from `accept` on.

    document: the smallest id of the linked ones. Boundary groups and pairs of other rules link alike.
    """
    links = decisions.filter("decision = 'yes'").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    if answers is not None:
        asked = decisions.filter("ask").select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), "accept")
        said = asked.join(answers.hint("merge"), ["left_id", "right_id"]).filter(F.col("same") & (F.col("confidence") >= F.col("accept")))
        links = links.unionByName(said.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    found = components(candidates.select("id"), links).withColumnRenamed("component", "document")
    sizes = found.groupBy("document").agg(F.count("*").alias("members"))
    return candidates.select("batch_id", "id").join(found.hint("merge"), "id").join(sizes.hint("merge"), "document").select("batch_id", "id", "document", "members")
