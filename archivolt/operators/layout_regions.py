"""Regions of pages that say the same twice. What stays depends on the order: a page is one row with its few regions, and Python takes many pages a call."""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.blocks import ratio
from archivolt.functions.seals import best_seal
from archivolt.functions.text import compact

# Shared parts of the smaller of two tables, with the likeness of their texts that each asks for, and of a text in a table or of two seals.
SAME_TABLE, LIKE_TABLE, NEAR_TABLE = 0.92, (0.72, 0.88), (0.58, 0.96)
COVERED, SAME_SEAL = 0.88, 0.55
PLAIN = ("text", "paragraph", "number")
HOLDS = 0.92


def _area(r) -> float:
    return max(0.0, r.x2 - r.x1) * max(0.0, r.y2 - r.y1)


def shared(a, b) -> float:
    """The shared area of two rectangles over the smaller one's; 0 without area."""
    small = min(_area(a), _area(b))
    if not small > 0:
        return 0.0
    return max(0.0, min(a.x2, b.x2) - max(a.x1, b.x1)) * max(0.0, min(a.y2, b.y2) - max(a.y1, b.y1)) / small


def _like(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else HOLDS if a in b or b in a else ratio(a, b)


def same_table(a, b) -> bool:
    """Whether two tables of a page are one: by place alone, or by place and text."""
    place = shared(a, b)
    if place >= SAME_TABLE:
        return True
    if place >= LIKE_TABLE[0] and (not a.said or not b.said or a.said in b.said or b.said in a.said or _like(a.said, b.said) >= LIKE_TABLE[1]):
        return True
    return place >= NEAR_TABLE[0] and bool(a.said and b.said) and _like(a.said, b.said) >= NEAR_TABLE[1]


def _pages(regions: DataFrame, *own: Column | str) -> DataFrame:
    """(page_id, all): the regions of each page in the order of their columns, sides that are null as none."""
    sides = (F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("x1", "y1", "x2", "y2"))
    return regions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*own, *sides))).alias("all"))


def _regions(pages: pa.Array) -> list[list[SimpleNamespace]]:
    return [[SimpleNamespace(nth=k, **r) for k, r in enumerate(page)] for page in pages.to_pylist()]


def _kept(page: list[SimpleNamespace]) -> list[int]:
    kept, tables = [], []  # tables: [region, its place among kept]
    for r in page:
        if r.type == "table":
            twin = next((t for t in tables if same_table(r, t[0])), None)
            if twin is None:
                tables.append([r, len(kept)])
                kept.append(r)
            elif r.score > twin[0].score:
                twin[0] = kept[twin[1]] = r
        elif not (r.type in PLAIN and r.bare and any(shared(r, t) >= COVERED and (not t.said or r.bare in t.said or t.said in r.bare) for t, _ in tables)):
            kept.append(r)
    return [r.nth for r in kept]


def _kept_of_pages(pages: pa.Array) -> pa.Array:
    return pa.array(map(_kept, _regions(pages)), pa.list_(pa.int32()))


def kept_regions(regions: DataFrame) -> DataFrame:
    """J-13c: (page_id, region_id, place) of the regions that stay, in their new order.

    regions: page_id, region_id (their order), type, content, x1, y1, x2, y2, said (a table's text), score (C-53). A table
    that is one with an earlier one goes, or takes its place if it tells more; a text inside a table that says the same goes.
    """
    pages = _pages(regions, "region_id", "type", compact(F.col("content")).alias("bare"), F.coalesce("said", F.lit("")).alias("said"), F.coalesce("score", F.lit(0.0)).alias("score"))
    pages = pages.withColumn("kept", F.arrow_udf(_kept_of_pages, "array<int>")("all"))
    return pages.select("page_id", F.transform("all", lambda r: r["region_id"]).alias("ids"), F.posexplode("kept").alias("place", "nth")).select("page_id", F.get("ids", F.col("nth")).alias("region_id"), "place")


def _targets(page: list[SimpleNamespace]) -> list[list[int]]:
    there, out = [], {}
    for r in page:
        twin = next((t for t in there if shared(r, t) >= SAME_SEAL), None) if r.detected else None
        if twin is None:
            there.append(r)
        out.setdefault((twin or r).nth, []).append(r.nth)
    return list(out.values())


def _targets_of_pages(pages: pa.Array) -> pa.Array:
    return pa.array(map(_targets, _regions(pages)), pa.list_(pa.list_(pa.int32())))


def merged_seals(seals: DataFrame) -> DataFrame:
    """J-13d: (page_id, region_id, content): the seals of pages with what a detector found of them, each once.

    seals: page_id, region_id (different for all seals of a page, in their order), detected (false: of the page), content,
    x1, y1, x2, y2. A detected seal goes to the first one that shares SAME_SEAL with it, detected ones before it included;
    of their texts the better one stays (C-52), in that order. Else it is a seal of its own.
    """
    pages = _pages(seals, "detected", "region_id", "content")
    bare = F.transform("all", lambda r: F.struct(*(r[c].alias(c) for c in ("detected", "x1", "y1", "x2", "y2"))))
    found = pages.withColumn("seals", F.arrow_udf(_targets_of_pages, "array<array<int>>")(bare)).select("page_id", "all", F.explode("seals").alias("of"))
    own = found.select("page_id", F.transform("of", lambda k: F.get("all", k)).alias("own"))
    return own.select("page_id", F.get("own", F.lit(0))["region_id"].alias("region_id"), best_seal(F.transform("own", lambda r: r["content"])).alias("content"))
