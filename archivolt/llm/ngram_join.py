"""Operator 4: near-duplicate documents by Jaccard similarity of word n-gram sets.

MinHash signatures are cut into bands; documents that share a band hash become candidates, and every
pair of a candidate cluster is verified on the full n-gram sets, in blocks of bounded size. Copies of a
text are one class and are compared once. The answer has one row per input row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, numbered, shingles, signed, small_batches, table, tidy
from .groups import Forest, block_pairs, candidate_clusters, components, set_overlaps

N, THRESHOLD = 5, 0.8
ROWS = 6
#: Bands for a recall of 0.999 at the threshold: 1 - (1 - 0.8^6)^24.
RECALL = 0.999
BLOCK = 512
KEYS = ("rid", "doc_id", "digest")


def band_count(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def _signer(n: int, bands: int, rows: int):
    def sign(batches):
        mul, add = _seeds(bands * rows)
        for batch in batches:
            out, has = np.zeros((batch.num_rows, bands), np.uint64), np.zeros(batch.num_rows, bool)
            for i, j, grams, of in shingles(batch.column("t"), n):
                if not len(grams):
                    continue
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                at = i + of[first]
                has[at] = True
                for b in range(bands):
                    h = np.full(len(first), np.uint64(b + 1))
                    for r in range(b * rows, b * rows + rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((grams ^ add[r]) * mul[r], first))
                    out[at, b] = h
            flat = pa.array(signed(out).ravel(), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), flat, mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEYS), lists], names=[*KEYS, "bands"])

    return sign


def _verifier(n: int, threshold: float):
    def verify(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("node").sort_values("node", ignore_index=True)
        sets = []
        for i, j, grams, of in shingles(pa.array(block["t"], pa.large_string()), n):
            cut = np.searchsorted(of, np.arange(j - i + 1))
            sets += [np.unique(grams[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        side, weight, size = block["side"].to_numpy(), block["weight"].to_numpy(), np.array([len(s) for s in sets], np.float64)
        bi, bj = int(block["bi"].iloc[0]), int(block["bj"].iloc[0])
        left, right = np.flatnonzero(side == bi), np.flatnonzero(side == bj)
        links, forest = np.zeros(len(block), np.int64), Forest(len(block))
        if len(left) and len(right):
            both = set_overlaps(sets, left, right).astype(np.float64)
            union = size[left][:, None] + size[right][None, :] - both
            hit = (both >= threshold * union - 1e-9) & (union > 0)
            if bi == bj:
                np.fill_diagonal(hit, False)
            links[left] += hit.astype(np.int64) @ weight[right]
            if bi != bj:
                links[right] += hit.astype(np.int64).T @ weight[left]
            for x in range(len(left)):
                for y in np.flatnonzero(hit[x]):
                    forest.join(int(left[x]), int(right[y]))
        node = block["node"].to_numpy()
        root = [node[forest.find(x)] for x in range(len(block))]
        return pd.DataFrame({"node": node, "links": links, "root": root})

    return verify


def _classes(base: DataFrame, n: int, threshold: float, rows: int, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows (rid, doc_id, digest, bands), and for each distinct text (digest, rid, class_id, keep, n_links).

    base: rid, doc_id, t. A text is told apart by its 128-bit digest and numbered by the first row that has it.
    keep: the row of the group that stays, with the smallest doc_id; null ids come last, ties by rid.
    """
    small_batches(base.sparkSession)
    bands = band_count(threshold, rows, recall)
    keyed = base.select("rid", "doc_id", F.unhex(F.md5(F.col("t").cast("binary"))).alias("digest"), "t")
    signs = table(keyed.mapInArrow(tidy(_signer(n, bands, rows)), f"rid long, doc_id {dict(base.dtypes)['doc_id']}, digest binary, bands array<long>"))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rid")
    classes = signs.filter("bands is not null").groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("weight"), F.first("bands").alias("bands"))
    classes = table(classes.withColumn("node", F.col("first.rid")))
    pieces = classes.select("node", F.explode("bands").alias("band"))
    found = table(candidate_clusters(pieces, block).join(classes.select("node", "weight"), "node"))
    texts = base.select(F.col("rid").alias("node"), "t").join(found.hint("merge"), "node")
    checked = table(block_pairs(texts).groupBy("cluster", "bi", "bj").applyInPandas(_verifier(n, threshold), "node long, links long, root long"))
    groups = components(checked.filter("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = classes.select("digest", "node", "first", "weight").join(groups, "node", "left").join(links, "node", "left")
    per_class = table(per_class.select("digest", "first", F.coalesce("comp", "node").alias("comp"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    lowest = per_class.groupBy("comp").agg(F.min("first").alias("of")).select("comp", F.col("of.doc_id").alias("class_id"), F.col("of.rid").alias("keep"))
    return signs, per_class.join(lowest, "comp").select("digest", F.col("first.rid").alias("rid"), "class_id", "keep", "n_links")


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of docs (doc_id, text).

    class_id: smallest doc_id of the group linked by Jaccard >= threshold over lower-cased word n-grams; null only if no
    row of the group has one. n_links: other rows linked directly, copies included. A text without words (or null) links
    with nothing and is its own class; fewer than n words make one n-gram. Rows that repeat a doc_id, or have none, count
    as rows of their own. An empty table gives no rows; other columns are not read.
    """
    base = numbered(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t")), "rid")
    signs, per_class = _classes(base, n, threshold, rows, recall, block)
    full = signs.filter("bands is not null").select("doc_id", "digest").join(per_class.select("digest", "class_id", "n_links"), "digest").select("doc_id", "class_id", "n_links")
    return full.unionByName(signs.filter("bands is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, that of the smallest doc_id (null ids come last); a row without words stays.

    Groups are made of rows, by their texts alone: rows that share a doc_id, or have none, are lost only as near copies.
    """
    rows = numbered(docs)
    base = rows.select(F.col("__rid").alias("rid"), "doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    signs, per_class = _classes(base, N, THRESHOLD, ROWS, RECALL, BLOCK)
    kept = per_class.filter("rid = keep").select(F.col("rid").alias("__rid"))
    bare = signs.filter("bands is null").select(F.col("rid").alias("__rid"))
    return rows.join(kept.unionByName(bare), "__rid", "left_semi").select(*docs.columns)
