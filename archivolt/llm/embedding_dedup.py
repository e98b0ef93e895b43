"""Operator 7: near-duplicate embeddings by randomised-rotation binary codes.

Each unit vector o is rotated; its code is the signs, its correction factor a = <code, o>. For another
vector q, <code, q> / a estimates <o, q> without bias, and what it can be off is bounded by the parts of
code and q outside o: where cos(o, q) >= t, the estimate is at least t - sqrt((1 - a^2) / a^2) sqrt(1 - t^2).
Only pairs beyond that bound are recomputed, in double precision; no link is lost. Equal vectors are
compared once; labels are compared in pairs of bounded blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .groups import Forest, block_pairs, components

COSINE, BLOCK = 0.93, 2048


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def codes(batches):
    """Adds the packed signs and the correction factor of each vector."""
    for batch in batches:
        bits, factor = [None] * batch.num_rows, np.zeros(batch.num_rows)
        dims = batch.column("dims").to_numpy()
        flat = batch.column("v").flatten().to_numpy().astype(np.float64)
        at = np.r_[0, np.cumsum(dims)]
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            x = flat[at[rows][:, None] + np.arange(d)]
            x = (x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)) @ rotation(int(d))
            factor[rows] = np.abs(x).sum(1) / np.sqrt(d)
            for r, code in zip(rows, np.packbits(x > 0, axis=1)):
                bits[r] = code.tobytes()
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(bits, pa.binary()), pa.array(factor)], names=[*batch.schema.names, "code", "factor"])


def _verifier(least: float):
    def verify(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node", ignore_index=True)
        x = np.array(block["v"].tolist(), np.float64)
        big = np.abs(x).max(1, keepdims=True)
        x = x / big
        norm = np.linalg.norm(x, axis=1)
        d = x.shape[1]
        signs = np.unpackbits(np.array([np.frombuffer(c, np.uint8) for c in block["code"]]), axis=1, count=d).astype(np.float32) * 2 - 1
        factor = block["factor"].to_numpy()
        rotated = ((x / norm[:, None]) @ rotation(d)).astype(np.float32)
        slack = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * np.sqrt(1 - least**2)
        floor = ((least - slack) * factor * np.sqrt(d) - 1e-3).astype(np.float32)
        side, weight = block["side"].to_numpy(), block["weight"].to_numpy()
        bi, bj = int(block["bi"].iloc[0]), int(block["bj"].iloc[0])
        left, right = np.flatnonzero(side == bi), np.flatnonzero(side == bj)
        links, forest = np.zeros(len(block), np.int64), Forest(len(block))
        for lo in range(0, len(left), 256):
            rows = left[lo : lo + 256]
            a, b = np.nonzero(signs[rows] @ rotated[right].T >= floor[rows][:, None])
            for part in range(0, len(a), 1 << 18):
                i, j = rows[a[part : part + (1 << 18)]], right[b[part : part + (1 << 18)]]
                once = i < j if bi == bj else np.ones(len(i), bool)
                i, j = i[once], j[once]
                hit = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= least
                i, j = i[hit], j[hit]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                for p, q in zip(i.tolist(), j.tolist()):
                    forest.join(p, q)
        node = block["node"].to_numpy()
        return pd.DataFrame({"node": node, "links": links, "root": node[[forest.find(k) for k in range(len(block))]]})

    return verify


def near_duplicates(vectors: DataFrame, least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Vectors link if their labels are equal and not null, their sizes equal and their cosine >= least. Null,
    empty and zero vectors and those with null or non-finite components link with nothing. Rows that repeat
    a vec_id count as vectors of their own. Equal vectors count as links of each other.
    """
    v = F.col("embedding")
    fine = F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v"), "label", F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("label", "v")))
    keys = rows.select("vec_id", "node")
    distinct = rows.filter("fine").groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("v").alias("v"))
    distinct = distinct.withColumn("dims", F.size("v"))
    kind = dict(distinct.dtypes)
    stored = table(distinct.mapInArrow(codes, ", ".join(f"{c} {kind[c]}" for c in distinct.columns) + ", code binary, factor double"))
    parts = stored.groupBy("label", "dims").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("k"))
    members = stored.select("node", "weight", "label", "dims", "v", "code", "factor").join(parts, ["label", "dims"])
    dealt = block_pairs(members)
    found = table(dealt.groupBy("label", "dims", "bi", "bj").applyInPandas(_verifier(least), "node long, links long, root long"))
    comps = components(found.filter("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per = stored.select("node", "weight", "low").join(links, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = table(per.select("node", "low", "comp", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    per = per.join(per.groupBy("comp").agg(F.min("low").alias("component_id")), "comp").select("node", "n_links", "component_id")
    out = keys.join(per, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
