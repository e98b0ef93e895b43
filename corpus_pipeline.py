"""From raw documents to packed training sequences: each stage is written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from archivolt.llm import line_dedup, ngram_join, packing, secrets, toxicity
from archivolt.llm.common import shared_dir

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("secret scan", secrets.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the network nor the tokenizer; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{home}/{k}")
            out = spark.read.schema(out.schema).parquet(f"{home}/{k}")
        docs = out
    return docs
