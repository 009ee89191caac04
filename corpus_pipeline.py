"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. The last stage returns the packed
pieces; all others return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spantide.llm import linededup, minhash, mixing, packing, quality
from spantide.llm.common import materialise

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", linededup.stage),
    ("near_dedup", minhash.stage),
    ("source_mixing", mixing.stage),
    ("packing", packing.stage),
]

# Signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
