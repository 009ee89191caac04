"""Annotation sink and reader (S10, re-aimed): all annotations of one document and
type packed into one array value, and exploded back.

The reference serialises a whole annotated document into one XMI value; here the
unit is ``(doc_id, type)`` so that readers select a type by partition pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(annotations: DataFrame, name: str = "annotations") -> DataFrame:
    """``(doc_id, type, begin, end, ...)`` -> ``(doc_id, type, <name> array<struct>)``
    sorted by ``(begin, end)`` inside each document."""
    fields = [c for c in annotations.columns if c not in ("doc_id", "type")]
    order = ["begin", "end"] + [c for c in fields if c not in ("begin", "end")]
    return (annotations.groupBy("doc_id", "type")
                       .agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name)))


def write(packed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, partitioned by annotation type."""
    packed.write.mode(mode).partitionBy("type").parquet(path)


def read(spark, path: str, type_name: str | None = None, name: str = "annotations") -> DataFrame:
    """Read packed annotations back as one row per annotation (A1 order)."""
    df = spark.read.parquet(path)
    if type_name is not None:
        df = df.where(F.col("type") == type_name)
    return df.select("doc_id", "type", F.inline(name))
