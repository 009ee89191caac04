"""Parquet tables of a corpus directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "pages", "labels", "conversations", "benchmark", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Plan-time schema check (the reference validates its annotation config)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; have {df.columns}")
    return df
