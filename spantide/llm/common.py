"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantide.session import scratch_path

# ASCII white space (0x20 and 0x09 to 0x0D), as characters and as a regex class.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared folder and read it back.

    Cuts the lineage the way ``checkpoint`` does: the files survive the loss of an
    executor, and Spark knows their size when it plans the joins that follow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(docs: DataFrame) -> DataFrame:
    """The input rows, each packed whole into the one column ``row``.

    Columns that an operator adds stand beside ``row`` and so never clash with a
    column of the input, whatever its name.
    """
    return docs.select(F.struct("*").alias("row"))


def ascii_lower(c):
    """Lower-case A-Z and nothing else; pure ASCII takes the built-in's fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def barrier(df: DataFrame, *keep: str, **made) -> DataFrame:
    """``df`` with the columns ``made``, computed once per row.

    ``inline`` of a one-element array is a generator, through which the optimizer does
    not copy an expression into the (per element) lambdas that use it later.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def shared_file(uri: str):
    """(file system, path) of a file below the shared folder, on an executor."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):].lstrip("/").join(["/", ""])
    return fs.FileSystem.from_uri(uri)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a short list of work items to tasks by number, which adaptive execution keeps."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
