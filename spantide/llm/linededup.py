"""Line deduplication across documents (native: DataFrame functions only).

Lines are exploded, normalised and hashed; the distinct documents of each hash are
counted; lines of at least ``min_chars`` whose hash stands in ``min_docs`` documents or
more are dropped, except in the largest document id that holds them; the rest of each
document is put together again by position.

Plan: the exploded (document, position, 128-bit key) rows are written once. Counting
first makes (key, document) distinct, hashed on both, so a line that a third of all
documents hold is spread and reaches its key as partial counts. The frequent keys join
back as a plain shuffled join, whose hot partitions adaptive execution splits. The texts
are shuffled once, to meet the positions dropped from them.

Defined results: a null or empty text is one empty line; rows with one id and one text
are one document; rows with one id and different texts count as one document for a key;
a null id is a document of its own, smaller than all others; no row is lost or added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantide.llm.common import WS_CHARS, ascii_lower, barrier, materialise, rows_of
from spantide.llm.quality import with_text

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(c):
    """A line without the white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(c, F.lit(WS_CHARS)))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, text_id, position, key) of every line whose key has ``min_chars`` code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_id"),
                    F.posexplode(F.split(text, "\n", -1)).alias("position", "line"))
    t = t.where(F.length(F.btrim("line", F.lit(WS_CHARS))) >= min_chars)
    return t.select("id", "text_id", "position", F.unhex(F.md5(line_key(F.col("line")))).alias("key"))


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(key, n_docs, keeper) of the keys in ``min_docs`` documents or more."""
    return (lines.select("key", "id").distinct().groupBy("key")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
            .where(F.col("n_docs") >= min_docs))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``row`` (the input row), ``n_lines``, ``n_dropped`` and ``kept_text``."""
    lines = materialise(line_rows(docs, id_col, text_col, min_chars), "lines")
    frequent = materialise(frequent_lines(lines, min_docs), "frequent-lines")
    drops = (lines.join(frequent, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
             .groupBy("id", "text_id").agg(F.collect_set("position").alias("dropped")))
    d = rows_of(docs)
    d = d.select("row", F.xxhash64(F.coalesce(F.col("row")[text_col], F.lit(""))).alias("tid"))
    j = d.join(drops, d.row[id_col].eqNullSafe(drops.id) & (d.tid == drops.text_id), "left")
    j = barrier(j, "row", lines=F.split(F.coalesce(F.col("row")[text_col], F.lit("")), "\n", -1),
                gone=F.coalesce("dropped", F.array().cast("array<int>")))
    kept = F.when(F.size("gone") == 0, F.coalesce(F.col("row")[text_col], F.lit(""))).otherwise(F.expr(
        "array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')"))
    return j.select("row", F.size("lines").cast("long").alias("n_lines"),
                    F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept_text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, without its dropped lines."""
    return with_text(dedup_lines(docs), docs, F.col("kept_text"))


ORACLE_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
