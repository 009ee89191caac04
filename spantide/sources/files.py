"""File sources and sinks.

All readers take explicit schemas or positional columns; nothing is inferred.
Row ids are ``file path + '#' + monotonically_increasing_id`` (unique, stable for
one read) instead of a per-file row counter, which would force a whole file into
one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from spantide.operators import pages as P

CRAWL_SCHEMA = Ty.StructType([
    Ty.StructField("url", Ty.StringType()), Ty.StructField("title", Ty.StringType()),
    Ty.StructField("website", Ty.StringType()), Ty.StructField("content_html", Ty.StringType()),
    Ty.StructField("date", Ty.StringType()), Ty.StructField("page_id", Ty.LongType()),
])


def _row_id() -> F.Column:
    return F.concat(F.col("_metadata.file_path"), F.lit("#"), F.monotonically_increasing_id().cast("string"))


def read_base64_tsv(spark: SparkSession, path: str, first_col: int = 0, multi_label: bool = False,
                    stats: dict | None = None) -> DataFrame:
    """S3/S4 (+C2): headerless TSV; rows with any null dropped (``stats['rows']``, when a
    dictionary is given, observes the numbers read and dropped as the result is computed); text = base64-decoded column ``first_col``;
    label = next column, or all following columns as an array for multi-label."""
    raw = spark.read.option("sep", "\t").option("header", "false").csv(path)
    cols = raw.columns
    raw = raw.select("*", _row_id().alias("row_id"))
    if stats is not None:
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
        stats["rows"] = Observation()
        raw = raw.observe(stats["rows"], F.count("*").alias("read"), F.count_if(missing).alias("dropped"))
    kept = raw.na.drop("any", subset=cols)
    text = F.decode(F.unbase64(F.col(cols[first_col])), "UTF-8").alias("text")
    rest = cols[first_col + 1:]
    if multi_label:
        label = F.array(*[F.col(c).cast("int") for c in rest]).alias("labels")
    else:
        label = F.col(rest[0]).cast("int").alias("label")
    return kept.select("row_id", text, label)


def write_training_tsv(df: DataFrame, path: str, text_col: str = "text", label_cols=("label",),
                       orig_lang_col: str = "lang", target_lang: str | None = None) -> None:
    """One TSV row per non-empty line of each text:
    ``(orig_lang, target_lang, translation 0/1, base64(line), *labels)``."""
    tgt = F.col(orig_lang_col) if target_lang is None else F.lit(target_lang)
    x = df.select(F.col(orig_lang_col).alias("orig"), tgt.alias("target"), *label_cols,
                  F.explode(F.split(text_col, "\n", -1)).alias("line")).where(F.col("line") != "")
    x = x.select("orig", "target", (F.col("orig") != F.col("target")).cast("int").alias("translation"),
                 F.regexp_replace(F.base64(F.encode("line", "UTF-8")), r"[\r\n]", "").alias("b64"), *label_cols)
    x.write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path)


def read_split(spark: SparkSession, split_dir: str, class_names=("neg", "pos"),
               dir_prefix: str = "") -> DataFrame:
    """Class-per-directory text files; label = index of the directory name in
    ``class_names`` (``dir_prefix`` is removed from the name first, e.g. ``lang=``)."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(split_dir)
    parent = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    name = F.regexp_replace(parent, "^" + dir_prefix, "") if dir_prefix else parent
    classes = F.array(*[F.lit(c) for c in class_names])
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"),
                     (F.array_position(classes, name) - 1).cast("int").alias("label"))


def read_articles(spark: SparkSession, text_dir: str) -> DataFrame:
    """One row per file, whole content."""
    return (spark.read.option("wholetext", "true").text(text_dir)
                 .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_mixed(spark: SparkSession, path: str) -> DataFrame:
    """Files by suffix: .txt as UTF-8 text, .html/.htm through the full-text
    extractor (P4), anything else null."""
    b = spark.read.format("binaryFile").load(path)
    content = F.decode("content", "UTF-8")
    low = F.lower("path")
    text = (F.when(low.endswith(".txt"), content)
             .when(low.endswith(".html") | low.endswith(".htm"), P.full_text_expr(content)))
    return b.select("path", text.alias("text"))


def read_qa_csv(spark: SparkSession, path: str, schema: str = "idx long, question string, answer string") -> DataFrame:
    """CSV with header, quoted multi-line fields."""
    return (spark.read.schema(schema).option("header", "true").option("multiLine", "true")
                 .option("escape", '"').csv(path))


def write_qa_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Crawl JSONL (url, title, website, content_html, date)."""
    return spark.read.schema(CRAWL_SCHEMA).json(path)


def write_crawl(pages: DataFrame, path: str) -> None:
    """S2 sink: pages as crawl JSONL."""
    (pages.select("url", P.titles_expr("html").alias("title"), P.host_expr("url").alias("website"),
                  F.col("html").alias("content_html"), F.lit(None).cast("string").alias("date"), "page_id")
          .write.mode("overwrite").json(path))
