"""Continuous page feed. New crawl JSONL files are picked up by Structured
Streaming; each micro-batch runs the batch pipeline (stateless, keyed by page id)
and writes a folder of its own in a parquet sink. Restarting with the same checkpoint resumes
where the previous run stopped; a batch that runs again replaces what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantide.functions.lexicon import SUPPORTED_LANGUAGES
from spantide.operators import pages as P
from spantide.operators import segment as G
from spantide.operators.entities import rule_entities
from spantide.plans import pipelines as L
from spantide.session import cut_lineage
from spantide.sources.files import CRAWL_SCHEMA


def chunk_batch(batch: DataFrame) -> DataFrame:
    """L1 on one micro-batch: record + sentence offsets per page."""
    rec = batch.select("page_id", P.main_text_tags_expr("content_html").alias("text"))
    s = G.sentences(rec, id_col="page_id")
    packed = (s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("ss"))
               .withColumnRenamed("doc_id", "page_id"))
    return rec.join(packed, "page_id", "left").select(
        "page_id", F.coalesce(F.size("ss"), F.lit(0)).cast("long").alias("n_sentences"),
        F.coalesce(F.array_join(F.transform("ss", lambda a: F.concat_ws(":", a["begin"], a["end"])), ","),
                   F.lit("")).alias("spans"))


def page_sinks(batch: DataFrame, find=rule_entities, marker: str = "?") -> dict[str, DataFrame]:
    """L1-L4 on one micro-batch of crawl rows, whose pages are parsed once: ``records`` (page, title, host,
    language, text), ``annotations`` (sentences, occurrences of the page's terms, entities), ``contacts`` and ``questions``."""
    pages = batch.withColumnRenamed("content_html", "html")
    rec = cut_lineage(pages.select("page_id", P.host_expr("url").alias("host"), P.title_expr("html").alias("title"),
                                   F.lower(F.regexp_extract("html", P.LANG_RE, 1)).alias("lang"),
                                   P.main_text_tags_expr("html").alias("text"), P.full_text_expr("html").alias("full")))
    known = rec.where(F.col("lang").isin(*SUPPORTED_LANGUAGES))
    main = rec.select(F.col("page_id").alias("doc_id"), "text")
    full = rec.select(F.col("page_id").alias("doc_id"), F.col("full").alias("text"))
    return {"records": rec.drop("full"),
            "annotations": L.term_annotations(G.sentences(known, id_col="page_id", keep=("lang",)), find),
            "contacts": L.contact_paragraphs(full),
            "questions": L.question_paragraphs(main, marker=marker)}


def run_page_feed(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, max_files_per_trigger: int = 64, **kw) -> None:
    """Every file present in ``in_dir`` through L1-L4. Each sink of a batch is a folder under the batch's
    number, so a batch that runs again after a failure replaces all that it wrote."""
    stream = spark.readStream.schema(CRAWL_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(in_dir)

    def each(batch: DataFrame, epoch: int) -> None:
        for name, rows in page_sinks(batch, **kw).items():
            rows.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={epoch}")

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_feed(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
             max_files_per_trigger: int = 64) -> None:
    """Process every file present in ``in_dir`` (availableNow) and stop."""
    stream = (spark.readStream.schema(CRAWL_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
                   .json(in_dir))

    def each(batch: DataFrame, epoch: int) -> None:
        chunk_batch(batch).write.mode("overwrite").parquet(f"{out_dir}/batch={epoch}")

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
