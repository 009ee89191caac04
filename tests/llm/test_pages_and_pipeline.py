"""The WARC round trip and the corpus pipeline."""

import io
import os
import random
import struct
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from helpers import classes, duck, odd_rows, spark_rows, table  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from spantide.llm import minhash, mixing, packing, quality, warc  # noqa: E402
from spantide.llm.common import materialise  # noqa: E402
from spantide.llm.queries import ORACLE, QUERIES  # noqa: E402
from spantide.session import scratch_path  # noqa: E402

SF = "/root/testdata/sf0.001"


def roundtrip(spark, pages, **kw):
    rows = warc.archive_rows(pages, **kw)
    manifest = materialise(warc.write_archives(rows, scratch_path(spark, "t"), archive_bytes=3000), "t")
    return warc.read_archives(manifest)


def test_warc_round_trip(spark):
    rng = random.Random(1)
    rows = [(k, f"http://h/{k}", "<p>" + rng.choice(["a", "é\r\n\r\nWARC/1.1", "longer text " * 50]) * rng.randint(0, 3)) for k in range(60)]
    rows += [(60, None, None), (61, "http://x/\r\ny", ""), (62, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit("x")).withColumn("name", F.lit(1))
    got = roundtrip(spark, pages).collect()
    texts = {i: h or "" for i, _, h in rows}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert len(got) == len(rows)
    for r in got:
        i = int(r.name)
        assert r.payload_bytes == len(texts[i].encode()) and r.payload_digest == warc.base32_sha1(texts[i].encode())
        if first[texts[i]] == i:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload).decode() == texts[i]
        else:
            assert r.record_type == "revisit" and r.refers_to == str(first[texts[i]]) and r.payload is None
    digest = roundtrip(spark, pages).select(F.col("name").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                            F.col("refers_to").cast("long").alias("refers_to"))
    assert spark_rows(digest) == duck(warc.ORACLE_SQL, pages, "pages")
    assert {r.record_type for r in roundtrip(spark, pages, min_bytes=10 ** 6).collect()} == {"response"}


def test_warc_without_ids_and_empty(spark):
    pages = spark.createDataFrame([(None, "u", "same"), (None, "v", "same"), (5, "w", "same"), (None, None, "other"), (5, "w", "same")],
                                  "page_id long, url string, html string")
    got = sorted((str(r.name), r.record_type, r.refers_to) for r in roundtrip(spark, pages).select("name", "record_type", "refers_to").collect())
    assert got == sorted([("5", "response", None)] * 2 + [("None", "revisit", "5")] * 2 + [("None", "response", None)])
    assert roundtrip(spark, pages.where("false")).count() == 0


def test_archive_format():
    records = [warc.record_bytes("response", str(k), "http://h/", warc.DATE, warc.base32_sha1(b"x" * k), b"x" * k, None) for k in range(200)]
    data = b"".join(warc.archive_bytes_of(records))
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and 0 < size <= warc.DICT_BYTES
    for chunk in (1, 17, 1 << 20):
        assert list(warc.frames(io.BytesIO(data), chunk)) == records


def test_stages_keep_the_columns(spark):
    docs = table(spark, odd_rows())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "t")
        assert docs.dtypes == table(spark, []).dtypes


def test_quality_stage_drops_rejected_documents(spark):
    docs = table(spark, odd_rows(repeated=False))
    kept = {r.doc_id: r for r in quality.stage(spark, docs, SF).collect()}
    verdict = {r.doc_id: r for r in quality.quality(docs).select("row.doc_id", "kept", "cleaned_text").collect()}
    assert set(kept) == {i for i, r in verdict.items() if r.kept}
    assert all(r.text == verdict[i].cleaned_text and r.n_chars == len(r.text) for i, r in kept.items())


def test_near_dedup_stage_keeps_one_of_each_class(spark):
    rows = odd_rows()
    kept = minhash.stage(spark, table(spark, rows), SF).collect()
    assert len(kept) == len(set(classes([t for _, t, _ in rows])))


def test_mixing_stage_repeats_documents(spark):
    docs = table(spark, odd_rows(repeated=False))
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).select("row.doc_id", "copies").collect()}
    got = mixing.stage(spark, docs, SF).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {i: n for i, n in copies.items() if n}


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    length = got.groupby("sequence_id").length
    assert len(got) and (length.cumsum() - got.length == got.offset).all() and length.sum().max() <= packing.CAPACITY
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.quality(docs).where("kept").select("row.doc_id").collect()}
    assert set(got.doc_id) <= kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "packing"]


def test_pipeline_of_nothing(spark):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "t")
    assert docs.count() == 0


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)
