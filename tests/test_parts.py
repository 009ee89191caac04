"""Operators and sources that no registered query reaches, on small hand-written inputs."""

import base64
import os

import pytest
from conftest import docs_df
from pyspark.sql import functions as F
from spantide.operators import qa as Q
from spantide.operators import segment as G
from spantide.operators import spans as A
from spantide.operators import terms as T
from spantide.session import scratch_path
from spantide.sources import annotations as S10
from spantide.sources import files as S
from spantide.streaming import feed as L7

# Parsed sentences (words, parts of speech, heads relative to the token) and the
# candidate spans expected of them, in order.
PARSED = {
    1: ("Credit and mortgage account holders of the rich must submit their requests",
        "NOUN CCONJ NOUN NOUN NOUN ADP DET ADJ VERB VERB DET NOUN", "3 -1 -2 1 5 -1 1 -2 1 0 1 -2"),
    2: ("This is a test sentence the 12 test sentence 23 27",
        "DET AUX DET NOUN NOUN DET NUM NOUN NOUN NUM NUM", "1 0 2 1 -3 3 2 1 -4 1 -2"),
}
SPANS = {
    1: ["Credit", "Credit and mortgage", "Credit and mortgage", "Credit", *["mortgage"] * 4, "account", "account",
        *["Credit and mortgage account"] * 2, "holders", "holders of the rich", "Credit and mortgage account holders of the rich",
        "Credit and mortgage account holders", "requests", "requests", *["their requests"] * 2],
    2: [*["test"] * 4, "sentence", "sentence the 12 test sentence 23 27", "a test sentence the 12 test sentence 23 27",
        "a test sentence", *["test"] * 4, "sentence", "sentence 23 27", "the 12 test sentence 23 27", "the 12 test sentence"],
}


def parsed(spark):
    rows = []
    for i, (words, pos, heads) in PARSED.items():
        w, p, h = words.split(), pos.split(), [int(x) for x in heads.split()]
        toks = [(k, 0, 0, a, " ", a, b) for k, (a, b) in enumerate(zip(w, p))]
        rows.append((i, 0, "en", toks, [k + x for k, x in enumerate(h)]))
    rows.append((4, 0, "en", [], []))
    return spark.createDataFrame(rows, f"doc_id long, sent_no long, lang string, toks array<{T._TOK}>, heads array<int>")


def test_subtree_candidates(spark):
    c = T.candidate_subtrees(parsed(spark)).withColumn("t", T.span_text(F.col("span"))).orderBy("doc_id", "anchor", "variant").collect()
    assert {i: [r["t"] for r in c if r["doc_id"] == i] for i in (1, 2)} == SPANS
    assert not [r for r in c if r["doc_id"] == 4]


def test_trimming_in_the_filter_chain(spark):
    got = T.filter_terms(T.candidate_subtrees(parsed(spark)), remove_stopwords=False, trim=True).collect()
    by = {i: {r["term"] for r in got if r["doc_id"] == i} for i in (1, 2)}
    # the digits of sentence 2 fail the character test before trimming, as the order of steps has it
    assert by[2] == {"test", "sentence", "test sentence"}
    assert "requests" in by[1] and "their requests" not in by[1] and "Credit and mortgage account holders of the rich" in by[1]


def test_spans_by_type_offsets_and_zip(spark):
    ann = spark.createDataFrame([(1, "s", 5, 9), (1, "p", 0, 9), (1, "s", 0, 4)], "doc_id long, type string, begin long, end long")
    assert [(r["begin"], r["end"]) for r in A.select_type(ann, "s").collect()] == [(0, 4), (5, 9)]
    s = G.sentences(docs_df(spark, ["ab cd\n\n  ef gh"]))
    rel = spark.createDataFrame([(0, 0, 3, 5, "x"), (0, 1, 0, 2, "y")], "doc_id long, sent_no long, begin long, end long, label string")
    assert sorted((r["label"], r["begin"], r["end"]) for r in A.shift_offsets(rel, s).collect()) == [("x", 3, 5), ("y", 9, 11)]
    assert A.zip_by_ordinal(rel, s.select("doc_id", "sent_no", "text"), "sent_no").count() == 2
    with pytest.raises(Exception, match="lists differ in length"):
        A.zip_by_ordinal(rel.where("sent_no = 0"), s.select("doc_id", "sent_no", "text"), "sent_no").collect()


def test_annotations_written_and_read(spark):
    ann = spark.createDataFrame([(1, "s", 5, 9, "b"), (1, "s", 0, 4, "a"), (2, "p", 0, 9, "c")],
                                "doc_id long, type string, begin long, end long, text string")
    path = scratch_path(spark, "ann")
    S10.write(S10.pack(ann), path)
    assert sorted(map(tuple, S10.read(spark, path).select(*ann.columns).collect())) == sorted(map(tuple, ann.collect()))
    assert [(r["begin"], r["text"]) for r in S10.read(spark, path, "s").collect()] == [(0, "a"), (5, "b")]


def test_file_readers(spark):
    d = scratch_path(spark, "mixed").removeprefix("file:")
    os.makedirs(d)
    for name, text in (("a.txt", "plain ü"), ("b.html", "<p>one</p><p>two</p>"), ("c.bin", "x")):
        with open(f"{d}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    got = {r["path"].rpartition("/")[2]: r["text"] for r in S.read_mixed(spark, d).collect()}
    assert got == {"a.txt": "plain ü", "b.html": "one\n\ntwo", "c.bin": None}
    assert {r["text"] for r in S.read_articles(spark, f"{d}/a.txt").collect()} == {"plain ü"}
    t = f"{d}/rows.tsv"
    with open(t, "w") as f:
        f.write("".join(f"{base64.b64encode(x.encode()).decode()}\t{y}\n" for x, y in (("one", 1), ("two", ""), ("three", 0))))
    stats = {}
    assert sorted((r["text"], r["label"]) for r in S.read_base64_tsv(spark, t, stats=stats).collect()) == [("one", 1), ("three", 0)]
    assert stats["rows"].get == {"read": 3, "dropped": 1}


def test_correct_answer(spark):
    df = spark.createDataFrame([([("a", False), ("b", True)],)], "c array<struct<answer:string,correct:boolean>>")
    assert df.select(Q.correct_answer("c")).first()[0] == "b"


def test_feed_batches_replace_themselves(spark):
    base = scratch_path(spark, "feed")
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>one {k}.</p><p>two.</p>") for k in range(5)], "page_id long, url string, html string")
    S.write_crawl(pages, f"{base}/in")
    assert S.read_crawl(spark, f"{base}/in").count() == 5
    L7.run_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    L7.run_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")            # nothing new
    L7.run_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt-lost")       # the same batch again
    got = spark.read.parquet(f"{base}/out")
    assert sorted(r["page_id"] for r in got.collect()) == list(range(5))
    assert {r["n_sentences"] for r in got.collect()} == {2}
