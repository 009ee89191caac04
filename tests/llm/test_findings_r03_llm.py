"""Tests for FINDINGS_r03 on the operators of this subpackage."""

import contextlib
import io
import math

import pytest
from pyspark.sql import functions as F

from spantide.llm import fingerprints

TERMS = "k string, part int, term long, w0 double, w1 double"


def terms(spark):
    words = [(f"d{k}", 0, 7919 * k + w, 0.0 if w % 3 else 0.7, None if w % 4 == 0 else 0.0) for k in range(5) for w in range(30)]
    digest = [(f"d{k}", n, 1000 * k + n, None, None) for k in range(6) for n in (1, 2, 3, 4)]      # d5 has no words
    return spark.createDataFrame(words + digest, TERMS)


def test_op6_samples_are_updated_in_small_steps(spark):
    """Three logarithms a place: an aggregate of 32 places has 96 of them and runs slower than 4 places each."""
    out, aqe = io.StringIO(), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(out):
            fingerprints.samples_of(terms(spark), 64).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    assert 0 < out.getvalue().count("StrictMath.log") < 50


def test_op6_samples_do_not_depend_on_groups(spark, monkeypatch):
    got = []
    for many in (16, fingerprints.GROUP):
        monkeypatch.setattr(fingerprints, "GROUP", many)
        got.append(sorted(fingerprints.samples_of(terms(spark), 16).collect(), key=lambda r: r.k))
    assert got[0] == got[1] and [len(r.sample) for r in got[0]] == [16] * 5 + [0]
    assert got[0][5].edited_sha256 == "".join(f"{5000 + n:016x}" for n in (1, 2, 3, 4))


def test_op6_most_words_need_no_logarithm(spark):
    """The bound leaves out most values above a cut, and never one below it."""
    place, cut = F.col("id") % 64, F.lit(24 / 300)
    value = fingerprints.sample_key(F.xxhash64("id"), F.lit(0.0), place)
    below = value < fingerprints._upper(F.ln(cut) - 1e-6)
    r = spark.range(200000).select(fingerprints.may_reach(F.xxhash64("id"), place, cut).alias("may"), below.alias("below"),
                                   fingerprints.cut_key(F.xxhash64("id"), F.lit(0.0), place, cut).isNull().alias("out"))
    n = r.agg(F.avg(F.col("may").cast("int")).alias("may"), F.avg(F.col("below").cast("int")).alias("below"),
              F.avg(F.col("out").cast("int")).alias("out"), F.sum((F.col("below") & F.col("out")).cast("int")).alias("lost")).first()
    assert n.lost == 0 and abs(n.below - (1 - math.exp(-24 / 300))) < 0.005
    assert n.may < 0.2 and abs(n.may + n.out - 1) < 1e-9
    log_weight = spark.range(1000).select(fingerprints.cut_key(F.xxhash64("id"), F.lit(0.7), place, F.lit(0.0)).isNull().alias("out"))
    assert log_weight.where("out").count() == 0         # weights other than 1 are never cut


def test_op6_samples_of_cut_terms_are_whole(spark):
    t = terms(spark)
    plain = {r.k: r for r in fingerprints.samples_of(t, 16).collect()}
    for cut, whole in ((3.0, 6), (0.3, None), (1e-9, 1)):
        # d5 has no words, where terms_of cuts nothing
        got = fingerprints.samples_of(t.withColumn("cut", F.when(F.col("k") == "d5", 24.0).otherwise(cut)), 16).collect()
        assert len(got) == 6 and all(r == plain[r.k] for r in got if r.whole)
        assert whole in (None, sum(r.whole for r in got))


@pytest.mark.parametrize("expected", [1, 3, 10 ** 9])
def test_op6_texts_below_no_cut_are_done_again(spark, monkeypatch, expected):
    words = [" ".join(f"w{(7 * k * i) % (40 + k)}" for i in range(20 + 3 * k)) for k in range(12)]
    rows = [(k, w) for k, w in enumerate(words)] + [(3, words[3]), (3, words[4]), (20, words[5]), (None, words[6]), (21, ""), (22, None), (23, " a "), (24, words[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda df: sorted(map(str, df.collect()))
    usual, calls = order(fingerprints.fingerprints(docs)), []
    monkeypatch.setattr(fingerprints, "EXPECTED", expected)
    monkeypatch.setattr(fingerprints, "materialise", lambda df, name, f=fingerprints.materialise: calls.append(name) or f(df, name))
    assert order(fingerprints.fingerprints(docs)) == usual and len(usual) == 19      # a row per distinct id and text
    assert ("samples-left" in calls) == (expected < 10 ** 9)
