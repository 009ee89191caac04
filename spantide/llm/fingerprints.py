"""Document fingerprints by consistent weighted sampling (native: DataFrame functions only).

The terms of a text are its words, weighted by their counts. For each of ``samples`` places, a
term draws r and c from a gamma distribution of shape 2 and b from [0, 1), all from hashes of
the term and the place; its weight w is cut to the step t = floor(ln w / r + b), and the term
with the smallest c / exp(r (t - b + 1)) gives the place its sample (term, t). Two texts agree in
a place with a probability equal to the generalised Jaccard similarity of their weights, the sum
of the smaller over the sum of the larger counts; ``likeness`` is the share of places in which
they agree. A sample is found as the smallest of 64-bit numbers, 32 bits of a logarithm above 32 of a
hash of (term, t), and kept as these lower 32 bits.

Plan: the order of documents comes from ids alone, range-partitioned and written; only the first
id of each range, a row per partition, is looked at across ranges. Texts are shuffled by document:
one exchange serves the join that cuts the next document's beginning and the join that brings it
to its document. Words are counted and samples taken behind that join, by the same partitioning,
in hash aggregates that need no further exchange; a word is counted in both versions at once. Logarithms
are taken only of words of a weight other than 1 and of those that a bound without logarithms does not show to be above a
cut, about ``EXPECTED`` a place; the few texts for which the cut proves too low are done again without it. Rows equal in id and text are not made distinct
(that would sort texts); their number divides the counts instead.

Defined results: a null text is empty; a text without words has empty samples, and two such texts
are alike in full (1), one of them and another text not at all (0); rows equal in id and text are
one document, each with its result; equal ids with different texts follow each other in order of
a hash of the text; null ids come last; a single document is its own next document.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantide.llm.common import materialise

SAMPLES = 64
GROUP = 4       # places of one aggregate row: with more its update runs slower, with fewer a term is looked up more often
PARTS = 4       # times the session's shuffle partitions
EXPECTED = 24   # words of one version that a cut is expected to let through to their logarithms, of each place
_BITS = 14      # of the four uniform numbers of a draw; what is left of 64 bits is the fifth


def _uniform(bits: Column, at: int, n: int = _BITS) -> Column:
    return (F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << n) - 1)) + F.lit(0.5)) * F.lit(2.0 ** -n)


def _draw(term: Column, place: Column) -> tuple[Column, Column, Column]:
    """(x, y, b) of a term in a place: r = -ln x, c = -ln y, and b."""
    bits = F.xxhash64(term, place)
    return (_uniform(bits, 0) * _uniform(bits, _BITS), _uniform(bits, 2 * _BITS) * _uniform(bits, 3 * _BITS),
            _uniform(bits, 4 * _BITS, 64 - 4 * _BITS))


def _upper(log_a: Column) -> Column:
    return F.floor((log_a + F.lit(100.0)) * F.lit(2.0 ** 24)) * F.lit(1 << 32)


def sample_key(term: Column, log_weight: Column, place: Column) -> Column:
    """The place's value for one weighted term, null for a null weight; the smallest over the terms gives the
    sample, its lower 32 bits. What does not depend on the weight is the same expression for every
    version of a text, and so is evaluated once."""
    x, y, b = _draw(term, place)
    r, log_c = -F.ln(x), F.ln(-F.ln(y))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + F.lit(1.0))
    low = F.lit((1 << 32) - 1)         # the term is a hash already, so that (term, t) needs no further one
    return _upper(log_a) + (term.bitwiseAND(low) + t * F.lit(0x9E3779B1)).bitwiseAND(low)


def may_reach(term: Column, place: Column, cut: Column) -> Column:
    """False only where the value c / exp(r (1 - b)) of a term of weight 1 is above ``cut``, without a logarithm:
    -ln y >= 2 (1 - y) / (1 + y), and x ** (1 - b) >= x / (1 - b + b x), the harmonic mean of x and 1."""
    x, y, b = _draw(term, place)
    return F.lit(2.0) * (F.lit(1.0) - y) * x <= cut * ((F.lit(1.0) + y) * (F.lit(1.0) - b + b * x))


def cut_key(term: Column, log_weight: Column, place: Column, cut: Column) -> Column:
    """``sample_key``, or null for a weight of 1 whose value is above ``cut``."""
    return F.when((log_weight != 0) | may_reach(term, place, cut), sample_key(term, log_weight, place))


def next_documents(ids: DataFrame) -> DataFrame:
    """(id, tk, n_chars, half, rows, next_id, next_tk, next_rows) of the distinct (id, tk, n_chars),
    with the number of rows that are equal in them and half of the characters: the next one by
    falling id (then tk), after the last the first."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = ids.groupBy("id", "tk", "n_chars").agg(F.count(F.lit(1)).alias("rows"))
    place = F.struct(F.col("id").isNotNull().alias("there"), "id", "tk", "rows")
    dealt = one.select("id", "tk", "n_chars", F.floor(F.col("n_chars") / 2).alias("half"), "rows", place.alias("place")).repartitionByRange(n, F.col("place").desc())
    dealt = materialise(dealt.withColumn("range", F.spark_partition_id()), "order")
    by_place = Window.partitionBy("range").orderBy(F.col("place").desc())
    dealt = dealt.withColumn("next", F.lead("place").over(by_place))
    heads = dealt.groupBy("range").agg(F.max("place").alias("head"))             # a row per range
    after, every = Window.orderBy("range"), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("range").alias("hrange"),
                         F.coalesce(F.lead("head").over(after), F.first("head").over(every)).alias("following"))
    nxt = F.coalesce("next", "following")
    return dealt.join(F.broadcast(heads), dealt.range == heads.hrange).select(
        "id", "tk", "n_chars", "half", "rows", nxt["id"].alias("next_id"), nxt["tk"].alias("next_tk"), nxt["rows"].alias("next_rows"))


def _key(id_col: str, tk_col: str) -> Column:
    """Id (left out if null) and text hash as one string."""
    return F.concat_ws("|", F.col(id_col).cast("string"), F.col(tk_col).cast("string"))


def edited_texts(docs: DataFrame, order: DataFrame) -> DataFrame:
    """(k, text, edited, copies), with k naming id and tk: the last half of each text replaced by as
    much of the beginning of the next document's. Rows equal in id and text come ``copies`` times
    over. The key is never null, so the joins are plain ones by k, and grouping by k afterwards needs
    no further exchange."""
    # parts small enough for the word counts of their texts to stay in memory
    n = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = docs.select(_key("id", "tk").alias("ak"), "text").repartition(n, "ak")
    o = order.select(_key("id", "tk").alias("k"), "half", (F.col("rows") * F.col("next_rows")).alias("copies"),
                     _key("next_id", "next_tk").alias("nk"))
    begin = a.join(o, F.col("ak") == F.col("nk")).select("k", "half", "copies", F.expr("substring(text, 1, cast(half AS int))").alias("begin"))
    return a.join(begin, F.col("ak") == F.col("k")).select(F.col("ak").alias("k"), "text", F.concat(
        F.expr("substring(text, 1, cast(char_length(text) - half AS int))"), "begin").alias("edited"), "copies")


def samples_of(terms: DataFrame, samples: int) -> DataFrame:
    """(k, sample, edited_sample, edited_sha256, whole) from terms (k, part, term, w0, w1): part 0 has the words with the
    logarithms of their weights in both versions, null where a version lacks the word, parts 1 to 4 the digest's quarters.

    A further column ``cut`` (one value per k; 2 or more, which cuts nothing, unless both versions have words) leaves out
    values above it. ``whole`` is true if every place of both versions has a value below the cut: nothing left out
    could have been smaller, so the samples are those of all the words."""
    # places in groups, as one aggregate of all their columns is slow; the digest's rows go with the first group only
    many = math.gcd(samples, GROUP)
    last = F.when(F.col("part") == 0, samples - many).otherwise(0)
    cut = ["cut"] if "cut" in terms.columns else []
    terms = terms.select("k", "part", "term", "w0", "w1", *cut, F.explode(F.sequence(F.lit(0), last, F.lit(many))).alias("base"))

    def key(y, n):
        args = F.col("term"), F.col(f"w{y}"), F.col("base") + n
        return cut_key(*args, F.col("cut")) if cut else sample_key(*args)
    s = terms.groupBy("k", *cut, "base").agg(*[F.min(key(y, n)).alias(f"s{y}_{n}") for n in range(many) for y in (0, 1)],
                                             *[F.max(F.when(F.col("part") == n + 1, F.col("term"))).alias(f"d{n}") for n in range(4)])

    def lower(y):
        bits = [(F.col(f"s{y}_{n}").bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int") for n in range(many)]
        return F.when(F.col(f"s{y}_0").isNull(), F.array().cast("array<int>")).otherwise(F.array(*bits)).alias(f"a{y}")
    whole = F.lit(True)
    if cut:        # 1e-6 is far above the error of the bound and of the logarithms
        below = [F.coalesce(F.col(f"s{y}_{n}") < _upper(F.ln("cut") - F.lit(1e-6)), F.lit(False)) for n in range(many) for y in (0, 1)]
        whole = (F.col("cut") >= 2) | functools.reduce(Column.__and__, below)
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"d{n}"), 16, "0") for n in range(4)]))
    s = s.select("k", "base", lower(0), lower(1), sha.alias("sha"), whole.alias("whole"))
    s = s.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("base", "a0", "a1"))).alias("g"), F.max("sha").alias("edited_sha256"),
                           F.min("whole").alias("whole"))
    return s.select("k", F.flatten("g.a0").alias("sample"), F.flatten("g.a1").alias("edited_sample"), "edited_sha256", "whole")


def terms_of(e: DataFrame) -> DataFrame:
    """(k, part, term, w0, w1, cut), as ``samples_of`` takes them, of ``edited_texts``. The smallest value of words of
    the weights w is exponential with the rate sum(w), so that a place has none below the cut with a probability of exp(-EXPECTED)."""
    # words of both versions one after the other, so that a word's draws serve both, and behind them the digest in four parts
    split = lambda c: F.split(c, r"[\x20\x09-\x0D]+", -1)
    e = e.select("k", "copies", split("text").alias("a"), split("edited").alias("b"), F.sha2("edited", 256).alias("sha"))
    parts = F.array(*[F.substring("sha", 1 + 16 * n, 16) for n in range(4)])
    v = e.select("k", "copies", F.size("a").alias("at"), F.size("b").alias("more"), F.posexplode(F.concat("a", "b", parts)).alias("i", "word"))
    kind = F.when(F.col("i") < F.col("at"), 0).when(F.col("i") < F.col("at") + F.col("more"), 1).otherwise(2 + F.col("i") - F.col("at") - F.col("more"))
    v = v.select("k", "copies", F.least("at", "more").alias("size"), "word", kind.alias("kind")).where((F.col("kind") > 1) | (F.col("word") != ""))
    v = v.select("k", "copies", "size", "kind", F.when(F.col("kind") < 2, F.xxhash64("word")).otherwise(F.conv("word", 16, -10).cast("long")).alias("x"))
    part = F.greatest(F.lit(0), F.col("kind") - 1)              # 0: a word; 1 to 4: a quarter of the digest
    terms = v.groupBy("k", "copies", "size", part.alias("part"), F.col("x").alias("term")).agg(
        F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("n1"))
    weight = lambda n: F.when((F.col("part") == 0) & (F.col(n) > 0), F.ln(F.col(n) / F.col("copies")))
    cut = F.greatest(F.lit(float(EXPECTED)) / F.col("size"), F.lit(2.0 ** -8))       # draws are too coarse for much smaller ones
    return terms.select("k", "part", "term", weight("n0").alias("w0"), weight("n1").alias("w1"), cut.alias("cut"))


def sampled(docs: DataFrame, id_col: str, text_col: str, samples: int) -> tuple[DataFrame, DataFrame]:
    """The written order of the documents (``next_documents``), and their written samples:
    (k, sample, edited_sample, edited_sha256), with k naming id and tk."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    order = materialise(next_documents(d.select("id", "tk", F.char_length("text").cast("long").alias("n_chars"))), "next")
    s = materialise(samples_of(terms_of(edited_texts(d, order)), samples), "samples")
    done, left = s.where("whole").drop("whole"), s.where("NOT whole").select("k")
    if left.isEmpty():
        return order, done
    # texts with a place without a value below their cut: once more, with all their words
    order_left = order.join(left, _key("id", "tk") == F.col("k"), "semi")
    both = order_left.select(F.explode(F.array(_key("id", "tk"), _key("next_id", "next_tk"))).alias("k"))
    e = edited_texts(d.join(both, _key("id", "tk") == F.col("k"), "semi"), order_left)
    again = materialise(samples_of(terms_of(e).drop("cut"), samples).drop("whole"), "samples-left")
    return order, done.unionByName(again)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, tk, rows, n_chars, edited_sha256, next_id, next_tk, sample, edited_sample): per distinct
    (id, text) the samples of its text and of its edited text, arrays of ``samples`` numbers, empty
    without words, and the number of rows it stands for."""
    order, s = sampled(docs, id_col, text_col, samples)
    j = order.withColumn("k", _key("id", "tk")).join(s, "k")
    return j.select("id", "tk", "rows", "n_chars", "edited_sha256", "next_id", "next_tk", "sample", "edited_sample")


def likeness(a: str, b: str) -> Column:
    """Share of places in which two samples agree."""
    same = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + coalesce(x, 0))")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(same / F.greatest(F.size(a), F.size(b)))


def as_text(sample: str) -> Column:
    """Samples as text, 16 hex digits each."""
    return F.array_join(F.transform(sample, lambda x: F.lpad(F.hex(x.cast("long") + F.lit(1 << 31)), 16, "0")), "")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    order, s = sampled(docs, "doc_id", "text", SAMPLES)
    # the narrow order fetches the next sample first, so that whole samples are shuffled once
    n = s.select(F.col("k").alias("nk"), F.col("sample").alias("next_sample"))
    o = order.select("id", "n_chars", "rows", _key("id", "tk").alias("k"), _key("next_id", "next_tk").alias("next_k"))
    j = o.join(n, F.col("next_k") == F.col("nk")).drop("next_k", "nk").join(s, "k")
    return j.select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"), "n_chars", "edited_sha256",
                    as_text("sample").alias("fingerprint"), as_text("edited_sample").alias("edited_fingerprint"),
                    likeness("sample", "edited_sample").alias("near_edited"), likeness("sample", "next_sample").alias("near_next")).drop("row")
