import random

from pyspark.sql import functions as F

from spantide.operators import match as D
from spantide.operators import segment as G
from spantide.operators import terms as T

WORDS = ["solar", "panel", "Grid", "the", "der", "und", "of", "3", "x-ray", "don't", "é", ",", ".", "ab", "will", "Wien", " ", "very"]


def sentences(spark, n=60):
    rnd = random.Random(5)
    rows = [(i // 2, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([1, 3, 30, 700]))) + "\n" + rnd.choice(WORDS), rnd.choice(["en", "de"])) for i in range(0, n, 2)]
    return G.sentences(spark.createDataFrame(rows, "doc_id long, text string, lang string"), keep=("lang",))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_token_is_sorted_or_shuffled(spark):
    """What is sorted are a document's lines; tokens and candidates are neither sorted nor moved."""
    lists = T.token_lists(sentences(spark))
    for df in (T.tokens(sentences(spark)), T.filter_terms(T.candidate_runs(lists), remove_stopwords=False, trim=False), T.filter_terms(T.candidate_runs(lists), trim=False)):
        p = plan(df)
        assert p.count("Exchange hashpartitioning") == 1 and p.count("Sort [") == 1, p


def test_word_filters_make_terms_once(spark):
    """a term's words are looked up beside it; the terms are not made a second time to be joined with."""
    lists = T.token_lists(sentences(spark))
    terms = T.filter_terms(T.candidate_runs(lists), trim=False)
    wrong = spark.createDataFrame([("en", "solar")], "lang string, word string")
    assert plan(T.known_word_terms(terms, lists)).count("Generate inline(") == 1
    assert plan(T.spelled_terms(terms, wrong)).count("Generate inline(") == 1


def test_tokens_give_their_place(spark):
    s = sentences(spark)
    got = T.tokens(s)
    joined = s.withColumnRenamed("text", "sent").withColumnRenamed("begin", "sb").select("doc_id", "sent_no", "sb", "sent").join(got, ["doc_id", "sent_no"])
    assert joined.where(F.expr("substring(sent, begin - sb + 1, end - begin) != text")).count() == 0
    w = got.groupBy("doc_id", "sent_no").agg(F.array_sort(F.collect_list(F.struct("tok_no", "text", "ws_after"))).alias("t"))
    back = w.select("doc_id", "sent_no", F.array_join(F.transform("t", lambda t: F.concat(t["text"], t["ws_after"])), "").alias("again")).join(s, ["doc_id", "sent_no"])
    assert back.where("again != text").count() == 0 and back.count() == s.count()


def test_candidates_against_all_four_spans(spark):
    s = sentences(spark)
    toks, want = T.tokens(s).collect(), {}
    by = {}
    for r in sorted(toks, key=lambda r: (r.doc_id, r.sent_no, r.tok_no)):
        by.setdefault((r.doc_id, r.sent_no), []).append(r)
    for (doc, no), ts in by.items():
        for i, t in enumerate(ts):
            if t.pos not in ("NOUN", "PROPN"):
                continue
            lo = hi = i
            while lo and ts[lo - 1].pos not in T.RUN_BREAK:
                lo -= 1
            while hi + 1 < len(ts) and ts[hi + 1].pos not in T.RUN_BREAK:
                hi += 1
            for v, (a, b) in enumerate([(i, i), (i, hi), (lo, hi), (lo, i)]):
                if b - a < 10:
                    term = "".join(x.text + x.ws_after for x in ts[a:b]) + ts[b].text
                    at = (no, i, v, " ".join(x.lemma for x in ts[a:b + 1]), b - a + 1)
                    if (doc, term) not in want or at < want[doc, term]:
                        want[doc, term] = at
    for lists in (T.token_lists(s), T.tokens(s)):
        got = T.distinct_first_terms(T.candidate_runs(lists)).collect()
        assert len(got) == len(want)
        assert {(r.doc_id, r.term): (r.sent_no, r.anchor, r.variant, r.lemma, r.n_tokens) for r in got} == want


def test_matcher_sorts_no_pieces(spark):
    """the starts of dictionary terms are found inside the sentence's row; with one dictionary
    for all sentences a sentence is not joined with its own starts."""
    sents = spark.createDataFrame([(1, 0, 0, "a solar panel")], "doc_id long, sent_no long, begin long, text string")
    terms = spark.createDataFrame([("solar panel", "solar panel")], "term string, lemma string")
    found = D.match_terms(sents, terms)
    assert [(r.begin, r.end) for r in found.collect()] == [(2, 13)]
    assert plan(found).count("Window") == 0 and plan(found).count("Join") <= 2
    own = terms.select(F.lit(1).cast("long").alias("doc_id"), "*")
    assert "Window" not in plan(D.match_terms(sents, own, per_document=True))
