"""Findings of round 3: what grew faster than the input, held against plain Python or the plan."""

import hashlib

import numpy as np
from conftest import docs_df
from pyspark.sql import functions as F
from spantide.operators import choices as QC
from spantide.operators import entities as N
from spantide.operators import induction as I
from spantide.operators import linear as LR
from spantide.operators import qa as Q
from spantide.operators import spans as A
from spantide.operators import terms as T
from spantide.plans import pipelines as L


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_keyed_by_a_digest(spark):
    """no row of a piece or an entity holds its whole sentence; the sentence comes back at the end."""
    long = "word " * 300 + "7 and 8."
    seen = []

    def find(s):
        seen.append({(r["sent_no"], r["text"]) for r in s.collect()})
        return N.rule_entities(s)
    rows = QC.sentence_entities(docs_df(spark, [long + "\nOr 12 km?", None]), find).collect()
    assert seen == [{(hashlib.md5(t.encode()).hexdigest(), t) for t in (long, "Or 12 km?")}]
    assert sorted((r["sentence"], r["text"], r["sentence"][r["begin"]:r["end"]]) for r in rows) == sorted(
        [(long, "7", "7"), (long, "8", "8"), ("Or 12 km?", "12 km", "12 km")])


def test_best_sentences_keep_all_that_can_win(spark):
    """only a document's best sentences reach the ranking of whole inputs, which is the same as that of all."""
    line = " ".join(f"{'x' * (k % 7 + 1)} number{k}." for k in range(120))
    docs = docs_df(spark, [line + "\n" + "filler " * 600 + "end.\n" + line + " Is it? a <context> b.", "One. Two."])
    asked = []

    def scored(inputs):
        return inputs.withColumn("score", -F.length("answer"))
    segs = L.best_sentences(Q.segments(docs), scored, 3).collect()
    for d in (0, 1):
        asked.append(sum(len(r["answers"]) for r in segs if r["doc_id"] == d))
    assert 3 <= asked[0] <= 6 and asked[1] == 2
    x = QC.correct_answers(QC.question_inputs(docs, "all"))
    x = x.withColumn("question", Q.clean_question(L.cloze(x))).withColumn("score", F.length("question"))
    x = x.withColumn("order", F.struct("style", "qg_input", "answer", "begin"))
    want = Q.rank_pairs(x, "doc_id", "score", "order", 10).select("doc_id", "rank", "question", "answer").collect()
    got = L.generate_questions(docs).select("doc_id", "rank", "question", "answer").collect()
    assert sorted(got) == sorted(want) and len(got) == 12


def test_name_runs_sort_no_token(spark):
    """runs of names are cut out of their sentence's arrays."""
    sents = spark.createDataFrame([(1, 0, 0, "we met Anna  Maria Berg and Carl", "en"), (2, 0, 0, "Nobody", "en"), (2, 1, 9, "see Oslo", "en")],
                                  "doc_id long, sent_no long, begin long, text string, lang string")
    lists = I.name_runs(T.token_lists(sents))
    assert "Window" not in plan(lists) and "Sort" not in plan(lists)
    want = {("Anna  Maria Berg", "left", "met"), ("Anna  Maria Berg", "right", "and"), ("Carl", "left", "and"), ("Carl", "right", "^"), ("Oslo", "left", "see"), ("Oslo", "right", "^")}
    for runs in (lists, I.name_runs(T.tokens(sents))):
        assert {(r["run"], r["side"], r["context"]) for r in runs.collect()} == want


def test_texts_are_dealt_out_before_they_are_cut(spark):
    """a table in one file is not read into tokens by one task."""
    docs = docs_df(spark, ["ab cd ab cd ef", "cd ef", None]).coalesce(1)
    vocab = spark.createDataFrame([("ab cd",), ("ef",), ("zz",)], "term string")
    hits = T.vocabulary_hits(docs, vocab, 2, lowercase=False)
    assert "RepartitionByExpression" in plan(hits)
    idf = spark.createDataFrame([(f, 1.0) for f in range(8)], "f int, idf double")
    assert "RepartitionByExpression" in plan(LR.text_features(docs, "doc_id", num_features=8, idf=idf)[0])
    assert {(r["term"], r["tf"]) for r in T.term_frequency(docs, vocab, 2).collect()} == {("ab cd", 2), ("ef", 2), ("zz", 0)}


def test_gradient_against_one_row_at_a_time(spark):
    """sums by feature are counted per label."""
    rows = [([0, 2], [0.6, 0.8], [1, 0]), ([2], [1.0], [0, 1]), ([], [], [1, 1])]
    df = spark.createDataFrame(rows, "fs array<int>, xs array<double>, ys array<int>")
    w, pos = np.array([[0.1, -0.2], [0.0, 0.0], [0.3, 0.4], [-0.5, 0.25]]), np.array([2.0, 3.0])
    want = np.zeros_like(w)
    for fs, xs, ys in rows:
        m = w[-1].copy()
        for f, x in zip(fs, xs):
            m += x * w[f]
        p = 1 / (1 + np.exp(-m))
        d = np.where(np.array(ys) > 0, (p - 1) * pos, p)
        for f, x in zip(fs, xs):
            want[f] += x * d
        want[-1] += d
    got = np.zeros_like(w)
    for r in LR.gradient(df, w, pos).collect():
        got[r["f"]] = r["g"]
    assert np.allclose(got, want)


def test_context_joins_places_not_texts(spark):
    """neighbours come by their numbers; no window over the texts of all units."""
    units = spark.createDataFrame([(1, k, 10 * k, 10 * k + 5, f"u{k}") for k in range(5)] + [(2, 0, 0, 5, "only")],
                                  "doc_id long, sent_no long, begin long, end long, text string")
    spans = spark.createDataFrame([(1, 0, 0, 5, "u0"), (1, 2, 20, 35, "u2"), (1, 9, 6, 8, "gap"), (2, 0, 0, 5, "only")],
                                  "doc_id long, span_no long, begin long, end long, content string")
    both = A.add_context(spans, units)
    assert "lag(" not in plan(both) and "lead(" not in plan(both)
    assert {(r["doc_id"], r["span_no"]): r["content_context"] for r in both.collect()} == {
        (1, 0): "u0\nu1", (1, 2): "u1\nu2\nu4", (1, 9): None, (2, 0): "only"}
    after = A.add_context(spans, units, prepend=False)
    assert {r["content_context"] for r in after.collect()} == {"u0\nu1", "u2\nu4", None, "only"}
    bare = A.add_context(spans, units, prepend=False, append=False)
    assert bare.columns == both.columns and bare.where("content_context IS NULL").count() == 1
