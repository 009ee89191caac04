"""Registered queries over whole records: L2, L5, multiple choice, corrupted pairs, splits and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from spantide.operators import choices as QC
from spantide.operators import classify as C
from spantide.operators import entities as N
from spantide.operators import induction as I
from spantide.operators import linear as LR
from spantide.operators import sampling as S
from spantide.operators import segment as G
from spantide.operators import terms as T
from spantide.plans import pipelines as L
from spantide.plans.catalog import _bench_dictionary, _conv_pairs, _docs, _labelled_texts, _pages, _token_lists, entity_finder, q_term_occurrences, query
from spantide.session import cut_lineage, scratch_path
from spantide.sources import annotations as S10
from spantide.sources import files as FS
from spantide.sources.tables import table
from spantide.streaming import feed as L7


def _listed(choices: str):
    """Choices as text, the correct one with a star."""
    return F.array_join(F.transform(choices, lambda c: F.concat(F.when(c["correct"], F.lit("*")).otherwise(F.lit("")), c["answer"])), " | ")


def _spans(array: str):
    return F.array_join(F.transform(array, lambda a: F.concat_ws(":", a["begin"].cast("string"), a["end"].cast("string"), a["value"], a["label"])), ",")


@query("extract_terms")
def q_extract_terms(spark, sf):
    """L2: sentences, term occurrences and entities of every page in one record."""
    r = L.extract_terms(_pages(spark, sf), entity_finder(spark, sf))
    return r.select("page_id", "host", "title", "language", *[_spans(c).alias(c) for c in ("sentences", "tokens", "entities")])


@query("mc_inputs")
def q_mc_inputs(spark, sf):
    """Q7 + Q8: multiple-choice inputs of every document."""
    return QC.mc_inputs(_docs(spark, sf), entity_finder(spark, sf)).withColumn("choices", _listed("choices"))


@query("question_inputs")
def q_question_inputs(spark, sf):
    """Q9, style ``all``, with Q13."""
    return QC.correct_answers(QC.question_inputs(_docs(spark, sf), "all", entity_finder(spark, sf))).withColumn("choices", _listed("choices"))


@query("generated_questions")
def q_generated_questions(spark, sf):
    """The ten best questions of every document (a top-k report: the limit is the feature)."""
    g = L.generate_questions(_docs(spark, sf), "all", 10, entity_finder(spark, sf))
    return g.withColumn("choices", _listed("choices")).withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.col("score").cast("long"))


@query("qa_corrupted")
def q_qa_corrupted(spark, sf):
    """Q14 + Q15 + Q16: evaluator pairs, corrupted by swapped answers or by entities."""
    return QC.evaluator_pairs(_conv_pairs(spark, sf), ["conv_id", "turn"], entity_finder(spark, sf))


@query("multilabel_split")
def q_multilabel_split(spark, sf):
    """C5 on the labels of documents, with a third one: long texts."""
    lab = table(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", (F.col("n_chars") > 1500).cast("int").alias("long")), "doc_id")
    return S.multilabel_split(lab, ["quality", "toxic", "long"], "doc_id")


@query("weighted_draws")
def q_weighted_draws(spark, sf):
    """C6 + C7: as many draws as rows, each class with the same total weight."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return S.draws(C.sample_weights(lab, "label"), "doc_id", "weight")


@query("misspellings")
def q_misspellings(spark, sf):
    """Words one edit away from a word in 100 times as many documents."""
    return T.misspellings(_token_lists(spark, sf))


@query("spelled_terms")
def q_spelled_terms(spark, sf):
    """T13 with T11: the terms of documents that hold no misspelling."""
    toks = _token_lists(spark, sf)
    terms = T.filter_terms(T.candidate_runs(toks), trim=False)
    return T.spelled_terms(terms, T.misspellings(toks), toks).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


@query("induced_gazetteer")
def q_induced_gazetteer(spark, sf):
    """Names of persons, organisations and places, from the contexts that they stand in."""
    return I.induce(I.name_runs(_token_lists(spark, sf)), min_score=I.ONE // 50)


@query("multilabel_predictions")
def q_multilabel_predictions(spark, sf):
    """C5 -> C8 -> C9 -> C11 -> C12: both labels of the hold-out, trained from one feature table; texts that are empty after
    cleaning keep their place with label 0 and probability -1."""
    d = cut_lineage(S.multilabel_split(cut_lineage(_labelled_texts(spark, sf)), ["quality", "toxic"], "doc_id"))
    model = LR.train_texts(d.where(~F.col("is_val") & (F.col("text") != "")), "doc_id", ["quality", "toxic"])
    val = d.where("is_val")
    p = LR.predict_texts(val, model, "doc_id").withColumnRenamed("doc_id", "id")
    x = val.join(p, F.col("doc_id") == F.col("id"))
    for j, c in enumerate(("quality", "toxic")):
        x = x.withColumn(f"proba_{c}", F.col("proba")[j]).withColumn(f"pred_{c}", (F.col("proba")[j] >= 0.5).cast("long"))
        x = C.with_empty_defaults(x, "text", f"pred_{c}", [f"proba_{c}"])
    exact = (F.col("pred_quality") == F.col("quality")) & (F.col("pred_toxic") == F.col("toxic"))
    return x.select("doc_id", "quality", "toxic", "pred_quality", "pred_toxic", "proba_quality", "proba_toxic", exact.cast("long").alias("exact"))


@query("training_rejects")
def q_training_rejects(spark, sf):
    """Labelled texts that are empty after cleaning, which training leaves out."""
    return _labelled_texts(spark, sf).where(F.col("text") == "").select("doc_id", "quality", "toxic")


@query("page_feed")
def q_page_feed(spark, sf):
    """Pages written as crawl files and streamed through L1-L4; what the sinks hold afterwards."""
    base = scratch_path(spark, "page-feed")
    FS.write_crawl(_pages(spark, sf), f"{base}/in")
    L7.run_page_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", marker=",")
    read = {k: spark.read.parquet(f"{base}/out/{k}") for k in ("records", "annotations", "contacts", "questions")}

    def rows(sink, df, page, place, text):
        return df.select(F.lit(sink).alias("sink"), F.col(page).alias("page_id"), F.col(place).cast("long").alias("place"), text.alias("text"))
    out = rows("records", read["records"].withColumn("n", F.length("text")), "page_id", "n", F.col("title"))
    for sink in ("contacts", "questions"):
        out = out.unionByName(rows(sink, read[sink], "doc_id", "span_no", F.col("content_context")))
    a = read["annotations"].withColumn("sink", F.col("type"))
    return out.unionByName(a.select("sink", F.col("doc_id").alias("page_id"), F.col("begin").alias("place"), F.concat_ws("|", "value", "label").alias("text")))


@query("scored_occurrences")
def q_scored_occurrences(spark, sf):
    """T16 with T15: every occurrence of the dictionary's terms, scored by the term's idf in the corpus."""
    idf = T.term_idf(_docs(spark, sf), _bench_dictionary(spark, sf), 2).select(F.col("term").alias("_t"), F.round("idf", 6).alias("idf"))
    occ = q_term_occurrences(spark, sf).drop("score")
    return occ.join(idf, F.col("term") == F.col("_t")).drop("_t").withColumnRenamed("idf", "score")


@query("stored_annotations")
def q_stored_annotations(spark, sf):
    """The annotations of pages (L2), packed per document and type, written, and two of the types read back."""
    path = scratch_path(spark, "annotations")
    rec = cut_lineage(L.page_texts(_pages(spark, sf)))
    a = L.term_annotations(G.sentences(rec, id_col="page_id", keep=("lang",)), N.rule_entities)
    S10.write(S10.pack(a), path)
    return S10.read(spark, path, "sentence").unionByName(S10.read(spark, path, "entity"))
