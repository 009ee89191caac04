"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the corpus tables of ``sf_dir`` whole; parameters are fixed here
once and never tuned per run. Oracle SQL for the same names is in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spantide.functions.lexicon import SUPPORTED_LANGUAGES
from spantide.operators import pages as P
from spantide.operators import segment as G
from spantide.session import cut_lineage
from spantide.sources.tables import table


QUERIES: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _pages(spark, sf):
    return table(spark, sf, "pages")


# ---- segmentation ---------------------------------------------------------------------

@query("sentences")
def q_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return G.sentences(_docs(spark, sf))


@query("paragraphs_blank")
def q_paragraphs_blank(spark, sf):
    full = _pages(spark, sf).select("page_id", P.full_text_expr("html").alias("text"))
    return G.paragraphs_blank(full, id_col="page_id")


@query("paragraphs_list")
def q_paragraphs_list(spark, sf):
    full = _pages(spark, sf).select("page_id", P.full_text_expr("html").alias("text"))
    return G.paragraphs_list(full, id_col="page_id")


# ---- pages ------------------------------------------------------------------------------

@query("page_titles")
def q_page_titles(spark, sf):
    return P.page_record(_pages(spark, sf), extra=(P.titles_expr("html").alias("titles"),))


@query("page_text_tags")
def q_page_text_tags(spark, sf):
    return P.page_texts(_pages(spark, sf))


@query("host_boilerplate")
def q_host_boilerplate(spark, sf):
    return P.host_boilerplate(_pages(spark, sf), min_pages=2)


@query("main_text")
def q_main_text(spark, sf):
    return P.main_text(_pages(spark, sf), min_pages=2)


@query("fingerprint_groups")
def q_fingerprint_groups(spark, sf):
    return P.fingerprint_groups(_docs(spark, sf))


@query("language_filter")
def q_language_filter(spark, sf):
    return P.language_filter(_docs(spark, sf), "en").select("doc_id", "lang", "n_chars")


@query("unsupported_language")
def q_unsupported_language(spark, sf):
    langs = spark.createDataFrame([(x,) for x in SUPPORTED_LANGUAGES], "lang string")
    return (_docs(spark, sf).select("doc_id", "lang")
            .join(F.broadcast(langs), "lang", "left_anti"))


# ---- spans --------------------------------------------------------------------------

from spantide.operators import spans as A  # noqa: E402
from spantide.sources import annotations as S10  # noqa: E402


def _digit_merged(spark, sf, uses: int = 2):
    s = G.sentences(_docs(spark, sf))
    s = cut_lineage(s) if uses > 1 else s       # cut into sentences once
    lab = A.label_spans(s, F.col("text").rlike("[0-9]"), "digit")
    return s, A.merge_consecutive(lab, "digit", ord_col="sent_no")


@query("merged_labelled")
def q_merged_labelled(spark, sf):
    return _digit_merged(spark, sf, uses=1)[1]


@query("context_both")
def q_context_both(spark, sf):
    s, m = _digit_merged(spark, sf)
    m = m.withColumn("span_no", F.col("first_no")).select("doc_id", "span_no", "begin", "end", "content")
    return A.add_context(m, s, prepend=True, append=True)


@query("context_next")
def q_context_next(spark, sf):
    s, m = _digit_merged(spark, sf)
    m = m.withColumn("span_no", F.col("first_no")).select("doc_id", "span_no", "begin", "end", "content")
    return A.add_context(m, s, prepend=False, append=True)


@query("covered_sentences")
def q_covered_sentences(spark, sf):
    s, m = _digit_merged(spark, sf)
    m = m.withColumn("span_no", F.col("first_no"))
    return (A.covered(s.select("doc_id", "sent_no", "begin", "end"), m, outer_key="span_no")
            .select("doc_id", "span_no", "o_begin", "o_end", "sent_no", "begin", "end"))


@query("reannotate")
def q_reannotate(spark, sf):
    d = _docs(spark, sf)
    existing = (G.sentences(d).select("doc_id", F.lit("sentence").alias("type"), "begin", "end")
                .unionByName(G.paragraphs_blank(d).select("doc_id", F.lit("paragraph").alias("type"), "begin", "end")))
    covered = table(spark, sf, "labels").select("doc_id").distinct()      # the documents that labels covers
    new = (G.paragraphs_list(d.join(covered, "doc_id", "left_semi"))
           .select("doc_id", F.lit("paragraph").alias("type"), "begin", "end"))
    return G.reannotate(existing, new)


@query("chunking_records")
def q_chunking_records(spark, sf):
    """L1: page record + sentences of its main text, packed per page."""
    pg = _pages(spark, sf)
    rec = cut_lineage(P.page_record(pg).select("page_id", "title", "hostname", "text"))     # parsed once, used twice
    sents = G.sentences(rec, id_col="page_id", text_col="text")
    packed = S10.pack(sents.withColumn("type", F.lit("sentence")), "sentences")
    out = rec.join(packed, rec.page_id == packed.doc_id, "left")
    return out.select(
        "page_id", "title", "hostname",
        F.coalesce(F.size("sentences"), F.lit(0)).cast("long").alias("n_sentences"),
        F.coalesce(F.array_join(F.transform("sentences", lambda a: F.concat_ws(":", a["begin"], a["end"])), ","),
                   F.lit("")).alias("spans"))


# ---- terms --------------------------------------------------------------------------

from spantide.operators import terms as T  # noqa: E402


def _supported_docs(spark, sf):
    return _docs(spark, sf).where(F.col("lang").isin(*SUPPORTED_LANGUAGES))


def _token_lists(spark, sf):
    return T.token_lists(G.sentences(_supported_docs(spark, sf), keep=("lang",)))


def _tokens(spark, sf):
    return T.tokens(G.sentences(_supported_docs(spark, sf), keep=("lang",)))


def _vocab(spark, sf):
    b = table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    return T.ngrams(b, 2).select(F.col("gram").alias("term")).distinct()


@query("tokens")
def q_tokens(spark, sf):
    return _tokens(spark, sf).drop("ws_after", "lang")


@query("candidate_terms")
def q_candidate_terms(spark, sf):
    return T.filter_terms(T.candidate_runs(_token_lists(spark, sf)), remove_stopwords=False, trim=False).drop("lang")


@query("terms_pipeline")
def q_terms_pipeline(spark, sf):
    return T.filter_terms(T.candidate_runs(_token_lists(spark, sf)), trim=False).drop("lang")


@query("stopword_filtered")
def q_stopword_filtered(spark, sf):
    """T9 rejects: candidate terms that are, as a whole, a stopword of their language."""
    c = T.filter_terms(T.candidate_runs(_token_lists(spark, sf)), remove_stopwords=False, trim=False)
    sw = F.broadcast(T.stopword_table(spark))
    return (c.withColumn("word", F.lower("term")).join(sw, ["lang", "word"], "left_semi")
             .select("doc_id", "term", "lang"))


@query("known_word_terms")
def q_known_word_terms(spark, sf):
    toks = _token_lists(spark, sf)
    terms = T.filter_terms(T.candidate_runs(toks), trim=False)
    return T.known_word_terms(terms, toks, min_df=2).select("doc_id", "term", "lemma")


@query("term_lemmas")
def q_term_lemmas(spark, sf):
    """T12 at corpus level: each (language, term, lemma) with its document count."""
    t = T.filter_terms(T.candidate_runs(_token_lists(spark, sf)), trim=False)
    return t.groupBy("lang", "term", "lemma").agg(F.count("*").alias("n_docs"))


@query("term_frequency")
def q_term_frequency(spark, sf):
    return T.term_frequency(_docs(spark, sf), _vocab(spark, sf), max_ngram_len=2)


@query("term_idf")
def q_term_idf(spark, sf):
    r = T.term_idf(_docs(spark, sf), _vocab(spark, sf), max_ngram_len=2)
    return r.select("term", "df", F.round("idf", 6).alias("idf"))


# ---- dictionary matching ------------------------------------------------------------

from spantide.operators import match as D  # noqa: E402


def _bench_dictionary(spark, sf):
    """Global dictionary: word bigrams of the benchmark passages, first lemma wins."""
    b = table(spark, sf, "benchmark")
    toks = F.regexp_extract_all("text", F.lit(T.SK_TOKEN_RE), F.lit(0))
    g = b.select("item_id", toks.alias("t")).where(F.size("t") >= 2).select(
        "item_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("t") - 2),
                                            lambda i: F.array_join(F.slice("t", i + 1, 2), " "))).alias("pos", "term"))
    g = g.select("term", F.col("term").alias("lemma"), F.struct("item_id", "pos").alias("ord"))
    return D.dedupe_dictionary(g)


@query("term_occurrences")
def q_term_occurrences(spark, sf):
    s = G.sentences(_docs(spark, sf))
    return D.match_terms(s, _bench_dictionary(spark, sf))


# ---- entities -------------------------------------------------------------------------

from spantide.operators import entities as N  # noqa: E402
from spantide.operators import qa as Q  # noqa: E402


def _titles(spark, sf):
    """Gazetteer of works: the first two words of every sentence of the benchmark passages, whole passages."""
    b = table(spark, sf, "benchmark").select(F.explode(F.split("text", r"[\n.!?]+", -1)).alias("text"))
    t = F.regexp_extract_all("text", F.lit(T.SK_TOKEN_RE), F.lit(0))
    return b.select(t.alias("t")).where(F.size("t") >= 2).select(F.lower(F.array_join(F.slice("t", 1, 2), " ")).alias("term")).distinct()


def entity_finder(spark, sf):
    """N1 as a function of sentences: the regex rules, and the works of the gazetteer."""
    title = _titles(spark, sf)

    def find(s):
        found = D.match_terms(s, title.withColumn("lemma", F.col("term")))
        return N.rule_entities(s).unionByName(N.gazetteer_entities(found, title.withColumn("label", F.lit("WORK_OF_ART"))))
    return find


def _entities(spark, sf):
    return N.leftmost_longest(entity_finder(spark, sf)(G.sentences(_docs(spark, sf))))


@query("entity_rules")
def q_entity_rules(spark, sf):
    return _entities(spark, sf)


@query("entity_stats")
def q_entity_stats(spark, sf):
    return N.entity_stats(_entities(spark, sf))


# ---- pipelines L3 / L4 ----------------------------------------------------------------

from spantide.plans import pipelines as L  # noqa: E402


@query("contact_paragraphs")
def q_contact_paragraphs(spark, sf):
    """L3 on page text (P4), whose blocks are paragraphs."""
    full = _pages(spark, sf).select(F.col("page_id").alias("doc_id"), P.full_text_expr("html").alias("text"))
    return L.contact_paragraphs(full)


@query("contact_documents")
def q_contact_documents(spark, sf):
    """L3 on documents, which have no blank lines: one paragraph each."""
    return L.contact_paragraphs(_docs(spark, sf))


@query("qa_paragraphs")
def q_qa_paragraphs(spark, sf):
    """L4 on page main text; the data holds no '?', so the marker is ','."""
    main = _pages(spark, sf).select(F.col("page_id").alias("doc_id"), P.main_text_tags_expr("html").alias("text"))
    return L.question_paragraphs(main, marker=",")


# ---- classification -------------------------------------------------------------------

from spantide.operators import classify as C  # noqa: E402
from spantide.operators import linear as LR  # noqa: E402


@query("clean_text")
def q_clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", C.clean_text("text").alias("cleaned"))


@query("class_weights")
def q_class_weights(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("quality").alias("label"))
    return C.class_weights(lab).select(F.col("label").cast("long").alias("label"), "n",
                                       F.round("weight", 6).alias("weight"))


@query("pos_weights")
def q_pos_weights(spark, sf):
    r = C.pos_weights(table(spark, sf, "labels"), ["quality", "toxic"])
    return r.select("pos", F.col("n_pos").cast("long").alias("n_pos"), F.round("weight", 6).alias("weight"))


@query("stratified_split")
def q_stratified_split(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return C.stratified_split(lab, "label", "doc_id", 0.1, 2022)


@query("empty_defaults")
def q_empty_defaults(spark, sf):
    d = _docs(spark, sf).select("doc_id", C.clean_text("text").alias("cleaned"))
    s = d.withColumn("label", L.contact_rule("cleaned"))
    s = s.withColumn("proba_1", F.col("label").cast("double")).withColumn("proba_0", 1.0 - F.col("label"))
    return C.with_empty_defaults(s, "cleaned", "label", ["proba_0", "proba_1"]).drop("cleaned")


def _scores(spark, sf):
    """Scores of each vector against every class: its inner products with the class means of
    the whole vectors; ``label`` is the place of the vector's class among the sorted classes."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    mean = e.select("label", F.posexplode("e").alias("j", "v")).groupBy("label", "j").agg(F.avg("v").alias("v"))
    mean = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("m"))
    classes = mean.agg(F.array_sort(F.collect_list(F.struct("label", F.col("m.v").alias("m"))))).scalar()   # a row per class
    e = e.select("vec_id", "label", "e", classes.alias("classes"))
    x = F.transform("classes", lambda c: F.aggregate(F.zip_with("e", c["m"], lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p))
    return e.select("vec_id", (F.array_position(F.col("classes.label"), F.col("label")) - 1).cast("int").alias("label"), x.alias("x"))


@query("threshold_predictions")
def q_threshold_predictions(spark, sf):
    s = _scores(spark, sf)
    return s.select("vec_id", F.col("label").cast("long").alias("label"), C.argmax("x").cast("long").alias("pred"),
                    F.array_join(C.threshold("x"), "").alias("multi_label"))


@query("accuracy")
def q_accuracy(spark, sf):
    s = _scores(spark, sf).withColumn("pred", C.argmax("x"))
    return s.agg(F.count("*").alias("n"),
                 F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"))


@query("class_report")
def q_class_report(spark, sf):
    s = _scores(spark, sf).withColumn("pred", C.argmax("x"))
    r = C.class_report(s, "label", "pred")
    return r.select("cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support"))


@query("mean_loss")
def q_mean_loss(spark, sf):
    """C15 over every element of the scores."""
    return C.mean_losses(_scores(spark, sf))


# ---- questions and answers ----------------------------------------------------------------

@query("qg_sentences")
def q_qg_sentences(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(Q.split_sentences("text")).alias("sentence"))


@query("segments")
def q_segments(spark, sf):
    return Q.segments(_docs(spark, sf))


@query("qg_inputs")
def q_qg_inputs(spark, sf):
    return Q.qg_inputs(Q.segments(_docs(spark, sf)))


def _conv_pairs(spark, sf):
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = (c.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
          .where((F.col("role") == "user") & (F.col("next_role") == "assistant")))
    return c.select("conv_id", "turn", F.col("text").alias("question"), F.col("next_text").alias("answer"))


@query("best_pairs")
def q_best_pairs(spark, sf):
    p = _conv_pairs(spark, sf).withColumn("question", Q.clean_question("question"))
    p = p.withColumn("score", F.length("answer").cast("long"))
    return Q.rank_pairs(p, "conv_id", "score", "turn", 10).select(
        "conv_id", F.col("rank").cast("long").alias("rank"), "turn", "question", "answer", "score")


@query("all_pairs")
def q_all_pairs(spark, sf):
    """Q12: every pair in order of appearance, unranked."""
    return _conv_pairs(spark, sf).select("conv_id", "turn", Q.clean_question("question").alias("question"), "answer")


@query("qa_negatives")
def q_qa_negatives(spark, sf):
    return Q.negatives(_conv_pairs(spark, sf), ["conv_id", "turn"]).select(
        "conv_id", "turn", "question", "answer", "label")


# ---- sources, sinks and the feed (write to the shared folder, read back) ---------------------

from spantide.session import scratch_path  # noqa: E402
from spantide.sources import files as S  # noqa: E402
from spantide.streaming import feed as L7  # noqa: E402


@query("tsv_roundtrip")
def q_tsv_roundtrip(spark, sf):
    """S12 writer -> S3 and S4 readers (+C2) on documents joined with labels."""
    d = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    path = scratch_path(spark, "tsv")
    S.write_training_tsv(d, path, label_cols=("quality", "toxic"))
    one = S.read_base64_tsv(spark, path, first_col=3)
    multi = S.read_base64_tsv(spark, path, first_col=3, multi_label=True)
    return (one.select(F.lit("multi_class").alias("reader"), "text", F.col("label").cast("string").alias("labels"))
               .unionByName(multi.select(F.lit("multi_label").alias("reader"), "text",
                                         F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))))


@query("file_readers")
def q_file_readers(spark, sf):
    """S5/S7 (class-per-directory whole files) and S8 (multi-line CSV) round trips."""
    d = _docs(spark, sf)
    tdir = scratch_path(spark, "split")
    d.select("lang", "text").write.mode("overwrite").option("maxRecordsPerFile", 10000).partitionBy("lang").text(tdir)
    split = S.read_split(spark, tdir, class_names=("en", "fr", "de", "es"), dir_prefix="lang=")
    per_class = split.groupBy("label").agg(
        F.sum(F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1))).cast("long").alias("n_lines"))
    cdir = scratch_path(spark, "qa_csv")
    S.write_qa_csv(_conv_pairs(spark, sf).select(F.col("turn").alias("idx"), "question", "answer")
                   .withColumn("idx", F.col("idx").cast("long")), cdir)
    qa = S.read_qa_csv(spark, cdir).agg(F.count("*").alias("n_pairs"),
                                        F.sum(F.length("question") + F.length("answer")).alias("qa_chars"))
    return per_class.join(F.broadcast(qa))      # one-row side


@query("feed_batches")
def q_feed_batches(spark, sf):
    """L7 + S2: pages written as crawl JSONL, consumed by a streaming query."""
    base = scratch_path(spark, "feed")
    S.write_crawl(_pages(spark, sf), f"{base}/in")
    L7.run_feed(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").drop("batch")


@query("classifier_lr")
def q_classifier_lr(spark, sf):
    """Clean (C1) -> drop empty (C3) -> stratified split (C4) -> positive weights
    -> logistic regression (C9) -> predictions on the hold-out (C10)."""
    d = C.stratified_split(cut_lineage(_labelled_texts(spark, sf)).where(F.col("text") != ""), "quality", "doc_id")
    d = cut_lineage(d)
    model = LR.train_texts(d.where(~F.col("is_val")), "doc_id", ["quality"])
    val = d.where("is_val")
    p = LR.predict_texts(val, model, "doc_id").select(F.col("doc_id").alias("id"), F.col("proba")[0].alias("proba_1"))
    return val.join(p, F.col("doc_id") == F.col("id")).select(
        "doc_id", F.col("quality").cast("long").alias("label"), (F.col("proba_1") >= 0.5).cast("long").alias("pred"), "proba_1")


def _labelled_texts(spark, sf):
    d = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "quality", "toxic")
    return d.repartition("doc_id").withColumn("text", C.clean_text("text"))      # dealt out before cleaning


@query("top_terms_per_host")
def q_top_terms_per_host(spark, sf):
    """L2 flagship: page main text -> sentences -> terms; top 5 terms per host by
    number of pages (a top-k report: the limit is the feature)."""
    return L.top_terms_per_host(_pages(spark, sf), k=5)

from spantide.plans import catalog_records  # noqa: E402,F401  (registers its queries)
