"""Cases of the second review in entities and terms: each was lost before."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import random  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from spantide.operators import entities as N  # noqa: E402


def folder(spark, path, texts, benchmark=(), lang="en"):
    """A data folder of the documents and the benchmark passages."""
    docs = [(i, t, lang, "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


# ---- gazetteer titles of more than three pieces ------------------------------------------------

def test_titles_with_digits(spark, tmp_path):
    text = "We read census 2020 and covid 19, not covid 19-related news."
    sf = folder(spark, tmp_path, [text], ["Census 2020 of all", "Covid 19 in towns"])
    got = E.queries()["entity_rules"](spark, sf).orderBy("begin").collect()
    assert [(r["text"], r["label"]) for r in got] == [("census 2020", "WORK_OF_ART"), ("covid 19", "WORK_OF_ART"), ("19", "CARDINAL")]
    assert all(text[r["begin"]:r["end"]] == r["text"] for r in got)
    stats = {r["label"]: r["n"] for r in E.queries()["entity_stats"](spark, sf).collect()}
    assert stats == {"WORK_OF_ART": 2, "CARDINAL": 1}


# ---- chains of overlapping entities ---------------------------------------------------------------

def readings(ents):
    """Plain fold over the entities of every sentence."""
    kept, end = [], {}
    for e in sorted(ents, key=lambda e: (e[0], e[1], e[2], -e[3], e[5])):
        if e[2] >= end.get(e[:2], 0):
            kept.append(e)
            end[e[:2]] = e[3]
    return kept


def test_chains_keep_what_overlaps_nothing_kept(spark):
    rng = random.Random(3)
    ents = [(0, 0, 0, 5, "A", "ORG"), (0, 0, 3, 10, "B", "ORG"), (0, 0, 7, 12, "C", "ORG"), (0, 0, 12, 14, "D", "ORG")]
    for doc in range(1, 40):
        ents += [(doc, rng.randint(0, 1), b, b + rng.randint(1, 9), f"e{k}", "ORG") for k, b in enumerate(rng.sample(range(40), rng.randint(1, 12)))]
    df = spark.createDataFrame(ents, "doc_id long, sent_no long, begin long, end long, text string, label string")
    got = N.leftmost_longest(df)
    assert got.columns == df.columns
    rows = [tuple(r) for r in got.collect()]
    assert [r[4] for r in sorted(rows) if r[0] == 0] == ["A", "C", "D"]
    assert sorted(rows) == sorted(readings(ents))


def test_overlapping_titles(spark, tmp_path):
    sf = folder(spark, tmp_path, ["aa bb cc dd"], ["aa bb", "bb cc", "cc dd"])
    got = E.queries()["entity_rules"](spark, sf).orderBy("begin").collect()
    assert [r["text"] for r in got] == ["aa bb", "cc dd"]


# ---- stopwords outside the closed classes ------------------------------------------------------------

def test_stopwords_are_dropped(spark, tmp_path):
    import duckdb
    sf = folder(spark, tmp_path, ["The same credit and the other few.", "Own credit: more such credit."])
    got = {name: {(r["doc_id"], r["term"]) for r in E.queries()[name](spark, sf).select("doc_id", "term").collect()}
           for name in ("candidate_terms", "terms_pipeline", "stopword_filtered")}
    assert {(0, "few"), (0, "same"), (0, "other"), (1, "Own"), (1, "more"), (1, "such")} <= got["stopword_filtered"]
    assert {(0, "credit"), (1, "credit"), (0, "same credit")} <= got["terms_pipeline"]
    assert got["terms_pipeline"] == got["candidate_terms"] - got["stopword_filtered"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    for name in ("terms_pipeline", "stopword_filtered"):
        assert {(d, t) for d, t in con.sql(E.oracle_sql()[name]).select("doc_id, term").fetchall()} == got[name]


def test_stopword_lists():
    from spantide.functions.lexicon import LEXICON, SUPPORTED_LANGUAGES, stopwords
    for lang in SUPPORTED_LANGUAGES:
        closed = {w for words in LEXICON[lang].values() for w in words.split()}
        assert closed <= set(stopwords(lang)) and len(stopwords(lang)) == len(set(stopwords(lang)))
        assert lang in ("sl", "hr") or set(stopwords(lang)) - closed
