"""N1-N4 on hand-written sentences; the SQL of every query parses and oracle_sql needs no jar."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from conftest import docs_df  # noqa: E402
from spantide.operators import entities as N  # noqa: E402
from spantide.operators import match as D  # noqa: E402
from spantide.operators import segment as G  # noqa: E402

# A text and the entities expected in it.
TEXT = "It cost €1,200 or 15 %, on 2024-05-01 at 10:30.\nThe 3rd run took 12 km and 7 steps in 1999; 5.5 kg."
EXPECTED = [("€1,200", "MONEY"), ("15 %", "PERCENT"), ("2024-05-01", "DATE"), ("10:30", "TIME"), ("3rd", "ORDINAL"),
            ("12 km", "QUANTITY"), ("7", "CARDINAL"), ("1999", "DATE"), ("5.5 kg", "QUANTITY")]


def test_rules_and_offsets(spark):
    got = N.rule_entities(G.sentences(docs_df(spark, [TEXT, "none here", ""]))).orderBy("doc_id", "begin").collect()
    assert [(r["text"], r["label"]) for r in got] == EXPECTED
    assert all(TEXT[r["begin"]:r["end"]] == r["text"] for r in got)
    assert {r["label"] for r in got} <= set(N.LABELS)


def test_gazetteer_and_overlaps(spark):
    s = G.sentences(docs_df(spark, ["We saw Acme 2000 and acme."]))
    gaz = spark.createDataFrame([("Acme", "ORG"), ("acme 2000", "PRODUCT"), ("saw", "VERB")], "term string, label string")
    d = D.dedupe_dictionary(gaz.selectExpr("term", "term AS lemma", "term AS ord"))
    ents = N.gazetteer_entities(D.match_terms(s, d), gaz).unionByName(N.rule_entities(s))
    got = N.leftmost_longest(ents).orderBy("begin").collect()
    assert [(r["text"], r["label"]) for r in got] == [("acme 2000", "PRODUCT"), ("acme", "ORG")]
    stats = {r["label"]: (r["n"], r["n_docs"]) for r in N.entity_stats(N.leftmost_longest(ents)).collect()}
    assert stats == {"PRODUCT": (1, 1), "ORG": (1, 1)}


def test_matcher_takes_one_piece_terms(spark):
    s = G.sentences(docs_df(spark, ["word and word-like words, word"]))
    d = spark.createDataFrame([("word", "word")], "term string, lemma string")
    assert [(r["begin"], r["end"]) for r in D.match_terms(s, d).orderBy("begin").collect()] == [(0, 4), (26, 30)]
    none = spark.createDataFrame([], "term string, lemma string")
    assert D.match_terms(s, none).count() == 0


def test_every_sql_can_be_planned():
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in E.oracle_sql().items():
        assert con.execute(f"EXPLAIN {sql}").fetchall(), name
    assert set(E.oracle_sql()) <= set(E.queries())
