import random

from conftest import docs_df

from pyspark.sql import functions as F

from spantide.operators import match as D
from spantide.operators import segment as G
from spantide.operators import terms as T

TERMS = [("this", "this"), ("a sentence", "a sentence"), ("other", "other"), ("the", "the"), ("t", "t")]


def _dict(spark, pairs):
    df = spark.createDataFrame([(t, l, i) for i, (t, l) in enumerate(pairs)], "term string, lemma string, ord long")
    return D.dedupe_dictionary(df)


def test_dictionary_fixture(spark):
    texts = ["  This is a sentence\n Another one\n\n other\n\n", "", "\n", "\t   t\n"]
    s = G.sentences(docs_df(spark, texts))
    got = D.match_terms(s, _dict(spark, TERMS)).orderBy("doc_id", "begin").collect()
    out = [(r["doc_id"], r["begin"], r["end"], texts[r["doc_id"]][r["begin"]:r["end"]]) for r in got]
    assert out == [(0, 2, 6, "This"), (0, 10, 20, "a sentence"), (0, 36, 41, "other"), (3, 4, 5, "t")]


F5 = [("test term text", 5, 8, True), ("test termtext", 5, 8, False), ("test termtext", 5, 12, True),
      ("test-termtext", 5, 12, False), ("term termtex", 0, 3, True), ("term-termtext", 0, 3, False),
      ("term-termtext", 0, 0, False), ("term-termtext", 0, 12, True), ("f g", 2, 2, True), ("fg", 1, 1, False)]


def test_boundary_fixture(spark):
    df = spark.createDataFrame(F5, "text string, s long, e long, want boolean")
    for r in df.select("want", D.is_token("text", "s", "e").alias("got")).collect():
        assert r["got"] == r["want"]
    df2 = spark.createDataFrame([("test-termtext", 5, 12), ("term-termtext", 0, 3)], "text string, s long, e long")
    assert all(r[0] for r in df2.select(D.is_token("text", "s", "e", special=("_", "+"))).collect())


def _brute(text, terms, special="-_+"):
    t = text.lower()
    out = []
    isc = lambda ch: ch.isalpha() or ch in special
    for term in {x.lower() for x in terms if x}:
        start = t.find(term)
        while start >= 0:
            end = start + len(term) - 1
            if (start == 0 or not isc(t[start - 1])) and (end == len(t) - 1 or not isc(t[end + 1])):
                out.append((start, end + 1, term))
            start = t.find(term, start + 1)
    return sorted(out)


def test_dictionary_random_against_brute_force(spark):
    rnd = random.Random(3)
    alphabet = ["ab", "a", "b", "-", " ", ".", "c", "ab-", "+", "é", "1", "_"]
    terms = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 3))).strip() for _ in range(40)} - {""})
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(120)]
    sents = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)],
                                  "doc_id long, sent_no long, begin long, text string")
    got = {}
    for r in D.match_terms(sents, _dict(spark, [(t, t) for t in terms])).collect():
        got.setdefault(r["doc_id"], []).append((r["begin"], r["end"], r["term"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == _brute(t, terms), t


def test_trims_and_text_filter(spark):
    words = "the 12 test sentence 23 27".split()
    pos = ["DET", "NUM", "NOUN", "NOUN", "NUM", "NUM"]
    span = [(i, 0, 0, w, " ", w, p) for i, (w, p) in enumerate(zip(words, pos))]
    df = spark.createDataFrame([(span,)], f"span array<{T._TOK}>")
    r = df.select(T.span_text(T.trim_invalid(F.col("span"))).alias("t")).first()
    assert r["t"] == "test sentence"
    checks = {"test": True, "test-test": True, "test term": True, "12": False, "test 12": False,
              "test.": False, "test , test": False, "": False}
    df = spark.createDataFrame([(k,) for k in checks], "t string")
    for row in df.select("t", T.is_clean_text(F.col("t")).alias("ok")).collect():
        assert row["ok"] == checks[row["t"]], row
