import itertools

from conftest import docs_df

from pyspark.sql import functions as F

from spantide.operators import classify as C
from spantide.operators import pages as P
from spantide.operators import qa as Q

# A page and what is expected of it.
HTML = ("<title>The title </title><p>This the first test sentence.</p><p> And this is the second.</p>"
        "<p> Another sentence </p><p> Now we start another paragraph </p><p>This is the third paragraph.</p>")


def test_page_fixture(spark):
    df = spark.createDataFrame([(1, None, HTML)], "page_id long, url string, html string")
    r = P.page_record(df).first()
    assert r["title"] == "The title "
    assert r["text"] == ("This the first test sentence.\nAnd this is the second.\nAnother sentence\n"
                         "Now we start another paragraph\nThis is the third paragraph.")
    assert r["fingerprint"] == "RvZQOGifmslZdY+7M/nU74v1YOM="
    assert r["hostname"] is None and r["source"] is None


def test_broken_html(spark):
    html = ('<html><head><title>x &amp;amp; y</title><script>var t="</p>";</script></head><body>'
            '<nav><ul><li><a href="/a">A</a></li><li>B</li></ul></nav><!-- c --><p>one <b>bold<p>two &amp; three'
            '<footer>&copy; f</footer>')
    df = spark.createDataFrame([(1, "http://Ex.org/a", html)], "page_id long, url string, html string")
    r = P.page_texts(df).first()
    assert r["main_text"] == "one bold\ntwo & three"
    assert r["full_text"] == "- A\n\n- B\n\none bold\n\ntwo & three\n\n© f"
    assert r["host"] == "ex.org"
    assert df.select(P.title_expr("html")).first()[0] == "x &amp; y"


def test_clean_text(spark):
    t = ("short line\n  this line has more than six words in it  \t 12 34 56 78 90 11 22 33\n"
         "!!! ... ??? ;;; ::: ,,, --- +++")
    r = docs_df(spark, [t]).select(C.clean_text("text")).first()[0]
    assert r == "this line has more than six words in it"


def _py_segments(text, max_tokens=490):
    """Cut points over running totals: a line begins a segment when the lines since the last
    beginning hold ``max_tokens`` words or more."""
    lines = [x for x in text.split("\n") if x]
    total = [0, *itertools.accumulate(len(x.split()) for x in lines)]
    cuts = [0] if lines else []
    for k in range(1, len(lines)):
        if total[k] - total[cuts[-1]] >= max_tokens:
            cuts.append(k)
    return [(" ".join(lines[a:b]), total[b] - total[a]) for a, b in zip(cuts, [*cuts[1:], len(lines)])]


def test_segments_against_plain_rule(spark):
    import random
    rnd = random.Random(5)
    texts = ["\n".join(" ".join("w" for _ in range(rnd.choice([0, 3, 50, 200, 489, 490, 700])))
                       for _ in range(rnd.randint(0, 8))) for _ in range(60)]
    got = {}
    for r in Q.segments(docs_df(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append((r["seg_no"], r["text"], r["n_tokens"]))
    for i, t in enumerate(texts):
        assert [(x[1], x[2]) for x in sorted(got.get(i, []))] == _py_segments(t)


def test_sentence_split_and_question_cleanup(spark):
    df = docs_df(spark, ["A b. C d! e f? tail\nx y."])
    got = set(df.select(F.explode(Q.split_sentences("text"))).toPandas().iloc[:, 0])
    assert got == {"A b.", "C d!", "e f?", "x y."}
    q = spark.createDataFrame([("what is it? more? x",)], "q string").select(Q.clean_question("q")).first()[0]
    assert q == "what is it?"


def test_class_report_and_threshold(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)], "label int, pred int")
    rows = {r["cls"]: r for r in C.class_report(df).collect()}
    assert rows["1"]["precision"] == 0.5 and rows["1"]["recall"] == 1.0
    assert rows["2"]["precision"] == 0.0 and rows["2"]["f1"] == 0.0
    p = spark.createDataFrame([([0.0, -1.0, 2.0],)], "p array<double>")
    assert p.select(C.threshold("p")).first()[0] == [1, 0, 1]
    assert p.select(C.argmax("p")).first()[0] == 2


def _record(spark, html, url="http://h.org/p"):
    return P.page_record(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")).first()


def test_metadata_in_any_order_of_attributes(spark):
    r = _record(spark, """<html><head><meta content="A &amp; B" property="og:site_name"><meta content='d1' name='description'>
        <link href="https://c.org/x" rel="canonical"><META NAME="keywords" CONTENT="k1, k2"></head><body><p>text</p></body></html>""")
    assert (r["source_hostname"], r["excerpt"], r["source"], r["hostname"], r["tags"]) == ("A & B", "d1", "https://c.org/x", "c.org", "k1, k2")


def test_entities(spark):
    r = _record(spark, "<title>M&uuml;ller &#8217; &#xE9; &amp;lt; &unknown; &#0; a&b &#128512;</title><p>M&uuml;ller&nbsp;&#x2019;&euro;</p>")
    assert r["title"] == "Müller ’ é &lt; &unknown; &#0; a&b 😀"
    assert r["text"] == "Müller ’€"


def test_boilerplate_class_among_others(spark):
    r = _record(spark, '<p>kept</p><div class="ad big">gone</div><div class="head">kept too</div>')
    assert r["text"] == "kept\nkept too"


def test_negatives_are_different_answers(spark):
    rows = [(k, 0, f"q{k}", f"a{k % 7}") for k in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, question string, answer string")
    got = Q.negatives(df, ["conv_id", "turn"]).collect()
    assert len(got) == 400 and 140 < sum(r["label"] for r in got) < 260
    for r in got:
        assert (r["answer"] == f"a{r['conv_id'] % 7}") == (r["label"] == 1)
    assert len({r["answer"] for r in got if r["label"] == 0}) == 7
    one = Q.negatives(df.limit(1), ["conv_id", "turn"]).collect()
    assert [r["label"] for r in one] == [1]


def test_losses_of_large_scores(spark):
    df = spark.createDataFrame([(0, [1000.0, -1000.0]), (1, [1000.0, -1000.0])], "label int, x array<double>")
    r = C.mean_losses(df).first()
    assert r["n"] == 2 and r["ce_loss"] == 1000.0 and r["bce_loss"] == 500.0


def test_split_is_exact_and_parallel(spark):
    import hashlib
    rows = [(k, k % 3 == 0) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, label boolean")
    got = {r["doc_id"]: r["is_val"] for r in C.stratified_split(df, "label", "doc_id").collect()}
    for label in (True, False):
        ids = sorted((k for k, v in rows if v == label), key=lambda k: (hashlib.md5(f"{k}2022".encode()).hexdigest(), k))
        n = -(-len(ids) // 10)
        assert [k for k in ids if got[k]] == ids[:n]
