"""L2 records, boilerplate regions by depth, term counts against plain Python."""

import random
import re
from collections import Counter

from conftest import docs_df
from pyspark.sql import functions as F
from spantide.operators import pages as P
from spantide.operators import terms as T
from spantide.plans import pipelines as L

# Pages and the text that is left of them.
REGIONS = [
    ('<body><div class="ad"><div>x</div><div>y<div>z</div></div></div><p>kept</p></body>', "kept"),
    ('<body><nav><ul><li>a<div>b</nav><p>kept</p><aside>c</aside><p>too</p></body>', "kept\ntoo"),
    ('<article><div class="x menu">never closed<p>gone</p></article><p>kept</p>', "kept"),
    ('<p>one</p></div></nav><p>two</p><footer>gone</footer></footer><p>three</p>', "one\ntwo\nthree"),
    ('<body><header>h<nav>n</nav>still h</header><div/><p>kept</p><nav>open to the end<p>gone</p>', "kept"),
    ('<div><section><aside>gone</section><p>kept</p></div><!-- <nav> --><script>"<nav>"</script><p>kept 2</p>', "kept\nkept 2"),
    ("", ""), ("no tags", "no tags"),
]
TAG = re.compile(r"(?i)</?(?:body|main|article|section|div|nav|header|footer|aside)\b[^>]*>")


def test_regions_by_depth(spark):
    df = spark.createDataFrame([(i, "http://h/", h) for i, (h, _) in enumerate(REGIONS)], "page_id long, url string, html string")
    got = P.cut_regions(df).select("page_id", P.full_text_expr("html").alias("text")).orderBy("page_id").collect()
    assert [r["text"].replace("\n\n", "\n") for r in got] == [t for _, t in REGIONS]


def plain_cut(html):
    """The depth rule said again, as one pass with a counter per tag."""
    depth, until, out, at = Counter(), None, [], 0
    for m in [*TAG.finditer(html), None]:
        if until is None:
            out.append(html[at:m.start() if m else None])
        if m is None:
            return "".join(out)
        at, tag, text = m.start(), re.match(r"</?([A-Za-z]+)", m[0])[1].lower(), m[0]
        if text.startswith("</"):
            depth[tag] = max(0, depth[tag] - 1)
            if until is not None and depth[tag] < until[tag]:
                until = None
        elif not text.endswith("/>"):
            depth[tag] += 1
            if until is None and re.match(P.BOILER_RE.replace("(?is)", ""), text, re.I | re.S):
                until = Counter(depth)


def test_regions_against_one_pass(spark):
    rng = random.Random(11)
    tags = ["<div>", "</div>", "<nav>", "</nav>", '<div class="ad">', "<section>", "</section>", "<aside>", "</aside>", "<div/>", "text ", "<p>more</p>"]
    pages = [(i, "u", "".join(rng.choice(tags) + str(k) for k in range(rng.randint(0, 40)))) for i in range(150)]
    got = {r["page_id"]: r["html"] for r in P.cut_regions(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, html in pages:
        assert got[i] == plain_cut(html), html


def test_term_record(spark):
    html = '<html lang="en"><head><title>T</title></head><body><p>The solar panel costs €12.</p><p>A solar panel and the Solar Panel.</p></body></html>'
    pages = spark.createDataFrame([(1, "http://h.org/x", html), (2, "http://h.org/y", '<html lang="xx"><p>word</p>'), (3, None, '<html lang="en"></html>')],
                                  "page_id long, url string, html string")
    got = {r["page_id"]: r for r in L.extract_terms(pages).collect()}
    assert set(got) == {1, 3} and got[1]["host"] == "h.org" and got[1]["title"] == "T"
    text = got[1]["text"]
    assert [text[a["begin"]:a["end"]] for a in got[1]["sentences"]] == text.split("\n")
    found = Counter((text[a["begin"]:a["end"]].lower(), a["value"]) for a in got[1]["tokens"])
    assert found[("solar panel", "solar panel")] == 3 and all(a == b for a, b in found)
    assert [(a["value"], a["label"]) for a in got[1]["entities"]] == [("€12", "MONEY")]
    assert got[3]["sentences"] == got[3]["tokens"] == got[3]["entities"] == []


def test_term_counts_against_plain_python(spark):
    rng = random.Random(2)
    words = ["ab", "Ab", "cd", "ef", "x", "gh"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [""]
    vocab = ["ab", "Ab", "ab cd", "cd ab cd", "ef ef", "zz", "ab x", "cd", "gh gh gh gh"]
    df = docs_df(spark, texts)
    v = spark.createDataFrame([(t,) for t in vocab + ["ab"]], "term string")

    def grams(t, n, lower):
        w = re.findall(r"\w\w+", t.lower() if lower else t)
        return [" ".join(w[i:i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]
    tf = {r["term"]: r["tf"] for r in T.term_frequency(df, v, 2).collect()}
    assert tf == {t: sum(grams(x, 2, False).count(t) for x in texts) for t in vocab}
    df_ = {r["term"]: r["df"] for r in T.term_idf(df, v, 2).collect()}
    assert df_ == {t: sum(t in grams(x, 3, True) for x in texts) for t in vocab}
