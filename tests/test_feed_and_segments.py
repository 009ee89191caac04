"""Q5 against the plain fold; L7: sinks of a batch, run again."""

import random

from conftest import docs_df
from spantide.operators import induction as I
from spantide.operators import qa as Q
from spantide.operators import terms as T
from spantide.streaming import feed


def plain_segments(text, most):
    out = []
    for line in [x for x in text.split("\n") if x]:
        if not out or out[-1][1] >= most:
            out.append([[], 0])
        out[-1][0].append(line)
        out[-1][1] += len(line.split())
    return [(k, " ".join(lines), n) for k, (lines, n) in enumerate(out)]


def test_segments_against_the_fold(spark):
    rng = random.Random(8)
    texts = ["\n".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 0, 1, 3, 9]))) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40)))
             for _ in range(60)] + ["", "\n\n", " \n \n ", "one"]
    for most in (1, 7, 490):
        got = {}
        for r in Q.segments(docs_df(spark, texts), most).collect():
            got.setdefault(r["doc_id"], []).append((r["seg_no"], r["text"], r["n_tokens"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: plain_segments(t, most) for k, t in enumerate(texts) if plain_segments(t, most)}


def test_page_sinks_and_repeated_batches(spark, tmp_path):
    html = '<html lang="en"><title>T</title><p>Call 12345678 now?</p><p>The solar panel.</p></html>'
    rows = [(k, f"http://h/{k}", "w", "", html) for k in range(6)]
    page = spark.createDataFrame(rows, "page_id long, url string, website string, date string, content_html string")
    page.repartition(3).write.json(f"{tmp_path}/in")
    feed.run_page_feed(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c", max_files_per_trigger=1)
    counts = {s: spark.read.parquet(f"{tmp_path}/out/{s}").count() for s in ("records", "annotations", "contacts", "questions")}
    batch = feed.page_sinks(page)
    assert counts == {s: d.count() for s, d in batch.items()} and counts["records"] == counts["contacts"] == counts["questions"] == 6
    feed.run_page_feed(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c2", max_files_per_trigger=1)      # as after a lost checkpoint
    assert counts == {s: spark.read.parquet(f"{tmp_path}/out/{s}").count() for s in counts}


def test_misspellings(spark):
    good, bad = ["receive", "solar"], ["recieve", "receve", "sola", "solars", "tomorrow"]
    rows = [(i, "en", w) for i in range(200) for w in good] + [(i, "en", w) for i, w in enumerate(bad)] + [(7, "fr", "solart"), (8, "en", "Receivee")]
    toks = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r["word"]: (r["n_docs"], r["suggestion"], r["suggestion_docs"]) for r in T.misspellings(toks).collect()}
    assert got == {"receve": (1, "receive", 200), "sola": (1, "solar", 200), "solars": (1, "solar", 200), "receivee": (1, "receive", 200)}
    terms = spark.createDataFrame([(1, "solar panel", "en"), (1, "Sola panel", "en"), (2, "sola", "fr")], "doc_id long, term string, lang string")
    assert sorted(r["term"] for r in T.spelled_terms(terms, T.misspellings(toks)).collect()) == ["sola", "solar panel"]


def test_names_from_contexts(spark):
    """A name that never stands in a seed context gets its label over a context it shares."""
    lines = ["we met mr Adams today", "then Adams slept", "then Baker slept", "we live in Paris now", "the Sea", "it was Zzyzx there"]
    runs = [("en", 1, n, s, c) for line in lines for n in [next(w for w in line.split() if w[0].isupper())]
            for s, c in (("left", line.split()[line.split().index(n) - 1]), ("right", [*line.split(), "^"][line.split().index(n) + 1]))]
    df = spark.createDataFrame(runs, "lang string, doc_id long, run string, side string, context string")
    got = {r["run"]: (r["label"], r["score"], r["n"]) for r in I.induce(df, rounds=2, min_score=1).collect()}
    assert got["Adams"][0] == got["Baker"][0] == "PERSON" and got["Paris"][0] == "GPE"
    assert "Sea" not in got and got["Adams"][1] > got["Baker"][1] > 0
    once = {r["run"] for r in I.induce(df, rounds=1, min_score=1).collect()}
    assert "Baker" not in once
