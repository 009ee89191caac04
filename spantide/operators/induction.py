"""A gazetteer from the corpus itself (N1): names scored over the contexts they stand in.

Runs of capitalised tokens and the words left and right of them are the two sides of a graph, an edge
per (run, context) with the number of places. Some contexts are seeds with a label. In each round a
run takes the mean score of its contexts, by label, and every context that is no seed the mean score of its
runs; each is one join on the context or the run and one sum, however many runs a context has.
Scores are whole numbers, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantide.functions.text import part
from spantide.operators.terms import listed
from spantide.session import cut_lineage

ONE = 1_000_000        # the score of a seed
# Contexts that give a label away, (language, side, word, label).
SEEDS = (
    ("en", "left", "mr", "PERSON"), ("en", "left", "mrs", "PERSON"), ("en", "left", "dr", "PERSON"), ("en", "left", "president", "PERSON"),
    ("en", "right", "said", "PERSON"), ("en", "right", "inc", "ORG"), ("en", "right", "ltd", "ORG"), ("en", "left", "at", "ORG"), ("en", "left", "by", "ORG"),
    ("en", "left", "in", "GPE"), ("en", "left", "from", "GPE"), ("en", "left", "near", "LOC"), ("en", "left", "river", "LOC"),
    ("fr", "left", "monsieur", "PERSON"), ("fr", "left", "madame", "PERSON"), ("fr", "left", "par", "PERSON"), ("fr", "left", "chez", "ORG"), ("fr", "left", "pour", "ORG"),
    ("fr", "left", "dans", "LOC"), ("fr", "left", "à", "GPE"),
    ("de", "left", "herr", "PERSON"), ("de", "left", "frau", "PERSON"), ("de", "left", "von", "PERSON"), ("de", "right", "gmbh", "ORG"), ("de", "left", "bei", "ORG"),
    ("de", "left", "in", "GPE"), ("de", "left", "aus", "GPE"), ("de", "left", "am", "LOC"),
    ("es", "left", "señor", "PERSON"), ("es", "left", "señora", "PERSON"), ("es", "left", "por", "PERSON"), ("es", "left", "en", "GPE"), ("es", "left", "desde", "GPE"),
    ("nl", "left", "meneer", "PERSON"), ("nl", "left", "mevrouw", "PERSON"), ("nl", "left", "in", "GPE"), ("nl", "left", "bij", "ORG"),
    ("en", "right", "is", "PERSON"), ("en", "right", "was", "PERSON"), ("fr", "right", "est", "PERSON"), ("de", "right", "ist", "PERSON"), ("es", "right", "es", "PERSON"),
    ("it", "left", "signor", "PERSON"), ("it", "left", "signora", "PERSON"), ("it", "left", "a", "GPE"), ("it", "left", "presso", "ORG"),
)
EDGE = "^"             # the context of a run at its sentence's end


def name_runs(toks: DataFrame) -> DataFrame:
    """``(lang, doc_id, run, side, context)``: the maximal runs of PROPN tokens of T1, as rows or as ``token_lists``, and the
    lower-cased tokens left and right of them. Runs are cut out of the arrays of their sentence, so no token is sorted."""
    x = listed(toks).withColumn("_p", F.transform("_pos", lambda p: p == "PROPN"))
    x = x.where(F.array_contains("_p", True))

    def edges(step):
        """Places of the tokens of runs whose neighbour ``step`` further belongs to none."""
        at = F.transform("_p", lambda p, i: F.when(p & ~F.coalesce(F.get(F.col("_p"), i + step), F.lit(False)), i))
        return F.filter(at, lambda i: i.isNotNull())

    def run(a, b):
        text = F.rtrim(F.array_join(part("_units", a, b + 1), ""))
        side = lambda name, i: F.struct(F.lit(name).alias("side"), F.lower(F.coalesce(F.get(F.col("_texts"), i), F.lit(EDGE))).alias("context"))
        return F.struct(text.alias("run"), F.array(side("left", a - 1), side("right", b + 1)).alias("sides"))
    r = x.select("lang", "doc_id", F.inline(F.zip_with(edges(-1), edges(1), run)))
    return r.select("lang", "doc_id", "run", F.inline("sides"))


def induce(runs: DataFrame, seeds=SEEDS, rounds: int = 2, min_places: int = 2, min_score: int = ONE // 10) -> DataFrame:
    """``(lang, run, label, score, n)``: the runs with at least ``min_places`` contexts in all whose best label scores
    ``min_score`` or more, the first label by letters of equal ones."""
    spark = runs.sparkSession
    edges = cut_lineage(runs.groupBy("lang", "run", "side", "context").agg(F.count("*").alias("n")))
    seed = F.broadcast(spark.createDataFrame(list(seeds), "lang string, side string, context string, label string"))      # a fixed list
    place = ["lang", "side", "context"]
    fixed = seed.withColumn("score", F.lit(ONE).cast("long"))
    score = fixed
    totals = edges.groupBy("lang", "run").agg(F.sum("n").alias("total"))
    for k in range(rounds):
        by_run = edges.join(score, place).groupBy("lang", "run", "label").agg(F.sum(F.col("n") * F.col("score")).alias("s"))
        by_run = by_run.join(totals, ["lang", "run"]).select("lang", "run", "label", F.expr("s div total").alias("score"), F.col("total").alias("n"))
        if k + 1 < rounds:
            by_run = cut_lineage(by_run)
            free = edges.join(seed.select(*place).distinct(), place, "left_anti")
            weight = free.groupBy(*place).agg(F.sum("n").alias("total"))
            by_context = free.join(by_run.select("lang", "run", "label", "score"), ["lang", "run"]).groupBy(*place, "label").agg(F.sum(F.col("n") * F.col("score")).alias("s"))
            by_context = by_context.join(weight, place).select(*place, "label", F.expr("s div total").alias("score"))
            score = fixed.unionByName(cut_lineage(by_context.where("score > 0")))
    best = F.min(F.struct((-F.col("score")).alias("a"), "label")).alias("b")
    out = by_run.groupBy("lang", "run", "n").agg(best)
    return out.select("lang", "run", F.col("b.label").alias("label"), (-F.col("b.a")).alias("score"), "n").where((F.col("n") >= min_places) & (F.col("score") >= min_score))
