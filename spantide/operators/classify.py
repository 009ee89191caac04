"""Sentence classification support (C1-C16) as DataFrame operators.

Model training and scoring are MLlib jobs (``train_linear``); everything around
them - cleaning, splits, weights, thresholds, metrics, losses - is plain
aggregation and is checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantide.functions.text import n_words, strip

# Extra characters that, with ASCII punctuation and digits, make a
# segment "numbers and punctuation only" (C1).
EXTRA_PUNCT = "∙ —…·+“√≤<≥>⋅■£½÷«°»–†‡"
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _class(chars: str) -> str:
    return "[0-9" + "".join("\\" + c if c in "[]\\^-" else c for c in chars) + "]"


NUMPUNCT_RE = "^" + _class(ASCII_PUNCT + EXTRA_PUNCT) + "+$"


def clean_text(text, min_words: int = 6, exclude_pattern: bool = True) -> Column:
    """Split on newline and tab, strip, drop empty segments, segments of at most
    ``min_words`` words and (optionally) digit/punctuation-only ones; join by newline."""
    t = F.col(text) if isinstance(text, str) else text
    segs = F.transform(F.split(t, r"[\n\t]", -1), lambda s: strip(s))

    def keep(s):
        k = (s != "") & (n_words(s) > min_words)
        return k & ~s.rlike(NUMPUNCT_RE) if exclude_pattern else k

    return F.array_join(F.filter(segs, keep), "\n")


def class_weights(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label, n, weight = 1/n)``."""
    return (labels.groupBy(label_col).agg(F.count("*").alias("n"))
                  .withColumn("weight", 1.0 / F.col("n")))


def sample_weights(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Every row with the weight of its class (for weighted sampling / weightCol)."""
    w = class_weights(labels, label_col).select(label_col, "weight")
    return labels.join(F.broadcast(w), label_col)      # a row per class


def pos_weights(labels: DataFrame, label_cols) -> DataFrame:
    """Multi-label positive weight per position ``N / positives - 1`` (null when a
    label has no positive). ``(pos, n_pos, weight)``."""
    arr = F.array(*[F.col(c).cast("long") for c in label_cols])
    x = labels.select(F.posexplode(arr).alias("pos", "y"))
    n = labels.agg(F.count("*")).scalar()
    g = x.groupBy("pos").agg(F.sum("y").alias("n_pos"))
    return g.select(F.col("pos").cast("long").alias("pos"), "n_pos",
                    F.when(F.col("n_pos") > 0, n / F.col("n_pos") - 1).alias("weight"))


def stratified_split(df: DataFrame, label_col: str, id_col: str, val_share: float = 0.1,
                     seed: int = 2022) -> DataFrame:
    """C4: per label, the first ``ceil(share * n)`` rows in md5(id || seed) order are
    validation rows. Deterministic and independent of partitioning; ``id_col`` is unique."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    x = df.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), h.alias("_h"), F.substring(h, 1, 3).alias("_p"))
    # labels are few, so rows are ranked per (label, first three digits of the hash): 4096 parts each
    per = x.groupBy("_label", "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_label")
    per = per.select(F.col("_label").alias("_l2"), F.col("_p").alias("_p2"),
                     F.coalesce(F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
                     F.ceil(F.sum("_c").over(w) * val_share).alias("_quota"))
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy("_label", "_p").orderBy("_h", "_id")))
    x = x.join(per, F.col("_label").eqNullSafe(F.col("_l2")) & F.col("_p").eqNullSafe(F.col("_p2")))
    x = x.select("_id", (F.col("_base") + F.col("_rn") <= F.col("_quota")).alias("is_val"))
    return df.join(x, F.col(id_col) == F.col("_id")).drop("_id")


def argmax(p) -> Column:
    """Index of the (first) largest probability."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def threshold(p, t: float = 0.5) -> Column:
    """C11: multi-label decision, inclusive threshold on the sigmoid."""
    p = F.col(p) if isinstance(p, str) else p
    return F.transform(p, lambda x: (1.0 / (1.0 + F.exp(-x)) >= t).cast("int"))


def with_empty_defaults(scored: DataFrame, cleaned_col: str, label_col: str, proba_cols,
                        default_label: int = 0) -> DataFrame:
    """Rows whose cleaned text is empty keep their place with the default
    label and probabilities -1.0."""
    empty = F.col(cleaned_col) == ""
    out = scored.withColumn(label_col, F.when(empty, F.lit(default_label)).otherwise(F.col(label_col)))
    for c in proba_cols:
        out = out.withColumn(c, F.when(empty, F.lit(-1.0)).otherwise(F.col(c).cast("double")))
    return out


def class_report(pred: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """C14: precision, recall, F1 and support per class, then macro and weighted
    averages (zero when undefined). ``(cls, precision, recall, f1, support)``."""
    a = pred.select(F.col(label_col).alias("cls"), F.lit(1).alias("sup"), F.lit(0).alias("np"),
                    (F.col(label_col) == F.col(pred_col)).cast("int").alias("tp"))
    b = pred.select(F.col(pred_col).alias("cls"), F.lit(0).alias("sup"), F.lit(1).alias("np"), F.lit(0).alias("tp"))
    g = a.unionByName(b).groupBy("cls").agg(F.sum("sup").alias("support"), F.sum("np").alias("n_pred"),
                                            F.sum("tp").alias("tp"))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = g.select(F.col("cls").cast("string").alias("cls"), p.alias("precision"), r.alias("recall"),
                   "support")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                         .otherwise(F.lit(0.0)))
    macro = per.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    tot = F.sum("support")
    weighted = per.agg(F.lit("weighted avg").alias("cls"),
                       (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("support"))
    cols = ["cls", "precision", "recall", "f1", "support"]
    return per.select(*cols).unionByName(macro.select(*cols)).unionByName(weighted.select(*cols))


def mean_losses(scored: DataFrame) -> DataFrame:
    """Over ``(label, x)``, with ``label`` a place in the scores ``x``, the mean
    cross-entropy of softmax(x) and the mean binary cross-entropy of every element on one-hot
    targets, positives weighted by ``N / positives - 1`` (classes without positives count for
    their negatives only). Shifted, so that large scores do not overflow.
    ``(n, ce_loss, bce_loss)``, rounded to six digits."""
    top = F.array_max("x")
    lse = top + F.ln(F.aggregate(F.transform("x", lambda v: F.exp(v - F.array_max("x"))), F.lit(0.0), lambda a, b: a + b))
    s = scored.select("label", "x", (lse - F.element_at("x", F.col("label") + 1)).alias("ce"))
    el = s.select("label", F.posexplode("x").alias("j", "v"))
    y = F.col("label") == F.col("j")
    soft = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    per = el.groupBy("j").agg(F.count("*").alias("n"), F.sum(y.cast("int")).alias("pos"),
                              F.sum(F.when(y, soft(-F.col("v"))).otherwise(0.0)).alias("on"),
                              F.sum(F.when(~y, soft(F.col("v"))).otherwise(0.0)).alias("off"))
    weighted = F.when(F.col("pos") > 0, (F.col("n") / F.col("pos") - 1) * F.col("on")).otherwise(F.lit(0.0)) + F.col("off")
    bce = per.agg(F.round(F.sum(weighted) / F.sum("n"), 6)).scalar()         # a row per class before
    return s.agg(F.count("*").alias("n"), F.round(F.avg("ce"), 6).alias("ce_loss")).withColumn("bce_loss", bce)


def train_linear(train: DataFrame, text_col: str = "text", label_col: str = "label",
                 weight_col: str | None = None, num_features: int = 1 << 18, max_iter: int = 20):
    """C9 (re-aimed): word 1-3-gram hashing + IDF + logistic regression in MLlib."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer

    tok = RegexTokenizer(inputCol=text_col, outputCol="_w", pattern=r"[\p{L}\p{N}_]+", gaps=False)
    ngs = [NGram(n=n, inputCol="_w", outputCol=f"_g{n}") for n in (2, 3)]
    cat = SQLTransformer(statement="SELECT *, concat(_w, _g2, _g3) AS _all FROM __THIS__")
    tf = HashingTF(inputCol="_all", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_feat")
    lr = LogisticRegression(featuresCol="_feat", labelCol=label_col, maxIter=max_iter,
                            weightCol=weight_col) if weight_col else \
        LogisticRegression(featuresCol="_feat", labelCol=label_col, maxIter=max_iter)
    return Pipeline(stages=[tok, *ngs, cat, tf, idf, lr]).fit(train)


def predict(model, df: DataFrame) -> DataFrame:
    """``label`` (argmax) and ``proba array<double>``."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    return (out.withColumn("proba", vector_to_array("probability"))
               .withColumn("pred", argmax("proba"))
               .drop(*[c for c in out.columns if c.startswith("_")], "rawPrediction", "probability", "prediction"))
