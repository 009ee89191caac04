"""Linear text classifiers, one per label, from one feature table.

Features are hashed word 1-3-grams weighted by tf-idf, a row of index and value arrays per text, written
once. All labels are trained together by full-batch AdaGrad on the weighted logistic loss: in each
iteration tasks add up the gradient of their rows, an aggregation by feature adds up the tasks, and what
reaches the driver, as the weights that go out, is ``num_features + 1`` rows at most, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantide.functions.text import part
from spantide.session import cut_lineage

NUM_FEATURES = 1 << 16
WORD_RE = r"[\p{L}\p{N}_]+"


def text_features(texts: DataFrame, id_col: str, text_col: str = "text", num_features: int = NUM_FEATURES, max_n: int = 3,
                  idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id_col, fs array<int>, xs array<double>)`` of every text, of length 1 or, without words, empty; and the
    inverse document frequencies ``(f, idf)``, which are taken from the texts unless they are given."""
    t = texts.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).repartition("_id")      # the n-grams of a text stay where it is
    t = t.select("_id", F.regexp_extract_all(F.lower("t"), F.lit(WORD_RE), F.lit(0)).alias("t"))
    starts = t.select("_id", F.explode(F.transform("t", lambda _, i: part("t", i, F.least(i + max_n, F.size("t"))))).alias("a"))
    upto = [F.when(F.size("a") >= n, F.concat_ws(" ", *[F.get("a", F.lit(k)) for k in range(n)])) for n in range(1, max_n + 1)]
    grams = starts.select("_id", F.explode(F.array(*upto)).alias("g")).where(F.col("g").isNotNull())
    counts = grams.groupBy("_id", F.pmod(F.xxhash64("g"), F.lit(num_features)).cast("int").alias("f")).agg(F.count("*").alias("tf"))
    if idf is None:
        counts = cut_lineage(counts)
        n = texts.agg(F.count("*")).scalar()
        idf = cut_lineage(counts.groupBy("f").agg(F.count("*").alias("df")).select("f", (F.ln((n + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    x = counts.join(F.broadcast(idf), "f").select("_id", "f", (F.col("tf") * F.col("idf")).alias("x"))      # num_features rows at most
    x = x.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    out = texts.select(id_col).join(x, F.col(id_col) == F.col("_id"), "left")
    return out.select(id_col, F.coalesce("v.f", F.array().cast("array<int>")).alias("fs"),
                      F.coalesce(F.transform("v", lambda e: e["x"] / F.col("norm")), F.array().cast("array<double>")).alias("xs")), idf


def _margins(block, weights):
    """(row numbers, features, values, margins) of an Arrow block; the last weight of each label stands alone."""
    import numpy as np
    fs = block.column("fs")
    rows = np.repeat(np.arange(block.num_rows), fs.value_lengths().to_numpy(zero_copy_only=False).astype("int64"))
    f, x = fs.flatten().to_numpy(zero_copy_only=False), block.column("xs").flatten().to_numpy(zero_copy_only=False)
    m = np.stack([np.bincount(rows, x * w[f], block.num_rows) + w[-1] for w in weights.T], axis=1)
    return rows, f, x, m


def gradient(rows: DataFrame, weights, pos_weights) -> DataFrame:
    """``(f, g array<double>)``: the summed gradient of the loss of ``rows`` (fs, xs, ys) per feature; the feature
    after the last one is the constant."""
    held = rows.sparkSession.sparkContext.broadcast(weights)                # num_features + 1 rows

    def add(batches):
        import numpy as np
        import pyarrow as pa
        w = held.value
        total = np.zeros_like(w)
        for b in batches:
            r, f, x, m = _margins(b, w)
            y = np.stack(b.column("ys").to_numpy(zero_copy_only=False)).astype("float64") if b.num_rows else np.zeros((0, w.shape[1]))
            p = 1.0 / (1.0 + np.exp(-m))
            d = np.where(y > 0, (p - 1.0) * pos_weights, p)
            for j in range(w.shape[1]):
                total[:, j] += np.bincount(f, x * d[r, j], len(w))
            total[-1] += d.sum(axis=0)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["f", "g"])

    parts = rows.select("fs", "xs", "ys").mapInArrow(add, "f int, g array<double>")
    k = weights.shape[1]
    return parts.groupBy("f").agg(F.array(*[F.sum(F.col("g")[j]) for j in range(k)]).alias("g"))


def train(rows: DataFrame, pos_weights: Sequence[float], num_features: int = NUM_FEATURES, iterations: int = 15, rate: float = 0.5):
    """Weights (num_features + 1, labels) for ``rows`` (fs, xs, ys array<int>): one model per label, positives of label j
    weighted by ``pos_weights[j]`` (C8)."""
    import numpy as np
    rows = cut_lineage(rows.select("fs", "xs", "ys"))
    n = max(1, rows.count())
    w = np.zeros((num_features + 1, len(pos_weights)))
    seen = np.zeros_like(w)
    for _ in range(iterations):
        got = gradient(rows, w, np.asarray(pos_weights, "float64")).collect()             # num_features + 1 rows at most
        if not got:
            break
        at = np.array([r["f"] for r in got])
        g = np.array([r["g"] for r in got]) / n
        seen[at] += g * g
        w[at] -= rate * g / np.sqrt(seen[at] + 1e-12)
    return w


def predict(rows: DataFrame, weights, id_col: str) -> DataFrame:
    """``(id_col, proba array<double>)``, the probability of every label, all labels in one pass."""
    held = rows.sparkSession.sparkContext.broadcast(weights)
    kind = rows.select(id_col).schema.fields[0].dataType.simpleString()

    def score(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            m = _margins(b, held.value)[3]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(1.0 / (1.0 + np.exp(-m))), pa.list_(pa.float64()))], names=["id", "proba"])
    return rows.select(id_col, "fs", "xs").mapInArrow(score, f"id {kind}, proba array<double>").withColumnRenamed("id", id_col)


def train_texts(train_rows: DataFrame, id_col: str, label_cols: list, text_col: str = "text", num_features: int = NUM_FEATURES, **kw):
    """``(weights, idf)`` from texts with 0/1 labels. A label without positives, or with only positives, has weight 1."""
    n, *pos = train_rows.agg(F.count("*"), *[F.sum(F.col(c).cast("long")) for c in label_cols]).first()      # a number per label
    x, idf = text_features(train_rows, id_col, text_col, num_features)
    ys = train_rows.select(F.col(id_col).alias("_y"), F.array(*[F.col(c).cast("int") for c in label_cols]).alias("ys"))
    x = x.join(ys, F.col(id_col) == F.col("_y"))
    return train(x, [(n / p - 1) or 1.0 if p else 1.0 for p in pos], num_features, **kw), idf


def predict_texts(texts: DataFrame, model, id_col: str, text_col: str = "text") -> DataFrame:
    weights, idf = model
    x, _ = text_features(texts, id_col, text_col, len(weights) - 1, idf=idf)
    return predict(x, weights, id_col)
