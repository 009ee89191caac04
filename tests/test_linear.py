"""The distributed trainer against the same steps in plain numpy, and held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F
from spantide.operators import linear as LR


def texts(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.random() < 0.4, rng.random() < 0.2
        words = [rng.choice(["common", "filler", "word", "thing"]) for _ in range(12)] + ["sun shines"] * a + ["heavy rain"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a), int(b)))
    return spark.createDataFrame(rows + [(n, "", 0, 0), (n + 1, None, 0, 0)], "id long, text string, a int, b int")


def test_training_equals_numpy(spark):
    df = texts(spark, 60, 1)
    x, idf = LR.text_features(df, "id", num_features=64)
    rows = x.join(df.select("id", F.array("a", "b").alias("ys")), "id").cache()
    got = LR.train(rows.repartition(3), [1.5, 4.0], 64, iterations=4)
    m, y = np.zeros((62, 65)), np.zeros((62, 2))
    for k, r in enumerate(rows.collect()):
        m[k, r["fs"]], m[k, 64], y[k] = r["xs"], 1.0, r["ys"]
        assert not r["fs"] or abs(sum(v * v for v in r["xs"]) - 1) < 1e-9
    w, seen = np.zeros((65, 2)), np.zeros((65, 2))
    for _ in range(4):
        p = 1 / (1 + np.exp(-m @ w))
        g = m.T @ np.where(y > 0, (p - 1) * [1.5, 4.0], p) / 62
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen + 1e-12)
    assert np.allclose(got, w, atol=1e-6)
    p = {r["id"]: r["proba"] for r in LR.predict(x, got, "id").collect()}
    assert len(p) == 62 and abs(p[60][0] - 1 / (1 + np.exp(-got[64, 0]))) < 1e-12
    assert idf.count() <= 64


def test_held_out_accuracy(spark):
    model = LR.train_texts(texts(spark, 300, 2), "id", ["a", "b"], num_features=4096)
    new = texts(spark, 100, 3)
    got = {r["id"]: r["proba"] for r in LR.predict_texts(new, model, "id").collect()}
    hits = [tuple(int(v >= 0.5) for v in got[r["id"]]) == (r["a"], r["b"]) for r in new.collect()]
    assert len(got) == 102 and sum(hits) >= 97
    one = spark.createDataFrame([(1, "x y", 1, 0)], "id long, text string, a int, b int")
    assert LR.train_texts(one, "id", ["a", "b"], num_features=16)[0].shape == (17, 2)
