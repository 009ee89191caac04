"""Exact top-k search, hard negatives and the Merkle manifest against SQL and plain Python."""

import hashlib
import math
import os
import sys
import zlib

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
import pytest  # noqa: E402
from helpers import duck, odd_rows, spark_rows, table  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from spantide.llm import merkle, negatives, topk  # noqa: E402
from spantide.llm import vectors as V  # noqa: E402

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int, v string, id long, score int, anchor long, chunk int, `a b` string"


def vectors(spark, n=260, d=13, seed=3):
    """Clustered vectors with ties, repeated rows and rows that take no part, and clashing extra columns."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    rows = []
    for k in range(n):
        v = (centres[k % 4] + rng.normal(size=d) * 0.5).round(2).tolist()
        rows.append((k, v, int(k % 4 if k % 9 else rng.integers(0, 10))))
    rows += [(n + k, rows[k % 3][1], rows[k % 3][2]) for k in range(40)]                # a third vector many times over
    rows += [rows[50], rows[100], rows[100], (150, rows[7][1], 2)]                        # repeated ids, equal and not
    rows += [(n + 50, None, 1), (None, rows[1][1], 1), (n + 51, [1.0, None] + [0.0] * (d - 2), 1), (n + 52, [float("nan")] * d, 1),
             (n + 53, [math.inf] + [0.0] * (d - 1), 1), (n + 54, rows[2][1], None), (1000, [0.0] * d, 3), (1050, [], 2), (1100, [0.5] * (d - 3), 2)]
    return spark.createDataFrame([(i, v, c, "x", 1, 2, 3, 4, "y") for i, v, c in rows], KIND)


@pytest.fixture
def folder(spark, tmp_path):
    def put(df, name):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return put


@pytest.mark.parametrize("op", [topk, negatives])
def test_vector_queries_against_sql(spark, folder, op):
    df = vectors(spark)
    assert spark_rows(op.query(spark, folder(df.repartition(3), "embeddings"))) == duck(op.ORACLE_SQL, df, "embeddings")
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert spark_rows(op.query(spark, SF)) == duck(op.ORACLE_SQL, df, "embeddings")


@pytest.mark.parametrize("op", [topk, negatives])
def test_vector_queries_on_few_rows(spark, folder, op, tmp_path):
    df = vectors(spark)
    assert op.query(spark, folder(df.where("false"), "embeddings")).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.0], 2)], "vec_id long, embedding array<double>, label long")
    few.write.parquet(f"{tmp_path}/few/embeddings.parquet")
    assert spark_rows(op.query(spark, f"{tmp_path}/few")) == duck(op.ORACLE_SQL, few, "embeddings")


def brute_top(q, qid, x, xid, k):
    s = q.astype(object) @ x.astype(object).T
    return [[(s[a, r], xid[r]) for r in sorted((r for r in range(len(x)) if xid[r] != qid[a]), key=lambda r: (-s[a, r], xid[r]))[:k]] for a in range(len(q))]


@pytest.mark.parametrize("most", [40, 10 ** 6, 1 << 28])
def test_branch_and_bound_against_brute_force(most):
    """Small numbers with many ties, usual ones, and ones beyond double arithmetic."""
    rng = np.random.default_rng(most)
    x = rng.integers(-most, most, (500, 21)) // (1 + np.arange(21) // 4)
    x[100:140] = x[100]
    xid, q, qid = np.arange(500) * 3, x[:30], np.arange(30) * 3
    qi, ri, score = topk._found(q, qid, x.T, xid, 7, np.full(30, -np.inf))
    place, rank = V.best_of(qi, score, xid[ri], 7)
    got = [[(int(score[p]), int(xid[ri[p]])) for p in place if qi[p] == a] for a in range(30)]
    assert got == brute_top(q, qid, x, xid, 7)
    if most < 1 << 28:      # pruned: not every pair comes through
        assert len(qi) < 30 * 499


def test_whole_numbers_fail_rather_than_round(spark):
    df = spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="53 bits"):
        V.whole_numbers(df, 4, "vec_id", "embedding").collect()
    with pytest.raises(OverflowError):
        V.wide_scores(np.full((1, 4), 1 << 40), np.full((1, 4), 1 << 40))


def test_boxes_hold_their_rows():
    rng = np.random.default_rng(1)
    x = rng.integers(-90, 90, (333, 5)).astype("float64")
    order, ends = negatives.tiles(x, 16)
    assert sorted(order.tolist()) == list(range(333)) and ends[-1] == 333 and max(np.diff(np.r_[0, ends])) <= 16
    t, q = x[order], rng.integers(-90, 90, (9, 5)).astype("float64")
    for low, high, step in zip(*zip(*negatives.boxes(t, ends)), (1, negatives.FAN)):
        lo, hi = negatives.intervals(q, low, high)
        starts = np.r_[0, ends[:-1]][::step]
        stops = np.r_[starts[1:], 333]
        for b, (s, e) in enumerate(zip(starts, stops)):
            inner = q @ t[s:e].T
            assert (lo[:, b] <= inner.min(axis=1)).all() and (hi[:, b] >= inner.max(axis=1)).all()


def test_tree_search_prunes_and_stays_exact():
    """Far clusters: most leaves are never scored, and windows are kept to."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-20, 20, (200, 3)) + c for c in ([900, 0, 0], [0, 900, 0], [-900, 0, 0], [0, 0, -900])]).astype("float64")
    order, ends = negatives.tiles(x, 16)
    x, ids, labels = x[order], order, order % 3
    q, windows = x[:5], np.array([[[300000, 800000], [-100, 100], [5, 4]]] * 5, "float64")
    a, w, r, s = negatives.search_tree(q, ids[:5], labels[:5], (x, ids, labels, ends), windows, np.full((5, 3), -np.inf), 4, False)
    place, _ = V.best_of(a * 3 + w, s, ids[r], 4)
    got = [(int(a[p]), int(w[p]), int(s[p]), int(ids[r[p]])) for p in place]
    want = []
    inner = q @ x.T
    for k in range(5):
        for j, (lo, hi) in enumerate(windows[k]):
            fit = [(-int(inner[k, t]), int(ids[t])) for t in range(len(x)) if lo <= inner[k, t] <= hi and labels[t] != labels[k]]
            want += [(k, j, -s0, i) for s0, i in sorted(fit)[:4]]
    assert got == want and len(a) < 5 * 600


# ---- Merkle manifest --------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(level):
    """(root, steps per leaf) of a list of digests."""
    steps, runs = [[] for _ in level], [(h, [i]) for i, h in enumerate(level)]
    while len(runs) > 1:
        above = []
        for a in range(0, len(runs), 2):
            pair = runs[a:a + 2]
            for side, (_, leaves) in enumerate(pair):
                for i in leaves:
                    steps[i].append("=" if len(pair) == 1 else "L" + pair[0][0] if side else "R" + pair[1][0])
            above.append((sha(*[h for h, _ in pair]), sum([x for _, x in pair], [])))
        runs = above
    return runs[0][0], steps


def brute_manifest(rows):
    def leaf(r):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names]
    root, upper = tree([s[0] for s in subs]) if subs else (None, [])
    out = []
    for g, (subroot, steps), up in zip(names, subs, upper):
        for (_, _, h, r), own in zip(sorted(groups[g], key=lambda x: x[:3]), steps):
            way, at = own + up, h
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                at = leaf((*r[:3], r[3] + 1, r[4]))
            for s in way:
                at = sha(at) if s == "=" else sha(s[1:], at) if s[0] == "L" else sha(at, s[1:])
            out.append((r[0], at, h, sha(*[s[1:] for s in way]), root, subroot, at == root))
    return sorted(out, key=repr)


def odd_manifest_rows(spark):
    docs = table(spark, odd_rows())
    lang = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") == 9, "zz").when(F.col("doc_id") % 5 == 1, "é").otherwise("en")
    more = spark.range(600).select((F.col("id") + 100).alias("doc_id"), F.lit("t").alias("text"), F.lit("de").alias("lang"), F.lit(None).cast("string").alias("source"),
                                   F.lit(1).cast("long").alias("n_chars"))
    return docs.withColumn("lang", lang).unionByName(more, allowMissingColumns=True).withColumn("group", F.lit("g")).withColumn("hash", F.lit(1)).withColumn("rank", F.lit(0))


def test_merkle_against_brute_force_and_sql(spark, folder):
    df = odd_manifest_rows(spark)
    got = spark_rows(merkle.query(spark, folder(df.repartition(5), "documents")))
    assert got == brute_manifest([tuple(r) for r in df.select(*merkle.FIELDS).collect()])
    assert {r[-1] for r in got} == {True, False}
    plain = df.where("doc_id is not null").dropDuplicates(["doc_id"]).select(*merkle.FIELDS).cache()
    m = merkle.manifest(plain, bits=2)
    sql = [(r[0], r[2], r[4], r[5]) for r in duck(merkle.ORACLE_SQL, plain)]
    assert sorted(map(tuple, m.select("id", "leaf", "root", "subroot").collect())) == sorted(sql)


def test_merkle_on_sf(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert spark_rows(merkle.query(spark, SF)) == duck(merkle.ORACLE_SQL, docs)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 17])
def test_merkle_sizes(spark, n):
    rows = [(k, "s", "en", None, f"text {k}") for k in range(n)]
    m = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), bits=2)
    got = m.select("id", "leaf", "root", merkle.folded(F.col("leaf"), F.col("steps")).alias("folded"), F.size("steps").alias("n")).collect()
    want = tree([sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r]) for r in rows]) if n else None
    assert len(got) == n and all(r.folded == r.root == want[0] for r in got)
    assert {r.n for r in got} == {len(s) for s in want[1]} if n else True
