"""Exact top-k search by columnar branch-and-bound.

A block of rows lies in columns, one per dimension, the dimensions with the largest sums of
squares first. Inner products accumulate block of dimensions by block of dimensions. What the
dimensions still to come can add or take away is at most the product of the two remaining norms
(Cauchy-Schwarz), so partial sums give bounds: the k-th largest lower bound of a query, the k-th
best score of earlier blocks of the task and that of the query's own block of queries (all of them
rows too) are thresholds, and rows whose upper bound is strictly below go. While most (query,
row) pairs live the sums are dense; then the survivors are compacted to a list of pairs, which
shrinks after each block. The scores of those that come through all dimensions are exact.

Plan: rows are packed into blocks where they are read, queries are dealt into blocks; the two meet
in a grid (``vectors``); each pair of blocks gives ``k`` rows a query at most, and a rank over
queries, limited before its exchange, keeps ``k``.

Defined results: see ``vectors`` for rows that take no part and for repeated rows; a query's own
row is every row with its id; a query that is there twice is two queries, with results of their
own; fewer than ``k`` candidates are all returned; an empty table gives an empty table. Only the
named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantide.llm import vectors as V
from spantide.llm.common import materialise

ROWS, QUERIES, WIDTH = 2048, 512, 8      # rows and queries per block, dimensions per step
DENSE_SHARE = 0.25                       # below this share of living pairs the survivors are compacted


def remaining_norms(a, width: int):
    """Norms of what lies behind each block of ``width`` rows of the matrix, one row per block."""
    import numpy as np
    squares = np.cumsum((a * a)[::-1], axis=0)[::-1]
    return np.sqrt(np.stack([squares[e] if e < len(a) else np.zeros(a.shape[1]) for e in range(width, len(a) + width, width)]))


def branch_and_bound(q, qid, x, xid, k: int, least, width: int = WIDTH):
    """(query, row, score) of all pairs that may be among the ``k`` best of a query: rows of ``q``
    against the columns of ``x``, without pairs of equal ids; ``least`` are scores that the k-th
    best reaches for certain. What is returned holds the ``k`` best, and all that tie with them."""
    import numpy as np
    q, least = q.astype("float64"), least.copy()
    d, n = x.shape
    x = x.astype("float64")
    acc = np.zeros((len(q), n))
    acc[qid[:, None] == xid[None, :]] = -np.inf
    begins = list(range(0, d, width))
    if begins:
        rest_q, rest_x = remaining_norms(q.T, width), remaining_norms(x, width)
    qi = None
    for b, s in enumerate(begins):
        last, e = b == len(begins) - 1, min(s + width, d)
        if qi is None:
            acc += q[:, s:e] @ x[s:e]
            if 2 * b + 2 < len(begins):
                continue          # less than half of the dimensions: bounds are still too wide to part rows
            room = rest_q[b][:, None] * rest_x[b][None, :] * (1 + 1e-12) + 0.5 * (not last)
            if n >= k:
                least = np.maximum(least, np.partition(acc - room, n - k, axis=1)[:, n - k])
            alive = (acc + room >= least[:, None]) & np.isfinite(acc)
            if last or alive.mean() < DENSE_SHARE:
                qi, ri = np.nonzero(alive)
                value = acc[qi, ri]
        else:
            value = value + (q[qi, s:e].T * x[s:e, ri]).sum(axis=0)
            room = 0.0 if last else rest_q[b][qi] * rest_x[b][ri] * (1 + 1e-12) + 0.5
            keep = value + room >= least[qi]
            qi, ri, value = qi[keep], ri[keep], value[keep]
    if qi is None:                # vectors without components
        qi, ri = np.nonzero(np.isfinite(acc))
        value = acc[qi, ri]
    return qi, ri, value.astype("int64")


def _every_pair(q, qid, x, xid):
    import numpy as np
    s = V.wide_scores(q, x.T)
    qi, ri = np.nonzero(qid[:, None] != xid[None, :])
    return qi, ri, s[qi, ri]


def _found(q, qid, x, xid, k, least, width=WIDTH):
    """``branch_and_bound`` where doubles are exact, else all pairs in wider numbers."""
    q, rows = V.same_width(q, x.T)
    x = rows.T
    if V.exact_in_doubles(q, rows):
        return branch_and_bound(q, qid, x, xid, k, least, width)
    return _every_pair(q, qid, x, xid)


def kth(groups: int, group, score, rank, k: int):
    """The ``k`` best scores of each group as a matrix, missing ones minus infinity."""
    import numpy as np
    top = np.full((groups, k), -np.inf)
    top[group, rank] = score
    return top


def _columns(run):
    """A block of rows: dimensions by falling sum of squares, one after the other."""
    import numpy as np
    m = V.matrix(run.column("v").combine_chunks())
    order = np.argsort(-(m.astype("float64") ** 2).sum(axis=0), kind="stable")
    ids = run.column("id").to_numpy()[:, None]
    return {"x": V.packed(m[:, order].T), "dims": V.packed(order[:, None]), "xid": V.packed(ids)}


_columns.columns = ("x", "dims", "xid")


def top_k(rows: DataFrame, queries: DataFrame, k: int, n_rows: int = ROWS, n_queries: int = QUERIES) -> DataFrame:
    """(query, query_id, rank, id, score): the ``k`` highest inner products of each row of
    ``queries`` with ``rows`` of other ids (both ``vectors.whole_numbers``); ``query`` numbers the
    queries."""
    def ask(run):
        import numpy as np
        q, ids = V.matrix(run.column("v").combine_chunks()), run.column("id").to_numpy()
        qi, _, score = _found(q, ids, q.T, ids, k, np.full(len(q), -np.inf))
        place, rank = V.best_of(qi, score, np.zeros(len(qi)), k)
        floor = kth(len(q), qi[place], score[place], rank, k)[:, -1]       # each query is a row for the others
        return {"q": V.packed(q), "qid": V.packed(ids[:, None]), "number": V.packed(run.column("number").to_numpy()[:, None]),
                "floor": floor.astype("<f8").tobytes()}
    ask.columns = ("q", "qid", "number", "floor")

    def step(row, state):
        import numpy as np
        q, qid, number = V.unpacked(row["q"]), V.unpacked(row["qid"])[:, 0], V.unpacked(row["number"])[:, 0]
        x, dims, xid = V.unpacked(row["x"]), V.unpacked(row["dims"])[:, 0], V.unpacked(row["xid"])[:, 0]
        wide = max(q.shape[1], len(dims))
        q = np.pad(q, ((0, 0), (0, wide - q.shape[1])))
        q = q[:, np.r_[dims, np.arange(len(dims), wide)]]
        top = state.setdefault(row["block"], np.full((len(q), k), -np.inf))
        least = np.maximum(np.frombuffer(row["floor"], "<f8"), top[:, 0])
        qi, ri, score = _found(q, qid, x, xid, k, least)
        keep = score >= least[qi]
        qi, ri, score = qi[keep], ri[keep], score[keep]
        place, rank = V.best_of(qi, score, xid[ri], k)
        qi, ri, score = qi[place], ri[place], score[place]
        state[row["block"]] = np.sort(np.concatenate([top, kth(len(q), qi, score, rank, k)], axis=1), axis=1)[:, -k:]
        return {"query": number[qi], "query_id": qid[qi], "id": xid[ri], "score": score}

    numbered = materialise(queries.select("id", "v").withColumn("number", F.monotonically_increasing_id()), "queries")
    asked = materialise(V.query_blocks(numbered, n_queries, ask), "query-blocks")
    chunks = materialise(V.blocks(rows.select("id", "v"), n_rows, "chunk", _columns), "row-blocks")
    found = V.search(V.meet(chunks, asked), "query long, query_id long, id long, score long", step,
                     ("x", "dims", "xid", "q", "qid", "number", "floor", "block"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "query_id", "rank", "id", "score")


SCALE, EVERY, K = 1024, 100, 10


def query(spark, sf_dir: str) -> DataFrame:
    rows = V.whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), SCALE, "vec_id", "embedding")
    got = top_k(rows, rows.where(F.col("id") % EVERY == 0), K)
    return got.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def sql_vectors(scale: int, *extra: str) -> str:
    """SQL of the rows that take part, their components as whole numbers."""
    also = "".join(f", {c}" for c in extra)
    return f"""SELECT vec_id{also}, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


ORACLE_SQL = f"""
WITH e AS (SELECT *, row_number() OVER () AS n FROM ({sql_vectors(SCALE)})),
x AS (SELECT n, vec_id, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM e),
p AS (SELECT a.n AS an, b.n AS bn, sum(a.c * b.c) AS s FROM x a JOIN x b ON a.i = b.i AND a.vec_id <> b.vec_id
      WHERE a.vec_id % {EVERY} = 0 GROUP BY 1, 2),
s AS (SELECT a.n, a.vec_id AS query_id, b.vec_id, CAST(coalesce(p.s, 0) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id LEFT JOIN p ON p.an = a.n AND p.bn = b.n WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
