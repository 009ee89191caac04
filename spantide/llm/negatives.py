"""Hard-negative mining over STR-packed R-trees.

Rows are packed by sort-tile-recursive: range-partitioned by their first component into slabs,
sorted by the second inside, cut into runs, and each run is tiled again, its rows sorted along the
tile's widest component and split, until a tile is a leaf. A run of rows is a tree: minimum
bounding boxes of the leaves, and of groups of leaves above them.

For an anchor a box gives an interval per component, and with them an interval that holds the
inner products of all its rows. A search has windows of scores, each with its own k best so far;
the queue hands out the anchor's leaves by falling upper end, a few at a time, and a box goes that
lies outside all windows or, in the windows it touches, strictly below the k-th best. Leaves that
come out are scored exactly. The same search finds the positives (one window without ends, rows of
the same label, k = 5) and the negatives (a window per positive, rows of other labels, k = 3).

Plan: trees are packed once and written, anchors are dealt into blocks; trees and blocks meet in a
grid (``vectors``), so that a task holds one tree and one block, and the best scores of a block go
on from tree to tree inside a task. What comes out is ranked per anchor, or per anchor and
positive, limited before its exchange.

Defined results: rows without id, vector or label, or with a component that is null or not finite,
take no part; an anchor is no candidate of its own, nor is any row with its id; a row that is there
twice is two rows, as an anchor and as a candidate; negative positive-scores have no window; an
empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantide.llm import vectors as V
from spantide.llm.common import materialise
from spantide.llm.topk import sql_vectors

ROWS, LEAF, FAN, ANCHORS = 4096, 64, 8, 512      # rows per tree and leaf, leaves per inner box, anchors per block
POPS = 4                                         # leaves that the queue hands out to an anchor at a time


def tiles(m, leaf: int):
    """Sort-tile-recursive order of the rows of a matrix, and the leaves' ends: each tile is sorted
    along its widest component and split in two at a multiple of the leaf size."""
    import numpy as np
    out, ends, todo = [], [], [np.arange(len(m))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf or not m.shape[1]:
            for s in range(0, len(at), leaf):
                out.append(at[s:s + leaf])
                ends.append(min(leaf, len(at) - s))
            continue
        part = m[at]
        at = at[np.argsort(part[:, int((part.max(axis=0) - part.min(axis=0)).argmax())], kind="stable")]
        half = -(-len(at) // (2 * leaf)) * leaf
        todo += [at[half:], at[:half]]
    return np.concatenate(out), np.cumsum(ends)


def _tree(run):
    """A run of rows as a tree: rows in leaf order, ids, labels, ends of leaves."""
    m = V.matrix(run.column("v").combine_chunks())
    order, ends = tiles(m, LEAF)
    ids, labels = run.column("id").to_numpy()[order], run.column("label").to_numpy()[order]
    return {"x": V.packed(m[order]), "xid": V.packed(ids[:, None]), "xlabel": V.packed(labels[:, None]), "ends": V.packed(ends[:, None])}


_tree.columns = ("x", "xid", "xlabel", "ends")


def boxes(x, ends, fan: int = FAN):
    """Lower and upper corners of the leaves, and of the boxes over ``fan`` leaves each."""
    import numpy as np
    starts = np.r_[0, ends[:-1]]
    low, high = np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)
    over = np.arange(0, len(ends), fan)
    return (low, high), (np.minimum.reduceat(low, over, axis=0), np.maximum.reduceat(high, over, axis=0))


def intervals(q, low, high):
    """Ends of the intervals that hold the inner products of each row of ``q`` with a box's rows."""
    import numpy as np
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def search_tree(q, qid, qlabel, tree, windows, least, k: int, same: bool):
    """(anchor, window, row, score) of what may be among the ``k`` best of a window: ``windows`` holds
    (lowest, highest) score per anchor and window, ``least`` scores that the k-th best reaches for
    certain; rows of the anchor's label only (``same``) or of all other labels."""
    import numpy as np
    x, xid, xlabel, ends = tree
    starts = np.r_[0, ends[:-1]]
    least, low_w, high_w = least.copy(), windows[..., 0], windows[..., 1]
    top = np.full((*least.shape, k), -np.inf)
    leaves, above = boxes(x, ends)
    lo, hi = intervals(q, *above)
    floor = np.maximum(low_w, least)

    def wanted(lo, hi, floor, high_w):
        """Boxes that touch a window, at or above its k-th best."""
        return ((hi[:, :, None] >= floor[:, None, :]) & (lo[:, :, None] <= high_w[:, None, :])).any(axis=2)
    over = np.repeat(wanted(lo, hi, floor, high_w), FAN, axis=1)[:, :len(ends)]
    lo, hi = intervals(q, *leaves)
    queue = np.argsort(np.where(over, -hi, np.inf), axis=1, kind="stable")
    found = []
    for at in range(0, len(ends), POPS):
        pop = queue[:, at:at + POPS]
        there = np.take_along_axis(over, pop, axis=1) & wanted(
            np.take_along_axis(lo, pop, axis=1), np.take_along_axis(hi, pop, axis=1), np.maximum(low_w, least), high_w)
        if not there.any():
            if not np.take_along_axis(over, queue[:, at + POPS:], axis=1).any():
                break
            continue
        width = int((ends - starts).max())
        score = np.full((len(q), POPS * width), -np.inf)
        row = np.zeros((len(q), POPS * width), "int64")
        for leaf in np.unique(pop[there]):
            a, p = np.nonzero((pop == leaf) & there)
            rows = np.arange(starts[leaf], ends[leaf])
            s = q[a] @ x[rows].T
            fits = (qlabel[a][:, None] == xlabel[rows][None, :]) == same
            s[~fits | (qid[a][:, None] == xid[rows][None, :])] = -np.inf
            cols = p[:, None] * width + np.arange(len(rows))[None, :]
            score[a[:, None], cols], row[a[:, None], cols] = s, rows[None, :]
        for w in range(least.shape[1]):
            inside = np.where((score >= np.maximum(low_w, least)[:, w, None]) & (score <= high_w[:, w, None]), score, -np.inf)
            a, c = np.nonzero(np.isfinite(inside))
            if not len(a):
                continue
            both = np.concatenate([top[:, w], inside], axis=1)
            top[:, w] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            least[:, w] = np.maximum(least[:, w], top[:, w].min(axis=1))
            found.append((a, np.full(len(a), w), row[a, c], inside[a, c]))
    if not found:
        return tuple(np.zeros(0, "int64") for _ in range(4))
    a, w, r, s = (np.concatenate(f) for f in zip(*found, strict=True))
    keep = s >= least[a, w]
    return a[keep], w[keep], r[keep], s[keep].astype("int64")


def _wide(q, qid, qlabel, x, xid, xlabel, windows, same):
    """``search_tree`` without pruning, for scores that doubles cannot hold."""
    import numpy as np
    s = V.wide_scores(q, x)
    fits = ((qlabel[:, None] == xlabel[None, :]) == same) & (qid[:, None] != xid[None, :])
    out = []
    for w in range(windows.shape[1]):
        inside = fits & np.array([[lo <= v <= hi for v in line] for line, (lo, hi) in zip(s.tolist(), windows[:, w], strict=True)], bool).reshape(s.shape)
        a, r = np.nonzero(inside)
        out.append((a, np.full(len(a), w), r, s[a, r]))
    return tuple(np.concatenate(f) for f in zip(*out, strict=True))


def _windows(data: bytes, anchors: int):
    """Windows of a block of anchors as (anchors, windows, 2); without any given, one without ends."""
    import numpy as np
    if not data:
        return np.broadcast_to(np.array([-np.inf, np.inf]), (anchors, 1, 2))
    return V.unpacked(data).reshape(anchors, -1, 2).astype("float64")


def _best(q, qid, qlabel, packed_tree, windows, least, k: int, same: bool):
    """(anchor, window, id, score) of the ``k`` best rows of a packed tree in each window."""
    x, xid, xlabel, ends = V.unpacked(packed_tree["x"]), *(V.unpacked(packed_tree[c])[:, 0] for c in ("xid", "xlabel", "ends"))
    q, x = V.same_width(q, x)
    if V.exact_in_doubles(q, x):
        a, w, r, s = search_tree(q.astype("float64"), qid, qlabel, (x.astype("float64"), xid, xlabel, ends), windows, least, k, same)
    else:
        a, w, r, s = _wide(q, qid, qlabel, x, xid, xlabel, windows, same)
    place, _ = V.best_of(a * windows.shape[1] + w, s, xid[r], k)
    return a[place], w[place], xid[r[place]], s[place]


def _tops(shape, a, w, s):
    """Scores of ``_best`` by anchor and window, missing ones minus infinity."""
    import numpy as np
    top = np.full(shape, -np.inf)
    group = a * shape[1] + w
    _, rank = V.best_of(group, s, np.zeros(len(s)), shape[2])
    top[a, w, rank] = s
    return top


def pack_trees(rows: DataFrame, name: str = "trees") -> DataFrame:
    """Written trees of ``rows`` (id, label, v): slabs by the first component, runs by the second."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    # ids and a seeded number spread rows that are equal in the components
    dealt = rows.select("id", "label", "v", F.rand(11).alias("salt")).repartitionByRange(n, first, "id", "salt").sortWithinPartitions(second, "id")
    return materialise(V.blocks(dealt.select("id", "label", "v"), ROWS, "chunk", _tree), name)


def best_in_windows(trees: DataFrame, anchors: DataFrame, k: int, same: bool, n_anchors: int = ANCHORS) -> DataFrame:
    """(anchor, window, id, score): for each row of ``anchors`` (anchor, id, label, v, windows) what may
    be among the ``k`` best rows of a window; windows are (lowest, highest) one after the other."""
    def ask(run):
        import numpy as np
        q, ids = V.matrix(run.column("v").combine_chunks()), run.column("id").to_numpy()
        w = V.matrix(run.column("windows").combine_chunks()) if "windows" in run.column_names else None
        labels = run.column("label").to_numpy()
        out = {"q": V.packed(q), "qid": V.packed(ids[:, None]), "qlabel": V.packed(labels[:, None]),
               "anchor": V.packed(run.column("anchor").to_numpy()[:, None]), "windows": b"", "floor": b""}
        if w is not None:
            # no window: a lowest score above the highest
            sizes = run.column("windows").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            gone = np.arange(w.shape[1])[None, :] >= sizes[:, None]
            w[gone] = np.broadcast_to(np.arange(w.shape[1])[None, :] % 2 == 0, w.shape)[gone]
            out["windows"] = V.packed(w)
        # anchors are rows too: their k-th best among themselves is a first threshold
        ends_w = _windows(out["windows"], len(q))
        if ends_w.shape[1] and V.exact_in_doubles(q, q):
            a, g, _, s = _best(q, ids, labels, _tree(run), ends_w, np.full((len(q), ends_w.shape[1]), -np.inf), k, same)
            out["floor"] = _tops((len(q), ends_w.shape[1], k), a, g, s).min(axis=2).astype("<f8").tobytes()
        return out
    ask.columns = ("q", "qid", "qlabel", "anchor", "windows", "floor")

    def step(row, state):
        import numpy as np
        q, qid, qlabel, anchor = V.unpacked(row["q"]), *(V.unpacked(row[c])[:, 0] for c in ("qid", "qlabel", "anchor"))
        windows = _windows(row["windows"], len(q))
        if not windows.shape[1]:
            return None
        top = state.setdefault(row["block"], np.full((len(q), windows.shape[1], k), -np.inf))
        least = top.min(axis=2)
        if row["floor"]:
            least = np.maximum(least, np.frombuffer(row["floor"], "<f8").reshape(least.shape))
        a, w, ids, s = _best(q, qid, qlabel, row, windows, least, k, same)
        state[row["block"]] = np.sort(np.concatenate([top, _tops(top.shape, a, w, s)], axis=2), axis=2)[..., -k:]
        return {"anchor": anchor[a], "window": w, "id": ids, "score": s}

    cols = ["id", "label", "v", "anchor"] + ["windows"] * ("windows" in anchors.columns)
    asked = materialise(V.query_blocks(anchors.select(*cols), n_anchors, ask), "anchors")
    return V.search(V.meet(trees, asked), "anchor long, window long, id long, score long", step,
                    ("x", "xid", "xlabel", "ends", "q", "qid", "qlabel", "anchor", "windows", "floor", "block"))


def hard_negatives(rows: DataFrame, is_anchor, positives: int, negatives: int, lowest: int, highest: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows`` (id,
    label, v): for each anchor its best rows of its label, and for each of them the best rows of other
    labels with a score of ``lowest`` to ``highest`` hundredths of the positive's."""
    rows = materialise(rows, "rows")
    trees = pack_trees(rows)
    anchors = materialise(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchor-rows")
    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
    pos = best_in_windows(trees, anchors, positives, same=True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    p = F.col("score").cast("decimal(38,0)")
    ends = F.array(F.ceil(p * lowest / 100).cast("long"), F.floor(p * highest / 100).cast("long"))
    per = pos.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                                                                        ends.alias("ends")))).alias("pos"))
    per = materialise(per, "positives")      # a row per anchor, at most ``positives`` entries in it
    asked = anchors.join(per, "anchor").select("anchor", "id", "label", "v", F.flatten("pos.ends").alias("windows"))
    best = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
    neg = best_in_windows(trees, asked, negatives, same=False).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= negatives)
    named = anchors.select("anchor", F.col("id").alias("anchor_id")).join(per, "anchor").select("anchor", "anchor_id", F.posexplode("pos").alias("window", "p"))
    return neg.join(named, ["anchor", "window"]).select(
        "anchor_id", "p.positive_id", F.col("nth").alias("rank"), F.col("id").alias("negative_id"), "p.positive_score", F.col("score").alias("negative_score"))


SCALE, EVERY, POISONED, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES, LOWEST, HIGHEST = 5, 3, 50, 95


def query(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("label").isNotNull())
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % POISONED == 0, F.pmod(label + 1, F.lit(LABELS))).otherwise(label)
    rows = V.whole_numbers(e, SCALE, "vec_id", "embedding", moved.alias("label"))
    return hard_negatives(rows, F.col("id") % EVERY == 0, POSITIVES, NEGATIVES, LOWEST, HIGHEST)


ORACLE_SQL = f"""
WITH e AS (SELECT *, CASE WHEN vec_id % {POISONED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS lab,
                  row_number() OVER () AS n
           FROM ({sql_vectors(SCALE, "label")}) WHERE label IS NOT NULL),
x AS (SELECT n, vec_id, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM e),
p AS (SELECT a.n AS an, b.n AS bn, sum(a.c * b.c) AS s FROM x a JOIN x b ON a.i = b.i AND a.vec_id <> b.vec_id
      WHERE a.vec_id % {EVERY} = 0 GROUP BY 1, 2),
s AS (SELECT a.n, a.vec_id AS anchor_id, b.vec_id, a.lab = b.lab AS same, CAST(coalesce(p.s, 0) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id LEFT JOIN p ON p.an = a.n AND p.bn = b.n WHERE a.vec_id % {EVERY} = 0),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
neg AS (SELECT pos.anchor_id, pos.vec_id AS positive_id, s.vec_id AS negative_id, pos.score AS positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY pos.n, pos.k ORDER BY s.score DESC, s.vec_id) AS rank
        FROM pos JOIN s ON s.n = pos.n AND NOT s.same AND {LOWEST} * pos.score <= 100 * s.score AND 100 * s.score <= {HIGHEST} * pos.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {NEGATIVES}
"""
