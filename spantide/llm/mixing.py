"""Mixing sources to target weights by weighted fair queueing (DataFrame functions).

Each source is a queue of its documents in a fixed shuffled order, repeated for up to
``max_epochs`` epochs. A document's virtual finish time is the cumulative size of its
source up to and with it, divided by the source's target. All queues are merged in order
of finish time and the merged stream is cut at the total budget. Queues are served fairly, so each has
about its target by then; but documents are whole, and one that is large for its source's target holds back its queue
while others run on. So each source then ends at that place of its queue, before or behind the cut, at which it
is nearest to its target (the earlier of two).

Targets share the budget by weight; a source is limited to ``max_epochs`` times its own
size, and the excess is shared again by weight until none is above (a water level over the
sources, one row each).

Plan: cumulative sizes come from ``bins`` ranges of the shuffle hash in each source, so a
source that holds a third of all rows is summed in many tasks. The global order is a range
partition by finish time into ``slots`` fixed ranges: sums per slot find the slot in which
the budget runs out, and only its rows (about 1 in ``slots``) are sorted one by one. What
comes out are per source and epoch the last shuffle keys taken; documents, with their
texts, meet these few rows and are never shuffled.

Defined results: a null text has size 0; a null source is a source, last in order; a
source without words has target 0, and its documents are taken once for 0 words; rows
that are equal in id and text share one key and are taken or left together; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantide.llm.common import materialise, rows_of

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix"
BINS, SLOTS = 256, 16384      # bins: a power of 16


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """``row`` with ``size`` (words), ``source`` and ``key``, its place in the shuffled order."""
    row = rows_of(docs)
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    return row.select("row", F.col("row")[source_col].alias("source"),
                      F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
                      F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("row")[id_col].cast("string"), F.lit("")),
                                        text)).alias("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): the total of all sizes shared by the repeating weights.

    ``sizes`` has one row per source. With limits c = max_epochs * size and weights w, the
    level is (total - sum of c over full sources) / (sum of w over the others). With sources
    in order of c / w and the first ones taken as full, it rises as long as the next one's
    c / w is below it, and falls from then on, so it is the largest of these values.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1,
                             F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.alias("w"), (F.lit(max_epochs) * F.col("source_size")).cast("double").alias("c"))
    by_ratio = Window.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    t = t.select("*", F.sum("c").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)).alias("c0"),
                 F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("w1"),
                 F.sum("source_size").over(everything).cast("double").alias("total"))
    t = t.withColumn("level", (F.col("total") - F.coalesce("c0", F.lit(0.0))) / F.col("w1"))
    t = t.withColumn("water", F.max("level").over(everything))
    return t.select("source", "source_size", F.least(F.col("c"), F.col("water") * F.col("w")).alias("target"), "total")


def queue(measured: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, bins: int = BINS) -> DataFrame:
    """(source, key, size, epoch, finish) of every place in the queues, with ``source_size``,
    ``target`` and ``total``; the first result of the method, before the cut."""
    digits = len(f"{bins:x}") - 1
    m = measured.select("source", "key", "size", F.substring("key", 1, digits).alias("bin"))
    per_bin = m.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = materialise(per_bin.withColumn("base", F.coalesce(F.sum("bin_size").over(before), F.lit(0))), "mix-bins")
    t = materialise(targets(per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, max_epochs),
                    "mix-targets")
    inside = Window.partitionBy("source", "bin").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("run", F.sum("size").over(inside))
    b, t2 = per_bin.alias("b"), t.alias("t")
    m = m.alias("m").join(b, F.col("m.source").eqNullSafe(F.col("b.source")) & (F.col("m.bin") == F.col("b.bin")))
    m = m.join(t2, F.col("m.source").eqNullSafe(F.col("t.source")))
    m = m.select("m.source", "key", "size", (F.col("base") + F.col("run")).alias("upto"), "source_size", "target", "total",
                 F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    finish = F.when(F.col("target") == 0, F.col("epoch").cast("double")).otherwise(
        (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target"))
    # no source ends behind twice its target: without any document it would be nearer
    return m.withColumn("finish", finish).where((F.col("finish") <= 2.0) & ((F.col("target") > 0) | (F.col("epoch") == 0)))


def cut(q: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(source, epoch, last_key): up to which key the mix takes each epoch of a source, once the total
    budget has cut the merged stream and each source has come as near to its target as its documents allow."""
    q = materialise(q.select("source", "key", "size", "epoch", "finish", "total",
                             F.floor(F.col("finish") * slots).alias("slot")), "mix-queue")
    per_slot = q.groupBy("slot").agg(F.sum("size").alias("n"), F.max("total").alias("total"))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = (per_slot.withColumn("upto", F.sum("n").over(upto))          # 2 * slots rows at most
            .where(F.col("upto") > F.col("total")).orderBy("slot").limit(1)
            .select(F.col("slot").alias("s"), (F.col("upto") - F.col("n")).alias("base")))
    # the slot in which the budget runs out: its rows in order of finish time
    last = q.join(F.broadcast(over), q.slot == F.col("s"))
    by_finish = Window.partitionBy("slot").orderBy("finish").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.col("base") + F.sum("size").over(by_finish))
    edge = last.agg(F.max(F.when(F.col("upto") <= F.col("total"), F.col("finish"))).alias("in_slot"),
                    F.min("s").alias("s")).select("in_slot", "s")
    slot, in_slot = edge.select("s").scalar(), edge.select("in_slot").scalar()       # one row
    q = q.select("source", "epoch", "key", "slot", "finish", slot.alias("last_slot"), in_slot.alias("last_finish"))
    taken = F.col("last_slot").isNull() | (F.col("slot") < F.col("last_slot")) | (F.col("finish") <= F.col("last_finish"))
    q = q.select("source", "epoch", "key", "finish", taken.alias("taken"))
    # of the places in the stream and the next one, the nearest to time 1, at which a source has its target
    before = F.max(F.when(F.col("taken") & (F.col("finish") <= 1.0), F.col("finish")))
    per = q.groupBy(F.col("source").alias("s")).agg(before.alias("upto"), F.min(F.when(F.col("finish") > 1.0, F.col("finish"))).alias("beyond"))
    ends = per.select("s", F.when(F.col("beyond") - 1.0 < 1.0 - F.coalesce("upto", F.lit(0.0)), F.col("beyond")).otherwise(F.col("upto")).alias("end"))
    j = q.join(ends, q.source.eqNullSafe(ends.s)).where(F.col("finish") <= F.col("end"))
    return j.groupBy("source", "epoch").agg(F.max("key").alias("last_key"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``row`` with ``size``, ``source_size``, ``target`` and ``copies``, the number of times the
    mix takes it."""
    measured = _measured(docs, id_col, text_col, source_col, seed)
    narrow = materialise(measured.select("source", "size", "key"), "mix-keys")
    q = queue(narrow, weights, max_epochs)
    keys = cut(q).groupBy("source").agg(F.collect_list("last_key").alias("last_keys"))
    sizes = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    per_source = materialise(sizes.alias("a").join(keys.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
                             .select(F.col("a.source").alias("s"), "source_size", "target", "last_keys"), "mix-cut")
    j = measured.join(per_source, measured.source.eqNullSafe(per_source.s))
    copies = F.coalesce(F.size(F.filter("last_keys", lambda k: F.col("key") <= k)), F.lit(0))
    return j.select("row", "size", "source_size", "target", F.greatest(copies, F.lit(0)).alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("row.doc_id", "size", "source_size", "target",
                            (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it."""
    m = mix(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return m.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


_W = ", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(concat_ws('|', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS key
           FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([{_W}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w,
             CAST({MAX_EPOCHS} * source_size AS DOUBLE) AS c FROM s),
r AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
             coalesce(sum(c) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
             sum(w) OVER (ORDER BY c / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w1 FROM w),
l AS (SELECT *, (total - c0) / w1 AS level FROM r),
t AS (SELECT source, source_size, total, c, w,
             max(level) OVER () AS water FROM l),
tt AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, total,
              least(c, water * w) AS target FROM t),
q AS (SELECT d.doc_id, d.size, d.source, d.key, tt.source_size, tt.target, tt.total, e.e,
             CASE WHEN tt.target = 0 THEN CAST(e.e AS DOUBLE) ELSE
               (e.e * tt.source_size + sum(d.size) OVER (PARTITION BY d.source, e.e ORDER BY d.key)) / tt.target END AS finish
      FROM d JOIN tt ON tt.source IS NOT DISTINCT FROM d.source, (SELECT unnest(range({MAX_EPOCHS})) AS e) e),
q2 AS (SELECT *, finish <= 2.0 AND (target > 0 OR e = 0) AS there FROM q),
near AS (SELECT source, max(finish) FILTER (there AND finish <= 1) AS upto, min(finish) FILTER (there AND finish > 1) AS beyond FROM q2 GROUP BY source),
ends AS (SELECT source, CASE WHEN beyond - 1 < 1 - coalesce(upto, 0) THEN beyond ELSE upto END AS fin FROM near)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(sum(CASE WHEN there AND finish <= fin THEN size ELSE 0 END) AS BIGINT) AS taken
FROM q2 JOIN ends ON ends.source IS NOT DISTINCT FROM q2.source GROUP BY doc_id, size, source_size, target
"""
