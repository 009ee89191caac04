"""Multi-label splits (C5) and draws with replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantide.session import cut_lineage

BINS = 3          # hex digits of the hash that deal rows into bins: 4096
WEIGHT_BITS = 40  # weights are taken to multiples of 2^-40


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def label_quotas(combos: DataFrame, n_labels: int, val_share: float) -> DataFrame:
    """C5, counts: ``(combo array<int>, n, n_val)`` of the label combinations ``(combo, n)``, a row per combination.

    Iterative stratification in rounds, one per label: of the labels that are still open the one with the
    fewest rows left takes what is missing of its quota, the rounded share of all its rows, from the
    open combinations that hold it, in proportion to their rows (largest remainders first); these combinations are
    closed. What holds no label takes what is missing of the quota of all rows. Labels with equal counts
    come in order.
    """
    def quota(n):
        return F.floor(n * val_share + 0.5).cast("long")

    c = cut_lineage(combos.select("combo", F.col("n").cast("long").alias("n"), F.lit(None).cast("long").alias("n_val")))
    todo = list(range(n_labels))
    while True:
        # a number or two per label: what is left of it, and what its quota lacks
        open_n = F.when(F.col("n_val").isNull(), F.col("n")).otherwise(0)
        has = [F.element_at("combo", j + 1) == 1 for j in todo]
        row = c.agg(*[F.sum(F.when(h, open_n).otherwise(0)).alias(f"n{j}") for j, h in zip(todo, has, strict=True)],
                    *[(quota(F.sum(F.when(h, F.col("n")).otherwise(0))) - F.sum(F.when(h, F.coalesce("n_val", F.lit(0))).otherwise(0))).alias(f"q{j}")
                      for j, h in zip(todo, has, strict=True)],
                    (quota(F.sum("n")) - F.sum(F.coalesce("n_val", F.lit(0)))).alias("rest")).first()
        if row["rest"] is None:
            return c
        left = sorted((row[f"n{j}"], j) for j in todo if row[f"n{j}"])
        label = left[0][1] if left else None
        if label is not None:
            todo.remove(label)
        lack = row["rest"] if label is None else row[f"q{label}"]
        mine = F.col("n_val").isNull() & (F.lit(True) if label is None else F.element_at("combo", label + 1) == 1)
        total = F.sum(F.when(mine, F.col("n"))).over(Window.partitionBy())
        part = F.when(mine, F.greatest(F.lit(0), F.least(F.lit(lack), total)) * F.col("n"))
        x = c.withColumn("_whole", F.floor(part / total).cast("long")).withColumn("_frac", F.when(mine, part % total))
        rank = F.row_number().over(Window.orderBy(F.col("_frac").desc_nulls_last(), "combo"))       # a row per combination
        missing = F.greatest(F.lit(0), F.least(F.lit(lack), total)) - F.sum("_whole").over(Window.partitionBy())
        x = x.withColumn("_more", (rank <= missing).cast("long"))
        c = cut_lineage(x.select("combo", "n", F.when(mine, F.col("_whole") + F.col("_more")).otherwise(F.col("n_val")).alias("n_val")))
        if label is None:
            return c


def hash_ranked(df: DataFrame, strata: str, id_col: str, seed: int) -> DataFrame:
    """``(_id, _stratum, _rank)``: rank of every row in its stratum, from 1, in md5(id || seed) order. Ranked
    per bin of the hash, so that a stratum with a third of all rows is ranked by many tasks."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    x = df.select(F.col(id_col).alias("_id"), F.col(strata).alias("_stratum"), h.alias("_h"), F.substring(h, 1, BINS).alias("_p"))
    per = x.groupBy("_stratum", "_p").agg(F.count("*").alias("_c"))
    per = per.select(F.col("_stratum").alias("_s2"), F.col("_p").alias("_p2"),
                     F.coalesce(F.sum("_c").over(_before(Window.partitionBy("_stratum").orderBy("_p"))), F.lit(0)).alias("_base"))
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy("_stratum", "_p").orderBy("_h", "_id")))
    x = x.join(per, F.col("_stratum").eqNullSafe(F.col("_s2")) & (F.col("_p") == F.col("_p2")))
    return x.select("_id", "_stratum", (F.col("_base") + F.col("_rn")).alias("_rank"))


def multilabel_split(df: DataFrame, label_cols: list, id_col: str, val_share: float = 0.1, seed: int = 2022) -> DataFrame:
    """``df`` with ``is_val``: a validation share in which every label, and all rows together, has the rounded
    share of its rows, as far as label combinations allow. ``id_col`` is unique; a null label is 0."""
    combo = F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in label_cols])
    x = df.select(F.col(id_col).alias("_sid"), combo.alias("_combo"))
    quotas = label_quotas(x.groupBy(F.col("_combo").alias("combo")).agg(F.count("*").alias("n")), len(label_cols), val_share)
    r = hash_ranked(x, "_combo", "_sid", seed).join(quotas.select("combo", "n_val"), F.col("_stratum") == F.col("combo"))
    return df.join(r.select("_id", (F.col("_rank") <= F.col("n_val")).alias("is_val")), F.col(id_col) == F.col("_id")).drop("_id")


def draws(weighted: DataFrame, id_col: str, weight_col: str, n_draws: Column | int | None = None, seed: int = 2022,
          per_bucket: int = 1000) -> DataFrame:
    """``(id_col, n)``, how often each row is drawn in ``n_draws`` draws with replacement (as many as
    rows, by default), each with a chance in proportion to its weight.

    Rows stand on a line in md5 order of their ids, each as long as its weight (in multiples of
    2^-40): lengths are summed per bin of the hash, the 4096 sums from bin to bin, and inside the bins. Draw k
    falls on the place that md5 of k and the seed names. The line is cut into ranges of about ``per_bucket``
    draws; rows, in every range that they touch, and draws are merged by range and place, where a draw takes the last row that
    begins before it. A row with most of the weight lies in most ranges. Rows without weight are never drawn;
    ids are unique.
    """
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    size = F.floor(F.greatest(F.coalesce(F.col(weight_col), F.lit(0.0)), F.lit(0.0)) * F.lit(float(1 << WEIGHT_BITS))).cast("long")
    rows = weighted.select(F.col(id_col).alias("id"), h.alias("h"), F.substring(h, 1, BINS).alias("bin"), size.alias("size"))
    per = rows.groupBy("bin").agg(F.sum("size").alias("s"))
    per = per.select(F.col("bin").alias("b2"), F.coalesce(F.sum("s").over(_before(Window.orderBy("bin"))), F.lit(0)).alias("base"))    # 4096 rows at most
    inside = Window.partitionBy("bin").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    line = rows.withColumn("upto", F.sum("size").over(inside)).join(per, F.col("bin") == F.col("b2"))
    line = cut_lineage(line.select("id", (F.col("base") + F.col("upto") - F.col("size")).alias("begin"), (F.col("base") + F.col("upto")).alias("end")))
    total, n = line.agg(F.max("end"), F.count("*")).first()                  # two numbers
    n = n if n_draws is None else n_draws
    if not total or not n:
        return line.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n"))
    step = max(1, -(-total * per_bucket // n))
    spark = weighted.sparkSession
    place = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long"), F.lit(total))
    d = spark.range(n).select(place.alias("at"))
    d = d.select(F.expr(f"at div {step}").alias("bucket"), "at", F.lit(1).alias("kind"), F.lit(None).cast(line.schema["id"].dataType).alias("id"))
    spans = F.sequence(F.expr(f"begin div {step}"), F.expr(f"(end - 1) div {step}"))
    r = line.where(F.col("end") > F.col("begin")).select("id", "begin", F.explode(spans).alias("bucket"))
    r = r.select("bucket", F.greatest("begin", F.col("bucket") * step).alias("at"), F.lit(0).alias("kind"), "id")
    merged = Window.partitionBy("bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    hit = r.unionByName(d).withColumn("hit", F.last("id", ignorenulls=True).over(merged)).where("kind = 1")
    counts = hit.groupBy(F.col("hit").alias("_hit")).agg(F.count("*").alias("c"))
    return line.join(counts, F.col("id") == F.col("_hit"), "left").select(F.col("id").alias(id_col), F.coalesce("c", F.lit(0)).cast("long").alias("n"))
