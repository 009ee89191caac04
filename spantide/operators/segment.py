"""Offset-preserving segmentation.

All three segmenters share one plan shape: documents are hash-partitioned on
``doc_id`` once, lines are generated in place (``posexplode`` keeps the partitioning),
and every window / aggregate after that is keyed on ``doc_id`` so it reuses the same
exchange. Offsets are code points, half-open ``[begin, end)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantide.functions.text import NONWS, lstrip_len, rstrip, strip

_ALL_BEFORE = (Window.unboundedPreceding, Window.currentRow)


def by_doc(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple = ()) -> DataFrame:
    """``(doc_id, text, *keep)`` hash-partitioned on ``doc_id``: the one exchange per corpus."""
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
            .repartition("doc_id"))


def lines(docs: DataFrame, strip_trailing_newlines: bool = False) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, line_no, line_begin, line)``.

    ``line_begin`` is the running sum of ``length(line) + 1`` over earlier lines.
    """
    text = F.col("text")
    if strip_trailing_newlines:
        text = F.regexp_replace(text, r"\n+\z", "")
    keep = [c for c in docs.columns if c not in ("doc_id", "text")]
    x = docs.select("doc_id", *keep, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(*_ALL_BEFORE)
    step = F.length("line") + 1
    return x.withColumn("line_begin", F.sum(step).over(w) - step)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              keep: tuple = ()) -> DataFrame:
    """G1: one sentence per non-blank line, offsets of its stripped part.

    Output ``(doc_id, sent_no, begin, end, text, *keep)``; ``sent_no`` counts from 0.
    """
    d = by_doc(docs, id_col, text_col, keep)
    x = lines(d)
    nonblank = F.col("line").rlike(NONWS)
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(*_ALL_BEFORE)
    x = x.withColumn("nb", nonblank).withColumn(
        "sent_no", F.sum(F.col("nb").cast("long")).over(w) - 1)
    x = x.where("nb")
    return x.select(
        "doc_id",
        F.col("sent_no").cast("long").alias("sent_no"),
        (F.col("line_begin") + lstrip_len("line")).cast("long").alias("begin"),
        (F.col("line_begin") + F.length(rstrip("line"))).cast("long").alias("end"),
        strip("line").alias("text"),
        *keep,
    )


def paragraphs_blank(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal runs of non-blank lines, untrimmed (first line start .. last line end).

    Output ``(doc_id, par_no, begin, end, text)``.
    """
    d = by_doc(docs, id_col, text_col)
    x = lines(d)
    w_run = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(*_ALL_BEFORE)
    w_lag = Window.partitionBy("doc_id").orderBy("line_no")
    nb = F.col("line").rlike(NONWS)
    x = x.withColumn("nb", nb)
    x = x.withColumn("start", F.col("nb") & ~F.coalesce(F.lag("nb").over(w_lag), F.lit(False)))
    x = x.withColumn("par_no", F.sum(F.col("start").cast("long")).over(w_run) - 1).where("nb")
    g = x.groupBy("doc_id", "par_no").agg(
        F.min("line_begin").alias("begin"),
        F.max(F.col("line_begin") + F.length("line")).alias("end"),
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"),
    )
    return g.select(
        "doc_id", F.col("par_no").cast("long").alias("par_no"),
        F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"),
        F.array_join(F.col("ls.line"), "\n").alias("text"),
    )


def paragraphs_list(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    marker: str = "- ") -> DataFrame:
    """Every non-empty line is a paragraph, but consecutive ``marker`` lines form one.

    Trailing newlines are removed first; empty lines neither count nor end a list; a
    list followed by a normal line ends one character before that line starts.
    Output ``(doc_id, par_no, begin, end, text)``.
    """
    d = by_doc(docs, id_col, text_col)
    x = lines(d, strip_trailing_newlines=True).where(F.length("line") > 0)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    w_run = w.rowsBetween(*_ALL_BEFORE)
    x = x.withColumn("is_list", F.col("line").startswith(marker))
    x = (x.withColumn("start", ~(F.col("is_list") & F.coalesce(F.lag("is_list").over(w), F.lit(False))))
          .withColumn("next_begin", F.lead("line_begin").over(w)))
    x = x.withColumn("par_no", F.sum(F.col("start").cast("long")).over(w_run) - 1)
    g = x.groupBy("doc_id", "par_no").agg(
        F.min("line_begin").alias("begin"),
        F.max(F.col("line_begin") + F.length("line")).alias("last_end"),
        F.max_by("next_begin", "line_no").alias("next_begin"),
        F.bool_and("is_list").alias("is_list"),
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"),
    )
    end = F.when(F.col("is_list") & F.col("next_begin").isNotNull(),
                 F.col("next_begin") - 1).otherwise(F.col("last_end"))
    # empty lines inside a list come back as extra newlines, by line-number gaps
    ls = F.col("ls")
    body = F.array_join(F.transform(ls, lambda s, i: F.concat(
        F.repeat(F.lit("\n"), F.when(i == 0, F.lit(0)).otherwise(
            s["line_no"] - F.element_at(ls, i)["line_no"] - 1)), s["line"])), "\n")
    g = g.withColumn("end", end).withColumn("body", body)
    tail = F.repeat(F.lit("\n"), F.greatest(F.col("end") - F.col("last_end"), F.lit(0)))
    return g.select(
        "doc_id", F.col("par_no").cast("long").alias("par_no"),
        F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"),
        F.substring(F.concat("body", tail), 1, F.col("end") - F.col("begin")).alias("text"),
    )


def classifier_text(c) -> "F.Column":
    """Newline and tab to space, then strip."""
    return strip(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\n\t]", " "))


def reannotate(existing: DataFrame, new: DataFrame, type_col: str = "type") -> DataFrame:
    """Replace all annotations of the (doc_id, type) pairs present in ``new``.

    Existing rows of those pairs are removed (left anti join on the pair) before the
    new rows are appended, so running the same annotator twice gives the same table.
    """
    keys = new.select("doc_id", type_col).distinct()
    kept = existing.join(keys, ["doc_id", type_col], "left_anti")
    return kept.unionByName(new)
