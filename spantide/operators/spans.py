"""Span (interval) operators over annotation tables.

Annotation tables carry ``doc_id``, an ordinal column and ``begin``/``end``. Every
join below has ``doc_id`` as an equi key; interval containment adds a position
bin to that key so no document ever pairs all its spans with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantide.functions.text import normalise_lines


def select_type(annotations: DataFrame, type_name: str, type_col: str = "type") -> DataFrame:
    """A1: annotations of one type in document order."""
    return annotations.where(F.col(type_col) == type_name).orderBy("doc_id", "begin", "end")


def label_spans(spans: DataFrame, predicate: Column, label: str,
                label_col: str = "div_type") -> DataFrame:
    """A3: set ``div_type`` to ``label`` where ``predicate`` holds (else null) and
    ``content`` to the stripped covered text of labelled spans."""
    return (spans.withColumn(label_col, F.when(predicate, F.lit(label)))
                 .withColumn("content", F.when(predicate, normalise_lines("text"))))


def merge_consecutive(spans: DataFrame, label: str, ord_col: str = "par_no",
                      label_col: str = "div_type") -> DataFrame:
    """A4 + A5: merge runs of consecutive spans (in ``ord_col`` order) labelled ``label``.

    Input ``(doc_id, <ord_col>, begin, end, text, <label_col>)``; output
    ``(doc_id, label, begin, end, content, first_no, last_no)`` where ``content`` is
    the covered text with every line stripped and blank lines dropped.
    Islands: ``ord - row_number()`` is constant along a run of labelled spans.
    """
    w = Window.partitionBy("doc_id").orderBy(ord_col)
    x = (spans.where(F.col(label_col) == label)
              .withColumn("_grp", F.col(ord_col) - F.row_number().over(w)))
    g = x.groupBy("doc_id", "_grp").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"),
        F.min(ord_col).alias("first_no"), F.max(ord_col).alias("last_no"),
        F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col("text").alias("t")))).alias("m"))
    # spans are line-aligned, so the raw slice between members is whitespace and
    # newlines only: joining member texts by newline normalises to the same content
    return g.select("doc_id", F.lit(label).alias("label"),
                    F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"),
                    normalise_lines(F.array_join(F.col("m.t"), "\n")).alias("content"),
                    F.col("first_no").cast("long").alias("first_no"),
                    F.col("last_no").cast("long").alias("last_no"))


def covered(inner: DataFrame, outer: DataFrame, bin_size: int = 4096,
            outer_key: str = "span_no") -> DataFrame:
    """A2: pairs ``(outer, inner)`` with ``outer.begin <= inner.begin`` and
    ``inner.end <= outer.end``, same ``doc_id``.

    Range join by binning: each outer span is replicated to the position bins it
    overlaps, each inner span goes to the bin of its ``begin``; the equi key is
    ``(doc_id, bin)``. Result columns: outer's ``outer_key``, ``o_begin``, ``o_end``
    plus all inner columns.
    """
    o = outer.select("doc_id", outer_key, F.col("begin").alias("o_begin"), F.col("end").alias("o_end"))
    o = o.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col("o_begin") / bin_size).cast("long"),
        F.floor(F.greatest(F.col("o_end") - 1, F.col("o_begin")) / bin_size).cast("long"))))
    i = inner.withColumn("_bin", F.floor(F.col("begin") / bin_size).cast("long"))
    j = i.join(o, ["doc_id", "_bin"])
    return j.where((F.col("begin") >= F.col("o_begin")) & (F.col("end") <= F.col("o_end"))).drop("_bin")


def add_context(merged: DataFrame, units: DataFrame, prepend: bool = True, append: bool = True,
                unit_no: str = "sent_no", span_key: str = "span_no") -> DataFrame:
    """A6 + A7: text of the unit before the first / after the last covered unit,
    around ``content``, every line stripped.

    ``merged``: ``(doc_id, span_no, begin, end, content, ...)``;
    ``units``: ``(doc_id, <unit_no>, begin, end, text)`` numbered consecutively.
    Spans covering no unit get a null context; with neither flag the context is
    the content itself. Neighbours come by number, so both tables had best be written once before.
    """
    # coverage is joined on places alone; the texts of the two neighbours are fetched by their numbers
    cov = (covered(units.select("doc_id", unit_no, "begin", "end"), merged, outer_key=span_key)
           .groupBy("doc_id", span_key).agg(F.min(unit_no).alias("_first"), F.max(unit_no).alias("_last")))
    x = merged.join(cov, ["doc_id", span_key], "left")
    for wanted, name, no in ((prepend, "_prev", F.col("_first") - 1), (append, "_next", F.col("_last") + 1)):
        if wanted:
            t = units.select(F.col("doc_id").alias("_d"), F.col(unit_no).alias("_no"), F.col("text").alias(name))
            x = x.join(t, (F.col("doc_id") == F.col("_d")) & (no == F.col("_no")), "left").drop("_d", "_no")
    parts = ([F.col("_prev")] if prepend else []) + [F.col("content")] + ([F.col("_next")] if append else [])
    ctx = F.when(F.col("_first").isNotNull(), normalise_lines(F.concat_ws("\n", *parts)))
    return x.withColumn("content_context", ctx).drop("_first", "_last", "_prev", "_next")


def shift_offsets(rel: DataFrame, sentences: DataFrame, key: str = "sent_no") -> DataFrame:
    """Sentence-relative ``begin``/``end`` to document offsets (equi-join on the
    sentence ordinal)."""
    s = sentences.select("doc_id", key, F.col("begin").alias("_sb"))
    return (rel.join(s, ["doc_id", key])
               .withColumn("begin", (F.col("begin") + F.col("_sb")).cast("long"))
               .withColumn("end", (F.col("end") + F.col("_sb")).cast("long"))
               .drop("_sb"))


def zip_by_ordinal(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
                   check: bool = True) -> DataFrame:
    """Positional zip of two per-document lists = equi-join on ``(doc_id, key)``.

    With ``check`` the join fails at run time (``assert_true``) for any ordinal that
    exists on one side only, as the reference's length assertion does.
    """
    if not check:
        return left.join(right, ["doc_id", key], how)
    j = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), ["doc_id", key], "full")
    j = j.withColumn("_ok", F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(),
                                          F.lit("lists differ in length")))
    return j.where(F.col("_ok").isNull()).drop("_l", "_r", "_ok")
