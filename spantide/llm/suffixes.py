"""Removal of long repeated byte strings by bucket-pointer refinement of suffixes.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else.
Suffixes stand in buckets of equal beginnings; a bucket is refined by the bucket identifiers
of later offsets of its suffixes, a refined bucket is reused in the next round, and a suffix
that is alone, or whose question is settled, leaves.

Identifiers. The identifier of the bucket that a suffix has at any depth is the polynomial
hash of that much text, taken from prefix sums; so identifiers of later offsets are at hand
without a global round for each depth. They are 64 bits wide and only compared within one
q-gram bucket, which is 64 bits more.

Round 0 puts suffixes in q-gram buckets. Of the windows of ``length`` bytes, each refers to
one suffix, the q-gram in it with the smallest hash (the leftmost of equals); equal windows
refer to equal q-grams at equal distances, and neighbouring windows mostly to the same one,
so about one suffix in a hundred stands for all. A suffix with its run of windows is a row.
Round 1 refines by the text of the whole run: runs found twice are settled; buckets with runs
found once are refined again, in them the unsettled runs and one of each settled kind. Round
2 does it with blocks of ``block`` windows, aligned to the suffix, round 3 with single windows;
there a bucket is first refined by the text that all windows of a block cover, so that blocks of
which no window can occur twice leave at once. Each round is exact for what it settles, and round
3 settles everything.

Plan: buckets are counted by pre-summed aggregates, and rows meet the counts of their bucket
in joins on written tables, whose hot keys adaptive execution splits; a passage in a third of
all documents sends one row of its kind to the next round, not all. Only the text around
unsettled runs (at most 2 * length bytes each) goes to rounds 2 and 3. Documents are shuffled
twice, once to cut out that text and once to meet their spans.

Defined results: a null or empty text has no bytes and no spans; texts under ``length`` bytes
lose nothing; repeated rows are copies of each other, also under one id; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantide.llm.common import materialise

LENGTH, GRAM, BLOCK = 400, 128, 16
SLAB = 1 << 21      # windows of one text that are hashed at a time


def window_runs(buf, length: int, gram: int):
    """(suffix, first window, last window, q-gram hash, run hash) arrays of one text of at
    least ``length`` bytes."""
    import numpy as np

    from spantide.llm.tokens import mix64, prefix_hashes
    prefix, down = prefix_hashes(buf)
    n, w = len(buf) - gram + 1, length - gram + 1
    g = mix64((prefix[gram:] - prefix[:n]) * down[:n])
    windows = n - w + 1
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    rows = padded.reshape(-1, w)        # the minimum of any w neighbours: a suffix of one row, a prefix of the next
    least = np.minimum(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:windows],
                       np.minimum.accumulate(rows, axis=1).ravel()[w - 1:w - 1 + windows])
    suffix = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = np.flatnonzero(np.diff(suffix, prepend=-1) != 0)
    high = np.append(low[1:], windows) - 1
    at = suffix[low]
    return at, low, high, g[at], run_hashes(prefix, down, at, low, high, length)


def run_hashes(prefix, down, at, low, high, length: int):
    """Identifiers of the texts of windows ``low`` to ``high``, with their place by the suffix."""
    import numpy as np

    from spantide.llm.tokens import mix64
    place = ((at - low).astype(np.uint64) << np.uint64(32)) | (high - low).astype(np.uint64)
    return mix64((prefix[high + length] - prefix[low]) * down[low] + mix64(place))


def first_round(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, tk, at, low, high, bucket, block, run) of every run of windows."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *[
        T.StructField(c, T.LongType()) for c in ("tk", "at", "low", "high", "bucket", "block", "run")]])

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        from spantide.llm.tokens import blocks_of, text_bytes
        for block in blocks_of(batches, "text"):
            out, of = [], []
            for r, text in enumerate(text_bytes(block, "text")):
                for begin in range(0, len(text) - length + 1, SLAB):
                    part = np.frombuffer(text, np.uint8)[begin:begin + SLAB + length - 1]
                    at, low, high, g, run = window_runs(part, length, gram)
                    out.append((at + begin, low + begin, high + begin, g.view(np.int64), run.view(np.int64)))
                    of.append(np.full(len(at), r))
            if out:
                at, low, high, g, run = (np.concatenate(x) for x in zip(*out))
                take = pa.array(np.concatenate(of))
                zero = np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [block.column("id").take(take), block.column("tk").take(take),
                     *[pa.array(x) for x in (at, low, high, g, zero, run)]], names=schema.names)

    return docs.mapInArrow(rows, schema)


def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (the runs that occur twice or more, the runs that the next round refines)."""
    r = rows.withColumn("me", F.xxhash64("id", "tk", "at"))
    kinds = materialise(r.groupBy("bucket", "block", "run").agg(F.count(F.lit(1)).alias("n"), F.min("me").alias("one")), "kinds")
    buckets = materialise(kinds.groupBy("bucket", "block").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"),
                                                               F.sum((F.col("n") == 1).cast("int")).alias("alone"))
                          .where("all > 1").selectExpr("bucket", "block", "kinds > 1 AND alone > 0 AS mixed"), "buckets")
    kinds = materialise(kinds.join(buckets, ["bucket", "block"]).where("n > 1 OR mixed")
                        .select("bucket", "block", "run", "n", "one", "mixed"), "kinds-left")
    met = materialise(r.join(kinds, ["bucket", "block", "run"]).where("n > 1 OR mixed"), "met")
    return (met.where("n > 1").select("id", "tk", "low", "high"),
            met.where("mixed AND (n = 1 OR me = one)").select("id", "tk", "at", "low", "high", "bucket"))


def cut_out(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """``runs`` with ``text``, the bytes of their windows."""
    per_doc = runs.groupBy("id", "tk").agg(F.collect_list(F.struct("at", "low", "high", "bucket")).alias("runs"))
    per_doc = per_doc.select(F.col("id").alias("rid"), F.col("tk").alias("rtk"), "runs")
    d = docs.join(per_doc, docs.id.eqNullSafe(per_doc.rid) & (docs.tk == per_doc.rtk))
    d = d.select("id", "tk", F.col("text").cast("binary").alias("text"), F.explode("runs").alias("r"))
    return d.select("id", "tk", "r.*", F.substring("text", F.col("r.low").cast("int") + 1,
                                                   (F.col("r.high") - F.col("r.low")).cast("int") + length).alias("text"))


def finer(runs: DataFrame, length: int, block: int) -> DataFrame:
    """The rows of ``runs`` cut into blocks of ``block`` windows, counted from the suffix. Their
    bucket is refined by the text that all windows of the block cover."""
    schema = T.StructType([*[runs.schema[c] for c in ("id", "tk", "at")], *[
        T.StructField(c, T.LongType()) for c in ("low", "high", "bucket", "block", "run")]])

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        from spantide.llm.tokens import mix64, prefix_hashes
        for batch in batches:
            out, of = [], []
            low_, high_, at_, g_ = (batch.column(c).to_numpy() for c in ("low", "high", "at", "bucket"))
            for r, text in enumerate(batch.column("text").to_pylist()):
                low, high, at = int(low_[r]), int(high_[r]), int(at_[r])
                distance = at - np.arange(low, high + 1)             # of each window to its suffix, falling
                new = np.flatnonzero(np.diff(distance // block, prepend=-1) != 0)
                begin, end = low + new, low + np.append(new[1:], high - low + 1) - 1
                prefix, down = prefix_hashes(np.frombuffer(text, np.uint8))
                run = run_hashes(prefix, down, at - low + np.zeros(len(begin), np.int64), begin - low, end - low, length)
                k, number = len(begin), distance[new] // block
                near = at - low - number * block                     # what all windows of the whole block have in common
                core = (prefix[near + length - block + 1] - prefix[near]) * down[near]
                inner = mix64(core + mix64(np.full(k, g_[r]).view(np.uint64)))
                out.append((np.full(k, at), begin, end, inner.view(np.int64), number, run.view(np.int64)))
                of.append(np.full(k, r))
            if out:
                take = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("tk").take(take),
                     *[pa.array(np.concatenate(x)) for x in zip(*out)]], names=schema.names)

    return runs.select("id", "tk", "at", "low", "high", "bucket", "text").mapInArrow(rows, schema)


def remove(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """(id, n_bytes, spans, kept): the union of the windows in ``spans``, cut out of each text."""
    per_doc = spans.groupBy("id", "tk").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    per_doc = per_doc.select(F.col("id").alias("rid"), F.col("tk").alias("rtk"), "low", "high")
    d = docs.join(per_doc, docs.id.eqNullSafe(per_doc.rid) & (docs.tk == per_doc.rtk), "left")
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema["id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        from spantide.llm.tokens import blocks_of, text_bytes
        kinds = [pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
        for block in blocks_of(batches, "text"):
            sizes, merged, kept = [], [], []
            lows, highs = block.column("low").to_pylist(), block.column("high").to_pylist()
            for text, low, high in zip(text_bytes(block, "text"), lows, highs):
                found = []
                if low:
                    order = np.argsort(low, kind="stable")
                    begin, end = np.array(low)[order], np.maximum.accumulate(np.array(high)[order] + length)
                    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
                    found = list(zip(begin[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist()))
                at = [0, *[x for s in found for x in s], len(text)]
                sizes.append(len(text))
                merged.append([{"begin": b, "end": e} for b, e in found])
                kept.append(b"".join(text[a:b] for a, b in zip(at[::2], at[1::2])))
            yield pa.RecordBatch.from_arrays([block.column("id"), *[pa.array(x, k) for x, k in zip((sizes, merged, kept), kinds)]],
                                             names=schema.names)

    return d.select("id", "text", "low", "high").mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(id, n_bytes, spans, kept) of every document; spans are byte ranges [begin, end)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    found, left = settle(materialise(first_round(d, length, gram), "runs"))
    left = materialise(cut_out(d, left, length), "contexts")
    found2, left2 = settle(materialise(finer(left, length, block), "runs"))
    inner = (left2.withColumnRenamed("low", "lo2").withColumnRenamed("high", "hi2").withColumnRenamed("bucket", "b2"))
    part = left.alias("l").join(inner.alias("r"), F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.tk") == F.col("r.tk")) &
                                (F.col("l.at") == F.col("r.at"))).select("l.*", "lo2", "hi2")
    part = part.where("lo2 >= low AND hi2 <= high").select(
        "id", "tk", "at", F.col("lo2").alias("low"), F.col("hi2").alias("high"), "bucket",
        F.substring("text", (F.col("lo2") - F.col("low")).cast("int") + 1, (F.col("hi2") - F.col("lo2")).cast("int") + length).alias("text"))
    last = materialise(finer(part, length, 1), "runs")
    twice = last.groupBy("bucket", "block", "run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found3 = last.join(materialise(twice, "kinds"), ["bucket", "block", "run"]).select("id", "tk", "low", "high")
    return remove(d, found.unionByName(found2).unionByName(found3), length)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        # what stays, readable: a character that a cut has split is shown as U+FFFD
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
