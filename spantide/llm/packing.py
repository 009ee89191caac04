"""Best-fit packing of documents into training sequences by minimum bin slack.

Documents become token ids plus an end id; longer ones than a sequence are cut, the first
piece taking the remainder. What is packed is the histogram of piece lengths, which has at
most ``capacity`` rows whatever the corpus: per bin, a bitset subset-sum pass over the
lengths still available finds the fullest feasible combination that holds the longest of
them, and the combination is removed, as often as the counts allow. Repeating it is what
the method does bin by bin, since the same lengths give the same combination.

Plan: pieces are tokenised in one narrow pass and written once. Their ranks within a length
come from windows over (length, salt) and per-salt offsets, so a length that a third of all
pieces share is ranked in ``salts`` parts. The combinations (bounded by the capacity, not by
the corpus) are broadcast, and each piece finds its sequence and offset from its rank alone.

Defined results: a null or empty text is one piece with the end id only; repeated rows are
packed one by one; rows of equal length, id and piece are interchangeable; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantide.llm.common import materialise

CAPACITY, END_ID, SALTS = 2048, 0, 256


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, added: bool = False) -> DataFrame:
    """(id, piece, start, length, ids) of every document; ``ids`` are little-endian unsigned
    32-bit numbers. Arrow slices of about a megabyte of text are encoded at a time. With ``added``
    the vocabulary's added tokens are read as such in texts, else as ordinary text."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        from spantide.llm.tokens import blocks_of, encoder, text_bytes
        enc = encoder(vocabulary, pattern)
        encode = enc.encode_added if added else enc.encode
        for block in blocks_of(batches, "text"):
            row, piece, start, length, ids = [], [], [], [], []
            for r, got in enumerate(encode(text_bytes(block, "text"))):
                all_ids = np.append(got.astype("<u4"), np.uint32(end_id)).astype("<u4")
                n = len(all_ids)
                first = n % capacity or capacity
                begins = [0, *range(first, n, capacity)]
                for k, b in enumerate(begins):
                    e = begins[k + 1] if k + 1 < len(begins) else n
                    row.append(r), piece.append(k), start.append(b), length.append(e - b)
                    ids.append(all_ids[b:e].tobytes())
            yield pa.RecordBatch.from_arrays(
                [block.column("id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=[id_col, "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination [(length, times)] that holds the longest length there is.

    Bit s of ``reach`` says that lengths summing to s are available; each step adds
    2^j copies of one length, so that counts are covered in logarithmic steps.
    """
    longest = max(counts)
    room = capacity - longest
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length] - (length == longest), room // length), 1
        while left > 0 and not reach >> room:
            times = min(size, left)
            steps.append((length, times, reach))
            reach |= (reach << length * times) & mask
            left, size = left - times, size * 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {longest: 1}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + times
            total -= length * times
    return sorted(used.items(), reverse=True)


def bin_slack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, times per sequence, first sequence, offset): ranks
    [first, end) of a length go, ``times`` by ``times``, to sequences from the first on."""
    left, seen, plan, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while left:
        combination = fullest(left, capacity)
        bins, offset = min(left[x] // n for x, n in combination), 0
        for length, n in combination:
            plan.append((length, seen[length], seen[length] + bins * n, n, sequence, offset))
            seen[length] += bins * n
            left[length] -= bins * n
            offset += length * n
            if not left[length]:
                del left[length]
        sequence += bins
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) with ``sequence_id``
    and ``offset`` added."""
    spark, names = pieces.sparkSession, pieces.columns
    p = materialise(pieces.select(F.struct("*").alias("row"), F.pmod(F.xxhash64(*names), F.lit(salts)).alias("salt")),
                    "pieces")
    histogram = {r[0]: r[1] for r in p.groupBy(F.col("row.length").alias("x")).count().collect()}   # capacity rows
    plan = spark.createDataFrame(bin_slack_plan(histogram, capacity),
                                 "x long, first long, last long, times long, sequence long, offset long")
    counts = p.groupBy(F.col("row.length").alias("x"), "salt").count()
    before = Window.partitionBy("x").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(F.col("x").alias("bx"), F.col("salt").alias("bsalt"),
                           F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("x", "salt").orderBy(*[F.col("row")[c] for c in names if c != "length"])
    r = p.select("row", F.col("row.length").alias("x"), "salt").withColumn("k", F.row_number().over(inside) - 1)
    r = r.join(begins, (r.x == begins.bx) & (r.salt == begins.bsalt)).select("row", F.col("x").alias("rx"),
                                                                             (F.col("k") + F.col("begin")).alias("rank"))
    j = r.join(F.broadcast(plan), (F.col("rx") == F.col("x")) & (F.col("rank") >= F.col("first")) &
               (F.col("rank") < F.col("last")))
    nth = F.col("rank") - F.col("first")
    return j.select("row.*", (F.col("sequence") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
                    (F.col("offset") + F.pmod(nth, F.col("times")) * F.col("x")).cast("long").alias("offset"))


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers as P
    pieces = token_pieces(docs, P.path("byte_bpe_50k.json"), P.PATTERN, added=True)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of every document."""
    return packed(docs)
