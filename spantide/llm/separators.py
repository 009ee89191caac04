"""Token counts of documents from flat, unindexed token files, by a separator scan.

``write_token_files`` writes the ids of documents one after the other, each closed by an
end-of-document id, to flat files without an index. ``scan`` cuts the files into blocks of
fixed size; in each block one vectorised search finds the end ids. A prefix scan over the
blocks of a file (end ids so far, last end id so far) stitches documents that cross block
boundaries, however many blocks they cover, and numbers the documents.

Plan: the scan reads only byte ranges, so a file of any size is read by many tasks; the
prefix scan is a window over one row per block. Writer tasks name their files uniquely, and
only files named in the written ledger count, so repeated tasks leave nothing behind that is
read. The ledger (file, ordinal, id) says which document stands where; it holds no lengths.

Defined results: a null or empty text has 0 tokens; repeated rows are counted one by one; an
empty table gives an empty table; ids after the last end id of a file belong to no document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantide.llm.common import materialise, shared_file, spread
from spantide.session import scratch_path

END_ID, BLOCK_BYTES = 50256, 4 << 20
ID_BYTES = 2          # ids below 65,536 as little-endian unsigned 16-bit numbers


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, pattern: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write one flat file per partition; (file, n_bytes, ordinal, id): a row per document,
    and one per file, without ordinal, that gives its size."""
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("ordinal", T.LongType()), T.StructField("id", docs.schema[id_col].dataType)])

    def write(batches):
        import uuid

        import numpy as np
        import pyarrow as pa

        from spantide.llm.tokens import blocks_of, encoder, text_bytes
        enc, out, name, n, size = encoder(vocabulary, pattern), None, None, 0, 0
        for block in blocks_of(batches, "text"):
            if out is None:
                name = f"{folder}/{uuid.uuid4().hex}.tokens"
                files, path = shared_file(name)
                files.create_dir(path.rpartition("/")[0], recursive=True)
                out = files.open_output_stream(path)
            end = np.array([end_id], "<u2")
            data = np.concatenate([x for ids in enc.encode(text_bytes(block, "text")) for x in (ids.astype("<u2"), end)]).tobytes()
            out.write(data)
            k, size = block.num_rows, size + len(data)
            yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.nulls(k, pa.int64()), pa.array(range(n, n + k), pa.int64()),
                                              block.column("id")], names=["file", "n_bytes", "ordinal", "id"])
            n, kind = n + k, block.column("id").type
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, kind)],
                                             names=["file", "n_bytes", "ordinal", "id"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(write, schema)


def scan(files: DataFrame, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in ``files`` (file, n_bytes)."""
    per_block = block_bytes // ID_BYTES

    def search(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                fs, path = shared_file(file)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(block_bytes, block * block_bytes), "<u2")
                ends = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()),
                                                  pa.array([ends.tolist()], pa.list_(pa.int64()))], names=["file", "block", "ends"])

    blocks = files.where("n_bytes > 0").select(
        "file", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / block_bytes))).alias("block"))
    found = spread(blocks, "file", "block").mapInArrow(search, "file string, block long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("at", F.col("block") * per_block)
    found = found.select(
        "file", "at", "ends", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("base"),
        F.coalesce(F.max(F.col("at") + F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).over(before), F.lit(-1)).alias("last"))
    return found.select("file", F.expr(
        "inline(transform(ends, (e, k) -> named_struct('ordinal', base + k, "
        "'n_tokens', at + e - if(k = 0, last, at + ends[greatest(k - 1, 0)]) - 1)))"))


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, file, ordinal, n_tokens): documents written to flat files and counted from them."""
    folder = scratch_path(docs.sparkSession, "llm-tokens")
    ledger = materialise(write_token_files(docs, folder, vocabulary, pattern, id_col, text_col, end_id), "ledger")
    # both sides have a row per document, and far fewer bytes on disk than in memory: never broadcast
    counts = scan(ledger.where("n_bytes IS NOT NULL").select("file", "n_bytes"), end_id, block_bytes)
    return ledger.where("ordinal IS NOT NULL").select("id", "file", "ordinal").join(
        counts.hint("merge"), ["file", "ordinal"])


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN).select(F.col("id").alias("doc_id"), "n_tokens")
