"""Whole-number vectors in packed blocks, and searches of blocks of queries over blocks of rows.

A table of vectors is searched by a stated set of queries. Both are packed, a block of rows in
one binary row. Blocks of rows and blocks of queries meet in a grid: the row blocks lie in
``lanes``, the query blocks in ``cells``, and an equi-join on (lane, cell) brings each pair
together once. A cell holds ``CELL_BLOCKS`` query blocks at most, so what a join task buffers has
a bound; Arrow batches are bounded by their bytes. A task streams its pairs and keeps for each
query block of its cell the best scores so far, so that later blocks are pruned by earlier ones.

Which rows take part: those with an id and a vector whose components are all finite numbers. A
shorter vector is one with zeros behind; a row that is there twice is two rows. A component
beyond 53 bits fails the query, as does a score beyond 63 bits; nothing is rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_BLOCKS = 512


def whole_numbers(df: DataFrame, scale: int, id_col: str, vec_col: str, *extra) -> DataFrame:
    """(id, v, extra columns) of the rows that take part, with v = floor(scale * component)."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def whole(x):
        y = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.when(F.abs(x.cast("double")) * F.lit(float(scale)) < F.lit(2.0 ** 53), y).otherwise(
            F.raise_error(F.lit("a component is beyond 53 bits")).cast("long"))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vec_col, whole).alias("v"), *extra)


def matrix(column, fill: int = 0):
    """An Arrow list column as a matrix of 64-bit numbers, short lists filled up."""
    import numpy as np
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("int64")
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and int(sizes.min()) == width:
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), fill, "int64")
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def packed(a) -> bytes:
    """A matrix as bytes: its shape and its numbers in 2, 4 or 8 bytes each."""
    import numpy as np
    most = int(np.abs(a).max()) if a.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return np.array([*a.shape, int(kind[2])], "<i8").tobytes() + np.ascontiguousarray(a, kind).tobytes()


def unpacked(data: bytes):
    """The matrix of ``packed``, in 64-bit numbers."""
    import numpy as np
    rows, cols, size = np.frombuffer(data, "<i8", 3)
    return np.frombuffer(data, f"<i{size}", offset=24).reshape(rows, cols).astype("int64")


def runs_of(batches, size: int):
    """The rows of Arrow batches in runs of ``size`` (the last one fewer)."""
    import pyarrow as pa
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def blocks(df: DataFrame, size: int, name: str, make) -> DataFrame:
    """``df`` in blocks of ``size`` rows: (``name``, a number; the binary columns that ``make``
    gives of a run of rows, as a dict whose keys are the names in ``make.columns``)."""
    columns = make.columns

    def pack(batches):
        import pyarrow as pa
        for run in runs_of(batches, size):
            made = make(run)
            yield pa.RecordBatch.from_arrays([pa.array([made[c]], pa.binary()) for c in columns], names=list(columns))

    kind = T.StructType([T.StructField(c, T.BinaryType()) for c in columns])
    return df.mapInArrow(pack, kind).withColumn(name, F.monotonically_increasing_id())


def query_blocks(df: DataFrame, size: int, make) -> DataFrame:
    """A stated query set, dealt into blocks of about ``size``."""
    n = df.count()
    return blocks(df.repartition(max(1, -(-n // size))), size, "block", make)


def meet(row_blocks: DataFrame, q_blocks: DataFrame, cell_blocks: int = CELL_BLOCKS) -> DataFrame:
    """Every pair of a row block (numbered ``chunk``) and a query block (numbered ``block``)."""
    spark = row_blocks.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lanes, cells = 2 * n, max(1, -(-q_blocks.count() // cell_blocks))

    def turn(c):       # ids count up in each partition, which stands in the upper bits
        return F.shiftright(c, 33) + F.col(c).bitwiseAND(F.lit((1 << 33) - 1))
    c = row_blocks.select("*", F.pmod(turn("chunk"), F.lit(lanes)).alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    b = q_blocks.select("*", F.pmod(turn("block"), F.lit(cells)).cast("int").alias("bcell"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("blane"))
    # by number of partitions, which adaptive execution keeps: the work is in the pairs, not in the bytes
    c, b = c.repartition(n, "lane", "cell"), b.repartition(n, "blane", "bcell")
    return c.join(b, (F.col("lane") == F.col("blane")) & (F.col("cell") == F.col("bcell")))


def search(pairs: DataFrame, schema: str, step, columns: tuple) -> DataFrame:
    """Rows that ``step(row, state)`` gives, as a dict of arrays, for each pair; ``state`` is a
    dict that a task keeps from pair to pair, for what it knows of a query block."""
    kind = T._parse_datatype_string(schema)

    def run(batches):
        import pyarrow as pa
        target = pa.schema([(f.name, pa.int64()) for f in kind.fields])
        state = {}
        for batch in batches:
            got = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            for r in range(batch.num_rows):
                out = step({c: a[r].as_py() for c, a in zip(columns, got, strict=True)}, state)
                if out is not None and len(out[kind.names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in kind.names], schema=target)

    return pairs.select(*columns).mapInArrow(run, kind)


def exact_in_doubles(q, x) -> bool:
    """Whether every inner product, and every part of it, is exact in double arithmetic."""
    import numpy as np
    if not q.size or not x.size:
        return True
    return float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0 ** 52


def wide_scores(q, x):
    """Inner products of rows in unbounded whole numbers, for what doubles cannot hold."""
    s = q.astype(object) @ x.astype(object).T
    if s.size and max(abs(int(s.max())), abs(int(s.min()))) >= 1 << 63:
        raise OverflowError("a score is beyond 63 bits")
    return s.astype("int64")


def same_width(q, x):
    """Two matrices, the narrower one with zeros behind."""
    import numpy as np
    d = max(q.shape[1], x.shape[1])
    return tuple(a if a.shape[1] == d else np.pad(a, ((0, 0), (0, d - a.shape[1]))) for a in (q, x))


def best_of(group, score, ids, k: int):
    """Places of the ``k`` highest scores of each group, ties to the smaller id, in that order, with their ranks."""
    import numpy as np
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, "int64")
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    keep = rank < k
    return order[keep], rank[keep]
