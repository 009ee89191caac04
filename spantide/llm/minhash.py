"""Near-duplicate detection by DartMinHash signatures and a banded join.

The elements of a document are its distinct five-word shingles (weight 1 each, or their
counts). On each element, hashed darts fall as a Poisson process over (weight, rank): the
weight axis is cut into the regions [0,1), [1,2), [2,4), ..., each with the rate of its
width. Darts under the element's weight and under a rank limit, set so that a document gets
about k ln k + 2k darts whatever its size, go to one of k coordinates by hash, and each
coordinate keeps the earliest. Two documents agree in a coordinate with the probability of
their (weighted) Jaccard similarity. ``bands`` groups of ``rows`` coordinates are buckets;
at a similarity of 0.8 a pair shares no bucket with a probability of 3e-5.

Within a bucket pairs are not listed. First each bucket takes one pivot, the member that meets most
others in all its buckets, as an original does among its edited copies, and compares it with the
others. Vertices of buckets that then still hold members of two components, mostly texts that share
passages, are bucketed once more, now exactly, by their rarest shingles (see ``rare_shingles``). In
rounds, each of these buckets takes pivots, one from each of its smallest components, and compares
them with the members of its other components; compared pivots leave the bucket; it ends when one
component is left. So every two members are compared, or already joined, or have too few shingles
left after the shared one to be alike, and no link between members of a bucket is lost. Each round takes 64 times as many pivots per bucket as the one
before. Compared pairs are held to the exact similarity of their shingle sets.

Plan: equal texts are one vertex from the start (128-bit digest), so copies never meet.
Texts of vertices in shared buckets are gathered once; joins from members to pivots and to
texts are plain shuffled joins on written tables, whose hot keys adaptive execution splits.
Components are label propagation with pointer jumping over written edges. Every round is
written to the shared folder.

Defined results: null and empty texts and texts of white space have no shingles and join
equal texts only; rows with one id and different texts are separate texts; a class id is the
smallest id in the class, null if none of its rows has one; exactly one row of each class has
``keep``, unless rows are equal in id and text, which agree in all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantide.llm.common import materialise

BANDS, ROWS, SIMILARITY, SHINGLE = 45, 7, 0.8, 5


def dart_signatures(of, element, weight, n_docs: int, k: int):
    """(n_docs, k) array of the earliest darts, as 64-bit numbers of rank and name; documents
    without elements keep the largest number. ``of`` is sorted."""
    import numpy as np

    from spantide.llm.tokens import mix64
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n_docs * k, none, np.uint64)
    total = np.bincount(of, weights=weight, minlength=n_docs)
    darts = k * np.log(k) + 2 * k
    todo = np.flatnonzero(total > 0)
    with np.errstate(divide="ignore"):
        limit = darts / total
    while len(todo):
        wanted = np.zeros(n_docs, bool)
        wanted[todo] = True
        use = np.flatnonzero(wanted[of])
        region = 0
        while len(use):
            low, width = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1), 2.0 ** (region - 1))
            use = use[weight[use] > low]
            seed = mix64(element[use] + np.uint64((region + 1) * 0x9E3779B97F4A7C15 % 2**64))
            live, rank, nth, step = np.arange(len(use)), np.zeros(len(use)), 0, 1
            while len(live):
                counter = np.arange(nth, nth + step, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
                bits = mix64(seed[live][:, None] + counter[None, :])
                gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / width
                at = rank[live][:, None] + np.cumsum(gap, axis=1)
                i, j = np.nonzero(at < limit[of[use[live]]][:, None])
                name = mix64(bits[i, j] ^ np.uint64(0x5851F42D4C957F2D))
                place = low + width * ((name >> np.uint64(40)).astype(np.float64) * 2.0 ** -24)
                e = use[live[i]]
                hit = place < weight[e]
                i, j, name, e = i[hit], j[hit], mix64(name[hit] + np.uint64(1)), e[hit]
                coordinate = ((name >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
                value = (at[i, j].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) \
                    | (name & np.uint64(0xFFFFFFFF))
                np.minimum.at(sig, of[e] * k + coordinate.astype(np.int64), value)
                rank[live] = at[:, -1]
                live = live[at[:, -1] < limit[of[use[live]]]]
                nth, step = nth + step, min(2 * step, 64)
            region += 1
        todo = todo[(sig.reshape(n_docs, k)[todo] == none).any(axis=1)]
        limit = limit * 2
    return sig.reshape(n_docs, k)


def band_hashes(sig, bands: int, rows: int):
    import numpy as np

    from spantide.llm.tokens import mix64
    acc = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for r in range(rows):
        acc = mix64(acc * np.uint64(0xC2B2AE3D27D4EB4F) + sig[:, r * bands:(r + 1) * bands])
    return acc.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, shingle: int,
               counted: bool) -> DataFrame:
    """(id, key, buckets) of each row; ``key`` is the digest of its text, ``buckets`` is empty
    for a text without words."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("key", T.BinaryType()),
                           T.StructField("buckets", T.ArrayType(T.LongType()))])

    def sign(batches):
        import numpy as np
        import pyarrow as pa

        from spantide.llm.shingles import shingle_sets
        from spantide.llm.tokens import blocks_of, text_bytes
        for block in blocks_of(batches, "text"):
            n = block.num_rows
            of, element, count = shingle_sets(text_bytes(block, "text"), shingle)
            weight = count.astype(np.float64) if counted else np.ones(len(of))
            has = np.zeros(n, bool)
            has[of] = True
            values = band_hashes(dart_signatures(of, element, weight, n, bands * rows)[has], bands, rows).ravel()
            offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), block.column("key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                schema=pa.schema([("id", block.column("id").type), ("key", pa.binary()), ("buckets", pa.list_(pa.int64()))]))

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text")).mapInArrow(sign, schema)


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity or more, exactly."""
    left = pairs.join(texts.select(F.col("vid").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("vid").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches):
        import numpy as np
        import pyarrow as pa

        from spantide.llm.shingles import shingle_sets
        from spantide.llm.tokens import blocks_of, text_bytes
        for block in blocks_of(batches, "text_a"):
            n = block.num_rows
            of, element, _ = shingle_sets(text_bytes(block, "text_a") + text_bytes(block, "text_b"), shingle)
            size = np.bincount(of, minlength=2 * n)
            pair = of % n
            order = np.lexsort((element, pair))
            p, e = pair[order], element[order]
            twice = (p[1:] == p[:-1]) & (e[1:] == e[:-1])
            shared = np.bincount(p[1:][twice], minlength=n)
            ok = shared >= similarity * (size[:n] + size[n:] - shared)
            yield pa.RecordBatch.from_arrays([block.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def rare_shingles(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(bucket, vid, size, nth): the rarest shingles of each text that another text shares, with
    their places in the text's own order.

    With all shingles in one order, here by the number of these texts that hold them, two sets
    of similarity s or more share one of the first n - ceil(s n) + 1 of either. Passages that
    many texts share come last, so they bring no two texts together.
    """
    def sets(batches):
        import numpy as np
        import pyarrow as pa

        from spantide.llm.shingles import shingle_sets
        from spantide.llm.tokens import blocks_of, text_bytes
        for block in blocks_of(batches, "text"):
            of, element, _ = shingle_sets(text_bytes(block, "text"), shingle)
            size = np.bincount(of, minlength=block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("vid").take(pa.array(of)), pa.array(size[of]), pa.array(element.view(np.int64))],
                                             names=["vid", "size", "bucket"])

    rows = materialise(texts.select("vid", "text").mapInArrow(sets, "vid long, size long, bucket long"), "sets")
    shared = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    nth = F.row_number().over(Window.partitionBy("vid").orderBy("df", "bucket"))
    unshared = F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("vid"))          # come before all others
    rows = rows.join(shared, "bucket").withColumn("nth", nth + unshared)
    return rows.where(F.col("nth") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).select(
        "bucket", "vid", "size", "nth")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for the vertices of ``edges`` (a, b): the smallest vertex they reach."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                        .select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        step = label.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = materialise(step, "labels")
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = materialise(step.join(jump, "label", "left")
                          .select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        if new.where("old <> label").isEmpty():
            return new.select("v", "label")
        label = new.select("v", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS,
                    similarity: float = SIMILARITY, shingle: int = SHINGLE, counted: bool = False) -> DataFrame:
    """(id, key, class_id, class_texts, keep) of each row; ``key`` is the digest of its text."""
    signed = materialise(signatures(docs, id_col, text_col, bands, rows, shingle, counted), "signatures")
    texts = signed.groupBy("key").agg(F.min("id").alias("rep"), F.first("buckets").alias("buckets"))
    vertex = materialise(texts.withColumn("vid", F.monotonically_increasing_id()), "vertices")

    member = vertex.select("vid", F.explode("buckets").alias("bucket"))
    shared = materialise(member.groupBy("bucket").count().where("count > 1"), "shared")
    live = materialise(member.join(shared, "bucket"), "members")
    # the others that a vertex meets, over all its buckets: an original meets more than its edited copies do
    label = materialise(live.groupBy("vid").agg((-F.sum(F.col("count") - 1)).alias("order")).withColumn("label", F.col("vid")), "labels")
    nothing = F.lit(None).cast("long")
    live = live.select("bucket", "vid", nothing.alias("size"), nothing.alias("nth"))
    source = vertex.join(label, "vid").select("vid", "key", "rep")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("dkey"), text.alias("text"))
    texts = materialise(d.join(source, (d.dkey == source.key) & d.id.eqNullSafe(source.rep)).select("vid", "text"), "texts")

    seen, width, first_round = None, 1, True
    while True:
        here = live.join(label, "vid")
        by_label = here.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("order", "vid", "size", "nth")).alias("first"))
        if width == 1:
            pivots = (by_label.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.min(F.struct("n", "first", "label")).alias("p"))
                      .where("labels > 1").select("bucket", F.col("p.first").alias("first"), F.col("p.label").alias("plabel")))
        else:
            small_first = Window.partitionBy("bucket").orderBy("n", "first")
            pivots = (by_label.withColumn("nth", F.row_number().over(small_first))
                      .withColumn("labels", F.count(F.lit(1)).over(Window.partitionBy("bucket")))
                      .where((F.col("nth") < F.col("labels")) & (F.col("nth") <= width)).select("bucket", "first", F.col("label").alias("plabel")))
        pivots = materialise(pivots.select("bucket", "plabel", F.col("first.vid").alias("pivot"), F.col("first.size").alias("psize"),
                                           F.col("first.nth").alias("pnth")), "pivots")
        if pivots.isEmpty():
            break
        # if this is the first shingle that the two share, so many can follow at most in either
        shared = F.least(F.col("size") - F.col("nth"), F.col("psize") - F.col("pnth")) + 1
        enough = shared * (1 + similarity) >= similarity * (F.col("size") + F.col("psize")) - 1e-6
        pairs = here.join(pivots, "bucket").where((F.col("label") != F.col("plabel")) & (F.col("size").isNull() | enough)).select(F.least("vid", "pivot").alias("a"), F.greatest("vid", "pivot").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        if not pairs.isEmpty():
            links = similar_pairs(pairs, texts, shingle, similarity)
            la, lb = label.select(F.col("vid").alias("a"), F.col("label").alias("x")), label.select(F.col("vid").alias("b"), F.col("label").alias("y"))
            links = materialise(links.join(la, "a").join(lb, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
            if not links.isEmpty():
                joined = components(links)
                label = materialise(label.join(joined, label.label == joined.v, "left")
                                    .select("vid", "order", F.coalesce(joined.label, label.label).alias("label")), "labels")
            seen = pairs if seen is None else seen.unionByName(pairs)
        if first_round:
            open_ = live.join(label, "vid").groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
            rest = materialise(live.join(open_, "bucket", "left_semi").select("vid").distinct(), "rest")
            live, first_round = materialise(rare_shingles(texts.join(rest, "vid", "left_semi"), shingle, similarity), "members"), False
        else:
            live = materialise(live.join(pivots.select("bucket").distinct(), "bucket", "left_semi")
                               .join(pivots.select("bucket", F.col("pivot").alias("vid")), ["bucket", "vid"], "left_anti"), "members")
            width = min(width * 64, 1 << 40)       # beyond the labels of any bucket; rounds go on until no bucket is mixed

    v = vertex.join(label.select(F.col("vid").alias("lvid"), "label"), F.col("vid") == F.col("lvid"), "left")
    v = v.select("vid", "key", "rep", F.coalesce("label", "vid").alias("label"))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "vid"))
    heads = materialise(v.groupBy("label").agg(first.alias("head"), F.count(F.lit(1)).alias("class_texts")), "heads")
    classes = materialise(v.join(heads, "label").select(
        "key", "rep", F.col("head.rep").alias("class_id"), "class_texts", (F.col("vid") == F.col("head.vid")).alias("lead")), "classes")
    return signed.select("id", "key").join(classes, "key").select(
        "id", "key", "class_id", "class_texts", (F.col("lead") & F.col("id").eqNullSafe(F.col("rep"))).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "class_texts", "keep")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class of near duplicates."""
    kept = materialise(near_duplicates(docs).where("keep").select(F.col("id").alias("kid"), F.col("key").alias("kkey")).distinct(), "kept")
    d = docs.select(F.struct("*").alias("row"))
    d = d.select("row", F.col("row.doc_id").alias("did"), F.unhex(F.md5(F.coalesce(F.col("row.text"), F.lit("")))).alias("dkey"))
    j = d.join(kept, d.did.eqNullSafe(kept.kid) & (d.dkey == kept.kkey)).dropDuplicates(["kid", "kkey"])
    return j.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
