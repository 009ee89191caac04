"""Merkle manifest of a dataset by nested-struct rollup (DataFrame functions).

Every row is a leaf, the digest of its fields. Leaves are ranked inside their group; the rank's
lower ``BITS`` binary digits become columns, the rest names a block of 2^BITS consecutive leaves.
Inside a block the digit columns are grouped away one after the other, lowest first: what agrees
in the remaining digits becomes one struct that nests its children and holds the digest of their
digests. A block is then one row with a bounded tree in it. Blocks are the leaves of the next
round, until one row per group, the subroot, remains; subroots are ranked and rolled up likewise.

Proofs come back down: a nested transform walks a block's struct and gives each leaf its steps,
and one explode returns the leaves, without a join of leaves. Only block rows, one in 2^BITS,
fetch the steps above them.

A step is a sibling's digest with its side (``L`` or ``R``), or ``=`` where a node is alone in its
run; ``folded`` recomputes a root from a leaf and its steps.

Plan: leaf digests are written once, narrow; texts are not shuffled. Ranks come from one range
partition by group, key and digest, sorted inside the partitions: a row's number there, plus the
rows of its group in earlier partitions, of which there is one row per partition and group. So a
group that holds a third of all rows is ranked by many tasks; a seeded number at the end of the
sort key also parts rows that are equal in all else. One exchange by (group, block) serves all the
groupings of a block.

Defined results: a null field is ``-``; a null group is a group, the first; null ids come first in
their group, and rows of equal id follow by digest, so that equal rows are interchangeable; a lone
leaf is its group's subroot, and a lone subroot the root, without steps; an empty table gives an
empty table. A field of any length is digested whole. Fields are read by name, so further columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantide.llm.common import materialise

BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A field's part of a leaf: ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, group: str, *keys: str) -> tuple[DataFrame, int]:
    """Written ``rows`` with ``rank``, from 0 by ``keys`` (nulls first) in each ``group``, and ``n``,
    the rows of the group; and the largest ``n``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in (group, *keys, "_salt")]
    dealt = rows.withColumn("_salt", F.rand(13)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = materialise(dealt.drop("_salt").withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.select(*rows.columns, part.alias("_part"), inside.alias("_inside"))
    per = dealt.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_inside").alias("_first"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = materialise(per.select("_g", "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                                 F.sum("_n").over(Window.partitionBy("_g")).alias("n")), "merkle-parts")
    largest = per.agg(F.max("n")).first()[0] or 0                      # one number
    j = dealt.join(per, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return j.select(*rows.columns, (F.col("_inside") - F.col("_first") + F.col("_before")).alias("rank"), "n"), largest


def rollup(nodes: DataFrame, bits: int) -> DataFrame:
    """(group, block, n, node): ``nodes`` (group, rank, n, node), with ``node`` a struct that holds a
    ``hash``, in blocks of 2^bits ranks, a nested struct (hash, kids) each. A node alone at its
    level is handed up as it is."""
    digits = [F.shiftright("rank", level).bitwiseAND(F.lit(1)).alias(f"d{level}") for level in range(bits)]
    cur = nodes.select("group", F.shiftright("rank", bits).alias("block"), "n", "node", *digits).repartition("group", "block")
    for level in range(bits):
        left = [f"d{x}" for x in range(level + 1, bits)]
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{level}").alias("d"), "node")))["node"]
        cur = cur.groupBy("group", "block", "n", *left).agg(kids.alias("kids"))
        joined = F.when(F.col("n") > (1 << level), F.sha2(F.array_join(F.col("kids.hash"), ""), 256)).otherwise(F.col("kids")[0]["hash"])
        cur = cur.select("group", "block", "n", F.struct(joined.alias("hash"), "kids").alias("node"), *left)
    return cur


def _step(kids: Column, i: Column, alone: Column) -> Column:
    """The step from a kid to its parent, as an array of one; empty where nothing is joined yet."""
    pair = F.when(i == 0, F.concat(F.lit("R"), kids[1]["hash"])).otherwise(F.concat(F.lit("L"), kids[0]["hash"]))
    return F.when(F.size(kids) == 2, F.array(pair)).when(alone, F.array(F.lit("="))).otherwise(F.array().cast("array<string>"))


def _leaves(node: Column, level: int, n: Column, above: Column) -> Column:
    """All leaves below a nested struct, with their steps from the leaf up."""
    kids = node["kids"]

    def kid(k, i):
        steps = F.concat(_step(kids, i, n > (1 << level)), above)
        return F.struct(k.alias("leaf"), steps.alias("steps")) if level == 0 else _leaves(k, level - 1, n, steps)
    out = F.transform(kids, kid)
    return out if level == 0 else F.flatten(out)


def climb(nodes: DataFrame, largest: int, top, bits: int = BITS) -> DataFrame:
    """(group, rank, leaf, steps, further columns of ``top``) of ``nodes`` (group, rank, n, node);
    ``top`` is given (group, hash), a row per group, and returns (group, steps, further columns)."""
    b = materialise(rollup(nodes, bits), "merkle-blocks")
    if largest > 1 << bits:
        up = climb(b.select("group", F.col("block").alias("rank"), F.ceil(F.col("n") / (1 << bits)).alias("n"),
                            F.struct(F.col("node.hash").alias("hash")).alias("node")), -(-largest >> bits), top, bits).drop("leaf")
    else:
        up = top(b.select("group", F.col("node.hash").alias("hash"))).withColumn("rank", F.lit(0).cast("long"))
    further = [c for c in up.columns if c not in ("group", "rank", "steps")]
    up = up.select(F.col("group").alias("_g"), F.col("rank").alias("_r"), F.col("steps").alias("above"), *further)
    j = b.join(up, F.col("group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_r")))
    out = j.select("group", "block", *further, F.posexplode(_leaves(F.col("node"), bits - 1, F.col("n"), F.col("above"))).alias("pos", "x"))
    return out.select("group", ((F.col("block") * (1 << bits)) + F.col("pos")).alias("rank"), F.col("x.leaf").alias("leaf"),
                      F.col("x.steps").alias("steps"), *further)


def manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", group_col: str = "lang", other: Column | None = None,
             bits: int = BITS) -> DataFrame:
    """(id, group, leaf, other, subroot, root, steps) of every row; ``other`` is a further leaf of the row,
    to be held against the root, or null."""
    leaf = digest(*[field(F.col(c)) for c in fields])
    other = F.lit(None).cast("string") if other is None else other
    rows = materialise(docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf.alias("hash"), other.alias("other")), "merkle-leaves")
    rows, largest = ranked(rows, "group", "id", "hash")

    def root(tops: DataFrame) -> DataFrame:
        return tops.select("group", F.array().cast("array<string>").alias("steps"), F.col("hash").alias("root"))

    def over_groups(tops: DataFrame) -> DataFrame:
        subs, count = ranked(tops.select(F.lit("").alias("all"), F.col("group").alias("sub"), "hash"), "all", "sub")
        subs = subs.select(F.col("all").alias("group"), "rank", "n", F.struct("hash", "sub").alias("node"))
        got = climb(subs, count, root, bits)
        return got.select(F.col("leaf.sub").alias("group"), "steps", F.col("leaf.hash").alias("subroot"), "root")

    nodes = rows.select("group", "rank", "n", F.struct("hash", "id", "other").alias("node"))
    got = climb(nodes, largest, over_groups, bits)
    return got.select("leaf.id", "group", F.col("leaf.hash").alias("leaf"), "leaf.other", "subroot", "root", "steps")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    def up(acc, step):
        side, sibling = F.substring(step, 1, 1), F.substring(step, 2, 64)
        return F.sha2(F.when(side == "L", F.concat(sibling, acc)).when(side == "R", F.concat(acc, sibling)).otherwise(acc), 256)
    return F.aggregate(steps, leaf, up)


def siblings(steps: Column) -> Column:
    """The digests of the siblings, in order, as one string."""
    return F.array_join(F.transform(steps, lambda s: F.substring(s, 2, 64)), "")


TAMPERED = 7


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    changed = digest(*[field(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    m = manifest(docs, other=F.when(hit, changed))
    m = m.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"),
                 folded(F.coalesce("other", "leaf"), F.col("steps")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))



def _crc32_sql(text: str) -> str:
    """CRC-32 of a short decimal number, bit by bit."""
    step = "list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), {0})"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda a, b: {step.format('xor(a, b)')}, 4294967295::BIGINT), 4294967295)"


def _oracle() -> str:
    part = lambda c, v=None: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({v or c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({v or c} AS VARCHAR) END"
    leaf = "sha256(" + " || ".join(part(c) for c in FIELDS) + ")"
    changed = "sha256(" + " || ".join(part(c, "(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS) + ")"
    tree = """{t} AS (SELECT 0 AS level, g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves}
  UNION ALL SELECT level + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {t} WHERE n > 1 GROUP BY level, g, i // 2, n)"""
    return f"""
WITH RECURSIVE d AS (SELECT *, {leaf} AS leaf, CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % {TAMPERED} = 0 THEN {changed} END AS other FROM documents),
l AS (SELECT *, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d),
{tree.format(t="t", leaves="l")},
subs AS (SELECT g AS lang, h AS subroot FROM t WHERE n = 1),
sl AS (SELECT 0 AS g, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, subroot AS h, lang FROM subs),
{tree.format(t="u", leaves="sl")},
root AS (SELECT h AS root FROM u WHERE n = 1),
p AS (SELECT l.doc_id, l.i AS rank, l.lang, t.level, (l.i >> t.level) % 2 AS side, b.h FROM l JOIN t ON t.g IS NOT DISTINCT FROM l.g AND t.i = l.i >> t.level AND t.n > 1
      LEFT JOIN t b ON b.level = t.level AND b.g IS NOT DISTINCT FROM t.g AND b.i = xor(t.i, 1)
      UNION ALL
      SELECT l.doc_id, l.i, l.lang, 1000 + u.level, (sl.i >> u.level) % 2, b.h FROM l JOIN sl ON sl.lang IS NOT DISTINCT FROM l.lang JOIN u ON u.i = sl.i >> u.level AND u.n > 1
      LEFT JOIN u b ON b.level = u.level AND b.i = xor(u.i, 1)),
q AS (SELECT lang, rank, list(CASE WHEN h IS NULL THEN '=' WHEN side = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY level) AS steps FROM p GROUP BY lang, rank),
f AS (SELECT l.doc_id, l.leaf, subs.subroot, root.root, coalesce(q.steps, []) AS steps, coalesce(l.other, l.leaf) AS h
      FROM l JOIN subs ON subs.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root LEFT JOIN q ON q.lang IS NOT DISTINCT FROM l.lang AND q.rank = l.i),
r AS (SELECT *, list_reduce(steps, lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a WHEN s[1] = 'R' THEN a || s[2:] ELSE a END), h) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded_root,
       folded_root = root AS verified FROM r
"""


ORACLE_SQL = _oracle()
