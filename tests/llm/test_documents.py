"""The operators on documents against SQL or plain Python, on odd tables and on sf0.001."""

import collections
import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers as P  # noqa: E402
from helpers import classes, duck, odd_rows, prose, repeats, sorted_rows, spark_rows, table  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from spantide.llm import (fingerprints, licenses, linededup, minhash, mixing, packing, quality, separators,  # noqa: E402
                          suffixes, tokens)
from tokenizers import Tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"
VOCABULARY = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def plain(spark):
    return table(spark, odd_rows(repeated=False)).cache()


@pytest.fixture(scope="module")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- quality rules, line dedup, mixing: DuckDB SQL ------------------------------------------

def quality_digest(df):
    return quality.quality(df).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_chars", F.size("failed_lines").cast("long").alias("n_failed_lines"))


def test_quality_against_sql(plain, sf_docs):
    for df in (plain, sf_docs):
        assert spark_rows(quality_digest(df)) == duck(quality.ORACLE_SQL, df)


def test_quality_verdicts(odd):
    got = {(r.doc_id, r.n_words): r for r in quality.quality(odd).select("row.doc_id", "*").collect()}
    by_id = {i: r for (i, _), r in got.items()}
    assert not by_id[0].kept and by_id[0].n_words == 0 and by_id[0].cleaned_text == ""
    assert by_id[7].base_failed and by_id[7].n_repeat_words == by_id[7].n_words == 3000
    assert [x.rule for x in by_id[25].failed_lines][0] == "navigation" and by_id[25].failed_lines[-1].rule == "boilerplate"
    assert by_id[25].kept and "Home |" not in by_id[25].cleaned_text
    assert not by_id[26].kept
    assert by_id[6].kept and by_id[6].removed_chars == 0
    assert quality.quality(odd).count() == odd.count()


def line_digest(df, **kw):
    return linededup.dedup_lines(df, **kw).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def test_line_dedup_against_sql(plain, sf_docs):
    for df in (plain, sf_docs):
        got = spark_rows(line_digest(df))
        assert got == duck(linededup.ORACLE_SQL, df)
    assert sum(r[3] for r in got) > 0


def test_line_dedup_repeated_rows(spark):
    line = "A line of more than forty characters, the same everywhere."
    df = table(spark, [(k, f"{k}.\n{line}", "s") for k in range(4)] + [(3, f"3.\n{line}", "s")] * 2 + [(None, line, "s")])
    got = sorted(((r.doc_id is None, r.doc_id, r.n_dropped) for r in line_digest(df).collect()), key=repr)
    # five documents (0 to 3 and the one without id); the largest id keeps the line, in all its rows
    assert got == sorted([(False, 0, 1), (False, 1, 1), (False, 2, 1)] + [(False, 3, 0)] * 3 + [(True, None, 1)], key=repr)


def test_mixing_against_sql(plain, sf_docs):
    for df in (plain, sf_docs):
        got = mixing.mix(df).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
        assert spark_rows(got) == duck(mixing.ORACLE_SQL, df)


def shared_out(sizes, weights, epochs):
    """Targets by sharing the excess again and again."""
    target, full = [0.0] * len(sizes), set()
    while True:
        open_ = [k for k in range(len(sizes)) if k not in full]
        left = sum(sizes) - sum(epochs * sizes[k] for k in full)
        for k in range(len(sizes)):
            target[k] = epochs * sizes[k] if k in full else left * weights[k] / sum(weights[j] for j in open_)
        over = {k for k in open_ if target[k] > epochs * sizes[k]}
        if not over:
            return target
        full |= over


def test_targets(spark):
    rng = random.Random(6)
    for n in (1, 2, 7, 20):
        sizes = [rng.choice([0, 1, 10, 300, 5000]) * rng.randint(1, 9) for _ in range(n)]
        df = spark.createDataFrame([(f"s{k:02d}", x) for k, x in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
        weights = [(5, 2, 1)[k % 3] for k in range(n)]
        assert np.allclose(got, shared_out(sizes, weights, 3) if sum(sizes) else sizes)


def test_mixing_comes_near_its_targets(sf_docs, odd):
    m = mixing.mix(sf_docs).groupBy("row.source", "target").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("size").alias("largest"), F.max("copies").alias("copies")).collect()
    for r in m:
        assert abs(r.taken - r.target) <= max(0.5 * r.largest, 1e-6) and r.copies <= 3
    assert mixing.mix(odd).count() == odd.count()
    assert spark_rows(mixing.mix(odd).select("row.doc_id", "copies")) == spark_rows(mixing.mix(odd.repartition(3)).select("row.doc_id", "copies"))


# ---- tokens: packing and separator scan -------------------------------------------------------

def test_encoder_equals_tokenizers(reference):
    rng = random.Random(1)
    alphabet = list(" \n\t\r\x0b\x1c\x7f'sS1a.,é 　\u0085 中Đ😀") + ["'s", "'ll", " ", "\n", "<|endoftext|>", " the"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    enc = tokens.Encoder(VOCABULARY, P.PATTERN)
    for part in (texts[:1500], texts[1500:], texts[:100]):
        assert [x.tolist() for x in enc.encode([t.encode() for t in part])] == [reference(t) for t in part]


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        got = packing.fullest(counts, 40)
        longest = max(counts)
        sums = {longest}
        for length, n in counts.items():
            sums |= {s + length * k for s in sums for k in range(n + 1 - (length == longest)) if s + length * k <= 40}
        assert sum(x * n for x, n in got) == max(s for s in sums if s <= 40)
        assert all(n <= counts[x] for x, n in got) and dict(got)[longest] >= 1


def test_packing(spark, odd, reference):
    pieces = packing.token_pieces(odd, VOCABULARY, P.PATTERN)
    got = packing.pack(pieces).toPandas()
    texts = collections.Counter((i, t) for i, t, _ in odd_rows())
    expected = collections.Counter()
    for (i, t), n in texts.items():
        ids = np.array(reference(t) + [0], "<u4")
        first = len(ids) % 2048 or 2048
        for k, b in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[b:first if k == 0 else b + 2048]
            expected[(i, k, b, len(part), zlib.crc32(part.tobytes()))] += n
    seen = collections.Counter((None if i != i else int(i), p, s, n, zlib.crc32(bytes(x)))
                               for i, p, s, n, x in zip(got.doc_id.astype(object), got.piece, got.start, got.length, got.ids))
    assert seen == expected
    got = got.sort_values(["sequence_id", "offset"])
    group = got.groupby("sequence_id").length
    assert (group.cumsum() - got.length == got.offset).all() and group.sum().max() <= 2048
    bins = []
    for n in sorted(got.length, reverse=True):       # first fit decreasing does no better
        k = next((k for k, b in enumerate(bins) if b + n <= 2048), len(bins))
        bins[k:k + 1] = [n + (bins[k] if k < len(bins) else 0)]
    assert got.sequence_id.nunique() <= len(bins)


def test_packing_reaches_the_lower_bound(sf_docs):
    got = packing.packed(sf_docs).toPandas()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_token_counts(odd, reference):
    expected = sorted(((str(i), len(reference(t))) for i, t, _ in odd_rows()))
    for block_bytes in (separators.BLOCK_BYTES, 256):
        got = separators.count_tokens(odd, VOCABULARY, P.PATTERN, block_bytes=block_bytes)
        assert sorted((str(r.id), r.n_tokens) for r in got.collect()) == expected


# ---- near duplicates -----------------------------------------------------------------------------

def test_darts_collide_with_weighted_jaccard():
    rng = np.random.default_rng(3)
    element = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    a, b = rng.uniform(0.1, 9, 60), rng.uniform(0.1, 9, 60)
    b[:20] = a[:20]
    sig = minhash.dart_signatures(np.repeat([0, 1], 60), np.tile(element, 2), np.concatenate([a, b]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def check_classes(df, rows):
    got = minhash.near_duplicates(df).collect()
    number = classes([t for _, t, _ in rows])
    key = {hashlib.md5((t or "").encode()).digest(): n for (_, t, _), n in zip(rows, number)}
    ids = collections.defaultdict(list)
    for (i, t, _), n in zip(rows, number):
        ids[n].append(i)
    assert len(got) == len(rows)
    for r in got:
        assert r.class_id == min((i for i in ids[key[bytes(r.key)]] if i is not None), default=None)
    kept = {(key[bytes(r.key)], r.id, bytes(r.key)) for r in got if r.keep}
    assert sorted(k[0] for k in kept) == sorted(ids)


def test_near_duplicates_odd(odd):
    check_classes(odd, odd_rows())


def test_near_duplicates_of_many_edits(spark):
    """A chain and a crowd of edited copies, some pairs of them just above or below 0.8."""
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = prose(rng, 80).split(" ")
        for k in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 3)}"
            rows.append((100 * g + k, " ".join(w), "s"))
    check_classes(table(spark, rows), rows)


def test_near_duplicates_sf(sf_docs):
    rows = [(r.doc_id, r.text, r.source) for r in sf_docs.collect()]
    check_classes(sf_docs, rows)


# ---- repeated byte strings -----------------------------------------------------------------------

def check_repeats(df, rows, length, **kw):
    got = suffixes.remove_repeats(df, length=length, **kw).collect()
    expected = collections.Counter()
    for (i, t, _), (kept, spans) in zip(rows, repeats([(t or "").encode() for _, t, _ in rows], length)):
        expected[(i, len((t or "").encode()), kept, tuple(spans))] += 1
    assert collections.Counter((r.id, r.n_bytes, bytes(r.kept), tuple((s.begin, s.end) for s in r.spans)) for r in got) == expected


def test_repeats_odd(odd):
    check_repeats(odd, odd_rows(), 400)


def test_repeats_small_windows(spark):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 120))), "s") for k in range(40)]
    rows += [(50, "ab" * 60, "s"), (51, "a" * 90, "s"), (52, None, "s")]
    check_repeats(table(spark, rows), rows, 12, gram=5, block=3)


# ---- licences ------------------------------------------------------------------------------------

def test_licenses(odd, sf_docs):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for df in (odd, sf_docs):
        found = 0
        texts = collections.Counter((r.doc_id, r.text) for r in df.collect())
        expected = collections.Counter()
        for (i, t), n in texts.items():
            w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
            places, labels = [], set()
            for phrase, label in licenses.BASE.items():
                p = phrase.split()
                at = [k for k in range(len(w)) if w[k:k + len(p)] == p]
                places += at
                labels |= {label} if at else set()
            expected[(i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))] += n
        got = licenses.scan_licenses(df).collect()
        assert collections.Counter((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == expected
        for r in got:
            assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
            found += r.n_base
        assert found
    tagged = [r for r in licenses.scan_licenses(odd).collect() if r.expressions]
    assert [r.expressions for r in tagged] == [["mit apache-2.0 gpl-2.0-only classpath-exception-2.0 with and or"]]
    assert "gpl-2.0-only with classpath-exception-2.0" in tagged[0].labels and tagged[0].grade == 1.0


def test_expressions():
    assert licenses.to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.to_postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]
    for bad in ("", "a b", "a or", "or a", "(a", "a)", "()", "a or or b", "a $ b"):
        assert licenses.to_postfix(bad) is None
    assert licenses.evaluate(licenses.to_postfix("mit and gpl-2.0"))[1] == 0.3
    assert licenses.evaluate(licenses.to_postfix("mit or gpl-2.0"))[1] == 1.0


# ---- fingerprints ---------------------------------------------------------------------------------

def counts(text):
    return collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_fingerprints(plain, spark):
    rows = sorted(odd_rows(repeated=False), key=lambda r: -r[0])
    f = fingerprints.fingerprints(plain, samples=16)
    got = {r.id: r for r in f.collect()}
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(rows):
        t, (j, nxt, _) = t or "", rows[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[:len(t) - half] + (nxt or "")[:half]
        assert (got[i].n_chars, got[i].edited_sha256, got[i].next_id) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), j)
        assert len(got[i].sample) == (16 if counts(t) else 0) and len(got[i].edited_sample) == (16 if counts(edited) else 0)
    assert got[14].sample == got[15].sample == got[16].sample


def test_fingerprint_rate_is_weighted_jaccard(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    a = {w: rng.randint(1, 9) for w in words[:45]}
    b = {w: a[w] if k % 2 and w in a else rng.randint(1, 9) for k, w in enumerate(words)}
    rows = [(k, w, float(x[w])) for k, x in enumerate((a, b)) for w in words if x.get(w)]
    df = spark.createDataFrame(rows, "id int, w string, n double").withColumn("term", F.xxhash64("w"))
    s = df.groupBy("id").agg(*[F.min(fingerprints.sample_key(F.col("term"), F.ln("n"), F.lit(k))).alias(f"s{k}") for k in range(60)])
    hits, x, y = 0, *[list(r)[1:] for r in s.orderBy("id").collect()]
    hits = sum(p == q for p, q in zip(x, y)) / len(x)
    true = sum(min(a.get(w, 0), b.get(w, 0)) for w in words) / sum(max(a.get(w, 0), b.get(w, 0)) for w in words)
    assert abs(hits - true) < 4 * (true * (1 - true) / 60) ** 0.5


def test_fingerprints_of_repeated_rows(odd):
    f = fingerprints.fingerprints(odd).collect()
    assert sum(r.rows for r in f) == odd.count() and len(f) == odd.select("doc_id", F.coalesce("text", F.lit(""))).distinct().count()
    by_text = {}
    for r in f:
        by_text.setdefault(r.tk, set()).add(tuple(r.sample))
    assert all(len(x) == 1 for x in by_text.values())


# ---- empty tables ----------------------------------------------------------------------------------

def test_empty_tables(odd):
    none = odd.where("false")
    assert quality.quality(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack(packing.token_pieces(none, VOCABULARY, P.PATTERN)).count() == 0
    assert separators.count_tokens(none, VOCABULARY, P.PATTERN).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert suffixes.remove_repeats(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert fingerprints.fingerprints(none).count() == 0
    assert sorted_rows(["a"], []) == []
