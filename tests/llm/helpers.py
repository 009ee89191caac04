"""Odd tables and plain-Python statements of the operators, for the tests of this folder."""

import collections
import random
import re

import duckdb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, id string, lines long, size long, `a b` string"


def table(spark, rows):
    """Documents from (doc_id, text, source), with extra columns named like inner ones of the operators."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "r", 1, None, None, 3, "x") for i, t, s in rows], DOCS)


def prose(rng, words):
    out = []
    for k in range(words):
        w = "".join(rng.choice("abcdeéfghiß") for _ in range(rng.randint(1, 8)))
        out.append(w + rng.choice(["", "", "", "", ",", ".", ".\n"]))
    return " ".join(out) + "."


def odd_rows(repeated=True):
    """Null, empty, blank, short and very long texts, copies, near copies, shared lines and passages;
    with ``repeated`` also repeated rows and null ids."""
    rng = random.Random(7)
    passage = prose(rng, 120)
    line = "This very line, with more than forty characters, stands in many documents."
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t \x0b", None), (3, "one", "b"), (4, "a b c d", "b"), (5, "x\n\n", None)]
    rows.append((6, prose(rng, 20000), "b"))
    rows.append((7, "De " * 3000, "c"))
    base = prose(rng, 300)
    words = base.split(" ")
    for k in range(8, 14):
        w = list(words)
        w[k * 7] = "edited"
        rows.append((k, " ".join(w), "a"))
    rows += [(k, base, "c") for k in (14, 15, 16)]
    rows += [(k, prose(rng, 60) + "\n" + passage + "\n" + ["", " ", "\t"][k % 3] + line.upper() + "\n" + prose(rng, 60), "a") for k in range(17, 25)]
    rows.append((25, "Home | News | About | More | Contact | Help |\n" + prose(rng, 80) + "\nAll rights reserved.", "d"))
    rows.append((26, "a%%% b### c&&& d*** " * 30, "d"))
    rows.append((27, "Licensed under the Apache License, Version 2.0. MIT license mit LICENSE! cc-by\nSPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)", "d"))
    rows.append((28, "'s 're x　y <|endoftext|> \u0085 Đ😀 \x1c z  two\n\n\nthree ", "d"))
    rng.shuffle(rows)
    if repeated:
        rows += [rows[3], rows[3], (8, prose(rng, 70), "a"), (None, base, "a"), (None, prose(rng, 90), None), (None, None, None)]
    return rows


def duck(sql, df, name="documents"):
    """Rows of a SQL statement over a Spark table, as sorted tuples with sorted column names."""
    con = duckdb.connect()
    pdf = df.toPandas().astype({c: "Int64" for c, t in df.dtypes if t == "bigint"})
    con.register("given", pdf)
    con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
    rel = con.sql(sql)
    return sorted_rows(rel.columns, rel.fetchall())


def sorted_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(r[k]) for k in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def shingles(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(texts, similarity=0.8):
    """Class number of each text: equal or linked, directly or over others."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if (texts[a] or "") == (texts[b] or "") or sets[a] and k and k >= similarity * (len(sets[a]) + len(sets[b]) - k):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(len(texts))]


def repeats(texts, length):
    """(kept bytes, spans) of each text: windows that occur twice or more, cut out."""
    seen = collections.Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = b"\x01" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(gone))]
        out.append((bytes(b for b, g in zip(t, gone) if not g), spans))
    return out
