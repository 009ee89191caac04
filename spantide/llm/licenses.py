"""License scans: an Aho-Corasick automaton for identifier tags and notice phrases, and a
shunting-yard parser for licence expressions.

Words are maximal runs of letters, digits and characters outside ASCII, A-Z in lower case.
One automaton holds all phrases, each between spaces, and runs over the words of a text
joined by single spaces. Where it meets an identifier tag, the rest of that line of the
original text is read as an expression: operands are licence names, ``with`` binds closest,
then ``and``, then ``or``. Evaluating it gives the licences named and a grade from 0 (nothing
known to be allowed) to 1 (permissive): ``or`` takes the better side, ``and`` the worse.

Plan: one narrow pass in Arrow slices of about a megabyte, no exchange.

Defined results: a null text is empty; a text without any phrase has no places, empty labels,
null positions and score 0; a malformed expression adds the label ``invalid-expression``.
Rows are scanned one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notice phrases, their label, and how sure they make it.
NOTICES = {
    "gnu general public license version 2": ("gpl-2.0", 0.9),
    "gnu general public license version 3": ("gpl-3.0", 0.9),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "apache license version 2 0": ("apache-2.0", 0.9),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "boost software license": ("bsl", 0.8),
    "bsd license": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.7),
    "released into the public domain": ("public-domain", 0.8),
}
BASE_SCORE, TAG, TAG_SCORE = 0.8, "spdx license identifier", 1.0
# Grades of licence families, by the beginning of the name.
GRADES = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "bsl": 1.0, "cc-by-4": 0.9,
          "cc-by-sa": 0.6, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1}
EXCEPTION_GAIN = 0.2
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_WORD = bytes(b if b >= 0x80 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*(?:([()])|([a-z0-9][a-z0-9.+:-]*))")


def to_postfix(expression: str) -> list[str] | None:
    """The operands and operators of a (lower-case) expression in postfix order, or None."""
    out, stack, at, operand_next = [], [], 0, True
    expression = expression.rstrip()
    while at < len(expression):
        m = _TOKEN.match(expression, at)
        if not m:
            return None
        at, token = m.end(), m[1] or m[2]
        if token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")" or token in PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and (token == ")" or PRECEDENCE[stack[-1]] >= PRECEDENCE[token]):
                out.append(stack.pop())
            if token != ")":
                stack.append(token)
                operand_next = True
            elif not stack or stack.pop() != "(":
                return None
        elif not operand_next:
            return None
        else:
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def grade_of(name: str) -> float:
    return max(((len(p), g) for p, g in GRADES.items() if name.startswith(p)), default=(0, 0.0))[1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """(licences named, grade) of a postfix expression."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append(({token}, grade_of(token)))
            continue
        (right, g), (left, f) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(({f"{a} with {b}" for a in left for b in right}, min(1.0, f + EXCEPTION_GAIN)))
        else:
            stack.append((left | right, max(f, g) if token == "or" else min(f, g)))
    return stack[-1]


def automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(found, raw: bytes) -> dict:
    """What the automaton ``found`` and the tags of a text in UTF-8 say of it."""
    words = raw.translate(_WORD).split()
    text = f" {b' '.join(words).decode('utf-8')} "
    places, labels, base, score, tagged, at, spaces = [], set(), set(), 0.0, False, 0, 0
    for end, phrase in found.iter(text):
        if phrase == TAG:
            tagged = True
            continue
        if phrase in NOTICES:
            label, sure = NOTICES[phrase]
            labels.add(label)
            score = max(score, sure)
        if phrase in BASE:
            start = end - len(phrase) - 1          # the space before the first word
            at, spaces = (0, 0) if start < at else (at, spaces)
            spaces += text.count(" ", at, start)
            at = start
            places.append(spaces)
            base.add(BASE[phrase])
            score = max(score, BASE_SCORE)
    expressions, grade = [], None
    if tagged:
        for m in _TAG_LINE.finditer(raw):
            line = re.sub(r"(\*/|-->|[\"';,.])+\s*$", "", m[1].decode("utf-8", "replace").lower().strip())
            postfix = to_postfix(line)
            if postfix is None:
                labels.add("invalid-expression")
                continue
            names, g = evaluate(postfix)
            labels |= names
            expressions.append(" ".join(postfix))
            grade, score = g if grade is None else min(grade, g), TAG_SCORE
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None),
            "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | labels)), "score": score, "expressions": expressions, "grade": grade}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions
    (postfix) and grade (of all tags together; null without one)."""
    fields = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
              ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()),
              ("expressions", T.ArrayType(T.StringType())), ("grade", T.DoubleType())]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, t) for n, t in fields]])

    def run(batches):
        import pyarrow as pa

        from spantide.llm.tokens import blocks_of, text_bytes
        found = automaton()
        kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
        for block in blocks_of(batches, "text"):
            rows = [scan_text(found, t) for t in text_bytes(block, "text")]
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), *[pa.array([r[n] for r in rows], kinds[t.simpleString()]) for n, t in fields]],
                names=["id", *[n for n, _ in fields]])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).withColumnRenamed("id", "doc_id").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "grade")
