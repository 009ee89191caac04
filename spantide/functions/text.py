"""Column-expression helpers for text (all JVM-side, no Python UDF).

Regex classes are written out explicitly so that the same pattern means the same
thing in Java regex (Spark) and RE2 (the DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The whitespace set stripped by Python's str.strip (Unicode White_Space
# plus the information separators 0x1C-0x1F), and the word-character class of
# Python's `\w` (letters, numbers, underscore).
WS = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
NONWS = "[^" + WS[1:]
# the same characters one by one
WS_CHARS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}_]"
NL = "\n"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")


def lstrip_len(c) -> Column:
    """Number of leading whitespace characters."""
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), rf"^{WS}+", ""))


def rstrip(c) -> Column:
    return F.regexp_replace(col(c), rf"{WS}+\z", "")


def normalise_lines(c) -> Column:
    """Split on newline, strip every line, drop blank ones, join by newline."""
    parts = F.split(col(c), NL, -1)
    stripped = F.transform(parts, lambda s: F.regexp_replace(s, rf"^{WS}+|{WS}+\z", ""))
    return F.array_join(F.filter(stripped, lambda s: s != F.lit("")), NL)


def covered_text(text, begin, end) -> Column:
    """Text of a half-open span ``[begin, end)``."""
    return F.substring(col(text), col(begin) + 1, col(end) - col(begin))


def n_words(c) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    return F.size(F.filter(F.split(col(c), f"{WS}+", -1), lambda s: s != F.lit("")))


# ---- SQL (DuckDB) counterparts used by the oracle strings -------------------------

def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+\\z', '', 'g')"


def sql_normalise_lines(e: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split({e}, chr(10)), "
            f"lambda s: {sql_strip('s')}), lambda s: s <> ''), chr(10))")


def part(array: str, start, end) -> Column:
    """Elements ``start`` up to ``end`` (from 0, not beyond the array; ``start`` < ``end``) of the column ``array``, read one by one:
    ``slice`` copies the whole array, so one for each of its elements takes the square of its size."""
    return F.transform(F.sequence(start, end - 1), lambda k: F.get(F.col(array), k))


def with_places(df: DataFrame, lengths: str, name: str, block: int = 32) -> DataFrame:
    """``df`` with ``name``, the sums of ``lengths`` (arrays of long, not empty) before each one.

    Summed up in blocks, then over the blocks' sums, so that the work stays near an array's size however large it is.
    """
    def before(xs):
        return F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    n = F.size(lengths)
    starts = F.sequence(F.lit(0), n - 1, F.lit(block))
    # an array of one block needs no second sum
    x = df.withColumn("_in", F.when(n > block, F.transform(starts, lambda at: before(part(lengths, at, F.least(at + block, n))))))
    x = x.withColumn("_ahead", before(F.transform("_in", lambda sums: F.element_at(sums, -1))))
    # the last sum of a block is the first place of the next one
    every = F.zip_with("_in", F.slice("_ahead", F.lit(1), F.size("_in")), lambda sums, far: F.transform(F.slice(sums, F.lit(1), F.size(sums) - 1), lambda s: s + far))
    return x.withColumn(name, F.when(n > block, F.flatten(every)).otherwise(F.slice(before(F.col(lengths)), F.lit(1), n))).drop("_in", "_ahead", lengths)
