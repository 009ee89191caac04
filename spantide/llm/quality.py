"""Line-first quality rules (native: DataFrame functions only).

Every line is judged first, by a punctuation, a navigation and a boilerplate rule;
failing lines are removed, and a document that loses too much of its text with them
is rejected. Document figures of the whole text (words, symbols, repeated lines and
three-word windows) give a base verdict beside it.

Plan: one narrow stage, no exchange. A text is split into words and lines once.
Repeated windows are found by sorting ``(hash, position)`` inside the row, which is
n log n for any text. The hash of a window has 64 bits.

Defined results: a null or empty text has no words, fails the base rules and is not
kept; a line without a word is never removed and never counts as repeated; repeated
rows and ids are judged row by row; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantide.llm.common import WS_CHARS, barrier, rows_of

# Symbols that count as noise, marks that punctuate prose, signs that
# separate the entries of a menu, and phrases of page furniture (lower case).
SYMBOLS = "#*$%&|<>"
PROSE_MARKS = r"[.!?,;:\x{2026}\x{3002}\x{FF01}\x{FF1F}\x{3001}\x{FF0C}]"
MENU_SIGN = r"(^|[\x20\x09])[|>/\x{BB}\x{203A}\x{B7}\x{2022}]($|[\x20\x09])"
BOILERPLATE = ("all rights reserved", "accept cookies", "accept all cookies", "cookie policy",
               "cookie settings", "uses cookies", "privacy policy", "terms of use", "terms of service",
               "terms and conditions", "enable javascript", "javascript is disabled", "click here to",
               "sign in to", "log in to", "subscribe to our newsletter", "share this page", "skip to content",
               "back to top", "lorem ipsum")

# Defaults of the rules.
UNPUNCTUATED_WORDS = 40    # a line of so many words without any prose mark fails
SYMBOL_PER_WORDS = 4       # a line with more than one symbol in so many words fails
MENU_SIGNS = 3             # a line with so many separators ...
MENU_WORDS_PER_SIGN = 4    # ... and at most so many words to each of them fails
BOILERPLATE_WORDS = 30     # furniture phrases fail lines of at most so many words
MAX_LOSS_PERCENT = 50      # a document that loses more of its word characters is rejected
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_BLANKS = r"[^\x20\x09-\x0D]+"


def _blank_count(c: str) -> str:
    return f"length(regexp_replace({c}, r'{_BLANKS}', ''))"


def _n_words(c: str) -> str:
    return f"regexp_count({c}, r'{_BLANKS}')"


def _symbols(c: str) -> str:
    return f"length(regexp_replace({c}, r'[^{SYMBOLS}]+', ''))"


MENU_CHARS = "|>/\u00bb\u203a\u00b7\u2022"      # the signs of MENU_SIGN


def line_figures(line: str) -> str:
    """SQL for a struct of what the rules ask of a line, each counted once: words, symbols, and menu
    signs where there are enough of their characters."""
    return (f"named_struct('line', {line}, 'words', {_n_words(line)}, "
            f"'symbols', length({line}) - length(translate({line}, '{SYMBOLS}', '')), "
            f"'menu', if(length({line}) - length(translate({line}, '{MENU_CHARS}', '')) >= {MENU_SIGNS}, regexp_count({line}, r'{MENU_SIGN}'), 0))")


def line_verdict(x: str) -> str:
    """SQL for the rule that a line with ``line_figures`` fails (``punctuation``, ``navigation``,
    ``boilerplate``) or null."""
    phrases = "|".join(BOILERPLATE)
    return f"""CASE
      WHEN {x}.menu >= {MENU_SIGNS} AND {x}.words <= {MENU_WORDS_PER_SIGN} * {x}.menu THEN 'navigation'
      WHEN {x}.symbols * {SYMBOL_PER_WORDS} > {x}.words THEN 'punctuation'
      WHEN {x}.words >= {UNPUNCTUATED_WORDS} AND NOT {x}.line RLIKE r'{PROSE_MARKS}' THEN 'punctuation'
      WHEN {x}.words <= {BOILERPLATE_WORDS} AND lower({x}.line) RLIKE r'\\b({phrases})\\b' THEN 'boilerplate'
      END"""


# Positions covered by three-word windows that occur twice or more: windows sorted by
# (hash, position), neighbours of equal hash kept, then the union of [p, p + 3).
_PAIRS = "zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)), " \
         "(a, b) -> xxhash64(a, b))"
_SORTED = "sort_array(transform(zip_with(slice(pairs, 1, greatest(size(pairs) - 1, 0)), " \
          "slice(words, 3, greatest(size(words) - 2, 0)), (p, c) -> xxhash64(p, c)), (h, i) -> struct(h AS h, i AS i)))"
_HITS = "sort_array(array_distinct(flatten(filter(zip_with(slice(win, 1, greatest(size(win) - 1, 0)), " \
        "slice(win, 2, greatest(size(win) - 1, 0)), " \
        "(a, b) -> if(a.h = b.h, array(a.i, b.i), cast(null AS array<int>))), x -> x IS NOT NULL))))"
_COVERED = "aggregate(zip_with(hits, slice(hits, 2, greatest(size(hits) - 1, 0)), " \
           "(a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x)"


def quality(docs: DataFrame, text_col: str = "text", max_loss_percent: int = MAX_LOSS_PERCENT) -> DataFrame:
    """``row`` (the input row), the document figures, ``base_failed``, ``kept``, the share
    lost ``removed_chars`` / ``word_chars``, the failed lines (``position``, ``rule``) and
    ``cleaned_text``, the text without them."""
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    d = barrier(rows_of(docs), "row", text=text, trimmed=F.btrim(text, F.lit(WS_CHARS)))
    d = barrier(d, "row", "text",
                words=F.when(F.col("trimmed") == "", F.array().cast("array<string>"))
                       .otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+", -1)),
                lines=F.split("text", "\n", -1))
    d = barrier(d, "row", "text", "words", "lines",
                pairs=F.expr(_PAIRS),
                figures=F.expr(f"transform(lines, l -> {line_figures('l')})"))
    d = barrier(d, "row", "text", "words", "lines", "pairs",
                verdicts=F.expr(f"transform(figures, x -> {line_verdict('x')})"),
                worded=F.expr("transform(filter(figures, x -> x.words > 0), x -> x.line)"))
    d = barrier(d, "row", "text", "words", "lines", "verdicts", "worded", win=F.expr(_SORTED))
    d = barrier(d, "row", "text", "words", "lines", "verdicts", "worded", hits=F.expr(_HITS),
                failed=F.expr("filter(zip_with(lines, verdicts, (l, v) -> struct(l AS line, v AS rule)), x -> x.rule IS NOT NULL)"))
    d = d.select(
        "row", "text", "failed", "verdicts", "lines",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.expr(_blank_count("text"))).cast("long").alias("word_chars"),
        F.expr(_symbols("text")).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.expr(_COVERED).cast("long").alias("n_repeat_words"),
        F.expr(f"aggregate(failed, 0L, (s, x) -> s + length(x.line) - {_blank_count('x.line')})").alias("removed_chars"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_chars",
        base.alias("base_failed"),
        (~base & (100 * F.col("removed_chars") <= max_loss_percent * F.col("word_chars"))).alias("kept"),
        F.expr("filter(transform(verdicts, (v, i) -> struct(i AS position, v AS rule)), x -> x.rule IS NOT NULL)")
         .alias("failed_lines"),
        F.when(F.size("failed") == 0, F.col("text")).otherwise(F.expr(
            "array_join(transform(filter(zip_with(lines, verdicts, (l, v) -> struct(l AS line, v AS rule)), "
            "x -> x.rule IS NULL), x -> x.line), '\n')")).alias("cleaned_text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = quality(docs)
    return q.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "removed_chars", F.size("failed_lines").cast("long").alias("n_failed_lines"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept documents, with their failed lines taken out of the text."""
    return with_text(quality(docs).where("kept"), docs, F.col("cleaned_text"))


def with_text(df: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` from ``row``, with a new text and, if there, its ``n_chars``."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    kinds = dict(docs.dtypes)
    return df.select(*[(new[c].cast(kinds[c]) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _sql_verdict(line: str) -> str:
    """The line rules again, as DuckDB (RE2) SQL."""
    n = f"len(regexp_extract_all({line}, '{_BLANKS}'))"
    sym = f"len(regexp_extract_all({line}, '[{SYMBOLS}]'))"
    menu = f"len(regexp_extract_all({line}, '{MENU_SIGN}'))"
    nav = f"({menu} >= {MENU_SIGNS} AND {n} <= {MENU_WORDS_PER_SIGN} * {menu})"
    return (f"({nav} OR {sym} * {SYMBOL_PER_WORDS} > {n} OR "
            f"(NOT regexp_matches({line}, '{PROSE_MARKS}') AND {n} >= {UNPUNCTUATED_WORDS}) OR "
            f"(regexp_matches(lower({line}), '\\b({'|'.join(BOILERPLATE)})\\b') AND {n} <= {BOILERPLATE_WORDS}))")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_BLANKS}') AS words,
             string_split(text, chr(10)) AS lines FROM d),
wd AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
tri AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3
        FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT *, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM tri WHERE w3 IS NOT NULL),
cov AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, (VALUES (0), (1), (2)) t(k) WHERE n >= 2),
rw AS (SELECT doc_id, count(*) AS n_repeat_words FROM cov GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(lines) AS line FROM w),
lv AS (SELECT doc_id, line, regexp_matches(line, '{_BLANKS}') AS worded,
              length(regexp_replace(line, '{_BLANKS}', '', 'g')) AS blanks, {_sql_verdict('line')} AS bad FROM ln),
la AS (SELECT doc_id, count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS n_dup_lines,
              coalesce(sum(length(line) - blanks) FILTER (bad), 0) AS removed_chars,
              count(*) FILTER (bad) AS n_failed_lines
       FROM lv GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[{SYMBOLS}]')) AS BIGINT) AS n_symbols,
             CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(removed_chars AS BIGINT) AS removed_chars, CAST(n_failed_lines AS BIGINT) AS n_failed_lines
      FROM w JOIN la ON la.doc_id = w.doc_id LEFT JOIN rw ON rw.doc_id = w.doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND 100 * removed_chars <= {MAX_LOSS_PERCENT} * word_chars AS kept
FROM f
"""
