"""Term extraction (T1-T16) over sentence tables.

Plan shape: sentences are already hash-partitioned on ``doc_id``; a sentence's tokens
are arrays of its row and its candidates are made from them in place, so no token
is sorted, and the de-duplication is a hash aggregate keyed by ``doc_id`` and term, so the
whole chain runs without another exchange. Corpus statistics (T14/T15, T11) aggregate
map-side before their single shuffle on the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantide.functions.lexicon import (INVALID_POS, TERM_FORBIDDEN, lexicon_keys_by_pos,
                                        stopword_rows)
from spantide.functions.summary import key_summary, may_hold
from spantide.functions.text import WORD, WS, WS_CHARS, part, strip, with_places
from spantide.session import cut_lineage

PIECE_RE = rf"(?s){WORD}+(?:['\-]{WORD}+)*|{WS}+|."
# a token (a word or one other character) and the whitespace that follows it
UNIT_RE = rf"(?s)(?:{WORD}+(?:['\-]{WORD}+)*|.){WS}*"
WORDTOK_RE = rf"^{WORD}+(?:['\-]{WORD}+)*$"
WS_RE = rf"^{WS}+$"
NUM_RE = r"^\p{N}+$"
PUNCT_RE = r"^\p{P}$"
CAP_RE = r"^\p{Lu}"
# parts of speech that end a run of term tokens (T4): the invalid ones plus auxiliaries
RUN_BREAK = INVALID_POS + ("AUX",)
FUNCTION_POS = ("DET", "PRON", "ADP", "CCONJ", "SCONJ", "AUX", "ADV")


def _esc_class(chars: str) -> str:
    out = []
    for ch in chars:
        if ch == "\t":
            out.append(r"\t")
        elif ch in "[]\\^-":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "[" + "".join(out) + "]"


FORBIDDEN_RE = _esc_class(TERM_FORBIDDEN)
ASCII_RE = r"^[\x{00}-\x{7F}]+$"


def pos_expr(piece: Column, key: Column, tok_no: Column) -> Column:
    """Dictionary part of speech of one token (T1 filler; ``piece`` is a word or one other character, as the words of the lexicon are).

    ``key`` is ``lang|lower(piece)``: a column or a lambda's variable, since it is read once for every class.
    """
    by_pos = lexicon_keys_by_pos()
    listed = F.lit(None).cast("string")
    for pos, keys in reversed(by_pos.items()):
        listed = F.when(key.isin(keys), F.lit(pos)).otherwise(listed)
    e = F.when(key.isin([k for keys in by_pos.values() for k in keys]), listed)
    e = e.when((piece >= "a") & (piece < "{"), F.lit("NOUN"))       # begins with a to z, so none of what follows
    e = e.when(piece.rlike(NUM_RE), F.lit("NUM"))
    e = e.when(~piece.rlike(WORDTOK_RE), F.when(piece.rlike(PUNCT_RE), F.lit("PUNCT")).otherwise(F.lit("SYM")))
    return e.when(piece.rlike(CAP_RE) & (tok_no > 0), F.lit("PROPN")).otherwise(F.lit("NOUN"))


def token_lists(sents: DataFrame, lang_col: str = "lang") -> DataFrame:
    """T1, a row per sentence: ``(doc_id, sent_no, lang, _sb, _units, _texts, _pos, _lemmas)``, arrays in order of token.

    ``_units`` are the tokens with the whitespace that follows them, ``_sb`` is the place of the first one. A row holds
    its own sentence only, so nothing has to be sorted or gathered to see a token's neighbours.
    """
    text = F.regexp_replace("text", rf"^{WS}+", "")
    x = sents.select("doc_id", "sent_no", F.col(lang_col).alias("lang"), (F.col("begin") + F.length("text") - F.length(text)).alias("_sb"),
                     F.regexp_extract_all(text, F.lit(UNIT_RE), F.lit(0)).alias("_units"))
    x = x.withColumn("_texts", F.transform("_units", lambda u: F.rtrim(u, F.lit(WS_CHARS))))
    x = x.withColumn("_keys", F.transform("_texts", lambda t: F.concat(F.col("lang"), F.lit("|"), F.lower(t))))
    x = x.withColumn("_pos", F.transform("_texts", lambda t, i: pos_expr(t, F.get(F.col("_keys"), i), i))).drop("_keys")
    return x.withColumn("_lemmas", F.zip_with("_texts", "_pos", lambda t, p: F.when(p.isin(*FUNCTION_POS), F.lower(t)).otherwise(t)))


def tokens(sents: DataFrame, lang_col: str = "lang") -> DataFrame:
    """``(doc_id, sent_no, begin, text, lang)`` sentences -> one row per token
    ``(doc_id, sent_no, tok_no, begin, end, text, ws_after, lemma, pos, lang)``.

    Offsets are document offsets; ``ws_after`` is the whitespace that follows the
    token inside the sentence (so any token range can be turned back into text).
    """
    return token_rows(token_lists(sents, lang_col))


def token_rows(lists: DataFrame) -> DataFrame:
    """One row per token of ``token_lists``, with the columns of ``tokens``.

    A token's place is the length of the units before it.
    """
    x = lists.where(F.size("_units") > 0).withColumn("_n", F.transform("_units", lambda u: F.length(u).cast("long")))
    x = with_places(x, "_n", "_at")
    x = x.select("doc_id", "sent_no", "lang", "_sb", F.posexplode(F.arrays_zip("_at", "_units", "_texts", "_lemmas", "_pos")).alias("tok_no", "_t"))
    begin, text = F.col("_sb") + F.col("_t._at"), F.col("_t._texts")
    return x.select("doc_id", "sent_no", F.col("tok_no").cast("long").alias("tok_no"), begin.cast("long").alias("begin"),
                    (begin + F.length(text)).cast("long").alias("end"), text.alias("text"),
                    F.substr(F.col("_t._units"), F.length(text) + 1).alias("ws_after"), F.col("_t._lemmas").alias("lemma"), F.col("_t._pos").alias("pos"), "lang")


def listed(toks: DataFrame) -> DataFrame:
    """Rows of ``tokens`` as ``token_lists``; lists stay as they are."""
    if "_units" in toks.columns:
        return toks
    t = F.struct("tok_no", "text", "ws_after", "pos", "lemma", "begin")
    g = toks.groupBy("doc_id", "sent_no").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(t)).alias("t"))
    return g.select("doc_id", "sent_no", "lang", F.get("t", F.lit(0))["begin"].alias("_sb"), F.transform("t", lambda x: F.concat(x["text"], x["ws_after"])).alias("_units"),
                    F.col("t.text").alias("_texts"), F.col("t.pos").alias("_pos"), F.col("t.lemma").alias("_lemmas"))


def token_words(toks: DataFrame) -> DataFrame:
    """``(lang, word, doc_id)``, once per document: the lower-cased tokens of rows or lists. Both lie where their document does,
    so this needs no exchange."""
    if "_units" in toks.columns:
        return toks.select("lang", F.explode(F.transform(F.array_distinct("_texts"), lambda t: F.lower(t))).alias("word"), "doc_id").distinct()
    return toks.select("lang", F.lower("text").alias("word"), "doc_id").distinct()


_TOK = "struct<tok_no:bigint,begin:bigint,end:bigint,text:string,ws_after:string,lemma:string,pos:string>"


def span_text(span: Column) -> Column:
    """Text of a token array: each token with the whitespace that follows it, except
    after the last one. Tokens never start or end with whitespace, so this equals
    the stripped covered text without a regex pass."""
    last = F.size(span) - 1
    return F.array_join(F.transform(span, lambda t, i: F.when(i < last, F.concat(t["text"], t["ws_after"]))
                                    .otherwise(t["text"])), "")


def candidate_runs(toks: DataFrame, max_ngram: int = 10) -> DataFrame:
    """T4: parser-free candidate spans of token rows or of ``token_lists``.

    A *run* is a maximal sequence of tokens whose part of speech is not in
    ``RUN_BREAK``; it stands in for a noun chunk. For every NOUN/PROPN token ``i`` of
    a run ``[l, r]`` come the spans ``[i,i] [i,r] [l,r] [l,i]`` in that order
    (the subtree rule of T3 with the run as subtree), each place where it comes first. Inside a
    run no token has an invalid part of speech, so edge trimming cannot shorten a span and the
    length limit (T8) is applied here already.

    Output ``(doc_id, sent_no, anchor, variant, lang, term, lemma, n_tokens)``: a span's text, the lemmas
    joined by blanks and the number of its tokens.
    """
    # a function word ends a run, so the lemmas in a run of own lists are the tokens themselves
    lemmas = "_texts" if "_units" in toks.columns else "_lemmas"
    x = listed(toks).select("doc_id", "sent_no", "lang", "_units", F.col(lemmas).alias("_lemmas"), "_pos")
    breaks = F.filter(F.transform("_pos", lambda p, i: F.when(p.isin(*RUN_BREAK), i)), lambda i: i.isNotNull())
    x = x.withColumn("_b", F.concat(F.array(F.lit(-1)), breaks, F.array(F.size("_pos"))))
    pairs = F.zip_with("_b", F.slice("_b", F.lit(2), F.size("_b")), lambda a, b: F.struct((a + 1).alias("l"), (b - 1).alias("r")))
    runs = F.filter(pairs, lambda g: g["l"] <= g["r"])

    def nouns(g):
        at = F.filter(F.sequence(g["l"], g["r"]), lambda i: F.get(F.col("_pos"), i).isin("NOUN", "PROPN"))
        return F.transform(at, lambda i, k: F.struct(i.alias("i"), (i - g["l"]).alias("left"), (g["r"] - i).alias("right"), (k == 0).alias("first")))
    # only places are made with lambdas; what follows is generated code, in which a slice takes as long as the span, not the sentence
    x = x.select("doc_id", "sent_no", "lang", "_units", "_lemmas", F.flatten(F.transform(runs, nouns)).alias("_nouns"))
    x = x.select("doc_id", "sent_no", "lang", "_units", "_lemmas", F.inline(F.slice("_nouns", F.lit(1), F.size("_nouns"))))
    i, left, right = F.col("i"), F.col("left"), F.col("right")

    def span(variant, where, begin, n):
        return F.when(where & (n <= max_ngram), F.struct(F.lit(variant).alias("variant"), (begin + 1).alias("at"), n.alias("n")))
    spans = F.array(span(0, F.lit(True), i, F.lit(1)), span(1, right > 0, i, right + 1), span(2, F.col("first") & (left > 0), i - left, left + right + 1),
                    span(3, (left > 0) & (right > 0), i - left, left + 1))
    x = x.select("doc_id", "sent_no", "lang", "i", "_units", "_lemmas", F.explode(spans).alias("c")).where(F.col("c").isNotNull())

    def joined(array, by):
        return F.array_join(F.slice(array, F.col("c.at"), F.col("c.n")), by)
    # tokens do not end with whitespace; a generator's output is not made again for each condition that is put on it
    term = F.struct(F.rtrim(joined("_units", ""), F.lit(WS_CHARS)).alias("term"), joined("_lemmas", " ").alias("lemma"))
    x = x.select("doc_id", "sent_no", "lang", "i", "c", F.explode(F.array(term)).alias("t"))
    return x.select("doc_id", "sent_no", F.col("i").cast("long").alias("anchor"), F.col("c.variant").alias("variant"), "lang",
                    F.col("t.term").alias("term"), F.col("t.lemma").alias("lemma"), F.col("c.n").cast("long").alias("n_tokens"))


def candidate_subtrees(parsed: DataFrame) -> DataFrame:
    """Candidate spans of parsed sentences ``(doc_id, sent_no, lang, toks array<token>, heads
    array<int>)``, ``heads[i]`` being the position of token ``i``'s head, its own for a root.

    Every token is sent to each of its ancestors; the smallest and largest position that reach a
    token are the edges ``l, r`` of its subtree. For each NOUN/PROPN ``i`` come the spans
    ``[i,i] [i,r] [l,r] [l,i]``, in this order. Same output as ``candidate_runs``.
    """
    p = parsed.where(F.size("toks") > 0)
    at = p.select("doc_id", "sent_no", "heads", F.explode(F.sequence(F.lit(0), F.size("heads") - 1)).alias("i"))

    def up(chain, _):
        last = F.element_at(chain, -1)
        head = F.get(F.col("heads"), last)
        return F.when(head == last, chain).otherwise(F.concat(chain, F.array(head)))

    chain = F.aggregate(F.sequence(F.lit(1), F.size("heads")), F.array("i"), up)
    edges = (at.select("doc_id", "sent_no", "i", F.explode(chain).alias("a")).groupBy("doc_id", "sent_no", "a")
               .agg(F.min("i").alias("l"), F.max("i").alias("r")))
    e = edges.groupBy("doc_id", "sent_no").agg(F.array_sort(F.collect_list(F.struct("a", "l", "r"))).alias("edges"))
    x = p.join(e, ["doc_id", "sent_no"])
    noun = F.filter("edges", lambda g: F.get(F.col("toks"), g["a"])["pos"].isin("NOUN", "PROPN"))
    x = x.select("doc_id", "sent_no", "lang", "toks", F.explode(noun).alias("g"))
    span = lambda v, a, b: F.struct(F.lit(v).alias("variant"), a.alias("a"), b.alias("b"))
    i, lo, hi = F.col("g.a"), F.col("g.l"), F.col("g.r")
    x = x.select("doc_id", "sent_no", "lang", "toks", i.alias("anchor"),
                 F.explode(F.array(span(0, i, i), span(1, i, hi), span(2, lo, hi), span(3, lo, i))).alias("v"))
    return x.select("doc_id", "sent_no", F.col("anchor").cast("long").alias("anchor"), F.col("v.variant").alias("variant"), "lang",
                    F.slice("toks", F.col("v.a") + 1, F.col("v.b") - F.col("v.a") + 1).alias("span"))


def distinct_first(c: DataFrame, text_col: str = "term") -> DataFrame:
    """One row per ``(doc_id, stripped text)``, the first in (sentence, anchor,
    variant) order wins; case-sensitive. The window is keyed ``(doc_id, term)`` and so
    reuses the ``doc_id`` partitioning (a local sort, no exchange)."""
    w = Window.partitionBy("doc_id", text_col).orderBy("sent_no", "anchor", "variant")
    return c.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def distinct_first_terms(c: DataFrame) -> DataFrame:
    """T10 over candidates without spans: same result as ``distinct_first``. The lemma and the number of tokens of a term
    follow from its text and language, so they are keys, and the first place is the least of one number
    (sentence, anchor, variant): a hash aggregate, which keeps one entry per term instead of sorting all candidates."""
    at = F.col("sent_no") * (1 << 33) + F.col("anchor") * 4 + F.col("variant")
    g = c.groupBy("doc_id", "lang", "term", "lemma", "n_tokens").agg(F.min(at).alias("_at"))
    return g.select("doc_id", "term", "lemma", F.shiftright("_at", 33).alias("sent_no"), F.shiftright("_at", 2).bitwiseAND(F.lit((1 << 31) - 1)).alias("anchor"),
                    F.col("_at").bitwiseAND(F.lit(3)).cast("int").alias("variant"), "n_tokens", "lang")


def is_clean_text(text: Column, stripped: bool = True) -> Column:
    """T5: ASCII only, non-empty, no punctuation/digit other than - and ', no tab
    (the character test is on the stripped text; span texts already are)."""
    ascii_only = (F.octet_length(text) == F.length(text)) & (text != "")
    return ascii_only & ~(text if stripped else strip(text)).rlike(FORBIDDEN_RE)


def trim_invalid(span: Column) -> Column:
    """T6 + T7: drop the leading and the trailing run of invalid-POS tokens."""
    ok = F.transform(span, lambda t: ~t["pos"].isin(*INVALID_POS))
    first = F.array_position(ok, True)                       # 1-based, 0 when none
    last = F.size(ok) - F.array_position(F.reverse(ok), True) + 1
    return F.when(first == 0, F.array().cast(f"array<{_TOK}>")).otherwise(
        F.slice(span, first, last - first + 1))


def stopword_table(spark) -> DataFrame:
    """``(lang, word)``: the stopwords of each language (fixed, small)."""
    return spark.createDataFrame(stopword_rows(), "lang string, word string")


def filter_terms(cands: DataFrame, max_ngram: int = 10, remove_stopwords: bool = True,
                 trim: bool = True) -> DataFrame:
    """T10 -> T5 -> T6/T7 -> T8 -> T9 -> T10 -> T12 over candidate spans.

    ``trim=False`` is for candidates that provably contain no invalid-POS token at
    their edges (``candidate_runs``): trimming and the second de-duplication are
    then no-ops and are skipped. Output
    ``(doc_id, term, lemma, sent_no, anchor, variant, n_tokens, lang)``.
    """
    # lemmas are non-empty tokens without whitespace, so the joined string is stripped
    lemma = F.array_join(F.transform("span", lambda t: t["lemma"]), " ")
    if "span" in cands.columns:
        c = cands.withColumn("term", span_text(F.col("span")))
        if not trim:
            c = c.select("doc_id", "term", lemma.alias("lemma"), "sent_no", "anchor", "variant",
                         F.size("span").cast("long").alias("n_tokens"), "lang")
        c = distinct_first(c)
    else:
        c, trim = distinct_first_terms(cands), False
    c = c.where(is_clean_text(F.col("term")))
    if trim:
        c = c.withColumn("_t", trim_invalid(F.col("span"))).where(F.size("_t") > 0)
        c = c.withColumn("term", F.when(F.size("_t") == F.size("span"), F.col("term"))
                                  .otherwise(span_text(F.col("_t"))))
        c = c.withColumn("span", F.col("_t")).drop("_t").where(F.size("span") <= max_ngram)
    else:
        c = c.where(F.col("n_tokens") <= max_ngram)
    if remove_stopwords:
        sw = F.broadcast(stopword_table(cands.sparkSession))      # fixed lists, bounded size
        c = (c.withColumn("_lw", F.lower("term"))
              .join(sw.withColumnRenamed("word", "_lw"), ["lang", "_lw"], "left_anti").drop("_lw"))
    if trim:
        c = distinct_first(c)
        c = c.select("doc_id", "term", lemma.alias("lemma"), "sent_no", "anchor", "variant",
                     F.size("span").cast("long").alias("n_tokens"), "lang")
    return c


def words_by_document(words: DataFrame) -> DataFrame:
    """``(_d, _tab)``: the distinct ``(doc_id, lang, word)`` of each document in an array of buckets, by their hash.

    There is a bucket for eight words, so a word is looked up among a few, however many a document has. ``_d`` is no grouping
    key: a condition on it would be pushed down to the texts, whose exchange would no longer be that of the terms.
    """
    doc = Window.partitionBy("doc_id")
    x = words.select("doc_id", _word_key("word").alias("e")).withColumn("_i", F.row_number().over(doc.orderBy("e")))
    x = x.withColumn("_n", F.floor(F.count(F.lit(1)).over(doc) / 8).cast("int") + 1)
    # the first rows bring an empty entry for every bucket
    entries = F.array(F.struct(_bucket("_n", F.col("e")).alias("b"), "e"), F.when(F.col("_i") <= F.col("_n"), F.struct((F.col("_i") - 1).alias("b"), F.lit(None).alias("e"))))
    x = x.select("doc_id", F.explode(entries).alias("x")).where(F.col("x").isNotNull())
    x = x.groupBy("doc_id", F.col("x.b").alias("b")).agg(F.collect_list("x.e").alias("es"))
    x = x.groupBy("doc_id").agg(F.first("doc_id").alias("_d"), F.array_sort(F.collect_list(F.struct("b", "es"))).alias("_tab"))
    return x.select("_d", F.col("_tab.es").alias("_tab"))


def _word_key(word) -> Column:
    return F.concat(F.col("lang"), F.lit("\n"), word)


def _bucket(n, key: Column) -> Column:
    return F.pmod(F.xxhash64(key), n).cast("int")


def without_words(terms: DataFrame, bad: DataFrame, words: Column) -> DataFrame:
    """``terms`` none of whose ``words`` (array, of its language) is in ``bad`` ``(doc_id, lang, word)`` for its document.

    Terms stay where they are and are not sorted: what is moved to them are the bad words, one row a document, which are hashed.
    """
    tab = words_by_document(bad).hint("shuffle_hash")
    keys = F.transform(words, _word_key)
    is_bad = F.exists(keys, lambda k: F.array_contains(F.get(F.col("_tab"), _bucket(F.size("_tab"), k)), k))
    return terms.join(tab, (F.col("doc_id") == F.col("_d")) & is_bad, "left_anti")


def known_word_terms(terms: DataFrame, toks: DataFrame, min_df: int = 2) -> DataFrame:
    """T11 (re-aimed spelling filter): keep a term when every token of it is a known
    word of its language, known = appears in at least ``min_df`` documents. ``terms`` are those of the tokens ``toks``.

    A document's terms hold its own tokens only, so it is enough to know its words that are not known: these are few, and
    they go to the terms. A word in one document at most tells which one, so that words are counted and placed at once.
    """
    words = token_words(toks).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    df = words.groupBy("lang", "word").agg(F.count("doc_id").alias("df"), F.min("doc_id").alias("doc_id")).where(F.col("df") < min_df)
    rare = df.select("doc_id", "lang", "word") if min_df <= 2 else words.join(df.select("lang", "word"), ["lang", "word"], "left_semi").select("doc_id", "lang", "word")
    # whitespace other than a blank does not part a term's words, and no token holds it
    t = terms.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~F.col("term").rlike(WS.replace(" ", "")))
    return without_words(t, rare, F.split(F.lower("term"), " "))


def misspellings(toks: DataFrame, min_length: int = 4, times: int = 100) -> DataFrame:
    """T11, word list from the corpus: a word one edit (a letter more, less or other) away from a word of its
    language that stands in at least ``times`` as many documents is a misspelling of it.
    ``(lang, word, n_docs, suggestion, suggestion_docs)``; the suggestion in most documents, then the first by
    letters, wins. Words are lower-cased tokens with letters only, of ``min_length`` letters at least.

    Words meet over what is left of them when one letter is deleted, or none: two words one edit apart share such a
    rest. Only words that are frequent enough to correct another one are offered to the rare ones, so a rest is
    joined with few words however many rare ones share it.
    """
    w = token_words(toks).where(F.col("word").rlike(r"^\p{L}+$") & (F.length("word") >= min_length))
    w = cut_lineage(w.groupBy("lang", "word").agg(F.count("doc_id").alias("n_docs")))

    def rests(df):
        cuts = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)))
        return df.select("*", F.explode(F.array_distinct(F.concat(F.array("word"), cuts))).alias("rest"))
    often = rests(w.where(F.col("n_docs") >= times)).select(F.col("lang").alias("_l"), F.col("word").alias("suggestion"), F.col("n_docs").alias("suggestion_docs"),
                                                            F.col("rest").alias("_r"))
    # most rests are none of a frequent word, and need not be moved to be told so
    x = rests(w).where(may_hold(key_summary(often.select(F.xxhash64("_l", "_r"))), F.xxhash64("lang", "rest")))
    j = x.join(often, (F.col("lang") == F.col("_l")) & (F.col("rest") == F.col("_r")))
    j = j.where((F.col("suggestion_docs") >= times * F.col("n_docs")) & (F.levenshtein("word", "suggestion") == 1))
    best = F.min(F.struct((-F.col("suggestion_docs")).alias("a"), F.col("suggestion").alias("b")))
    return j.groupBy("lang", "word", "n_docs").agg(best.alias("best")).select(
        "lang", "word", "n_docs", F.col("best.b").alias("suggestion"), (-F.col("best.a")).alias("suggestion_docs"))


NO_LETTERS = r"[^\p{L}]+"


def spelled_terms(terms: DataFrame, wrong: DataFrame, toks: DataFrame | None = None) -> DataFrame:
    """The terms that hold none of the misspellings ``(lang, word)``.

    With ``toks``, the tokens that the terms come from, the documents that hold a misspelling are found first and its words go to the
    terms; without them every term is moved once for each of its words.
    """
    parts = F.split(F.lower("term"), NO_LETTERS)
    bad = wrong.select("lang", "word").distinct()
    if toks is None:
        words = terms.select(*terms.columns, F.explode(parts).alias("_w"))
        bad = bad.select("lang", F.col("word").alias("_w"), F.lit(True).alias("_bad"))
        flagged = words.join(bad, ["lang", "_w"], "left").groupBy(*terms.columns).agg(F.bool_or(F.col("_bad").isNotNull()).alias("_bad"))
        return flagged.where(~F.col("_bad") | F.col("doc_id").isNull()).drop("_bad")
    bad = cut_lineage(bad.where(F.col("lang").isNotNull() & F.col("word").isNotNull()))      # used twice
    held = token_words(toks).select("doc_id", "lang", F.explode(F.split("word", NO_LETTERS)).alias("word"))
    held = held.where(may_hold(key_summary(bad.select(F.xxhash64("lang", "word"))), F.xxhash64("lang", "word"))).distinct()
    # one key, which is never null, for the same reason as in words_by_document
    held = held.withColumn("_k", F.array("lang", "word")).join(bad.select(F.array("lang", "word").alias("_k")), "_k", "left_semi")
    return without_words(terms, held.select("doc_id", "lang", "word"), parts)


# ---- corpus statistics (T14, T15) -------------------------------------------------------

SK_TOKEN_RE = rf"{WORD}{{2,}}"


def ngrams(docs: DataFrame, max_n: int) -> DataFrame:
    """``(doc_id, gram)``: the word n-grams (1..max_n) of each document, tokens of at least 2 word characters."""
    d = docs.select("doc_id", F.regexp_extract_all("text", F.lit(SK_TOKEN_RE), F.lit(0)).alias("t"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(max_n), F.size("t"))), lambda n: F.transform(
        F.sequence(F.lit(0), F.size("t") - n), lambda i: F.array_join(F.slice("t", i + 1, n), " "))))
    return d.select("doc_id", F.explode(F.when(F.size("t") > 0, grams).otherwise(F.array())).alias("gram"))


def vocabulary_hits(docs: DataFrame, vocab: DataFrame, max_n: int, lowercase: bool) -> DataFrame:
    """``(doc_id, term)``: every place at which a vocabulary term of 1..max_n tokens stands.

    Places whose token begins no term go first; the others make only the n-grams of as many tokens as terms
    with this first token have, and these meet the vocabulary. So what is aggregated afterwards are
    occurrences of terms, not the n-grams of the corpus. Texts are dealt out before they are cut into tokens, since
    a table of few files would keep that in few tasks.
    """
    text = F.lower("text") if lowercase else F.col("text")
    d = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", F.regexp_extract_all(text, F.lit(SK_TOKEN_RE), F.lit(0)).alias("t"))
    ahead = F.transform("t", lambda _, i: part("t", i, F.least(i + max_n, F.size("t"))))
    x = d.select("doc_id", F.explode(ahead).alias("a")).select("doc_id", "a", F.get("a", F.lit(0)).alias("w"))
    v = vocab.select("term").distinct().withColumn("n", F.size(F.split("term", " "))).where(F.col("n") <= max_n)
    heads = v.groupBy(F.substring_index("term", " ", 1).alias("first")).agg(F.collect_set("n").alias("ns"))
    x = x.join(heads, F.col("w") == F.col("first"))
    x = x.select("doc_id", F.explode(F.transform(F.filter("ns", lambda n: n <= F.size("a")), lambda n: F.array_join(F.slice("a", F.lit(1), n), " "))).alias("gram"))
    return x.join(v, F.col("gram") == F.col("term")).select("doc_id", "term")


def term_frequency(docs: DataFrame, vocab: DataFrame, max_ngram_len: int) -> DataFrame:
    """Corpus count of each vocabulary term, n-grams 1..max, case-sensitive;
    unseen terms count 0. ``vocab(term)``; output ``(term, tf)``."""
    hits = vocabulary_hits(docs, vocab, max_ngram_len, lowercase=False)
    counts = hits.groupBy(F.col("term").alias("gram")).agg(F.count("*").alias("tf"))
    v = vocab.select("term").distinct()
    return v.join(counts, F.col("term") == F.col("gram"), "left").select("term", F.coalesce("tf", F.lit(0)).cast("long").alias("tf"))


def term_idf(docs: DataFrame, vocab: DataFrame, max_ngram_len: int) -> DataFrame:
    """Smoothed idf ``ln((1+N)/(1+df)) + 1`` of each vocabulary term over the
    lower-cased corpus with n-grams 1..max+1; the vocabulary is *not* lower-cased.
    Output ``(term, df, idf)``; sort by ``idf desc`` for the reference's order."""
    n_docs = docs.agg(F.count("*")).scalar()      # scalar subquery: the corpus size
    hits = vocabulary_hits(docs, vocab, max_ngram_len + 1, lowercase=True)
    df = hits.groupBy(F.col("term").alias("gram")).agg(F.countDistinct("doc_id").alias("df"))
    v = vocab.select("term").distinct().join(df, F.col("term") == F.col("gram"), "left").withColumn("df", F.coalesce("df", F.lit(0)).cast("long"))
    return v.select("term", "df", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))
