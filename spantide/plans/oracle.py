"""DuckDB SQL that states each registered query independently of Spark.

Views ``documents pages labels conversations benchmark embeddings ...`` are
registered by the caller. Column names equal those of ``catalog.QUERIES``.
"""

from __future__ import annotations

from spantide.functions.text import NONWS, WS
from spantide.operators import pages as P

ORACLE: dict = {}

ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _lines(src: str, text: str = "text", rstrip_newlines: bool = False) -> str:
    t = f"regexp_replace({text}, '\\n+\\z', '')" if rstrip_newlines else text
    return f"""
    SELECT s.doc_id, t.line, CAST(t.n - 1 AS BIGINT) AS line_no,
           sum(length(t.line) + 1) OVER (PARTITION BY s.doc_id ORDER BY t.n {ROWS})
             - (length(t.line) + 1) AS line_begin
    FROM {src} s, unnest(string_split({t}, chr(10))) WITH ORDINALITY AS t(line, n)"""


def sql_sentences(src: str) -> str:
    return f"""
WITH o AS ({_lines(src)})
SELECT doc_id,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS sent_no,
       CAST(line_begin + length(line) - length(regexp_replace(line, '^{WS}+', '')) AS BIGINT) AS "begin",
       CAST(line_begin + length(regexp_replace(line, '{WS}+\\z', '')) AS BIGINT) AS "end",
       regexp_replace(line, '^{WS}+|{WS}+\\z', '', 'g') AS text
FROM o WHERE regexp_matches(line, '{NONWS}')
"""


def sql_paragraphs_blank(src: str) -> str:
    return f"""
WITH o AS ({_lines(src)}),
nb AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS grp
       FROM o WHERE regexp_matches(line, '{NONWS}')),
g AS (SELECT doc_id, min(line_begin) AS b, max(line_begin + length(line)) AS e,
             string_agg(line, chr(10) ORDER BY line_no) AS text
      FROM nb GROUP BY doc_id, grp)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS BIGINT) AS par_no,
       CAST(b AS BIGINT) AS "begin", CAST(e AS BIGINT) AS "end", text
FROM g
"""


def sql_paragraphs_list(src: str, marker: str = "- ") -> str:
    return f"""
WITH o AS ({_lines(src, rstrip_newlines=True)}),
f AS (SELECT *, starts_with(line, '{marker}') AS is_list FROM o WHERE length(line) > 0),
s AS (SELECT *, NOT (is_list AND coalesce(lag(is_list) OVER (PARTITION BY doc_id ORDER BY line_no), false)) AS st
      FROM f),
i AS (SELECT *, sum(CAST(st AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line_no {ROWS}) - 1 AS par_no FROM s),
g AS (SELECT doc_id, par_no, min(line_begin) AS b, max(line_begin + length(line)) AS last_end,
             bool_and(is_list) AS il
      FROM i GROUP BY doc_id, par_no),
n AS (SELECT *, lead(b) OVER (PARTITION BY doc_id ORDER BY par_no) AS nxt FROM g),
e AS (SELECT *, CASE WHEN il AND nxt IS NOT NULL THEN nxt - 1 ELSE last_end END AS e FROM n)
SELECT e.doc_id, CAST(par_no AS BIGINT) AS par_no, CAST(b AS BIGINT) AS "begin", CAST(e AS BIGINT) AS "end",
       substr(src.text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT)) AS text
FROM e JOIN {src} src ON e.doc_id = src.doc_id
"""


ORACLE["sentences"] = sql_sentences("documents")

_FULL = f"(SELECT page_id AS doc_id, {P.sql_full_text('html')} AS text FROM pages)"
_MAIN = f"(SELECT page_id AS doc_id, {P.sql_main_text_tags('html')} AS text FROM pages)"
ORACLE["paragraphs_blank"] = sql_paragraphs_blank(_FULL)
ORACLE["paragraphs_list"] = sql_paragraphs_list(_FULL)

_rec_sel, _rec_txt = P.sql_page_record("html", "url")
ORACLE["page_titles"] = f"""
WITH x AS (SELECT page_id, html, url, {_rec_txt} AS txt FROM pages)
SELECT page_id, {_rec_sel}, {P.sql_titles('html')} AS titles FROM x
"""

ORACLE["page_text_tags"] = f"""
SELECT page_id, {P.sql_host('url')} AS host, {P.sql_main_text_tags('html')} AS main_text,
       {P.sql_full_text('html')} AS full_text
FROM pages
"""

ORACLE["host_boilerplate"] = f"""
WITH b AS (
  SELECT page_id, {P.sql_host('url')} AS host, t.txt
  FROM pages, unnest({P.sql_block_texts('html', False)}) AS t(txt)
)
SELECT host, md5(txt) AS block_md5, count(DISTINCT page_id) AS n_pages
FROM b WHERE txt <> '' GROUP BY host, md5(txt) HAVING count(DISTINCT page_id) >= 2
"""

ORACLE["main_text"] = f"""
WITH {P.sql_cut_regions('pages')},
b AS (SELECT page_id, {P.sql_host('url')} AS host, t.u.text AS text, t.u.link_chars AS link_chars, t.k FROM cut, unnest({P.sql_linked_blocks('html')}) WITH ORDINALITY AS t(u, k)),
rep AS (SELECT host, text FROM b WHERE text <> '' GROUP BY host, text HAVING count(DISTINCT page_id) >= 2),
kept AS (SELECT page_id, string_agg(text, chr(10) ORDER BY k) AS text FROM b
         WHERE text <> '' AND link_chars <= length(text) * 0.5 AND NOT EXISTS (SELECT 1 FROM rep WHERE rep.host = b.host AND rep.text = b.text) GROUP BY page_id)
SELECT page_id, {P.sql_host('url')} AS host, coalesce(kept.text, '') AS text FROM pages LEFT JOIN kept USING (page_id)
"""

ORACLE["fingerprint_groups"] = f"""
SELECT {P.sql_fingerprint('text')} AS fingerprint, count(*) AS n_docs, min(doc_id) AS first_doc_id
FROM documents GROUP BY 1
"""

ORACLE["language_filter"] = "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en'"

ORACLE["unsupported_language"] = """
SELECT lang, doc_id FROM documents
WHERE lang IS NULL OR lang NOT IN ('en', 'de', 'nl', 'fr', 'it', 'es', 'nb', 'sl', 'hr')
"""

from spantide.functions.text import sql_normalise_lines as _norm  # noqa: E402

_S_DOCS = f"({sql_sentences('documents')})"


def _sql_merged(sent_src: str, text_src: str) -> str:
    return f"""
    SELECT g.doc_id, 'digit' AS label, CAST(b AS BIGINT) AS "begin", CAST(e AS BIGINT) AS "end",
           {_norm('substr(d.text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT))')} AS content,
           CAST(f AS BIGINT) AS first_no, CAST(la AS BIGINT) AS last_no
    FROM (SELECT doc_id, min("begin") AS b, max("end") AS e, min(sent_no) AS f, max(sent_no) AS la
          FROM (SELECT *, sent_no - row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) AS grp
                FROM {sent_src} x WHERE regexp_matches(text, '[0-9]')) y
          GROUP BY doc_id, grp) g
    JOIN {text_src} d ON d.doc_id = g.doc_id"""


ORACLE["merged_labelled"] = _sql_merged(_S_DOCS, "documents")


def _sql_context(prepend: bool, append: bool) -> str:
    parts = (["p.text"] if prepend else []) + ["m.content"] + (["n.text"] if append else [])
    return f"""
WITH s AS {_S_DOCS},
m AS (SELECT doc_id, first_no AS span_no, "begin", "end", content FROM ({_sql_merged('s', 'documents')}) z),
c AS (SELECT m.doc_id, m.span_no, min(s.sent_no) AS f, max(s.sent_no) AS la
      FROM m JOIN s ON s.doc_id = m.doc_id AND s."begin" >= m."begin" AND s."end" <= m."end"
      GROUP BY m.doc_id, m.span_no)
SELECT m.doc_id, m.span_no, m."begin", m."end", m.content,
       CASE WHEN c.f IS NOT NULL THEN {_norm(f"concat_ws(chr(10), {', '.join(parts)})")} END AS content_context
FROM m LEFT JOIN c ON c.doc_id = m.doc_id AND c.span_no = m.span_no
LEFT JOIN s p ON p.doc_id = m.doc_id AND p.sent_no = c.f - 1
LEFT JOIN s n ON n.doc_id = m.doc_id AND n.sent_no = c.la + 1
"""


ORACLE["context_both"] = _sql_context(True, True)
ORACLE["context_next"] = _sql_context(False, True)

ORACLE["covered_sentences"] = f"""
WITH s AS {_S_DOCS},
m AS (SELECT doc_id, first_no AS span_no, "begin", "end" FROM ({_sql_merged('s', 'documents')}) z)
SELECT m.doc_id, m.span_no, m."begin" AS o_begin, m."end" AS o_end, s.sent_no, s."begin", s."end"
FROM m JOIN s ON s.doc_id = m.doc_id AND s."begin" >= m."begin" AND s."end" <= m."end"
"""

ORACLE["reannotate"] = f"""
WITH ex AS (
  SELECT doc_id, 'sentence' AS type, "begin", "end" FROM {_S_DOCS} a
  UNION ALL
  SELECT doc_id, 'paragraph' AS type, "begin", "end" FROM ({sql_paragraphs_blank('documents')}) b
), nw AS (
  SELECT doc_id, 'paragraph' AS type, "begin", "end"
  FROM ({sql_paragraphs_list("(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")}) c
)
SELECT * FROM ex WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.doc_id = ex.doc_id AND nw.type = ex.type)
UNION ALL SELECT * FROM nw
"""

_REC_SRC = f"(SELECT page_id AS doc_id, {P.sql_main_text_tags('html')} AS text FROM pages)"
ORACLE["chunking_records"] = f"""
WITH x AS (SELECT page_id, html, url, {_rec_txt} AS txt FROM pages),
r AS (SELECT page_id, {_rec_sel} FROM x),
s AS ({sql_sentences(_REC_SRC)}),
a AS (SELECT doc_id, count(*) AS n, string_agg(CAST("begin" AS VARCHAR) || ':' || CAST("end" AS VARCHAR), ','
                                               ORDER BY "begin", "end") AS spans
      FROM s GROUP BY doc_id)
SELECT r.page_id, r.title, r.hostname, CAST(coalesce(a.n, 0) AS BIGINT) AS n_sentences, coalesce(a.spans, '') AS spans
FROM r LEFT JOIN a ON a.doc_id = r.page_id
"""


# ---- terms ---------------------------------------------------------------------------

from spantide.functions.lexicon import SUPPORTED_LANGUAGES, stopword_rows as _sw_rows  # noqa: E402
from spantide.functions.lexicon import lexicon_keys_by_pos as _lex  # noqa: E402
from spantide.operators import terms as T  # noqa: E402


def _ql(s):
    return "'" + s.replace("'", "''") + "'"


def _inlist(xs):
    return "(" + ", ".join(_ql(x) for x in xs) + ")"


_SUPPORTED = _inlist(SUPPORTED_LANGUAGES)
_POS_CASES = "\n".join(f"WHEN lang || '|' || lower(piece) IN {_inlist(keys)} THEN '{pos}'"
                       for pos, keys in _lex().items())
_SW_VALUES = ", ".join(f"({_ql(a)}, {_ql(b)})" for a, b in _sw_rows())


def _strip(e):
    return f"regexp_replace({e}, '^{WS}+|{WS}+\\z', '', 'g')"


_TOKENS_CTE = f"""
sd AS (SELECT * FROM documents WHERE lang IN {_SUPPORTED}),
s AS ({sql_sentences('sd')}),
s2 AS (SELECT s.*, d.lang FROM s JOIN sd d ON d.doc_id = s.doc_id),
p AS (SELECT s2.doc_id, s2.sent_no, s2.lang, s2."begin" AS sb, t.piece, t.n AS pn
      FROM s2, unnest(regexp_extract_all(s2.text, {_ql(T.PIECE_RE)})) WITH ORDINALITY AS t(piece, n)),
q AS (SELECT *, regexp_matches(piece, {_ql(T.WS_RE)}) AS ws,
             sum(length(piece)) OVER (PARTITION BY doc_id, sent_no ORDER BY pn {ROWS}) - length(piece) AS rel,
             CASE WHEN lead(regexp_matches(piece, {_ql(T.WS_RE)})) OVER (PARTITION BY doc_id, sent_no ORDER BY pn)
                  THEN lead(piece) OVER (PARTITION BY doc_id, sent_no ORDER BY pn) ELSE '' END AS ws_after
      FROM p),
tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY pn) - 1 AS tok_no FROM q WHERE NOT ws),
tp AS (SELECT *, CASE WHEN regexp_matches(piece, {_ql(T.NUM_RE)}) THEN 'NUM'
                      WHEN NOT regexp_matches(piece, {_ql(T.WORDTOK_RE)}) THEN
                           CASE WHEN regexp_matches(piece, {_ql(T.PUNCT_RE)}) THEN 'PUNCT' ELSE 'SYM' END
                      {_POS_CASES}
                      WHEN regexp_matches(piece, {_ql(T.CAP_RE)}) AND tok_no > 0 THEN 'PROPN'
                      ELSE 'NOUN' END AS pos
       FROM tk),
tl AS (SELECT *, CASE WHEN pos IN {_inlist(T.FUNCTION_POS)} THEN lower(piece) ELSE piece END AS lemma FROM tp)"""

ORACLE["tokens"] = f"""
WITH {_TOKENS_CTE}
SELECT doc_id, sent_no, CAST(tok_no AS BIGINT) AS tok_no, CAST(sb + rel AS BIGINT) AS "begin",
       CAST(sb + rel + length(piece) AS BIGINT) AS "end", piece AS text, lemma, pos
FROM tl
"""

_CANDS_CTE = f"""{_TOKENS_CTE},
r AS (SELECT *, sum(CAST(pos IN {_inlist(T.RUN_BREAK)} AS BIGINT))
                  OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no {ROWS}) AS run FROM tl),
rt AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no, run ORDER BY tok_no) - 1 AS k,
              count(*) OVER (PARTITION BY doc_id, sent_no, run) AS n
       FROM r WHERE pos NOT IN {_inlist(T.RUN_BREAK)}),
c AS (SELECT doc_id, sent_no, run, lang, tok_no AS anchor, v.variant,
             CASE WHEN v.variant <= 1 THEN k ELSE 0 END AS a,
             CASE WHEN v.variant = 0 OR v.variant = 3 THEN k ELSE n - 1 END AS b
      FROM rt, (VALUES (0), (1), (2), (3)) v(variant) WHERE pos IN ('NOUN', 'PROPN')),
ct AS (SELECT c.doc_id, c.sent_no, c.anchor, c.variant, c.lang, c.b - c.a + 1 AS n_tokens,
              {_strip("string_agg(rt.piece || rt.ws_after, '' ORDER BY rt.k)")} AS term,
              {_strip("string_agg(rt.lemma, ' ' ORDER BY rt.k)")} AS lemma
       FROM c JOIN rt ON rt.doc_id = c.doc_id AND rt.sent_no = c.sent_no AND rt.run = c.run
                      AND rt.k BETWEEN c.a AND c.b
       WHERE c.b - c.a + 1 <= 10
       GROUP BY c.doc_id, c.sent_no, c.anchor, c.variant, c.lang, c.a, c.b),
d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY sent_no, anchor, variant) AS rn
                      FROM ct) z WHERE rn = 1),
cl AS (SELECT * FROM d1 WHERE regexp_matches(term, {_ql(T.ASCII_RE)})
                         AND NOT regexp_matches({_strip('term')}, {_ql(T.FORBIDDEN_RE)})),
sw(lang, word) AS (VALUES {_SW_VALUES}),
tm AS (SELECT * FROM cl WHERE NOT EXISTS (SELECT 1 FROM sw WHERE sw.lang = cl.lang AND sw.word = lower(cl.term)))"""



def sql_terms(src: str) -> str:
    """CTEs up to ``tm`` over the documents ``src`` (doc_id, text, lang)."""
    return _CANDS_CTE.replace("FROM documents", f"FROM {src}", 1)


_TERM_COLS = "doc_id, term, lemma, sent_no, CAST(anchor AS BIGINT) AS anchor, CAST(variant AS INTEGER) AS variant, CAST(n_tokens AS BIGINT) AS n_tokens"

ORACLE["candidate_terms"] = f"WITH {_CANDS_CTE}\nSELECT {_TERM_COLS} FROM cl"
ORACLE["terms_pipeline"] = f"WITH {_CANDS_CTE}\nSELECT {_TERM_COLS} FROM tm"
ORACLE["stopword_filtered"] = f"""WITH {_CANDS_CTE}
SELECT doc_id, term, lang FROM cl
WHERE EXISTS (SELECT 1 FROM sw WHERE sw.lang = cl.lang AND sw.word = lower(cl.term))"""
ORACLE["term_lemmas"] = f"""WITH {_CANDS_CTE}
SELECT lang, term, lemma, count(*) AS n_docs FROM tm GROUP BY lang, term, lemma"""
ORACLE["known_word_terms"] = f"""WITH {_CANDS_CTE},
kw AS (SELECT lang, lower(piece) AS w FROM tl GROUP BY lang, lower(piece) HAVING count(DISTINCT doc_id) >= 2),
tw AS (SELECT tm.doc_id, tm.term, tm.lang, u.w FROM tm, unnest(string_split(lower(tm.term), ' ')) AS u(w) WHERE u.w <> '')
SELECT doc_id, term, lemma FROM tm
WHERE NOT EXISTS (SELECT 1 FROM tw WHERE tw.doc_id = tm.doc_id AND tw.term = tm.term
                  AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.lang = tw.lang AND kw.w = tw.w))"""

_SK = T.SK_TOKEN_RE


def _sql_ngrams(src: str, id_col: str, max_n: int, lower: bool) -> str:
    txt = "lower(text)" if lower else "text"
    return f"""
    SELECT {id_col} AS doc_id, array_to_string(t[i + 1:i + n], ' ') AS gram
    FROM (SELECT {id_col}, regexp_extract_all({txt}, {_ql(_SK)}) AS t FROM {src}) x,
         range(1, {max_n} + 1) AS r1(n), range(0, CAST(len(t) AS BIGINT) - n + 1) AS r2(i)"""


_VOCAB = f"(SELECT DISTINCT gram AS term FROM ({_sql_ngrams('benchmark', 'item_id', 2, False)}) v)"

ORACLE["term_frequency"] = f"""
WITH v AS {_VOCAB},
g AS ({_sql_ngrams('documents', 'doc_id', 2, False)})
SELECT v.term, CAST(count(g.gram) AS BIGINT) AS tf FROM v LEFT JOIN g ON g.gram = v.term GROUP BY v.term
"""

ORACLE["term_idf"] = f"""
WITH v AS {_VOCAB},
g AS ({_sql_ngrams('documents', 'doc_id', 3, True)}),
n AS (SELECT count(*) AS n FROM documents)
SELECT v.term, CAST(count(DISTINCT g.doc_id) AS BIGINT) AS df,
       round(ln((1 + n.n) / (1 + count(DISTINCT g.doc_id))) + 1, 6) AS idf
FROM v CROSS JOIN n LEFT JOIN g ON g.gram = v.term GROUP BY v.term, n.n
"""


# ---- dictionary matching ---------------------------------------------------------------

_BOUND = r"[\p{L}\-_+]"

_P = r"(?s)[\p{L}\-_+]+|."
ORACLE["term_occurrences"] = f"""
WITH s AS ({sql_sentences('documents')}),
bt AS (SELECT item_id, regexp_extract_all(text, {_ql(T.SK_TOKEN_RE)}) AS t FROM benchmark),
bg AS (SELECT lower(array_to_string(t[i + 1:i + 2], ' ')) AS term FROM bt, range(0, CAST(len(t) AS BIGINT) - 1) AS r(i)),
dict AS (SELECT DISTINCT term, len(regexp_extract_all(term, '{_P}')) AS m FROM bg),
ms AS (SELECT DISTINCT m FROM dict),
pc AS (SELECT doc_id, sent_no, "begin" AS sb, regexp_extract_all(lower(text), '{_P}') AS pcs FROM s),
pos AS (SELECT doc_id, sent_no, sb, u.piece, u.n, sum(length(u.piece)) OVER (PARTITION BY doc_id, sent_no ORDER BY u.n) - length(u.piece) AS rel
        FROM pc, unnest(pcs) WITH ORDINALITY AS u(piece, n)),
win AS (SELECT pc.doc_id, pc.sent_no, i + 1 AS n, m, array_to_string(pcs[i + 1:i + m], '') AS text,
               CASE WHEN i > 0 THEN pcs[i] ELSE '' END AS prev, coalesce(pcs[i + m + 1], '') AS nxt
        FROM pc, ms, range(0, CAST(len(pcs) AS BIGINT) - m + 1) AS r(i)),
hit AS (SELECT win.*, dict.term FROM win JOIN dict ON dict.term = win.text AND dict.m = win.m)
SELECT hit.doc_id, hit.sent_no, CAST(sb + rel AS BIGINT) AS "begin", CAST(sb + rel + length(term) AS BIGINT) AS "end",
       term, term AS lemma, 1.0::DOUBLE AS score
FROM hit JOIN pos ON pos.doc_id = hit.doc_id AND pos.sent_no = hit.sent_no AND pos.n = hit.n
WHERE NOT regexp_matches(prev, '{_BOUND}$') AND NOT regexp_matches(nxt, '^{_BOUND}')
"""


# ---- entities ---------------------------------------------------------------------------

from spantide.operators import entities as _N  # noqa: E402
from spantide.operators import qa as _Q  # noqa: E402

_LABEL_CASE = "CASE " + " ".join(f"WHEN regexp_matches(ent, {_ql('^(?:' + r + ')$')}) THEN '{lab}'" for lab, r in _N.RULES) + " END"


def sql_rules(s: str = "s") -> str:
    """CTEs up to ``ru``: the matches of the recognisers in the sentences ``s``."""
    return f"""
mk AS (SELECT doc_id, sent_no, "begin" AS sb,
              string_split(regexp_replace(translate(text, chr(1) || chr(2), '  '), {_ql(_N.RULE_RE)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM {s}),
pt AS (SELECT doc_id, sent_no, sb, u.part, u.k FROM mk, unnest(parts) WITH ORDINALITY AS u(part, k)),
of AS (SELECT *, sb + coalesce(sum(length(part) - CAST(k > 1 AS INTEGER)) OVER (PARTITION BY doc_id, sent_no ORDER BY k
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_at, split_part(part, chr(2), 1) AS ent FROM pt),
ru AS (SELECT doc_id, sent_no, CAST(pos_at AS BIGINT) AS "begin", CAST(pos_at + length(ent) AS BIGINT) AS "end", ent AS text, {_LABEL_CASE} AS label
       FROM of WHERE k > 1)"""


def sql_matches(s: str, terms: str, per_document: bool = False, x: str = "") -> str:
    """CTEs up to ``ma`` (all names with ``x`` behind): occurrences of the terms (``term``, with ``doc_id`` if per
    document) in the sentences ``s``, whatever number of pieces each of them has."""
    own = f"AND di{x}.doc_id = win{x}.doc_id" if per_document else ""
    here = f"AND ms{x}.doc_id = pc{x}.doc_id" if per_document else ""
    return f"""
di{x} AS (SELECT DISTINCT *, len(regexp_extract_all(term, '{_P}')) AS m FROM {terms} WHERE term <> ''),
ms{x} AS (SELECT DISTINCT {"doc_id, " if per_document else ""}m FROM di{x}),
pc{x} AS (SELECT doc_id, sent_no, "begin" AS sb, regexp_extract_all(lower(text), '{_P}') AS pcs FROM {s}),
pp{x} AS (SELECT doc_id, sent_no, u.n, sum(length(u.piece)) OVER (PARTITION BY doc_id, sent_no ORDER BY u.n) - length(u.piece) AS rel
       FROM pc{x}, unnest(pcs) WITH ORDINALITY AS u(piece, n)),
win{x} AS (SELECT pc{x}.doc_id, pc{x}.sent_no, sb, i + 1 AS n, m, array_to_string(pcs[i + 1:i + m], '') AS text,
               CASE WHEN i > 0 THEN pcs[i] ELSE '' END AS prev, coalesce(pcs[i + m + 1], '') AS nxt
        FROM pc{x} JOIN ms{x} ON true {here}, range(0, CAST(len(pcs) AS BIGINT) - m + 1) AS r(i)),
ma{x} AS (SELECT win{x}.doc_id, win{x}.sent_no, CAST(sb + rel AS BIGINT) AS "begin", CAST(sb + rel + length(win{x}.text) AS BIGINT) AS "end", di{x}.* {"EXCLUDE (doc_id)" if per_document else ""}
       FROM win{x} JOIN di{x} ON di{x}.term = win{x}.text AND di{x}.m = win{x}.m {own}
       JOIN pp{x} ON pp{x}.doc_id = win{x}.doc_id AND pp{x}.sent_no = win{x}.sent_no AND pp{x}.n = win{x}.n
       WHERE NOT regexp_matches(prev, '{_BOUND}$') AND NOT regexp_matches(nxt, '^{_BOUND}'))"""


def sql_leftmost(src: str) -> str:
    """CTEs up to ``en``: of the entities ``src``, in order of (begin, longest, label), each one that begins where the
    last kept one has ended. To be used under WITH RECURSIVE."""
    return f"""
al AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY "begin", "end" DESC, label) AS rn FROM {src}),
kept AS (SELECT doc_id, sent_no, rn, "end" FROM al WHERE rn = 1
         UNION ALL
         SELECT doc_id, sent_no, rn, "end" FROM (
           SELECT al.doc_id, al.sent_no, al.rn, al."end", row_number() OVER (PARTITION BY al.doc_id, al.sent_no ORDER BY al.rn) AS f
           FROM kept JOIN al ON al.doc_id = kept.doc_id AND al.sent_no = kept.sent_no AND al.rn > kept.rn AND al."begin" >= kept."end") z WHERE f = 1),
en AS (SELECT al.doc_id, al.sent_no, al."begin", al."end", al.text, al.label FROM al JOIN kept USING (doc_id, sent_no, rn))"""


def _SPLIT(e):
    return (f"list_distinct(list_transform(regexp_extract_all({e}, '[^\\n.!?]*[.!?]'), "
            f"lambda s: regexp_replace(s, '^ +| +\\z', '', 'g')))")


# the gazetteer: the first two words of each sentence of the benchmark passages
TITLES = f"""
bs AS (SELECT unnest(regexp_split_to_array(text, '[\\n.!?]+')) AS sentence FROM benchmark),
bt AS (SELECT regexp_extract_all(sentence, {_ql(T.SK_TOKEN_RE)}) AS t FROM bs),
ti AS (SELECT DISTINCT lower(array_to_string(t[1:2], ' ')) AS term FROM bt WHERE len(t) >= 2)"""


def sql_entities(s: str = "s") -> str:
    """CTEs up to ``en``: rules and titles in the sentences ``s``."""
    return f"""{sql_rules(s)},{TITLES},{sql_matches(s, 'ti')},
al0 AS (SELECT * FROM ru UNION ALL SELECT doc_id, sent_no, "begin", "end", term, 'WORK_OF_ART' FROM ma),{sql_leftmost("al0")}"""


_ENTS = f"""
WITH RECURSIVE s AS ({sql_sentences('documents')}),{sql_entities()}"""
ORACLE["entity_rules"] = _ENTS + "\nSELECT * FROM en"
ORACLE["entity_stats"] = _ENTS + "\nSELECT label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM en GROUP BY label"


# ---- pipelines L3 / L4 ------------------------------------------------------------------

from spantide.plans import pipelines as _L  # noqa: E402


def _nwords(e):
    return f"len(list_filter(regexp_split_to_array({e}, '{WS}+'), lambda w: w <> ''))"


def _sql_ctx_pipeline(units_sql: str, roots_sql: str, pred: str, label: str, prepend: bool, text_src: str,
                      unit_no: str) -> str:
    parts = (["p.text"] if prepend else []) + ["m.content"] + ["n.text"]
    return f"""
WITH u AS ({units_sql}),
r AS ({roots_sql}),
lab AS (SELECT *, par_no - row_number() OVER (PARTITION BY doc_id ORDER BY par_no) AS grp FROM r WHERE {pred}),
g AS (SELECT doc_id, min("begin") AS b, max("end") AS e, min(par_no) AS f FROM lab GROUP BY doc_id, grp),
m AS (SELECT g.doc_id, CAST(f AS BIGINT) AS span_no, CAST(b AS BIGINT) AS "begin", CAST(e AS BIGINT) AS "end",
             {_norm('substr(d.text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT))')} AS content
      FROM g JOIN {text_src} d ON d.doc_id = g.doc_id),
c AS (SELECT m.doc_id, m.span_no, min(u.{unit_no}) AS f, max(u.{unit_no}) AS la
      FROM m JOIN u ON u.doc_id = m.doc_id AND u."begin" >= m."begin" AND u."end" <= m."end"
      GROUP BY m.doc_id, m.span_no)
SELECT m.doc_id, m.span_no, m."begin", m."end", m.content,
       CASE WHEN c.f IS NOT NULL THEN {_norm(f"concat_ws(chr(10), {', '.join(parts)})")} END AS content_context
FROM m LEFT JOIN c ON c.doc_id = m.doc_id AND c.span_no = m.span_no
LEFT JOIN u p ON p.doc_id = m.doc_id AND p.{unit_no} = c.f - 1
LEFT JOIN u n ON n.doc_id = m.doc_id AND n.{unit_no} = c.la + 1
"""


_G5 = f"regexp_replace(regexp_replace(text, '[\\n\\t]', ' ', 'g'), '^{WS}+|{WS}+\\z', '', 'g')"
_CONTACT = f"(regexp_matches({_G5}, {_ql(_L.EMAIL_RE)}) OR regexp_matches({_G5}, {_ql(_L.PHONE_RE)}))"
ORACLE["contact_paragraphs"] = "WITH ft AS MATERIALIZED " + _FULL + ", " + _sql_ctx_pipeline(
    sql_sentences("ft"), sql_paragraphs_blank("ft"), _CONTACT, "contact", True, "ft", "sent_no").strip()[len("WITH "):]
ORACLE["contact_documents"] = _sql_ctx_pipeline(
    sql_sentences("documents"), sql_paragraphs_blank("documents"), _CONTACT, "contact", True, "documents", "sent_no")

ORACLE["qa_paragraphs"] = _sql_ctx_pipeline(
    sql_paragraphs_list(_MAIN), sql_paragraphs_list(_MAIN),
    f"contains(text, ',') AND {_nwords('text')} >= 2", "question", False, _MAIN, "par_no")


# ---- classification -------------------------------------------------------------------

from spantide.operators import classify as _C  # noqa: E402
from spantide.operators import qa as _Q  # noqa: E402


def _sql_clean(e):
    return (f"array_to_string(list_filter(list_transform(regexp_split_to_array({e}, '[\\n\\t]'), lambda s: {_strip('s')}), "
            f"lambda s: s <> '' AND {_nwords('s')} > 6 AND NOT regexp_matches(s, {_ql(_C.NUMPUNCT_RE)})), chr(10))")


ORACLE["clean_text"] = f"SELECT doc_id, {_sql_clean('text')} AS cleaned FROM documents"
ORACLE["class_weights"] = """
SELECT CAST(quality AS BIGINT) AS label, count(*) AS n, round(1.0 / count(*), 6) AS weight FROM labels GROUP BY quality"""
ORACLE["pos_weights"] = """
WITH n AS (SELECT count(*) AS n FROM labels),
p AS (SELECT 0 AS pos, sum(quality) AS s FROM labels UNION ALL SELECT 1, sum(toxic) FROM labels)
SELECT CAST(pos AS BIGINT) AS pos, CAST(s AS BIGINT) AS n_pos,
       CASE WHEN s > 0 THEN round(n.n / s - 1, 6) END AS weight FROM p, n"""
ORACLE["stratified_split"] = """
SELECT doc_id, quality AS label,
       row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '2022'), doc_id)
         <= ceil(count(*) OVER (PARTITION BY quality) * 0.1) AS is_val
FROM labels"""
_CL = _sql_clean("text")
_RULE = f"CAST(regexp_matches(c, {_ql(_L.EMAIL_RE)}) OR regexp_matches(c, {_ql(_L.PHONE_RE)}) AS INTEGER)"
ORACLE["empty_defaults"] = f"""
WITH d AS (SELECT doc_id, {_CL} AS c FROM documents)
SELECT doc_id, CASE WHEN c = '' THEN 0 ELSE {_RULE} END AS label,
       CASE WHEN c = '' THEN -1.0 ELSE CAST({_RULE} AS DOUBLE) END AS proba_1,
       CASE WHEN c = '' THEN -1.0 ELSE 1.0 - {_RULE} END AS proba_0
FROM d"""
_SC = """(
  WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  m AS (SELECT label, j, avg(v) AS v FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS j FROM e) z GROUP BY label, j),
  c AS (SELECT label, list(v ORDER BY j) AS m FROM m GROUP BY label),
  k AS (SELECT list(label ORDER BY label) AS labels, list(m ORDER BY label) AS ms FROM c)
  SELECT vec_id, CAST(list_position(labels, label) - 1 AS INTEGER) AS label,
         list_transform(ms, lambda m: list_inner_product(e, m)) AS x FROM e, k)"""
_ARGMAX = "(list_position(x, list_max(x)) - 1)"
ORACLE["threshold_predictions"] = f"""
SELECT vec_id, CAST(label AS BIGINT) AS label, CAST({_ARGMAX} AS BIGINT) AS pred,
       array_to_string(list_transform(x, lambda v: CAST(1.0 / (1.0 + exp(-v)) >= 0.5 AS INTEGER)), '') AS multi_label
FROM {_SC} s"""
ORACLE["accuracy"] = f"""
SELECT count(*) AS n, round(avg(CAST({_ARGMAX} = label AS DOUBLE)), 6) AS accuracy FROM {_SC} s"""
ORACLE["class_report"] = f"""
WITH p AS (SELECT label, {_ARGMAX} AS pred FROM {_SC} s),
u AS (SELECT label AS cls, 1 AS sup, 0 AS np, CAST(label = pred AS INTEGER) AS tp FROM p
      UNION ALL SELECT pred, 0, 1, 0 FROM p),
g AS (SELECT cls, sum(sup) AS support, sum(np) AS n_pred, sum(tp) AS tp FROM u GROUP BY cls),
per AS (SELECT CAST(cls AS VARCHAR) AS cls,
               CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM g),
pf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per)
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pf
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf"""
ORACLE["mean_loss"] = f"""
WITH s AS {_SC},
ce AS (SELECT count(*) AS n, round(avg(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) - x[label + 1]), 6) AS ce_loss FROM s),
el AS (SELECT s.label, t.j - 1 AS j, t.v FROM s, unnest(s.x) WITH ORDINALITY AS t(v, j)),
pw AS (SELECT j, count(*) / nullif(count(*) FILTER (label = j), 0) - 1 AS w FROM el GROUP BY j),
b AS (SELECT round(avg(CASE WHEN el.label = el.j THEN pw.w * (greatest(-el.v, 0) + ln(1 + exp(-abs(el.v))))
                            ELSE greatest(el.v, 0) + ln(1 + exp(-abs(el.v))) END), 6) AS bce_loss
      FROM el JOIN pw ON pw.j = el.j)
SELECT ce.n, ce.ce_loss, b.bce_loss FROM ce, b"""

# ---- questions and answers ---------------------------------------------------------------

ORACLE["qg_sentences"] = f"""
SELECT doc_id, u.sentence FROM documents, unnest({_SPLIT('text')}) AS u(sentence)"""
_SEGS = f"""
WITH RECURSIVE p AS (
  SELECT doc_id, CAST(t.i - 1 AS BIGINT) AS i, t.s, CAST({_nwords('t.s')} AS BIGINT) AS n
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: length(s) > 0) AS ls FROM documents) d,
       unnest(d.ls) WITH ORDINALITY AS t(s, i)
), r(doc_id, i, cur, seg) AS (
  SELECT doc_id, i, n, CAST(0 AS BIGINT) FROM p WHERE i = 0
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN r.cur >= {_Q.MAX_SEGMENT_TOKENS} THEN p.n ELSE r.cur + p.n END,
         CASE WHEN r.cur >= {_Q.MAX_SEGMENT_TOKENS} THEN r.seg + 1 ELSE r.seg END
  FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1
), segs AS (
  SELECT p.doc_id, r.seg AS seg_no, string_agg(p.s, ' ' ORDER BY p.i) AS text, CAST(sum(p.n) AS BIGINT) AS n_tokens
  FROM p JOIN r ON r.doc_id = p.doc_id AND r.i = p.i GROUP BY p.doc_id, r.seg
)"""
ORACLE["segments"] = _SEGS + "\nSELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, text, n_tokens FROM segs"
ORACLE["qg_inputs"] = _SEGS + f"""
SELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, u.answer,
       '{_Q.ANSWER_TOKEN} ' || u.answer || ' {_Q.CONTEXT_TOKEN} ' || text AS qg_input
FROM segs, unnest({_SPLIT('text')}) AS u(answer)"""
_PAIRS = """
WITH c AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
                     lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
pr AS (SELECT conv_id, turn, text AS question, nt AS answer FROM c WHERE role = 'user' AND nr = 'assistant')"""
ORACLE["all_pairs"] = _PAIRS + """
SELECT conv_id, turn, split_part(question, '?', 1) || '?' AS question, answer FROM pr"""
ORACLE["best_pairs"] = _PAIRS + """
SELECT conv_id, CAST(rank AS BIGINT) AS rank, turn, question, answer, score FROM (
  SELECT conv_id, turn, split_part(question, '?', 1) || '?' AS question, answer, CAST(length(answer) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY conv_id ORDER BY length(answer) DESC, turn) AS rank FROM pr) z
WHERE rank <= 10"""
_H = "md5(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || ':' || '2022')"
ORACLE["qa_negatives"] = _PAIRS + f""",
a AS (SELECT DISTINCT answer FROM pr WHERE answer IS NOT NULL),
o AS (SELECT answer, coalesce(lead(answer) OVER w, first(answer) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other
      FROM a WINDOW w AS (ORDER BY md5(answer), answer)),
f AS (SELECT pr.*, o.other, CAST(('0x' || substr({_H}, 9, 8))::BIGINT % 2 AS BIGINT) = 1 AND o.other <> pr.answer AS flip
      FROM pr LEFT JOIN o ON o.answer = pr.answer)
SELECT conv_id, turn, question, CASE WHEN flip THEN other ELSE answer END AS answer, CASE WHEN flip THEN 0 ELSE 1 END AS label FROM f"""


# ---- sources and feed ------------------------------------------------------------------

ORACLE["tsv_roundtrip"] = """
WITH r AS (SELECT u.line, l.quality, l.toxic
           FROM documents d JOIN labels l ON l.doc_id = d.doc_id, unnest(string_split(d.text, chr(10))) AS u(line)
           WHERE u.line <> '')
SELECT 'multi_class' AS reader, line AS text, CAST(quality AS VARCHAR) AS labels FROM r
UNION ALL
SELECT 'multi_label', line, CAST(quality AS VARCHAR) || ',' || CAST(toxic AS VARCHAR) FROM r"""
ORACLE["file_readers"] = _PAIRS + """
, pc AS (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE -1 END AS label,
               CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines FROM documents GROUP BY 1),
qa AS (SELECT count(*) AS n_pairs, sum(length(question) + length(answer)) AS qa_chars FROM pr)
SELECT pc.label, pc.n_lines, qa.n_pairs, qa.qa_chars FROM pc, qa"""
ORACLE["feed_batches"] = f"""
WITH x AS (SELECT page_id, {P.sql_main_text_tags('html')} AS text FROM pages),
s AS ({sql_sentences("(SELECT page_id AS doc_id, text FROM x)")}),
a AS (SELECT doc_id, count(*) AS n, string_agg(CAST("begin" AS VARCHAR) || ':' || CAST("end" AS VARCHAR), ','
                                               ORDER BY "begin", "end") AS spans FROM s GROUP BY doc_id)
SELECT x.page_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_sentences, coalesce(a.spans, '') AS spans
FROM x LEFT JOIN a ON a.doc_id = x.page_id"""


from spantide.plans import oracle_records  # noqa: E402

ORACLE.update(oracle_records.ORACLE)
