"""DuckDB SQL of the queries of ``catalog_records.py``."""

from __future__ import annotations

from spantide.operators import induction as _I
from spantide.operators import pages as P
from spantide.operators import qa as _Q
from spantide.plans import oracle as O

ORACLE: dict = {}


# ---- L2 ---------------------------------------------------------------------------------

_PAGES = f"""pg AS (SELECT page_id AS doc_id, {P.sql_host('url')} AS host, {P.sql_title('html')} AS title, {P.sql_main_text_tags('html')} AS text,
              lower(regexp_extract(html, {O._ql(P.LANG_RE)}, 1)) AS lang FROM pages)"""
_PAGE_TERMS = f"WITH RECURSIVE {_PAGES},{O.sql_terms('pg')}"
ORACLE["extract_terms"] = f"""{_PAGE_TERMS},
own AS (SELECT doc_id, lower(term) AS term, arg_min(lower(lemma), (sent_no, anchor, variant)) AS lemma FROM tm GROUP BY doc_id, lower(term)),
{O.sql_matches('s', 'own', per_document=True, x='_own')},
tok AS (SELECT doc_id, string_agg("begin" || ':' || "end" || ':' || term || ':' || lemma, ',' ORDER BY "begin", "end", term) AS tokens FROM ma_own GROUP BY doc_id),
{O.sql_entities('s')},
ent AS (SELECT doc_id, string_agg("begin" || ':' || "end" || ':' || text || ':' || label, ',' ORDER BY "begin", "end", text, label) AS entities FROM en GROUP BY doc_id),
sen AS (SELECT doc_id, string_agg("begin" || ':' || "end", ',' ORDER BY "begin", "end") AS sentences FROM s GROUP BY doc_id)
SELECT pg.doc_id AS page_id, host, title, lang AS language, coalesce(sentences, '') AS sentences, coalesce(tokens, '') AS tokens, coalesce(entities, '') AS entities
FROM pg LEFT JOIN sen USING (doc_id) LEFT JOIN tok USING (doc_id) LEFT JOIN ent USING (doc_id) WHERE lang IN {O._SUPPORTED}
"""


# ---- Q7, Q8, Q9, L5 ------------------------------------------------------------------------

_SENT = f"""se AS (SELECT DISTINCT doc_id, u.sentence FROM documents, unnest({O._SPLIT('text')}) AS u(sentence)),
s AS (SELECT doc_id, sentence AS sent_no, CAST(0 AS BIGINT) AS "begin", sentence AS text FROM se)"""
_MC = f"""{_SENT},{O.sql_entities('s')},
po AS (SELECT DISTINCT doc_id, text, label, md5(concat_ws('|', '2022', label, text)) AS h FROM en),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY h, label, text) AS li, count(*) OVER (PARTITION BY doc_id, label) AS ln,
              row_number() OVER (PARTITION BY doc_id ORDER BY h, label, text) AS di, count(*) OVER (PARTITION BY doc_id) AS dn FROM po),
ds AS (SELECT a.doc_id, a.text, a.label, b.text AS other, a.dn, row_number() OVER (PARTITION BY a.doc_id, a.text, a.label ORDER BY a.label <> b.label,
              CASE WHEN a.label = b.label THEN (b.li - a.li + a.ln) % a.ln ELSE (b.di - a.di + a.dn) % a.dn END) AS k
       FROM rk a JOIN rk b ON a.doc_id = b.doc_id AND (a.text <> b.text OR a.label <> b.label)),
ch AS (SELECT doc_id, text, label, text AS answer, true AS correct FROM po
       UNION ALL SELECT doc_id, text, label, other, false FROM ds WHERE k <= least(4, dn) - 1),
mc AS (SELECT en.doc_id, en.sent_no AS sentence, en."begin", en."end", en.text AS answer, en.label,
              string_agg(CASE WHEN ch.correct THEN '*' ELSE '' END || ch.answer, ' | ' ORDER BY md5(concat_ws('|', '2022', en.sent_no, CAST(en."begin" AS VARCHAR), ch.answer, CAST(ch.correct AS VARCHAR))),
                         ch.answer, ch.correct) AS choices
       FROM en JOIN ch ON ch.doc_id = en.doc_id AND ch.text = en.text AND ch.label = en.label GROUP BY ALL),
mi AS (SELECT *, '{_Q.ANSWER_TOKEN} ' || answer || ' {_Q.CONTEXT_TOKEN} ' || sentence AS qg_input FROM mc)"""
ORACLE["mc_inputs"] = f"WITH RECURSIVE {_MC}\nSELECT doc_id, sentence, \"begin\", answer, label, qg_input, choices FROM mi"
_ALL = f"""{O._SEGS.strip()}, {_MC},
qi AS (SELECT doc_id, 'sentences' AS style, CAST(NULL AS BIGINT) AS "begin", u.answer, CAST(NULL AS VARCHAR) AS choices, '{_Q.ANSWER_TOKEN} ' || u.answer || ' {_Q.CONTEXT_TOKEN} ' || text AS qg_input
       FROM segs, unnest({O._SPLIT('text')}) AS u(answer)
       UNION ALL SELECT doc_id, 'multiple_choice', "begin", answer, choices, qg_input FROM mi)"""
ORACLE["question_inputs"] = f"{_ALL}\nSELECT doc_id, style, \"begin\", answer, choices, qg_input FROM qi"
_CTX = f"split_part(qg_input, ' {_Q.CONTEXT_TOKEN} ', 2)"
ORACLE["generated_questions"] = f"""{_ALL},
cz AS (SELECT *, split_part(substr({_CTX}, 1, strpos({_CTX}, answer) - 1) || '____' || substr({_CTX}, strpos({_CTX}, answer) + length(answer)) || '?', '?', 1) || '?' AS question FROM qi),
rn AS (SELECT *, length(question) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY length(question) DESC, style, qg_input, answer, "begin") AS rank FROM cz)
SELECT doc_id, rank, question, answer, choices, CAST(score AS BIGINT) AS score FROM rn WHERE rank <= 10"""


# ---- Q14, Q15, Q16 ------------------------------------------------------------------------

def _coin(seed: int) -> str:
    return f"CAST('0x' || substr(md5(conv_id || ':' || turn || ':{seed}'), 9, 8) AS BIGINT) % 2 = 0"


_NEXT = """an AS (SELECT DISTINCT answer, md5(answer) AS h FROM pr WHERE answer IS NOT NULL),
nx AS (SELECT answer, coalesce(lead(answer) OVER (ORDER BY h, answer), first(answer) OVER (ORDER BY h, answer)) AS other FROM an)"""
ORACLE["qa_corrupted"] = f"""{O._PAIRS.strip().replace('WITH c AS', 'WITH RECURSIVE c AS')},
{_NEXT},
w AS (SELECT pr.*, nx.other, conv_id || '|' || turn AS key, {_coin(2022)} AS keep, {_coin(2023)} AS swap FROM pr LEFT JOIN nx USING (answer)),
s AS (SELECT key AS doc_id, CAST(0 AS BIGINT) AS sent_no, CAST(0 AS BIGINT) AS "begin", question AS text FROM w WHERE NOT keep AND NOT swap),{O.sql_entities('s')},
el AS (SELECT doc_id AS key, list({{'b': "begin", 'e': "end", 't': text}} ORDER BY "begin", "end") AS es FROM en GROUP BY doc_id),
z AS (SELECT w.*, es, coalesce(len(es), 0) AS n, es[CAST('0x' || substr(md5('2022|' || w.key), 1, 8) AS BIGINT) % len(es) + 1].t AS one FROM w LEFT JOIN el USING (key)),
y AS (SELECT *, CASE WHEN n > 1 THEN list_reduce(list_transform(range(1, n + 2), lambda k: substr(question,
                 CASE WHEN k = 1 THEN 1 ELSE es[k - 1].e + 1 END, CASE WHEN k > n THEN length(question) ELSE es[k].b END - CASE WHEN k = 1 THEN 0 ELSE es[k - 1].e END)), lambda a, b: a || one || b) END AS replaced,
             other <> answer AS differs FROM z),
k AS (SELECT *, CASE WHEN keep THEN 'kept' WHEN swap THEN CASE WHEN differs THEN 'swap' ELSE 'kept' END
                     WHEN n > 1 AND replaced <> question THEN 'entities' WHEN n = 1 AND one <> coalesce(answer, '') THEN 'entity'
                     WHEN differs THEN 'swap' ELSE 'kept' END AS kind FROM y)
SELECT conv_id, turn, CASE WHEN kind = 'entities' THEN replaced ELSE question END AS question,
       CASE kind WHEN 'entity' THEN one WHEN 'swap' THEN other ELSE answer END AS answer, CAST(kind = 'kept' AS INTEGER) AS label, kind FROM k"""


# ---- C5, C7 -----------------------------------------------------------------------------------

_LAB = ("quality", "toxic", "long")


def _split_rounds() -> str:
    """The rounds of the multi-label split, one CTE each."""
    ctes = ["r0 AS (SELECT combo, count(*) AS n, CAST(NULL AS BIGINT) AS v FROM lb GROUP BY combo)"]
    for k in range(len(_LAB) + 1):
        # the open label with the fewest open rows, what its quota lacks; none left: all rows
        ctes.append(f"""l{k} AS (SELECT j, sum(CASE WHEN v IS NULL THEN n ELSE 0 END) AS open_n, CAST(floor(sum(n) * 0.1 + 0.5) AS BIGINT) - sum(coalesce(v, 0)) AS lack
  FROM r{k}, range(1, {len(_LAB) + 1}) t(j) WHERE combo[j] = 1 GROUP BY j HAVING sum(CASE WHEN v IS NULL THEN n ELSE 0 END) > 0),
p{k} AS (SELECT (SELECT j FROM l{k} ORDER BY open_n, j LIMIT 1) AS j, coalesce((SELECT lack FROM l{k} ORDER BY open_n, j LIMIT 1),
  (SELECT CAST(floor(sum(n) * 0.1 + 0.5) AS BIGINT) - sum(coalesce(v, 0)) FROM r{k})) AS lack),
m{k} AS (SELECT r{k}.*, v IS NULL AND (p{k}.j IS NULL OR combo[p{k}.j] = 1) AS mine, greatest(0, least(lack, sum(CASE WHEN v IS NULL AND (p{k}.j IS NULL OR combo[p{k}.j] = 1) THEN n END) OVER ())) AS take,
  sum(CASE WHEN v IS NULL AND (p{k}.j IS NULL OR combo[p{k}.j] = 1) THEN n END) OVER () AS total FROM r{k}, p{k}),
q{k} AS (SELECT *, CASE WHEN mine THEN take * n // total END AS whole, CASE WHEN mine THEN take * n % total END AS frac FROM m{k}),
r{k + 1} AS (SELECT combo, n, CASE WHEN mine THEN whole + CAST(row_number() OVER (ORDER BY frac DESC NULLS LAST, combo) <= take - sum(whole) OVER () AS BIGINT) ELSE v END AS v FROM q{k})""")
    return ",\n".join(ctes)


ORACLE["multilabel_split"] = f"""
WITH lb AS (SELECT l.doc_id, l.quality, l.toxic, CAST(d.n_chars > 1500 AS INTEGER) AS long, [l.quality, l.toxic, CAST(d.n_chars > 1500 AS INTEGER)] AS combo FROM labels l JOIN documents d USING (doc_id)),
{_split_rounds()},
x AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY md5(doc_id || '2022'), doc_id) AS k FROM lb)
SELECT doc_id, quality, toxic, long, k <= v AS is_val FROM x JOIN r{len(_LAB) + 1} USING (combo)"""

ORACLE["weighted_draws"] = """
WITH c AS (SELECT quality, 1.0::DOUBLE / count(*) AS w FROM labels GROUP BY quality),
r AS (SELECT doc_id, CAST(floor(w * 1099511627776) AS BIGINT) AS size, md5(doc_id || '2022') AS h FROM labels JOIN c USING (quality)),
l AS (SELECT doc_id, sum(size) OVER (ORDER BY h, doc_id) - size AS b, sum(size) OVER (ORDER BY h, doc_id) AS e, sum(size) OVER () AS total FROM r),
d AS (SELECT CAST('0x' || substr(md5('2022:' || k), 1, 15) AS BIGINT) % (SELECT CAST(max(total) AS BIGINT) FROM l) AS at FROM (SELECT unnest(range((SELECT count(*) FROM labels))) AS k) z)
SELECT doc_id, CAST(count(d.at) AS BIGINT) AS n FROM l LEFT JOIN d ON d.at >= l.b AND d.at < l.e GROUP BY doc_id"""


# ---- T11 ---------------------------------------------------------------------------------------

_WRONG = """wc AS (SELECT lang, lower(piece) AS word, count(DISTINCT doc_id) AS n FROM tl WHERE regexp_matches(lower(piece), '^\\p{L}+$') AND length(lower(piece)) >= 4 GROUP BY 1, 2),
wf AS (SELECT * FROM wc WHERE n >= 100),
ws AS (SELECT a.lang, a.word, a.n AS n_docs, b.word AS suggestion, b.n AS suggestion_docs, row_number() OVER (PARTITION BY a.lang, a.word ORDER BY b.n DESC, b.word) AS k
       FROM wc a JOIN wf b ON a.lang = b.lang AND b.n >= 100 * a.n AND abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.word, b.word) = 1)"""
ORACLE["misspellings"] = f"WITH {O._TOKENS_CTE},\n{_WRONG}\nSELECT lang, word, n_docs, suggestion, suggestion_docs FROM ws WHERE k = 1"
ORACLE["spelled_terms"] = f"""WITH {O._CANDS_CTE},\n{_WRONG},
tw AS (SELECT doc_id, term, lang, unnest(regexp_split_to_array(lower(term), '[^\\p{{L}}]+')) AS word FROM tm),
bad AS (SELECT DISTINCT doc_id, term FROM tw JOIN ws USING (lang, word))
SELECT doc_id, count(*) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM tm ANTI JOIN bad USING (doc_id, term) GROUP BY doc_id"""


# ---- N1, induced -----------------------------------------------------------------------------

_SEEDS = ", ".join(f"({O._ql(a)}, {O._ql(b)}, {O._ql(c)}, {O._ql(d)})" for a, b, c, d in _I.SEEDS)
ORACLE["induced_gazetteer"] = f"""WITH {O._TOKENS_CTE},
np AS (SELECT *, pos = 'PROPN' AS p, lag(piece) OVER w AS before, lead(piece) OVER w AS after,
              row_number() OVER w - row_number() OVER (PARTITION BY doc_id, sent_no, pos = 'PROPN' ORDER BY tok_no) AS island
       FROM tl WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)),
nr AS (SELECT lang, doc_id, rtrim(string_agg(piece || ws_after, '' ORDER BY tok_no), ' ') AS run, arg_min(coalesce(before, '^'), tok_no) AS l, arg_max(coalesce(after, '^'), tok_no) AS r
       FROM np WHERE p GROUP BY lang, doc_id, sent_no, island),
ed AS (SELECT lang, run, side, context, count(*) AS n FROM (SELECT lang, run, 'left' AS side, lower(l) AS context FROM nr UNION ALL SELECT lang, run, 'right', lower(r) FROM nr) z GROUP BY ALL),
sd0(lang, side, context, label) AS (VALUES {_SEEDS}),
tot AS (SELECT lang, run, sum(n) AS total FROM ed GROUP BY ALL),
r1 AS (SELECT ed.lang, ed.run, label, sum(n * {_I.ONE}) // any_value(total) AS score FROM ed JOIN sd0 USING (lang, side, context) JOIN tot USING (lang, run) GROUP BY ALL),
fr AS (SELECT *, sum(n) OVER (PARTITION BY lang, side, context) AS total FROM ed ANTI JOIN sd0 USING (lang, side, context)),
c1 AS (SELECT fr.lang, side, context, label, sum(n * score) // any_value(total) AS score FROM fr JOIN r1 USING (lang, run) GROUP BY fr.lang, side, context, label),
sc AS (SELECT lang, side, context, label, {_I.ONE} AS score FROM sd0 UNION ALL SELECT * FROM c1 WHERE score > 0),
r2 AS (SELECT ed.lang, ed.run, label, sum(n * score) // any_value(total) AS score, any_value(total) AS n FROM ed JOIN sc USING (lang, side, context) JOIN tot USING (lang, run) GROUP BY ed.lang, ed.run, label),
bs AS (SELECT *, row_number() OVER (PARTITION BY lang, run ORDER BY score DESC, label) AS k FROM r2)
SELECT lang, run, label, CAST(score AS BIGINT) AS score, CAST(n AS BIGINT) AS n FROM bs WHERE k = 1 AND n >= 2 AND score >= {_I.ONE // 50}"""


# ---- C3 ---------------------------------------------------------------------------------------

ORACLE["training_rejects"] = f"""
SELECT doc_id, quality, toxic FROM labels JOIN documents USING (doc_id) WHERE {O._sql_clean('text')} = ''"""


# ---- L7 ---------------------------------------------------------------------------------------

ORACLE["page_feed"] = f"""
SELECT 'records' AS sink, page_id, CAST(length({P.sql_main_text_tags('html')}) AS BIGINT) AS place, {P.sql_title('html')} AS text FROM pages
UNION ALL SELECT 'contacts', doc_id, span_no, content_context FROM ({O.ORACLE['contact_paragraphs']}) c
UNION ALL SELECT 'questions', doc_id, span_no, content_context FROM ({O.ORACLE['qa_paragraphs']}) q
UNION ALL SELECT * FROM ({_PAGE_TERMS},
own AS (SELECT doc_id, lower(term) AS term, arg_min(lower(lemma), (sent_no, anchor, variant)) AS lemma FROM tm GROUP BY doc_id, lower(term)),
{O.sql_matches('s', 'own', per_document=True)},
{O.sql_rules('s')},{O.sql_leftmost('ru')}
SELECT 'sentence' AS sink, doc_id AS page_id, "begin" AS place, '' AS text FROM s
UNION ALL SELECT 'token', doc_id, "begin", term || '|' || lemma FROM ma
UNION ALL SELECT 'entity', doc_id, "begin", text || '|' || label FROM en) a"""


# ---- T16, S10 ------------------------------------------------------------------------------------

ORACLE["scored_occurrences"] = f"""
SELECT o.* EXCLUDE (score), i.idf AS score FROM ({O.ORACLE['term_occurrences']}) o
JOIN ({O.ORACLE['term_idf'].replace('SELECT DISTINCT gram AS term', 'SELECT DISTINCT lower(gram) AS term', 1).replace("range(1, 2 + 1)", "range(2, 2 + 1)", 1)}) i USING (term)"""
ORACLE["stored_annotations"] = f"""
WITH RECURSIVE {_PAGES}, sd AS (SELECT * FROM pg WHERE lang IN {O._SUPPORTED}),
s AS ({O.sql_sentences('sd')}),{O.sql_rules('s')},{O.sql_leftmost('ru')}
SELECT doc_id, 'sentence' AS type, "begin", "end", CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS label FROM s
UNION ALL SELECT doc_id, 'entity', "begin", "end", text, label FROM en"""
