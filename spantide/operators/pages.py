"""Page to text (P1-P9) as corpus jobs over a ``pages(page_id, url, html)`` table.

A page becomes a *block array* inside its own row: script/style/comments are cut,
every opening block tag starts a block (closing tags are never trusted), and each
block is reduced to text. Only the corpus-wide boilerplate test (P9) needs a
shuffle; everything else is a narrow, codegen'd projection.

Each regex step is declared once in ``CLEAN_STEPS`` / ``BLOCK_STEPS`` and rendered
both as Spark Columns and, for the oracle, as DuckDB SQL text.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantide.functions.text import WORD, strip
from spantide.session import cut_lineage

# Block-level tags that start a new text block.
BLOCK_TAGS = ("p|div|h[1-6]|li|ul|ol|dl|dt|dd|nav|article|section|header|footer|aside|main|"
              "table|thead|tbody|tr|td|th|blockquote|pre|form|figure|figcaption|address|center")
# Regions that are boilerplate for the main-text variant.
BOILER_REGIONS = ("nav", "footer", "aside", "header")
BOILER_CLASSES = "ad|ads|advert|banner|cookie|cookies|share|social|sidebar|menu|breadcrumb"
# Tags that bound a region; what is left open inside one ends with it.
CONTAINERS = ("body", "main", "article", "section", "div", "nav", "header", "footer", "aside")
# Named entities: those of Latin-1 (from the standard library's table) and a few of typography;
# a no-break space is read as a space.
ENTITIES = {n: chr(c) for n, c in sorted(name2codepoint.items()) if c < 256} | {
    n: chr(name2codepoint[n]) for n in ("ndash", "mdash", "lsquo", "rsquo", "sbquo", "ldquo", "rdquo", "bdquo", "hellip",
                                        "bull", "euro", "trade", "rarr", "larr", "minus")} | {"apos": "'", "nbsp": " "}
ENTITY_RE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

MARK, SEP = "\u0001", "\u0002"

TITLE_RE = r"(?is)<title[^>]*>(.*?)</title\s*>"
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
META_TAG_RE, LINK_TAG_RE = r"(?is)<meta\s[^>]*>", r"(?is)<link\s[^>]*>"
ATTR_RE = r"""(?is)\s(?:{name})\s*=\s*["']([^"']*)["']"""
LANG_RE = r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})"""

# (pattern, replacement) applied to the whole page, in order
CLEAN_STEPS = [
    (r"[\x{01}\x{02}]", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b.*?</script\s*>", ""),
    (r"(?is)<style\b.*?</style\s*>", ""),
    (r"(?is)<noscript\b.*?</noscript\s*>", ""),
    (r"(?is)<head\b.*?</head\s*>", ""),
    (r"(?is)<title\b.*?</title\s*>", ""),
]
MAIN_STEPS = [(rf"(?is)<{t}\b.*?</{t}\s*>", "") for t in BOILER_REGIONS] + [
    (rf"""(?is)<div\s[^>]*class\s*=\s*["'](?:[^"']*\s)?(?:{BOILER_CLASSES})(?:\s[^"']*)?["'][^>]*>.*?</div\s*>""", ""),
]
MARK_RE = rf"(?i)<({BLOCK_TAGS})\b[^>]*>"
CONTAINER_RE = rf"(?i)</?(?:{'|'.join(CONTAINERS)})\b[^>]*>"
BOILER_RE = rf"""(?is)^<(?:(?:{'|'.join(BOILER_REGIONS)})\b|div\s[^>]*class\s*=\s*["'](?:[^"']*\s)?(?:{BOILER_CLASSES})(?:\s[^"']*)?["'])"""
# applied to each block body, in order (entities are decoded between step 2 and 3)
BLOCK_STEPS_PRE = [
    (r"(?i)<br\s*/?>", "\n"),
    (r"<[^>]*>", ""),
]
BLOCK_STEPS_POST = [
    (r"[\t\r\f\x{0B} \x{A0}]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n+", "\n"),
    (r"^[\n ]+|[\n ]+\z", ""),
]


# ---- Spark expressions -------------------------------------------------------------

def _unescape(c: Column) -> Column:
    """Named, decimal and hexadecimal entities, each decoded once; unknown ones stay."""
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def one(part):
        name = F.regexp_extract(part, ENTITY_RE, 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(
            name.startswith("#"), F.substring(name, 2, 8)).cast("long")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).when(number.isNull(), names[name])
        return F.coalesce(F.concat(char, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))

    parts = F.split(c, "&", -1)
    return F.when(~c.contains("&"), c).otherwise(F.concat(parts[0], F.array_join(
        F.transform(F.slice(parts, 2, F.size(parts)), one), "")))


def _clean(html: Column, main: bool) -> Column:
    for p, r in CLEAN_STEPS + (MAIN_STEPS if main else []):
        html = F.regexp_replace(html, p, r)
    return F.regexp_replace(html, MARK_RE, MARK + "$1" + SEP)


def _block_text(body: Column) -> Column:
    for p, r in BLOCK_STEPS_PRE:
        body = F.regexp_replace(body, p, r)
    body = _unescape(body)
    for p, r in BLOCK_STEPS_POST:
        body = F.regexp_replace(body, p, r)
    return body


def blocks_expr(html, main: bool = False, links: bool = True) -> Column:
    """Array of ``struct(tag, text, link_chars)`` for one page, in document order; without ``links``
    the link texts are not looked at and ``link_chars`` is left out."""
    html = F.col(html) if isinstance(html, str) else html
    parts = F.split(_clean(html, main), MARK, -1)

    def one(b):
        has = F.instr(b, SEP) > 0
        tag = F.when(has, F.lower(F.substring_index(b, SEP, 1))).otherwise(F.lit(""))
        body = F.when(has, F.substring_index(b, SEP, -1)).otherwise(b)
        text = _block_text(body)
        text = F.when((tag == "li") & (text != ""), F.concat(F.lit("- "), text)).otherwise(text)
        if not links:
            return F.struct(tag.alias("tag"), text.alias("text"))
        linked = F.array_join(F.regexp_extract_all(body, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), " ")
        return F.struct(tag.alias("tag"), text.alias("text"), F.length(_block_text(linked)).alias("link_chars"))

    return F.transform(parts, one)


def full_text_expr(html) -> Column:
    """All blocks (headers and footers kept), a blank line between blocks."""
    texts = F.transform(blocks_expr(html, main=False, links=False), lambda b: b["text"])
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")


def main_text_tags_expr(html) -> Column:
    """P3, tag-only variant: boilerplate regions removed, one line per block."""
    texts = F.transform(blocks_expr(html, main=True, links=False), lambda b: b["text"])
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def title_expr(html) -> Column:
    """First <title>, untrimmed, entities decoded; null when there is none."""
    html = F.col(html) if isinstance(html, str) else html
    return F.when(html.rlike(TITLE_RE), _unescape(F.regexp_extract(html, TITLE_RE, 1)))


def titles_expr(html) -> Column:
    """All titles joined by newline; null when there is none."""
    html = F.col(html) if isinstance(html, str) else html
    return F.when(html.rlike(TITLE_RE),
                  F.array_join(F.regexp_extract_all(html, F.lit(TITLE_RE), F.lit(1)), "\n"))


def host_expr(url) -> Column:
    """Lower-cased host of an absolute URL, null if it has none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.when(url.rlike(HOST_RE), F.lower(F.regexp_extract(url, HOST_RE, 1)))


def _attr(tag: Column, name: str) -> Column:
    """The value of the first attribute of a tag whose name matches, or null."""
    regex = ATTR_RE.format(name=name)
    return F.when(tag.rlike(regex), F.regexp_extract(tag, regex, 1))


def _meta(html: Column, key: str) -> Column:
    """Content of the first <meta> with this name or property, in any order of attributes."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(META_TAG_RE), F.lit(0)),
                    lambda t: (F.lower(_attr(t, "name|property")) == key) & _attr(t, "content").isNotNull())
    return _unescape(_attr(F.get(tags, 0), "content"))


def _canonical(html: Column) -> Column:
    """Target of the first <link rel=canonical>, in any order of attributes."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(LINK_TAG_RE), F.lit(0)),
                    lambda t: (F.lower(_attr(t, "rel")) == "canonical") & _attr(t, "href").isNotNull())
    return _unescape(_attr(F.get(tags, 0), "href"))


def fingerprint_expr(text) -> Column:
    """base64(SHA-1(words of >= 5 word characters, lower-cased, space-joined))."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD + "{5,}"), F.lit(0))
    return F.base64(F.unhex(F.sha1(F.array_join(words, " "))))


# ---- DataFrame operators -----------------------------------------------------------

def page_texts(pages: DataFrame) -> DataFrame:
    """P3 (tag-only) and P4 text per page: ``(page_id, host, main_text, full_text)``."""
    return pages.select(
        "page_id", host_expr("url").alias("host"),
        main_text_tags_expr("html").alias("main_text"),
        full_text_expr("html").alias("full_text"))


def cut_regions(pages: DataFrame) -> DataFrame:
    """P3, regions: ``(page_id, url, html)`` without comments, scripts, head and boilerplate regions.

    A page is cut at its container tags into events; an event is an opening tag, a closing tag, or void
    (``<div/>``), with the text up to the next one. Each kind of tag has a running depth, never below
    zero, so a closing tag that closes nothing has no effect. A boilerplate region ends where a
    depth falls below what it was behind the region's opening tag: at its own closing tag, however many
    nested ones come before, or at that of a container around it, or else with the page. The next such
    event comes from a running value over the closing tags of one kind and depth, and a text goes if a
    region that began before it ends behind it: windows over the events of a page, linear in them.
    """
    html = F.col("html")
    for p, r in CLEAN_STEPS:
        html = F.regexp_replace(html, p, r)
    x = pages.select("page_id", "url", html.alias("html")).repartition("page_id")
    x = x.select("page_id", "url", F.posexplode(F.split(F.regexp_replace("html", CONTAINER_RE, MARK + "$0"), MARK, -1)).alias("k", "part"))
    tag = F.lower(F.regexp_extract("part", r"^</?([A-Za-z]+)", 1))
    step = F.when((F.col("k") == 0) | F.regexp_extract("part", r"^<[^>]*>", 0).endswith("/>"), 0).when(F.col("part").startswith("</"), -1).otherwise(1)
    x = x.select("page_id", "url", "k", "part", tag.alias("tag"), step.alias("step"))
    w = Window.partitionBy("page_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *[F.sum(F.when(F.col("tag") == t, F.col("step")).otherwise(0)).over(w).alias(f"s_{t}") for t in CONTAINERS])
    x = x.select("*", *[F.min(f"s_{t}").over(w).alias(f"m_{t}") for t in CONTAINERS])
    depth = {t: F.col(f"s_{t}") - F.least(F.lit(0), F.col(f"m_{t}")) for t in CONTAINERS}
    x = x.select("page_id", "url", "k", "part", "tag", "step", *[depth[t].cast("int").alias(f"d_{t}") for t in CONTAINERS])
    boiler = (F.col("step") == 1) & F.col("part").rlike(BOILER_RE)
    # closing tags by (tag, depth left), and for each region the closings that would end it
    own = F.coalesce(*[F.when(F.col("tag") == t, F.col(f"d_{t}")) for t in CONTAINERS])
    closing = F.array(F.struct(F.col("tag").alias("t"), own.alias("level")))
    ends = F.filter(F.array(*[F.struct(F.lit(t).alias("t"), (F.col(f"d_{t}") - 1).alias("level")) for t in CONTAINERS]), lambda e: e["level"] >= 0)
    e = x.where(boiler | (F.col("step") == -1)).select("page_id", "k", boiler.alias("boiler"), F.explode(F.when(boiler, ends).otherwise(closing)).alias("e"))
    back = Window.partitionBy("page_id", "e.t", "e.level").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("end", F.last(F.when(~F.col("boiler"), F.col("k")), ignorenulls=True).over(back)).where("boiler")
    # no such closing tag: the page's end
    regions = e.groupBy(F.col("page_id").alias("_p"), F.col("k").alias("_k")).agg(F.min("end").alias("end"))
    x = x.join(regions, (F.col("page_id") == F.col("_p")) & (F.col("k") == F.col("_k")), "left")
    x = x.withColumn("until", F.max(F.when(F.col("_k").isNotNull(), F.coalesce("end", F.lit(2 ** 31 - 1)))).over(w))
    kept = F.array_sort(F.collect_list(F.when(F.col("until").isNull() | (F.col("k") >= F.col("until")), F.struct("k", "part"))))
    return x.groupBy("page_id", "url").agg(F.array_join(kept["part"], "").alias("html"))


def block_table(pages: DataFrame, main: bool = False, links: bool = True) -> DataFrame:
    """One row per non-empty block: ``(page_id, host, block_no, tag, text, link_chars)``, the last one with ``links``."""
    x = pages.select("page_id", host_expr("url").alias("host"),
                     F.posexplode(blocks_expr("html", main, links)).alias("block_no", "b"))
    return (x.select("page_id", "host", F.col("block_no").cast("long").alias("block_no"), "b.*")
             .where(F.col("text") != ""))


def repeated_blocks(blocks: DataFrame, min_pages: int = 3) -> DataFrame:
    """P9 over blocks ``(page_id, host, text)``: texts seen on at least ``min_pages`` distinct pages of
    one host, ``(host, block_md5, n_pages)``.

    Grouping key is ``(host, md5(text))``: a host holding a third of the corpus still
    spreads over its many distinct blocks, and the distinct-page count is aggregated
    map-side first.
    """
    b = blocks.select("host", "page_id", F.md5("text").alias("block_md5"))
    return (b.groupBy("host", "block_md5")
             .agg(F.countDistinct("page_id").alias("n_pages"))
             .where(F.col("n_pages") >= min_pages))


def host_boilerplate(pages: DataFrame, min_pages: int = 3, main: bool = False) -> DataFrame:
    """Block texts that are repeated on a host."""
    return repeated_blocks(block_table(pages, main, links=False), min_pages)


def main_text(pages: DataFrame, min_pages: int = 3, max_link_density: float = 0.5,
              min_chars: int = 1) -> DataFrame:
    """P3 full heuristic: blocks outside boilerplate regions, minus link-heavy blocks, minus blocks
    repeated on ``min_pages`` pages of the host (P9). ``(page_id, host, text)``. Pages are
    parsed once, into a written table of blocks."""
    every = cut_lineage(block_table(cut_regions(pages)).drop("tag"))
    b = every.where((F.length("text") >= min_chars)
                    & (F.col("link_chars") <= F.length("text") * max_link_density))
    boiler = repeated_blocks(every, min_pages)
    kept = (b.withColumn("block_md5", F.md5("text"))
             .join(boiler.select("host", "block_md5"), ["host", "block_md5"], "left_anti"))
    per_page = (kept.groupBy("page_id")
                    .agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("bs")))
    return (pages.select("page_id", host_expr("url").alias("host"))
                 .join(per_page, "page_id", "left")
                 .select("page_id", "host",
                         F.coalesce(F.array_join(F.col("bs.text"), "\n"), F.lit("")).alias("text")))


def page_record(pages: DataFrame, language_col: str | None = None, extra: tuple = ()) -> DataFrame:
    """The page record with the reference's defaults.

    When main text was extracted, missing metadata is null; when nothing was
    extracted, text/hostname/source-hostname/source default to '' and tags/excerpt
    to null. The title comes from <title> either way. ``extra`` are further columns of ``pages``.
    """
    html = F.col("html")
    text = main_text_tags_expr(html)
    got = text != ""
    canon = _canonical(html)
    source = F.coalesce(canon, F.col("url"))
    lang = F.col(language_col) if language_col else F.lower(F.regexp_extract(html, LANG_RE, 1))
    return pages.select(
        "page_id",
        title_expr(html).alias("title"),
        F.when(got, F.coalesce(_meta(html, "keywords"), F.lit(""))).alias("tags"),
        F.when(got, _meta(html, "description")).alias("excerpt"),
        text.alias("text"),
        F.when(got, host_expr(source)).otherwise(F.lit("")).alias("hostname"),
        F.when(got, _meta(html, "og:site_name")).otherwise(F.lit("")).alias("source_hostname"),
        F.when(got, source).otherwise(F.lit("")).alias("source"),
        F.when(lang != "", lang).alias("language"),
        F.when(got, fingerprint_expr(text)).alias("fingerprint"),
        *extra,
    )


def language_filter(df: DataFrame, target: str | None, lang_col: str = "lang") -> DataFrame:
    """Keep rows in the target language; ``None`` keeps everything."""
    if target is None:
        return df
    return df.where(F.col(lang_col) == target)


def fingerprint_groups(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Exact-content duplicate groups ``(fingerprint, n_docs, first_doc_id)``."""
    return (docs.select("doc_id", fingerprint_expr(text_col).alias("fingerprint"))
                .groupBy("fingerprint")
                .agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc_id")))


def first_of_duplicates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Keep one document per fingerprint (the smallest doc_id)."""
    fp = docs.withColumn("fingerprint", fingerprint_expr(text_col))
    w = Window.partitionBy("fingerprint").orderBy("doc_id")
    return fp.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# ---- DuckDB SQL renderings (oracle) --------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_unescape(e: str) -> str:
    """The entity rule in SQL: the text cut at '&', each part begun by an entity decoded."""
    names = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in ENTITIES.items()) + "}"
    name = f"regexp_extract(p, {_q(ENTITY_RE)}, 1)"
    number = (f"CASE WHEN regexp_matches({name}, '^#[xX]') THEN CAST('0x' || substr({name}, 3) AS BIGINT) "
              f"WHEN starts_with({name}, '#') THEN CAST(substr({name}, 2) AS BIGINT) END")
    char = (f"CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr(CAST({number} AS INTEGER)) "
            f"WHEN {number} IS NULL THEN {names}[{name}] END")
    one = f"coalesce({char} || substr(p, length({name}) + 2), '&' || p)"
    return (f"CASE WHEN NOT contains({e}, '&') THEN {e} ELSE string_split({e}, '&')[1] || "
            f"array_to_string(list_transform(string_split({e}, '&')[2:], lambda p: {one}), '') END")


def _sql_steps(e: str, steps) -> str:
    for p, r in steps:
        rr = _q(r) if r != "\n" else "chr(10)"
        e = f"regexp_replace({e}, {_q(p)}, {rr}, 'g')"
    return e


def sql_block_texts(html: str, main: bool) -> str:
    cleaned = _sql_steps(html, CLEAN_STEPS + (MAIN_STEPS if main else []))
    marked = f"regexp_replace({cleaned}, {_q(MARK_RE)}, chr(1) || '\\1' || chr(2), 'g')"
    body = "(CASE WHEN strpos(b, chr(2)) > 0 THEN split_part(b, chr(2), 2) ELSE b END)"
    tag = "(CASE WHEN strpos(b, chr(2)) > 0 THEN lower(split_part(b, chr(2), 1)) ELSE '' END)"
    raw = f"{{'tag': {tag}, 'body': {_sql_steps(body, BLOCK_STEPS_PRE)}}}"
    text = f"{{'tag': b.tag, 'text': {_sql_steps(_sql_unescape('b.body'), BLOCK_STEPS_POST)}}}"
    item = "CASE WHEN b.tag = 'li' AND b.text <> '' THEN '- ' || b.text ELSE b.text END"
    blocks = f"list_transform(string_split({marked}, chr(1)), lambda b: {raw})"
    return f"list_transform(list_transform({blocks}, lambda b: {text}), lambda b: {item})"


def sql_linked_blocks(html: str) -> str:
    """List of ``{text, link_chars}``, as ``blocks_expr`` with links."""
    marked = f"regexp_replace({_sql_steps(html, CLEAN_STEPS)}, {_q(MARK_RE)}, chr(1) || '\\1' || chr(2), 'g')"
    body = "(CASE WHEN strpos(b, chr(2)) > 0 THEN split_part(b, chr(2), 2) ELSE b END)"
    tag = "(CASE WHEN strpos(b, chr(2)) > 0 THEN lower(split_part(b, chr(2), 1)) ELSE '' END)"
    linked = f"array_to_string(regexp_extract_all({body}, {_q(r'(?is)<a\b[^>]*>(.*?)</a\s*>')}, 1), ' ')"
    raw = f"{{'tag': {tag}, 'body': {_sql_steps(body, BLOCK_STEPS_PRE)}, 'linked': {_sql_steps(linked, BLOCK_STEPS_PRE)}}}"
    text = f"{{'tag': b.tag, 'text': {_sql_steps(_sql_unescape('b.body'), BLOCK_STEPS_POST)}, 'link_chars': length({_sql_steps(_sql_unescape('b.linked'), BLOCK_STEPS_POST)})}}"
    item = "{'text': CASE WHEN b.tag = 'li' AND b.text <> '' THEN '- ' || b.text ELSE b.text END, 'link_chars': b.link_chars}"
    blocks = f"list_transform(string_split({marked}, chr(1)), lambda b: {raw})"
    return f"list_transform(list_transform({blocks}, lambda b: {text}), lambda b: {item})"


def sql_cut_regions(src: str) -> str:
    """CTEs up to ``cut`` (page_id, url, html): per boilerplate region the first later closing tag that leaves some
    depth below the region's."""
    depth = ", ".join(f"sum(CASE WHEN tag = '{t}' THEN step ELSE 0 END) OVER w AS s_{t}" for t in CONTAINERS)
    least = ", ".join(f"s_{t} - least(0, min(s_{t}) OVER w) AS d_{t}" for t in CONTAINERS)
    below = " OR ".join(f"(b.tag = '{t}' AND b.d_{t} < a.d_{t})" for t in CONTAINERS)
    return f"""
cx AS (SELECT page_id, url, u.part, u.k FROM {src}, unnest(string_split(regexp_replace({_sql_steps('html', CLEAN_STEPS)}, {_q(CONTAINER_RE)}, chr(1) || '\\0', 'g'), chr(1))) WITH ORDINALITY AS u(part, k)),
cs AS (SELECT *, lower(regexp_extract(part, '^</?([A-Za-z]+)', 1)) AS tag,
              CASE WHEN k = 1 OR regexp_extract(part, '^<[^>]*>') LIKE '%/>' THEN 0 WHEN starts_with(part, '</') THEN -1 ELSE 1 END AS step FROM cx),
cd AS (SELECT *, {depth} FROM cs WINDOW w AS (PARTITION BY page_id ORDER BY k)),
ce AS (SELECT *, {least} FROM cd WINDOW w AS (PARTITION BY page_id ORDER BY k)),
cr AS (SELECT a.page_id, a.k, (SELECT min(b.k) FROM ce b WHERE b.page_id = a.page_id AND b.k > a.k AND b.step = -1 AND ({below})) AS till
       FROM ce a WHERE step = 1 AND regexp_matches(part, {_q(BOILER_RE)})),
cut AS (SELECT page_id, any_value(url) AS url, coalesce(string_agg(part, '' ORDER BY k) FILTER (NOT EXISTS (
          SELECT 1 FROM cr WHERE cr.page_id = ce.page_id AND cr.k <= ce.k AND (cr.till IS NULL OR ce.k < cr.till))), '') AS html FROM ce GROUP BY page_id)"""


def sql_full_text(html: str) -> str:
    return f"array_to_string(list_filter({sql_block_texts(html, False)}, lambda t: t <> ''), chr(10) || chr(10))"


def sql_main_text_tags(html: str) -> str:
    return f"array_to_string(list_filter({sql_block_texts(html, True)}, lambda t: t <> ''), chr(10))"


def sql_title(html: str) -> str:
    return (f"(SELECT {_sql_unescape('v')} FROM (SELECT CASE WHEN regexp_matches({html}, {_q(TITLE_RE)}) "
            f"THEN regexp_extract({html}, {_q(TITLE_RE)}, 1) END AS v) y)")


def sql_titles(html: str) -> str:
    return (f"CASE WHEN regexp_matches({html}, {_q(TITLE_RE)}) "
            f"THEN array_to_string(regexp_extract_all({html}, {_q(TITLE_RE)}, 1), chr(10)) END")


def sql_host(url: str) -> str:
    return f"CASE WHEN regexp_matches({url}, {_q(HOST_RE)}) THEN lower(regexp_extract({url}, {_q(HOST_RE)}, 1)) END"


def sql_fingerprint(text: str) -> str:
    return (f"base64(unhex(sha1(array_to_string(regexp_extract_all(lower({text}), "
            f"{_q(WORD + '{5,}')}, 0), ' '))))")


def _sql_attr(tag: str, name: str) -> str:
    regex = _q(ATTR_RE.format(name=name))
    return f"CASE WHEN regexp_matches({tag}, {regex}) THEN regexp_extract({tag}, {regex}, 1) END"


def _sql_tag_value(html: str, tag_re: str, key_attr: str, key: str, value_attr: str) -> str:
    tag = (f"list_filter(regexp_extract_all({html}, {_q(tag_re)}), lambda t: lower({_sql_attr('t', key_attr)}) = {_q(key)} "
           f"AND {_sql_attr('t', value_attr)} IS NOT NULL)[1]")
    return f"(SELECT {_sql_unescape('v')} FROM (SELECT {_sql_attr(tag, value_attr)} AS v) y)"


def sql_meta(html: str, key: str) -> str:
    return _sql_tag_value(html, META_TAG_RE, "name|property", key, "content")


def sql_canonical(html: str) -> str:
    return _sql_tag_value(html, LINK_TAG_RE, "rel", "canonical", "href")


def sql_page_record(html: str = "html", url: str = "url") -> str:
    """Select-list of the P5/S11 record, mirroring ``page_record``."""
    text = sql_main_text_tags(html)
    canon = sql_canonical(html)
    source = f"coalesce({canon}, {url})"
    lang = f"lower(regexp_extract({html}, {_q(LANG_RE)}, 1))"
    got = "(txt <> '')"
    return f"""
      {sql_title(html)} AS title,
      CASE WHEN {got} THEN coalesce({sql_meta(html, 'keywords')}, '') END AS tags,
      CASE WHEN {got} THEN {sql_meta(html, 'description')} END AS excerpt,
      txt AS text,
      CASE WHEN {got} THEN {sql_host(source)} ELSE '' END AS hostname,
      CASE WHEN {got} THEN {sql_meta(html, 'og:site_name')} ELSE '' END AS source_hostname,
      CASE WHEN {got} THEN {source} ELSE '' END AS source,
      CASE WHEN {lang} <> '' THEN {lang} END AS language,
      CASE WHEN {got} THEN {sql_fingerprint('txt')} END AS fingerprint""", text
