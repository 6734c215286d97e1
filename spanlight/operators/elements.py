"""Rules over the elements of a page: blocks, images, controls, ids and headings.

Each takes the plan, which has the dialect and the relations ``site`` and
``blocks``, and gives SQL.  An array of a page's elements is exploded, so the
work stays where the page is; only groups of blocks or ids are shuffled.
"""

from __future__ import annotations

from spanlight.functions.dialect import SPACE

#: Media types of alternates that are no translations.
MACHINE_MEDIA = "('text/markdown', 'text/plain', 'application/json', 'application/ld+json', 'application/atom+xml', 'application/rss+xml', 'application/feed+json')"
#: Data-ui that may repeat on a page, alone or at either end of a hyphenated name.
REPEATABLE = "card|item|entry|result|tile|row|skill-card"
#: Words that cite, words of counters, and words that open a question.
CITING = "source|sources|reference|references|according to|citation"
COUNTING = "feature|features|category|categories|tool|tools|tab|tabs|agent|agents|session|sessions|mcp|count|counts|stat|stats|metric|metrics|status|active|inactive|cost|latency|users"
ASKING = "what|why|how|when|where|who"
UNQUESTIONED = "('search', 'admin', 'utility', 'feed')"
UNCITED = "('search', 'admin', 'utility', 'feed', 'not_found', 'home', 'listing')"
#: Least bytes of a block whose numbers want a source; most bytes of a counter; most bytes of a thin answer.
FACT_BYTES, COUNTER_BYTES, ANSWER_BYTES = 80, 120, 120
OPENING_WORDS = 8


def block_groups(p) -> list[str]:
    """GEO003, 005, 006, 010, 012, 013: repeated names, bare details and code, and one finding a page for facts, questions and overlaps."""
    d, t = p.d, p.t
    low = t.lower("text")
    repeatable = d.like(t.lower("data_ui"), f"^({REPEATABLE})$|-({REPEATABLE})$|^({REPEATABLE})-")
    fact = f"page_kind NOT IN {UNCITED} AND bytes >= {FACT_BYTES} AND NOT supporting AND {d.like('text', '[0-9]')} AND NOT (bytes <= {COUNTER_BYTES} AND {d.like(low, COUNTING)}) AND NOT {d.like(low, CITING)}"
    question = f"page_kind NOT IN {UNQUESTIONED} AND bytes < {ANSWER_BYTES} AND ({d.like('text', '[?]$')} OR {d.like(low, f'^({ASKING})( |$)')})"
    opening = t.lower(d.joined(d.first(d.split("text", " "), OPENING_WORDS), " "))
    kept = f"SELECT site, path, {opening} AS k FROM blocks WHERE has_heading AND text <> ''"
    return [
        f"SELECT site, 'GEO003' AS rule_id, 'warning' AS severity, path, concat('duplicate data-ui ''', data_ui, ''' on page') AS message FROM (SELECT site, path, data_ui, row_number() OVER (PARTITION BY site, path, data_ui ORDER BY text) AS nr FROM blocks WHERE data_ui IS NOT NULL AND NOT {repeatable}) z WHERE nr > 1",
        f"SELECT site, 'GEO005' AS rule_id, 'warning' AS severity, path, '<details> is missing a <summary>' AS message FROM ({d.rows('site, path', 'details', 'e1', 'site')}) z WHERE e1 NOT LIKE '%<summary%'",
        f"SELECT site, 'GEO006' AS rule_id, 'warning' AS severity, path, '<pre> is missing nested <code>' AS message FROM ({d.rows('site, path', 'pres', 'e1', 'site')}) z WHERE e1 NOT LIKE '%<code%'",
        f"SELECT DISTINCT site, 'GEO010' AS rule_id, 'warning' AS severity, path, 'page contains factual numeric claims without visible source or citation cues' AS message FROM blocks WHERE {fact}",
        f"SELECT DISTINCT site, 'GEO012' AS rule_id, 'warning' AS severity, path, 'question-like block appears under-explained' AS message FROM blocks WHERE {question}",
        f"SELECT DISTINCT site, 'GEO013' AS rule_id, 'warning' AS severity, path, 'page contains overlapping answer chunks that may reduce retrieval quality' AS message FROM (SELECT site, path, k FROM ({kept}) y GROUP BY site, path, k HAVING count(*) > 1) z",
    ]


def image_rules(p) -> list[tuple[str, str, str, str]]:
    """(rule, severity, condition, message) over images (src, alt, role, hidden)."""
    d, t = p.d, p.t
    gaps = SPACE[:-2] + r"\-_]+"
    stem = d.sub(d.one("src", r"([^/\\]*)$", 1), r"[.][^.]*$", "")
    plain = lambda x: t.lower(d.sub(x, gaps, ""))
    short = f"CASE WHEN {d.octets('src')} > 60 THEN concat(substring(src, 1, 60), '…') ELSE src END"
    return [
        ("CNT003", "warning", "alt IS NULL", "concat('inline image is missing alt text: ', src)"),
        ("A11Y001", "error", "alt IS NULL AND coalesce(hidden, '') <> 'true' AND coalesce(role, '') NOT IN ('presentation', 'none')", f"concat('<img src=\"', {short}, '\"> missing alt attribute')"),
        ("A11Y006", "warning", f"alt <> '' AND {stem} <> '' AND {plain('alt')} = {plain(stem)}", "concat('alt text \"', alt, '\" matches the image filename — likely placeholder text')"),
    ]


def control_findings(p) -> str:
    """A11Y002: links and buttons with no text, no label and no image that has an alt text."""
    d, t = p.d, p.t

    def of(tag: str, kind: str) -> str:
        two, one = 'alt="([^"]*)"', "alt='([^']*)'"
        named = f"CASE WHEN {d.like('m', two)} THEN {t.trim(d.one('m', two, 1))} <> '' ELSE {t.trim(d.one('m', one, 1))} <> '' END"
        inner = d.one("c", f"(?s)^<[^>]*>(.*)</{tag}>$", 1)
        rows = d.rows("site, path", d.all("html", f"(?s)<{tag}(?: [^>]*)?>.*?</{tag}>", 0), "c", "site")
        bare = f"{t.strip_tags('within')} = '' AND {d.size(d.keep(t.tags('within', 'img'), d.fn('m', named)))} = 0 AND NOT {d.like('opened', 'aria-label=|aria-labelledby=|title=')}"
        return f"SELECT site, 'A11Y002' AS rule_id, 'error' AS severity, path, '<{kind}> with no accessible text or label' AS message FROM (SELECT site, path, {d.one('c', '^<[^>]*>', 0)} AS opened, {inner} AS within FROM ({rows}) r) q WHERE {bare}"

    return f"{of('a', 'link')} UNION ALL {of('button', 'button')}"


def id_findings(p) -> str:
    """A11Y003: values of ``id="`` that a page has more than once, scripts and styles apart."""
    rows = p.d.rows("site, path", p.d.all("cleaned", 'id="([^"]*)"', 1), "v", "site")
    return f"SELECT site, 'A11Y003' AS rule_id, 'error' AS severity, path, concat('duplicate id=\"', v, '\" appears ', CAST(count(*) AS STRING), ' times on this page') AS message FROM ({rows}) r WHERE v <> '' GROUP BY site, path, v HAVING count(*) > 1"


def heading_findings(p) -> str:
    """A11Y004: a heading more than one level below the one before it."""
    d = p.d
    was = d.before("levels")
    jump = f"CASE WHEN i > {1 if p.duckdb else 0} AND CAST(x AS INT) > CAST({was} AS INT) + 1 THEN concat('heading jumps from h', {was}, ' to h', x, ' without intermediate level') END"
    found = d.keep(d.indexed("levels", jump), d.fn("y", "y IS NOT NULL"))
    levels = d.all("cleaned", r"<h([1-6])[ >/\n\t]", 1)
    return f"SELECT site, 'A11Y004' AS rule_id, 'warning' AS severity, path, message FROM ({d.rows('site, path', found, 'message', f'(SELECT site, path, {levels} AS levels FROM site) l')}) q"
