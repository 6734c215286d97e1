"""Where in a page's source the elements are that findings tell of: lines and columns, counted from 1 in characters.

A page is cut at the elements of a kind.  What lies before an element are the
pieces and elements before it, so its place is a running sum of their lengths,
its line one of their line feeds and its column what follows the furthest line
feed so far: one pass over the source for a kind, and windows over small rows
of one page, not a scan for each finding.  A page without elements has none.

The rules over single elements then run as they are, over pages of one element
whose path carries the place.  Findings that are alike in all but their place
take those places in order.
"""

from __future__ import annotations

from spanlight.operators import elements as element_rules
from spanlight.operators import parse, rules

#: Elements by kind, as the rules over them cut them out.
KINDS = {
    "section": "(?s)<section[^>]*>.*?</section>", "article": "(?s)<article[^>]*>.*?</article>", "details": "(?s)<details[^>]*>.*?</details>", "pre": "(?s)<pre[^>]*>.*?</pre>",
    "image": "<img[^>]*>", "control": "(?s)<a(?: [^>]*)?>.*?</a>", "button": "(?s)<button(?: [^>]*)?>.*?</button>", "link": r"(?s)<a[^>]*href=[\"'][^>]*>.*?</a>",
}
COLUMNS = "page_id, site, path, page_kind, strong_blocks, route, relative_path, place"


def elements(p) -> str:
    """(COLUMNS, kind, nr, text, line, column) of each element of ``site``."""
    d = p.d
    parts = []
    for kind, pattern in KINDS.items():
        cut = p.d.pattern(pattern)
        if p.duckdb:
            rows = f"SELECT {COLUMNS}, '{kind}' AS kind, unnest(range(1, len(pieces) + 1)) AS nr, unnest(pieces) AS piece, unnest(list_concat(found, [CAST(NULL AS VARCHAR)])) AS text FROM (SELECT {COLUMNS}, string_split_regex(html, {cut}) AS pieces, regexp_extract_all(html, {cut}) AS found FROM site) q"
        else:
            rows = f"SELECT {COLUMNS}, '{kind}' AS kind, nr, e.pieces AS piece, e.found AS text FROM (SELECT {COLUMNS}, split(html, {cut}, -1) AS pieces, regexp_extract_all(html, {cut}, 0) AS found FROM site) q LATERAL VIEW posexplode(arrays_zip(pieces, found)) x AS nr, e"
        parts.append(rows)
    feed = "chr(10)"
    feeds = lambda x: f"(length({x}) - length(replace({x}, {feed}, '')))"
    tail = (lambda x: f"length(list_extract(string_split({x}, {feed}), -1))") if p.duckdb else (lambda x: f"length(substring_index({x}, {feed}, -1))")
    both = "concat(piece, coalesce(text, ''))"
    before = "(PARTITION BY site, path, kind ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sized = f"SELECT *, length(piece) AS size, length({both}) AS whole, {feeds('piece')} AS feeds, {feeds(both)} AS all_feeds, {tail('piece')} AS rest, {tail(both)} AS all_rest FROM ({' UNION ALL '.join(parts)}) u"
    summed = f"SELECT *, coalesce(sum(whole) OVER {before}, 0) AS start, coalesce(sum(all_feeds) OVER {before}, 0) AS lines FROM ({sized}) s"
    # The place of the furthest line feed of the rows before.
    last = f"SELECT *, coalesce(max(CASE WHEN all_feeds > 0 THEN start + whole - all_rest END) OVER {before}, 0) AS fed FROM ({summed}) t"
    return f"SELECT {COLUMNS}, kind, nr, text, CAST(1 + lines + feeds AS BIGINT) AS line, CAST(1 + start + size - CASE WHEN feeds > 0 THEN start + size - rest ELSE fed END AS BIGINT) AS col FROM ({last}) v WHERE text IS NOT NULL"


def places(p) -> str:
    """(site, rule_id, path, message, line, col) of the rules over single elements, from ``elements``, ``known`` and ``site``."""
    d, t = p.d, p.t
    empty = "CAST([] AS VARCHAR[])" if p.duckdb else "CAST(array() AS ARRAY<STRING>)"
    one = lambda *kinds: f"CASE WHEN kind IN ({', '.join(repr(k) for k in kinds)}) THEN {'[text]' if p.duckdb else 'array(text)'} ELSE {empty} END"
    spot = "struct_pack(path := path, line := line, col := col)" if p.duckdb else "named_struct('path', path, 'line', line, 'col', col)"
    images = d.keep(one("image"), d.fn("i", f"{t.attribute('i', 'src')} IS NOT NULL"))
    single = f"SELECT page_id, site, {spot} AS path, page_kind, strong_blocks, route, relative_path, place, kind, text AS html, {one('section', 'article')} AS blocks, {one('details')} AS details, {one('pre')} AS pres, {images} AS images FROM elements"
    # The rules read the relation site, which within them is the elements of a kind.
    over = lambda rule, *kinds: f"SELECT site, rule_id, path, message FROM (WITH site AS (SELECT * FROM single WHERE kind IN ({', '.join(repr(k) for k in kinds)})), blocks AS ({p.block_rows()}) SELECT * FROM ({rule}) r) q"
    repeated, details, pres, facts, questions, _ = element_rules.block_groups(p)
    repeated = repeated.replace("PARTITION BY site, path, data_ui ORDER BY text", "PARTITION BY site, path.path, data_ui ORDER BY path.line, path.col")
    blocks = " UNION ALL ".join([*(f"SELECT site, '{r}' AS rule_id, '{s}' AS severity, path, {m} AS message FROM blocks WHERE {c}" for r, s, c, m in rules.BLOCK_RULES), repeated, facts, questions])
    broken, weak, _ = p.link_findings().split("UNION ALL")
    links = f"SELECT site, rule_id, path, message FROM (WITH every AS (SELECT * FROM single WHERE kind = 'link'), own_links AS (SELECT * FROM ({parse.links('every', p.duckdb)}) l WHERE place = 1) SELECT * FROM ({broken} UNION ALL {weak}) r) q"
    found = " UNION ALL ".join([over(blocks, "section", "article"), over(details, "details"), over(pres, "pre"), over(p.image_findings(), "image"), over(element_rules.control_findings(p), "control", "button"), links])
    # Of these a page has one finding, at the first element.
    first = "rule_id NOT IN ('GEO010', 'GEO012') OR row_number() OVER (PARTITION BY site, rule_id, path.path ORDER BY path.line, path.col) = 1"
    return f"SELECT site, rule_id, path, message, line, col FROM (SELECT site, rule_id, path.path AS path, message, path.line AS line, path.col AS col, {first} AS told FROM (WITH single AS ({single}) {found}) y) x WHERE told"


def located(p, findings: str = "findings", spots: str = "spots") -> str:
    """The findings with line and col, those that no place is known of at the start."""
    numbered = "row_number() OVER (PARTITION BY site, rule_id, path, message ORDER BY"
    same = " AND ".join(f"f.{c} {'IS NOT DISTINCT FROM' if p.duckdb else '<=>'} s.{c}" for c in ("site", "rule_id", "path", "message", "nr"))
    return f"SELECT f.site, f.rule_id, f.severity, f.path, f.message, coalesce(s.line, 1) AS line, coalesce(s.col, 1) AS col FROM (SELECT *, {numbered} severity) AS nr FROM {findings}) f LEFT JOIN (SELECT *, {numbered} line, col) AS nr FROM {spots}) s ON {same}"
