"""Stand-in records and facts for operators.suggestions, and what those compute as SQL of another engine."""

from __future__ import annotations

from spanlight.operators.claims import ABSTRACT, AFTER, BEFORE, CONCRETE, SPECIFIC, TOLD, TRIGGERS, WINDOW, any_word
from spanlight.operators.link_suggestions import BLOCK_BYTES, BLOCK_WORDS, FEW_LINKS, LEAST_POINTS, PREFIX
from spanlight.operators.link_suggestions import TOLD as LINKS_TOLD
from spanlight.operators.rules import THIN
from spanlight.operators.suggestions import BARE, CHILD, HOST, NO_DESCRIPTOR, NO_LABEL, NO_ROUTE, TOP_ROUTES
from spanlight.plans.intelligence_sql import listed, low

#: A page's text with copy that test data lacks.
COPY = "concat(visible, CASE page_id % 7 WHEN 0 THEN ' A shop Needs  growth and needs 3 things' WHEN 1 THEN ' designed for ease. Wants the best speed, of all there is in the whole wide world' WHEN 2 THEN ' looking for our case study on growth; looking for Clarity' WHEN 3 THEN ' user needs speedometers' ELSE '' END)"


def stand_ins() -> dict[str, str]:
    """records and facts, over the relation site; alike in both engines."""
    return {
        "records": "SELECT site, CASE WHEN page_id % 3 = 0 THEN 'review' ELSE 'news' END AS source_type, CASE WHEN page_id % 4 = 0 THEN concat('https://other.example/', route) WHEN page_id % 4 = 1 THEN concat('https://', upper(site), '/', route, '/gone') ELSE concat('https://', site, '/', route, '?a#b') END AS url, title, substr(visible, 1, 200) AS snippet, CASE WHEN page_id % 5 = 0 THEN NULL ELSE concat('Entity ', site) END AS entity FROM site",
        "facts": "SELECT DISTINCT site, 'label' AS kind, concat('ENTITY ', site) AS term, CAST(NULL AS STRING) AS preferred FROM site WHERE length(site) % 2 = 0 UNION ALL SELECT DISTINCT site, 'descriptor', 'The', NULL FROM site UNION ALL SELECT DISTINCT site, 'forbidden', 'And', 'plus' FROM site UNION ALL SELECT DISTINCT site, 'forbidden', 'Page', NULL FROM site WHERE length(site) % 3 = 0",
    }


def sitemap_files() -> str:
    """Stand-in sets of sitemaps over site: an index of indexes and lists, some in a circle, some broken."""
    base = "concat('https://', site, '/"
    page = f"concat('<urlset><url><loc> ', {base}', route, ' </loc></url></urlset>'))"
    return f"""SELECT site, 'sitemap.xml' AS path, CASE WHEN length(site) % 4 = 0 THEN {base}x</loc><urlset><loc>/one</loc>') ELSE concat('<sitemapindex><loc>', {base}maps/a.xml?x</loc><loc>'), {base}sitemap.xml#y</loc><loc>/gone.xml</loc>')) END AS text FROM (SELECT DISTINCT site FROM site) s
      UNION ALL SELECT site, 'a.xml', CASE WHEN length(site) % 5 = 0 THEN '<html></html>' ELSE '<sitemapindex><loc>b0.xml</loc><loc>b1.xml</loc><loc>b2.xml</loc><loc>sitemap.xml</loc></sitemapindex>' END FROM (SELECT DISTINCT site FROM site) s
      UNION ALL SELECT site, CASE nr WHEN 0 THEN 'b0.xml' WHEN 1 THEN 'b1.xml' ELSE 'unlisted.xml' END, {page} FROM (SELECT site, min(route) AS route, page_id % 3 AS nr FROM site GROUP BY site, page_id % 3) g"""


def trust_ctes(p) -> str:
    """Records of other sites, what is wrong with them, and their counts: issues and sources."""
    made = stand_ins()
    about = lambda kind: f"EXISTS (SELECT 1 FROM trust_facts f WHERE f.site = j.site AND kind = '{kind}') AND NOT EXISTS (SELECT 1 FROM trust_facts f WHERE f.site = j.site AND kind = '{kind}' AND contains(j.t, {low('f.term')}))"
    before, after = NO_ROUTE.split("{}")
    return f"""trust_facts AS MATERIALIZED ({made['facts']}), r AS (SELECT *, {low("concat_ws(' ', title, snippet, entity)")} AS t, lower(regexp_extract(url, '{HOST}', 1)) = site AS own, {p.t.urlish('url')} AS target FROM ({made['records']}) q),
      j AS MATERIALIZED (SELECT r.*, EXISTS (SELECT 1 FROM site s WHERE s.site = r.site AND s.route = r.target) AS has FROM r),
      issues AS (SELECT site, source_type, url, target AS route, 'route_not_in_site' AS kind, concat('{before}', coalesce(target, '(unresolved)'), '{after}') AS message FROM j WHERE own AND NOT has
      UNION ALL SELECT site, source_type, url, CASE WHEN own THEN target END, 'missing_canonical_entity', '{NO_LABEL}' FROM j WHERE {about('label')}
      UNION ALL SELECT site, source_type, url, target, 'descriptor_gap', '{NO_DESCRIPTOR}' FROM j WHERE own AND {about('descriptor')}
      UNION ALL SELECT j.site, source_type, url, CASE WHEN own THEN target END, 'forbidden_terminology', concat('record uses forbidden term ''', f.term, ''' instead of preferred ''', coalesce(f.preferred, ''), '''') FROM j JOIN trust_facts f ON f.site = j.site AND f.kind = 'forbidden' AND contains(j.t, {low('f.term')})),
      sources AS (SELECT site, source_type, count(*) AS rows, count(*) FILTER (WHERE own AND has) AS matched_routes, count(*) FILTER (WHERE NOT own) AS offsite FROM j GROUP BY site, source_type)"""


def texts(p) -> dict[str, str]:
    case = lambda c: f"array_to_string(list_transform(list_filter(string_split({c}, '-'), lambda x: x <> ''), lambda x: concat(translate(x[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), x[2:])), ' ')"
    base = "concat('https://', s.site, '/')"
    head = f"WITH {p.base()}, inner_ AS (SELECT * FROM site WHERE route <> '404' AND page_kind NOT IN ({listed(BARE)}, 'home'))"
    level = "SELECT site, route, i, parts[i] AS part, array_to_string(list_filter(parts[1:i], lambda x: x <> ''), '/') AS above FROM (SELECT site, route, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT site, route, string_split(route, '/') AS parts FROM inner_) a) b WHERE parts[i] <> ''"
    child = f"SELECT site, route AS below, title, h1_texts[1] AS h1, regexp_extract(route, '{CHILD}', 1) AS parent, regexp_extract(route, '{CHILD}', 2) AS part FROM site"
    schema = f"""{head}
      SELECT s.site, s.route, 'WebSite' AS type, 0 AS position, coalesce(title, h1_texts[1], concat('https://', s.site)) AS name, {base} AS url, CASE WHEN EXISTS (SELECT 1 FROM site o WHERE o.site = s.site AND o.page_kind = 'search') THEN concat({base}, 'search?q={{search_term_string}}') END AS detail FROM site s WHERE page_kind = 'home' AND route <> '404'
      UNION ALL SELECT s.site, s.route, 'BreadcrumbList', 1, 'Home', {base}, NULL FROM inner_ s
      UNION ALL SELECT s.site, s.route, 'BreadcrumbList', i + 1, coalesce((SELECT title FROM site o WHERE o.site = s.site AND o.route = s.above), {case('s.part')}), concat({base}, s.above), NULL FROM ({level}) s
      UNION ALL SELECT s.site, s.route, 'ItemList', row_number() OVER (PARTITION BY s.site, s.route ORDER BY below), coalesce(c.title, c.h1, {case('c.part')}), concat({base}, below), NULL FROM inner_ s JOIN ({child}) c ON s.site = c.site AND s.route = c.parent WHERE part <> ''
      UNION ALL SELECT s.site, s.route, 'TechArticle', 0, coalesce(title, h1_texts[1], {case('s.route')}), concat({base}, s.route), description FROM inner_ s WHERE page_kind = 'docs'"""
    top = f"WITH {p.base()}, l AS ({p.links()}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY inbound DESC, route) AS place FROM (SELECT s.site, s.route, count(DISTINCT l.relative_path) AS inbound, any_value(s.title) AS title FROM site s LEFT JOIN l ON s.site = l.site AND s.route = l.target AND s.relative_path <> l.relative_path WHERE s.route <> '404' GROUP BY s.site, s.route) a) b WHERE place <= {TOP_ROUTES}"
    trust = f"WITH {p.base()}, {trust_ctes(p)}"
    issues = f"{trust} SELECT * FROM issues"
    sources = f"{trust} SELECT * FROM sources"
    quoted = lambda x: x.replace("'", "''")
    triggers = ", ".join(f"({nr}, '{x}')" for nr, x in enumerate(TRIGGERS))
    told = f"array_to_string(list_filter(regexp_split_to_array(sample, '\\s+'), lambda w: w <> '')[1:{TOLD}], ' ')"
    claims = f"""WITH {p.base()}, c AS (SELECT site, path, {low(COPY)} AS t, string_split(t, trigger) AS parts, nr, trigger FROM site, (VALUES {triggers}) AS v(nr, trigger) WHERE page_kind NOT IN {THIN}),
      w AS (SELECT *, substr(t, 1 + CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS BIGINT) + i * length(trigger), {WINDOW}) AS sample FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM c) q)
      SELECT site, 'CNT006' AS rule_id, 'warning' AS severity, path, concat('{quoted(BEFORE)}', arg_min(concat(trigger, {told}), nr * 1000000 + i), '{quoted(AFTER)}') AS message FROM w
      WHERE regexp_matches(sample, '{any_word(ABSTRACT)}') AND NOT regexp_matches(sample, '{quoted(any_word(CONCRETE))}') AND NOT regexp_matches(sample, '{quoted(SPECIFIC)}') GROUP BY site, path"""
    nested = "regexp_extract(regexp_extract(loc, '^([^?#]*)', 1), '([^/]*)$', 1)"
    maps = f"""WITH RECURSIVE {p.base()}, files AS MATERIALIZED ({sitemap_files()}),
      named AS MATERIALIZED (SELECT site, path, {nested} AS child FROM (SELECT site, path, trim(unnest(regexp_extract_all(text, '<loc>((?s:.*?))</loc>', 1))) AS loc FROM files WHERE contains(text, '<sitemapindex')) q),
      reached AS (SELECT site, path FROM files WHERE path = 'sitemap.xml' UNION SELECT n.site, n.child FROM reached r JOIN named n ON r.site = n.site AND r.path = n.path JOIN files f ON f.site = n.site AND f.path = n.child),
      read AS MATERIALIZED (SELECT f.* FROM (SELECT DISTINCT site, path FROM reached) r JOIN files f ON r.site = f.site AND r.path = f.path),
      sets AS (SELECT site, count(*) AS files_read, bool_or(NOT contains(text, '<sitemapindex') AND NOT contains(text, '<urlset')) AS broken FROM read GROUP BY site),
      found AS (SELECT DISTINCT site, {p.t.urlish('loc')} AS route FROM (SELECT site, trim(unnest(regexp_extract_all(text, '<loc>((?s:.*?))</loc>', 1))) AS loc FROM read WHERE contains(text, '<urlset') AND NOT contains(text, '<sitemapindex')) q)
      SELECT s.site, files_read, broken, CASE WHEN broken THEN NULL ELSE f.route END AS route FROM sets s LEFT JOIN found f ON s.site = f.site AND NOT broken AND f.route IS NOT NULL"""
    said = f"concat_ws(' ', data_ui, CASE WHEN has_heading OR strlen(text) > {BLOCK_BYTES} THEN array_to_string(list_filter(string_split(text, ' '), lambda w: w <> '')[1:{BLOCK_WORDS}], ' ') END)"
    word = lambda x: f"unnest(regexp_extract_all({low(x)}, '[a-z0-9]+'))"
    (few, high), (some, weak) = FEW_LINKS
    suggested = f"""WITH {p.base()}, l AS ({p.links()}), blocks AS ({p.block_rows()}), own AS (SELECT * FROM site WHERE route <> '404'),
      words AS (SELECT site, route, {word("concat_ws(' ', route, title, description, array_to_string(h1_texts, ' '))")} AS w FROM own UNION SELECT s.site, s.route, {word(said)} FROM own s JOIN blocks b ON s.site = b.site AND s.path = b.path),
      bags AS (SELECT o.site, o.route, o.relative_path, list(w) FILTER (WHERE w IS NOT NULL) AS bag FROM own o LEFT JOIN words w ON o.site = w.site AND o.route = w.route GROUP BY ALL),
      inbound AS (SELECT o.site, o.route, count(DISTINCT l.relative_path) AS n FROM own o JOIN l ON o.site = l.site AND o.route = l.target AND o.relative_path <> l.relative_path GROUP BY ALL),
      met AS (SELECT a.site, a.route, b.route AS target, coalesce(len(list_intersect(a.bag, b.bag)), 0) + CASE WHEN split_part(a.route, '/', 1) = split_part(b.route, '/', 1) THEN {PREFIX} ELSE 0 END + CASE WHEN coalesce(i.n, 0) < {few} THEN {high} WHEN i.n < {some} THEN {weak} ELSE 0 END AS score
        FROM bags a JOIN bags b ON a.site = b.site AND a.route <> b.route LEFT JOIN inbound i ON b.site = i.site AND b.route = i.route
        WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.place = 1 AND l.site = a.site AND l.relative_path = a.relative_path AND l.target = b.route))
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, route ORDER BY score DESC, target) AS place FROM met WHERE score >= {LEAST_POINTS}) q WHERE place <= {LINKS_TOLD}"""
    return {"sitemap_sets": maps, "link_suggestions": suggested, "rules_claims": claims, "schema_suggestions": schema, "top_routes": top, "trust_issues": issues, "trust_sources": sources}
