"""Rules over a site's robots.txt, sitemap.xml and llms.txt.

``artifacts(site, robots_text, sitemap_text, llms_text)`` has a row for each
site; a null text is a file that the site lacks.  The test data has no such
files, so ``relations`` makes stand-ins from the site's name and routes.
Pages carry no response headers, so nothing depends on those.
"""

from __future__ import annotations

#: Crawlers for language models, as robots.txt names them.
AI_BOTS = "gptbot|claude-web|claudebot|chatgpt-user|perplexitybot|google-extended|googleother|ccbot|bytespider|applebot-extended|meta-externalagent|facebookbot|anthropic-ai|cohere-ai|diffbot|amazonbot|youbot"
#: Routes with one of these may be noindex or nofollow.
UTILITY = "search|admin|preview|internal"
#: Lines after a ``user-agent: *`` that are read with it, and disallowed paths among them that are many.
GROUP_LINES, MANY = 5, 3
NL = "\n"


def relations(p) -> str:
    """``artifacts``, from the view ``site_files(site, kind, text)`` or stand-ins, and what is read from it: ``robots_lines``, ``map_facts``, ``map_routes``.

    Of given files the sets are those of operators.sitemaps, in the views site_map_sets and site_map_routes.
    """
    d, t = p.d, p.t
    lines = d.keep(d.each(d.split("robots_text", NL), d.fn("x", t.lower(t.trim(d.sub("x", "#.*", ""))))), d.fn("y", "y <> ''"))
    within = lambda tag: d.each(d.all("sitemap_text", f"(?s)<{tag}>(.*?)</{tag}>", 1), d.fn("x", t.trim("x")))
    low = t.lower("sitemap_text")
    loc = lambda r: f"'<url><loc>https://', site, '/', {r}, '</loc>'"
    if p.files:
        one = lambda kind: f"max(CASE WHEN kind = '{kind}' THEN text END) AS {kind}_text"
        made = f"SELECT s.site, f.robots_text, f.sitemap_text, f.llms_text FROM (SELECT DISTINCT site FROM every WHERE site IS NOT NULL) s LEFT JOIN (SELECT site, {one('robots')}, {one('sitemap')}, {one('llms')} FROM site_files GROUP BY site) f ON s.site = f.site"
    else:
        made = stand_ins(loc)
    is_list = d.like("sitemap_text", "<urlset")
    listed = f"SELECT DISTINCT site, route FROM (SELECT site, {t.urlish('u')} AS route FROM ({d.rows('site', 'locs', 'u', f'(SELECT * FROM map_texts WHERE NOT is_index)')}) r) w WHERE route IS NOT NULL"
    routes, broken = ("SELECT site, route FROM site_map_routes", "SELECT site, broken FROM site_map_sets") if p.files else (listed, f"SELECT site, NOT {d.like('sitemap_text', '<sitemapindex')} AND NOT {is_list} AS broken FROM map_texts WHERE sitemap_text IS NOT NULL")
    return f"""artifacts AS ({made}),
      robots_lines AS (SELECT site, {lines} AS lines FROM artifacts WHERE robots_text IS NOT NULL),
      map_texts AS (SELECT site, sitemap_text, {t.trim(low)} AS low, coalesce({d.like(low, '<sitemapindex')}, FALSE) AS is_index, {within('loc')} AS locs, {within('lastmod')} AS lastmods FROM artifacts),
      map_routes AS ({routes}),
      map_facts AS (SELECT f.site, f.sitemap_text, f.low, f.is_index, f.lastmods, coalesce(b.broken, FALSE) AS broken, coalesce(c.n, 0) AS n_routes FROM map_texts f LEFT JOIN ({broken}) b ON f.site = b.site LEFT JOIN (SELECT site, count(*) AS n FROM map_routes GROUP BY site) c ON f.site = c.site)"""


def stand_ins(loc) -> str:
    """Files for test data that has none, from a site's name and routes."""
    return f"""SELECT site,
          CASE length(site) % 4 WHEN 1 THEN 'User-agent: *{NL}Disallow: / # all{NL}' WHEN 2 THEN 'User-agent: *{NL}Disallow: /a{NL}Disallow: /b{NL}Disallow: /c{NL}Sitemap: /sitemap.xml' WHEN 3 THEN 'User-Agent: GPTBot{NL}Disallow:{NL}Content-Signal: ai-train=no{NL}Sitemap: /sitemap.xml' END AS robots_text,
          CASE length(site) % 7 WHEN 1 THEN ' ' WHEN 2 THEN '<html><body>404</body></html>' WHEN 3 THEN concat('<urlset>', {loc('least')}, '<lastmod>yesterday</lastmod></url></urlset>') WHEN 4 THEN concat('<urlset>', {loc('least')}, '</url>', {loc('most')}, '</url></urlset>') WHEN 5 THEN '<urlset></urlset>' WHEN 6 THEN '<urlset><url>' END AS sitemap_text,
          CASE length(site) % 5 WHEN 1 THEN ' ' WHEN 2 THEN concat('# S{NL}## Pages{NL}- [a](/', least, ')') WHEN 3 THEN '# S{NL}- [b](missing.html){NL}- [c](https://other.example/x)' WHEN 4 THEN '## Pages{NL}[d](/no/such?q)' END AS llms_text
        FROM (SELECT site, min(route) AS least, max(route) AS most FROM every WHERE site IS NOT NULL GROUP BY site) g"""


def union(*selects: tuple[str, str, str, str, str]) -> str:
    """(rule, severity, path, message, rest of the query) as one query."""
    return " UNION ALL ".join(f"SELECT a.site, '{r}' AS rule_id, '{s}' AS severity, {p} AS path, {m} AS message {rest}" for r, s, p, m, rest in selects)


def robots_findings(p) -> str:
    """ROB001-007, 010, 011.  Without a robots.txt only ROB001 holds.  Of the groups for all agents the first that blocks all or much counts."""
    d = p.d
    none = lambda body: f"{d.size(d.keep('lines', d.fn('x', body)))} = 0"
    after = d.following("lines", GROUP_LINES)
    many = d.size(d.keep(after, d.fn("z", d.like("z", "^disallow: /.")))) + f" >= {MANY}"
    block = f"CASE WHEN x = 'user-agent: *' THEN CASE WHEN {d.has(after, chr(39) + 'disallow: /' + chr(39))} THEN 'ROB003' WHEN {many} THEN 'ROB007' END END"
    groups = f"FROM (SELECT site, {d.nth(d.keep(d.indexed('lines', block), d.fn('y', 'y IS NOT NULL')), 1)} AS verdict FROM robots_lines) a WHERE verdict = "
    path, page = "'crawl/robots.txt'", "FROM site a JOIN robots_lines r ON a.site = r.site "
    low, free = p.t.lower("a.robots"), f"NOT {d.like('a.route', UTILITY)}"
    return union(
        ("ROB001", "warning", path, "'missing robots.txt'", "FROM artifacts a WHERE robots_text IS NULL"),
        ("ROB002", "warning", path, "'robots.txt is missing a Sitemap declaration'", f"FROM robots_lines a WHERE {none(d.like('x', '^sitemap:'))}"),
        ("ROB003", "warning", path, "'robots.txt blocks the entire site for user-agent *'", groups + "'ROB003'"),
        ("ROB007", "warning", path, "'robots.txt contains several broad disallow rules that may indicate crawl-budget overblocking'", groups + "'ROB007'"),
        ("ROB010", "warning", path, "'robots.txt has no AI-bot User-agent directives (GPTBot, ClaudeBot, ChatGPT-User, PerplexityBot, …); editors who want a different policy for AI crawlers than for general crawlers must declare it explicitly'", f"FROM robots_lines a WHERE {none(d.like('x', f'^user-agent:.*({AI_BOTS})'))}"),
        ("ROB011", "warning", path, "'robots.txt has no Content-Signal directives; AI training/search/input preferences are not declared'", f"FROM robots_lines a WHERE {none(d.like('x', '^content-signal:'))}"),
        ("ROB004", "warning", "a.path", "'page is listed in sitemap.xml but declares noindex via meta robots'", f"{page} JOIN map_routes m ON a.site = m.site AND a.route = m.route WHERE {low} LIKE '%noindex%'"),
        ("ROB005", "warning", "a.path", "'page declares both canonical and noindex via meta robots'", f"{page} WHERE a.canonical IS NOT NULL AND {low} LIKE '%noindex%' AND {free}"),
        ("ROB006", "warning", "a.path", "'page declares nofollow via robots directive'", f"{page} WHERE {low} LIKE '%nofollow%' AND {free}"),
    )


def sitemap_findings(p) -> str:
    """MAP001-009.  A set with a file that is neither an index nor a list is invalid; of such a one only that is told, and so of one without addresses."""
    d, t = p.d, p.t
    path = "'crawl/sitemap.xml'"
    wrong = "FROM map_facts a WHERE broken AND "
    empty = "FROM map_facts a WHERE NOT broken AND NOT is_index AND "
    good = "NOT a.broken AND a.n_routes > 0"
    html, known = d.like("low", "<html|<!doctype html"), d.like("low", "<urlset|<sitemapindex")
    bad = d.keep("a.lastmods", d.fn("x", f"NOT {d.like('x', '^[0-9]{4}-[0-9]{2}-[0-9]{2}(T|$)')}"))
    return union(
        ("MAP001", "error", path, "'missing sitemap.xml'", empty + "sitemap_text IS NULL"),
        ("MAP003", "error", path, "'sitemap set contains no URLs'", empty + "sitemap_text IS NOT NULL AND n_routes = 0"),
        ("MAP005", "error", path, "'sitemap.xml exists but is empty'", wrong + "low = ''"),
        ("MAP006", "error", path, "'sitemap.xml returned HTML instead of sitemap XML'", wrong + html),
        ("MAP007", "error", path, "'sitemap.xml exists but is not recognizable sitemap XML'", wrong + f"low <> '' AND NOT {html} AND NOT {known}"),
        ("MAP002", "error", path, "'invalid sitemap.xml'", wrong + f"NOT {html} AND {known}"),
        ("MAP008", "warning", path, "'sitemap.xml does not expose <lastmod> values'", f"FROM map_facts a WHERE {good} AND {d.size('a.lastmods')} = 0"),
        ("MAP009", "warning", path, f"concat('sitemap.xml contains invalid <lastmod> values: ', {d.joined(d.first(bad, 3), ', ')})", f"FROM map_facts a WHERE {good} AND {d.size(bad)} > 0"),
        ("MAP004", "error", "s.path", "concat('canonical missing from sitemap: ', s.canonical)", f"FROM map_facts a JOIN (SELECT site, path, canonical, {t.urlish('canonical')} AS target FROM site WHERE relative_path <> '404.html' AND canonical IS NOT NULL) s ON a.site = s.site LEFT JOIN map_routes m ON s.site = m.site AND s.target = m.route WHERE {good} AND s.target IS NOT NULL AND m.route IS NULL"),
    )


def llms_findings(p) -> str:
    """LLM001-005.  A missing or blank llms.txt is all that is told of a site."""
    d, t = p.d, p.t
    path = "'crawl/llms.txt'"
    text = t.trim("a.llms_text")
    titled = lambda name: f"{d.size(d.keep(d.split('a.llms_text', NL), d.fn('x', d.like(t.trim('x'), f'^(## )+ *{name}'))))} > 0"
    pages, features = titled("Pages$"), titled("Feature Pages")
    expected = f"coalesce(f.n, 0) > 0 AND NOT {features}"
    sections = f"CASE WHEN {pages} THEN '## Feature Pages' WHEN {expected} THEN '## Pages, ## Feature Pages' ELSE '## Pages' END"
    routes = "LEFT JOIN (SELECT site, count(*) AS n FROM site WHERE route LIKE 'features/%' GROUP BY site) f ON a.site = f.site"
    linked = d.rows("site", d.all("llms_text", r"\]\(([^)]*)\)", 1), "h", f"(SELECT site, llms_text FROM artifacts WHERE llms_text IS NOT NULL) z")
    local = f"(SELECT site, href, {t.internal('concat(' + chr(39) + '/' + chr(39) + ', ltrim(href, ' + chr(39) + '/' + chr(39) + '))') if p.duckdb else t.internal('concat(' + chr(39) + '/' + chr(39) + ', trim(LEADING ' + chr(39) + '/' + chr(39) + ' FROM href))')} AS target FROM (SELECT site, {t.trim('h')} AS href FROM ({linked}) l) q WHERE href <> '' AND NOT {d.like('href', '^https?://')})"
    return union(
        ("LLM001", "error", path, "'missing llms.txt'", "FROM artifacts a WHERE llms_text IS NULL"),
        ("LLM002", "error", path, "'llms.txt is empty'", f"FROM artifacts a WHERE {text} = ''"),
        ("LLM003", "error", path, f"concat('llms.txt is missing expected page sections: ', {sections})", f"FROM artifacts a {routes} WHERE {text} <> '' AND (NOT {pages} OR {expected})"),
        ("LLM004", "error", path, "concat('llms.txt references missing path: ', a.href)", f"FROM {local} a LEFT JOIN known k ON a.site = k.site AND a.target = k.target WHERE k.target IS NULL"),
        ("LLM005", "warning", path, "concat('llms.txt references noncanonical internal path: ', a.href)", f"FROM {local} a WHERE {d.ends('a.href', chr(39) + '.html' + chr(39))}"),
    )
