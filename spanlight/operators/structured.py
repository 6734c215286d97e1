"""Rules over JSON-LD, for a site of no particular profile.

``ld_pages`` has the pages with ``vals``, the values of their JSON-LD objects
(see functions.json_ld), and ``bads``, the blocks that are no JSON.  Everything
but the comparison between the pages of a site (SCH009) is decided where the
page is.
"""

from __future__ import annotations

from spanlight.functions.json_ld import APP_FIELDS, KEYS, REQUIRED

#: Words that speak for software, and words that speak for documentation.
APP_WORDS = "app|application|software|tool|plugin|sdk|server|framework|library|cli"
DOCS_WORDS = "documentation|docs|guide|reference|tutorial|manual|how to|explained"
EDITORIAL = ("Article", "BlogPosting", "NewsArticle", "TechArticle")
#: A listing of more blocks or internal links than these wants an ItemList.
LISTED_BLOCKS, LISTED_LINKS = 3, 8
#: Rules that are off unless asked for: types and families that every page must have, and breadcrumbs.
REQUIRED_TYPES, REQUIRED_FAMILIES = ("Organization",), ("WebSite",)
COLUMNS = "site, path, route, page_kind, title, h1_texts, description, canonical, html"


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def pages(p) -> str:
    """``ld_pages``, from ``site``."""
    d = p.d
    counts = f"{d.size('details')} AS n_details, {d.size('pres')} AS n_pres, {d.size('blocks')} AS n_blocks"
    if not p.duckdb:
        return f"SELECT {COLUMNS}, {counts}, walked.bads AS bads, walked.vals AS vals FROM (SELECT *, walk_json_ld(ld) AS walked FROM site) w"
    struct = "STRUCT(obj BIGINT, block BIGINT, depth BIGINT, key VARCHAR, kind VARCHAR, value VARCHAR)[]"
    return f"""WITH texts AS (SELECT site, path, unnest(ld) AS j, generate_subscripts(ld, 1) AS nr FROM site),
        tree AS MATERIALIZED (SELECT b.site, b.path, b.nr, t.id, t.parent, t.key, t.type, t.path AS spot, json_extract_string(t.value, '$') AS value FROM (SELECT site, path, nr, CASE WHEN json_valid(j) THEN j ELSE 'null' END AS j FROM texts WHERE j <> '') b, json_tree(b.j) t),
        fields AS (SELECT * FROM tree WHERE key IN ({listed(KEYS)})),
        flat AS (SELECT site, path, nr, parent, spot, key, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'other' END AS kind, CASE WHEN type = 'VARCHAR' THEN value END AS value FROM fields
          UNION ALL SELECT f.site, f.path, f.nr, f.parent, f.spot, f.key, 'item', i.value FROM fields f JOIN tree i ON f.site = i.site AND f.path = i.path AND f.nr = i.nr AND i.parent = f.id WHERE f.type = 'ARRAY' AND i.type = 'VARCHAR'),
        vals AS (SELECT site, path, list(struct_pack(obj := nr * 1000000 + parent, block := nr, depth := CAST(len(regexp_extract_all(spot, '[.\\[]')) AS BIGINT), key := key, kind := kind, value := value)) AS vals FROM flat GROUP BY site, path),
        bads AS (SELECT site, path, list(nr) AS bads FROM texts WHERE j <> '' AND NOT json_valid(j) GROUP BY site, path)
        SELECT {', '.join('s.' + c for c in COLUMNS.split(', '))}, {counts}, coalesce(b.bads, []) AS bads, coalesce(v.vals, CAST([] AS {struct})) AS vals
        FROM site s LEFT JOIN vals v ON s.site = v.site AND s.path = v.path LEFT JOIN bads b ON s.site = b.site AND s.path = b.path"""


class Facts:
    """Columns over ``vals`` in one dialect."""

    def __init__(self, p):
        self.d, self.t = p.d, p.t

    def values(self, *keys: str) -> str:
        d = self.d
        return d.each(d.keep("vals", d.fn("x", f"x.key IN ({listed(keys)}) AND x.kind IN ('string', 'item')")), d.fn("y", "y.value"))

    def any(self, a: str, body: str) -> str:
        return f"{self.d.size(self.d.keep(a, self.d.fn('x', body)))} > 0"

    def typed(self, *types: str) -> str:
        return "(" + " OR ".join(self.d.has("types", f"'{t}'") for t in types) + ")"

    def docs_route(self, route: str = "route") -> str:
        return self.d.like(route, "^docs/|^guide|/docs/|/guide/")

    def intent(self) -> str:
        low = self.t.lower("route")
        title = self.t.lower(self.t.trim("coalesce(title, '')"))
        return f"""CASE WHEN page_kind IN ('home', 'search', 'listing', 'detail', 'docs') THEN page_kind WHEN page_kind <> 'generic' THEN 'utility'
            WHEN {self.d.like(low, '^skills$|^skills/|^category/|/category/')} THEN 'listing' WHEN {self.d.like(low, '^skill/|/skill/')} THEN 'detail'
            WHEN {self.d.like(low, '^docs/|^guide|/docs/')} THEN 'docs' WHEN {title} IN ('search', 'search results') THEN 'search' ELSE 'generic' END"""

    def described(self) -> str:
        return self.t.lower(f"concat(coalesce(title, ''), ' ', coalesce(description, ''), ' ', {self.d.joined('h1_texts', ' ')})")

    def visible(self) -> str:
        """Lower-cased text outside scripts, styles and noscript, which go without leaving a space."""
        s = "html"
        for tag in ("script", "style", "noscript"):
            s = self.d.sub(s, rf"(?s)<{tag}.*?(?:</{tag}>|\z)", "")
        return self.t.lower(self.t.strip_tags(s))

    def aligned(self, ours: str, theirs: str) -> str:
        """Whether some text of ours loosely is one of theirs: one within the other by letters and digits, or by words."""
        d = self.d
        plain = lambda x: d.sub(self.t.lower(x), "[^a-z0-9]+", "")
        words = lambda x: d.keep(d.split(d.sub(self.t.lower(x), "[^a-z0-9]+", " "), " "), d.fn("w", "w <> ''"))
        within = lambda a, b, v: f"{d.size(d.keep(words(a), d.fn(v, f'NOT {d.has(words(b), v)}')))} = 0"
        holds = lambda a, b: f"contains({plain(a)}, {plain(b)})"
        fits = f"{plain('a')} <> '' AND {plain('b')} <> '' AND ({holds('a', 'b')} OR {holds('b', 'a')} OR {within('a', 'b', 'u')} OR {within('b', 'a', 'v')})"
        inner = f"{d.size(d.keep(theirs, d.fn('b', fits)))} > 0"
        return f"{d.size(d.keep(ours, d.fn('a', inner)))} > 0"


def facts(p) -> str:
    """One row a page: ld_pages with the types, names and intent of the page."""
    d, f = p.d, Facts(p)
    app = d.each(d.keep("vals", d.fn("x", "x.key = '@type' AND x.value = 'SoftwareApplication' AND x.depth <= 1")), d.fn("y", "y.obj"))
    visible_titles = f"{'list_concat' if p.duckdb else 'concat'}({'CASE WHEN title IS NULL THEN [] ELSE [title] END' if p.duckdb else 'filter(array(title), z -> z IS NOT NULL)'}, h1_texts)"
    return f"""SELECT *, {f.values('@type')} AS types, {f.values('name', 'headline')} AS names, {f.values('author')} AS authors,
        {d.each(d.keep(f.values('datePublished', 'dateModified'), d.fn('z', d.like('z', '^[0-9]{4}'))), d.fn('w', 'substring(w, 1, 4)'))} AS years,
        {f.intent()} AS intent, {f.described()} AS described, {app} AS apps, {visible_titles} AS shown FROM ld_pages"""


def findings(p, optional: bool = False) -> str:
    """SCH001, 003, 005-007, 009-018; with optional, SCH002, 004 and 008 instead."""
    d, t, f = p.d, p.t, Facts(p)
    typed, like = f.typed, d.like
    known = f"ld_facts AS ({facts(p) if p.duckdb else 'SELECT * FROM parsed_ld_facts'})"
    if optional:
        rows = [
            *(("SCH002", "error", f"NOT {typed(x)}", f"'missing JSON-LD schema type: {x}'") for x in REQUIRED_TYPES),
            *(("SCH008", "warning", f"NOT {typed(x)}", f"'missing configured schema family: {x}'") for x in REQUIRED_FAMILIES),
            ("SCH004", "warning", f"route LIKE '%/%' AND NOT {typed('BreadcrumbList')}", "'nested page is missing BreadcrumbList JSON-LD'"),
        ]
        return f"WITH {known} {p.one_pass('ld_facts', rows)}"
    shaped = f.any("vals", f"x.kind <> 'item' AND x.key IN ({listed(APP_FIELDS)}) AND {d.has('apps', 'x.obj')}")
    software = like("described", APP_WORDS)
    docs_shaped = f"({f.docs_route()} OR {like('described', DOCS_WORDS)} OR n_pres > 0 OR (n_details >= 2 AND n_blocks >= 4))"
    misfit = f"{typed('SoftwareApplication')} AND NOT {software} AND {docs_shaped} AND NOT ({shaped})"
    written = typed("Article", "TechArticle", "HowTo")
    seen = lambda a, body: f"{d.size(a)} > 0 AND NOT ({f.any(a, body)})"
    author = f"{t.trim('x')} <> '' AND contains(shown_text, {t.lower(t.trim('x'))})"
    rows = [
        ("SCH003", "n_details > 0 AND NOT " + typed("FAQPage"), "page uses <details> blocks but has no FAQPage JSON-LD"),
        ("SCH005", f"{d.size('types')} > 0 AND {d.size('shown')} > 0 AND NOT ({f.aligned('names', 'shown')})", "JSON-LD name/headline values do not align with the visible page title or H1"),
        ("SCH010", f"{f.docs_route()} AND NOT {written}", "docs-like page is missing Article, TechArticle, or HowTo schema"),
        ("SCH011", f"intent = 'home' AND {d.size('types')} = 0", "home page appears to be missing sitewide schema context"),
        ("SCH013", f"intent = 'detail' AND {misfit}", "detail page looks like it may be using SoftwareApplication where a richer content schema would fit better"),
        ("SCH013", f"intent = 'detail' AND NOT ({misfit}) AND {d.size('types')} > 0 AND NOT {typed('Product', 'SoftwareApplication', 'Article', 'TechArticle')}", "detail page appears under-described in schema"),
        ("SCH014", f"intent = 'docs' AND {f.docs_route()} AND NOT {written}", "docs-like page does not expose docs-oriented schema"),
        ("SCH015", f"intent = 'search' AND NOT {typed('SearchAction')}", "search page could expose search-specific schema"),
        ("SCH016", "intent = 'utility' AND " + f.any("vals", "x.key = '@type' AND x.kind = 'string' AND x.value = 'Organization' AND x.depth > 0"), "utility pages usually should not repeat Organization schema inline"),
    ]
    editorial = [
        ("SCH017", seen("authors", author), "editorial schema declares an author that is not visible in page content"),
        ("SCH018", seen("years", "contains(shown_text, x)"), "editorial schema declares publish/update dates that are not visible in page content"),
    ]
    told = lambda some: [(r, "warning", c, f"'{m}'") for r, c, m in some]
    links = f"SELECT l.site, l.path, count(*) AS n FROM own_links l WHERE l.target IS NOT NULL GROUP BY l.site, l.path HAVING count(*) > {LISTED_LINKS}"
    objects = d.rows("site, path, route, title, canonical, intent, described, vals", d.keep("vals", d.fn("x", "x.key = '@type' AND x.kind IN ('string', 'item')")), "o", "ld_facts")
    present = d.keep("vals", d.fn("x", "x.obj = o.obj AND x.kind <> 'item'"))
    its = lambda key: d.nth(d.each(d.keep("vals", d.fn("x", f"x.obj = o.obj AND x.kind = 'string' AND x.key = '{key}'")), d.fn("y", "y.value")), 1)
    has_any = lambda keys: "(" + " OR ".join(d.has("every_key", f"'{k}'") for k in keys) + ")"
    array = lambda keys: f"[{listed(keys)}]" if p.duckdb else f"array({listed(keys)})"
    wanted = f"CASE o_type {' '.join(f"WHEN '{k}' THEN {array(v)}" for k, v in REQUIRED.items())} END"
    missing = d.joined(d.keep("wanted", d.fn("x", f"NOT {d.has('full_keys', 'x')}")), ", ")
    enforced = f"""o_depth <= 1 AND CASE WHEN o_type = 'Organization' THEN o_depth = 0 OR {has_any(['url'])}
        WHEN o_type = 'SoftwareApplication' THEN (intent = 'detail' AND NOT {f.docs_route()}) OR {software} OR {has_any(APP_FIELDS[:5])}
        WHEN o_type IN ('Article', 'TechArticle', 'HowTo') THEN intent IN ('docs', 'generic') OR {has_any(['headline', 'step', 'author', 'name'])} ELSE TRUE END"""
    route_of = lambda u: f"coalesce({t.urlish(u)}, trim({u}, '/'))" if p.duckdb else f"coalesce({t.urlish(u)}, trim(BOTH '/' FROM {u}))"
    checked = [
        ("SCH006", "warning", f"{missing} <> ''", f"concat(o_type, ' schema is missing required fields: ', {missing})"),
        ("SCH007", "warning", f"o_url IS NOT NULL AND canonical IS NOT NULL AND {route_of('o_url')} <> {route_of('canonical')}", "concat(o_type, ' schema url does not align with canonical')"),
    ]
    return f"""WITH {known},
        ld_objects AS (SELECT site, path, route, title, canonical, intent, described, o.depth AS o_depth, o.value AS o_type, {d.each(present, d.fn('z', 'z.key'))} AS every_key,
          {d.each(d.keep(present, d.fn('v', "v.kind <> 'null'")), d.fn('z', 'z.key'))} AS full_keys, {its('name')} AS o_name, {its('url')} AS o_url FROM ({objects}) r),
        ld_checked AS (SELECT * FROM (SELECT *, {wanted} AS wanted FROM ld_objects) k WHERE wanted IS NOT NULL AND {enforced})
        SELECT site, 'SCH001' AS rule_id, 'error' AS severity, path, 'invalid JSON-LD: invalid JSON payload' AS message FROM ({d.rows('site, path', 'bads', 'bad', 'ld_pages')}) b
        UNION ALL {p.one_pass('ld_facts', told(rows))}
        UNION ALL {p.one_pass(f"(SELECT *, {f.visible()} AS shown_text FROM ld_facts WHERE {typed(*EDITORIAL)}) e", told(editorial))}
        UNION ALL {p.one_pass('ld_checked', checked)}
        UNION ALL SELECT f.site, 'SCH012', 'warning', f.path, 'listing page appears to lack ItemList schema' FROM ld_facts f LEFT JOIN ({links}) l ON f.site = l.site AND f.path = l.path WHERE f.intent = 'listing' AND NOT {typed('ItemList')} AND (f.n_blocks > {LISTED_BLOCKS} OR l.n IS NOT NULL)
        UNION ALL SELECT site, 'SCH009', 'warning', 'crawl/schema-graph', concat('sitewide schema entity graph is inconsistent for ', graph) FROM (
          SELECT site, concat(o_type, '.name') AS graph, {t.trim('o_name')} AS v FROM ld_objects WHERE o_type IN ('Organization', 'WebSite') AND o_name IS NOT NULL
          UNION ALL SELECT site, concat(o_type, '.url'), {t.trim('o_url')} FROM ld_objects WHERE o_type IN ('Organization', 'WebSite') AND o_url IS NOT NULL) g GROUP BY site, graph HAVING count(DISTINCT v) > 1"""
