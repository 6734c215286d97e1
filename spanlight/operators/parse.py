"""Raw page snapshots to typed columns, as SQL over a table ``pages(page_id, url, html)``."""

from __future__ import annotations

from spanlight.functions.dialect import DuckDB, Spark, Text

#: Words of a block's data-ui that mark it as supporting: fixed values.
SUPPORTING = "hero showcase cta step proof screenshot banner stat stats metric metrics counter summary callout highlight badge promo overview".split()
#: Least bytes of an answer block.
BLOCK_BYTES = 120


def richer(pages: str = "pages") -> str:
    """Pages with metadata, alternates, sections and images added by page_id, so that every rule has something to find."""
    head = """concat('<head>',
      CASE WHEN page_id % 2 = 1 AND page_id % 3 <> 0 THEN '<title>Same page</title>' ELSE '' END,
      CASE WHEN page_id % 3 <> 0 THEN concat('<meta name="description" content=" About ', CAST(page_id % 2 AS STRING), ' ">') ELSE '' END,
      CASE WHEN page_id % 4 = 1 THEN concat('<link rel="canonical" href="', url, '">') WHEN page_id % 4 = 2 THEN '<link rel=''canonical nofollow'' href=''https://other.example/en/1''>' ELSE '' END,
      CASE WHEN page_id % 2 = 0 THEN '<meta property="og:title" content="T"><meta property="og:type" content="article">' ELSE '<meta property="og:description" content="D"><meta property="og:url" content="https://other.example/x">' END,
      CASE WHEN page_id % 6 = 1 THEN '<meta name="twitter:card" content="Summary">' WHEN page_id % 6 = 2 THEN '<meta name="twitter:card" content="player">' ELSE '' END,
      CASE WHEN page_id % 5 = 1 THEN '<meta name="robots" content="noindex, NoSnippet , max-snippet:0">' WHEN page_id % 5 = 2 THEN '<meta name="robots" content="nofollow,max-snippet:50">' ELSE '' END,
      CASE WHEN page_id % 7 = 3 THEN '<link rel="alternate" hreflang="xx_bad" href="/nowhere"><link rel="alternate" type="text/markdown" href="/no.md">' WHEN page_id % 7 = 5 THEN concat('<link rel="alternate" hreflang="fr" href="', url, '"><meta property="og:image" content="/og.png">') WHEN page_id % 7 = 4 THEN '<link rel="alternate" hreflang="x-default" href="/en/1"><link rel="alternate" hreflang="de-DE" href="/de/2">' ELSE '' END,
      CASE page_id % 9 WHEN 1 THEN '<script type="application/ld+json"> {"@type": "Organization", "name": "Ann"}</script>' WHEN 2 THEN '<script type=''application/LD+JSON''>{"@graph": [{"@type": ["Organization", "WebSite"], "name": " Bob ", "url": "https://b.example/x"}, {"@type": "Product", "name": "Same", "description": null}]}</script>'
        WHEN 3 THEN '<script type="application/ld+json">{"@type": </script><script type="application/ld+json"> </script>' WHEN 4 THEN '<script type="application/ld+json">[{"@type": "Article", "headline": "Same-Page!", "author": "Nobody Known", "datePublished": "1889-01-02"}, {"@type": "SoftwareApplication", "name": "q", "publisher": {"@type": "Organization", "name": "Eve"}}]</script>' ELSE '' END)"""
    body = """concat(
      CASE WHEN page_id % 5 = 0 THEN '<section data-ui="hero"><h2>What is this?</h2>Short.</section>' WHEN page_id % 5 = 1 THEN '<section>No heading here</section><section data-ui="faq"><h3>How to start</h3>Thin.</section><section data-ui="faq"><h3>How to start</h3>Thin.</section>' ELSE '' END,
      CASE WHEN page_id % 4 = 3 THEN '<img src="/a.png"><img src="/b.png" alt=""><img src="/c/hero-banner.jpg" alt="Hero Banner"><img src="/d.png" role="none">' ELSE '' END,
      CASE WHEN page_id % 6 = 4 THEN '<a class="x" href="/en/1"><img src="/a.png"></a><a href="/en/2" title="t"></a><a href="/en/3"><img src="/a.png" alt="A"></a><button> </button><i id="k"></i><i id="k"></i><script>id="k"</script>' ELSE '' END,
      CASE WHEN page_id % 3 = 1 THEN '<main><h4>Deep</h4></main>' ELSE '' END,
      CASE WHEN page_id % 8 = 5 THEN '<div data-nosnippet></div><details>x</details><pre>y</pre>' ELSE '' END, '</body>')"""
    return f"SELECT page_id, url, replace(replace(html, '<head>', {head}), '</body>', {body}) AS html FROM {pages}"


def parsed(pages: str, duckdb: bool = False) -> str:
    """A SELECT of one row for each page, before routes are made unique."""
    d = DuckDB() if duckdb else Spark()
    t = Text(d)
    strings = "VARCHAR" if duckdb else "STRING"
    pages = pages.replace("STRING", strings)
    metas = t.tags("html", "meta")

    def meta(kind: str, key: str) -> str:
        found = d.keep("metas", d.fn("m", f"coalesce({t.lower(t.attribute('m', kind))}, '') = '{key}' AND coalesce({t.attribute('m', 'content')}, '') <> ''"))
        return t.attribute(d.nth(found, -1), "content")

    def data(key: str) -> str:
        return f"coalesce({meta('name', key)}, {meta('property', key)})"

    relation = f"{t.lower('coalesce(' + t.attribute('l', 'rel') + ', ' + chr(39) * 2 + ')')}"
    canonical = t.attribute(d.nth(d.keep(t.tags("html", "link"), d.fn("l", d.like(relation, r"(^|\s)canonical(\s|$)"))), 1), "href")
    alternates = d.keep(t.tags("html", "link"), d.fn("l", f"{d.like(relation, r'(^|\s)alternate(\s|$)')} AND {t.attribute('l', 'href')} IS NOT NULL"))
    address = d.one("url", r"://([^/?#]*)", 1)
    path = d.one("url", r"://[^/?#]*([^?#]*)", 1)
    trimmed = f"trim({path}, '/')" if duckdb else f"trim(BOTH '/' FROM {path})"
    sections, articles = (d.all("html", f"(?s)<{tag}[^>]*>.*?</{tag}>", 0) for tag in ("section", "article"))
    blocks = f"{'list_concat' if duckdb else 'concat'}({sections}, {articles})"
    visible = t.strip_tags("html")
    routes = f"CASE WHEN canonical IS NULL THEN route ELSE coalesce({t.internal('canonical')}, CASE WHEN {d.like('canonical', '^https?://')} THEN {t.urlish('canonical')} END, route) END"
    opening = d.one("x", "^<script[^>]*>", 0)
    scripts = d.keep(d.all("html", "(?s)<script[^>]*>.*?</script>", 0), d.fn("x", f"{t.lower('coalesce(' + t.attribute(opening, 'type') + ', ' + chr(39) * 2 + ')')} = 'application/ld+json'"))
    json_ld = d.each(scripts, d.fn("y", t.trim(d.one("y", "(?s)^<script[^>]*>(.*)</script>$", 1))))
    directives = d.sorted(d.keep(d.each(d.split("robots", ","), d.fn("x", t.lower(t.trim("x")))), d.fn("y", "y <> ''")))
    empty = "[]" if duckdb else "array()"
    own = f"({d.like('b', '<h[1-6]')} AND {d.octets(t.strip_tags('b'))} >= {BLOCK_BYTES})"
    return f"""
      WITH a AS (SELECT page_id, url, html, {t.lower(address)} AS site, {trimmed} AS route, {metas} AS metas,
          {t.texts('html', 'title')} AS titles, {t.texts('html', 'h1')} AS h1_texts, {canonical} AS canonical, {alternates} AS alternates,
          nullif({t.attribute(d.one('html', '<html[^>]*>', 0), 'lang')}, '') AS html_lang, {visible} AS visible,
          {d.count('html', 'data-nosnippet')} AS nosnippets, {blocks} AS blocks,
          {d.all('html', '(?s)<details[^>]*>.*?</details>', 0)} AS details, {d.all('html', '(?s)<pre[^>]*>.*?</pre>', 0)} AS pres,
          {d.keep(t.tags('html', 'img'), d.fn('i', t.attribute('i', 'src') + ' IS NOT NULL'))} AS images,
          {json_ld} AS ld, {t.unscripted('html')} AS cleaned FROM ({pages}) p),
      b AS (SELECT *, CASE WHEN route = '' THEN 'index.html' ELSE concat(route, '/index.html') END AS relative_path,
          {d.nth('titles', 1)} AS title, CAST({d.size('h1_texts')} AS INT) AS h1_count, {meta('name', 'description')} AS description,
          {data('robots')} AS robots, {data('og:title')} AS og_title, {data('og:description')} AS og_description, {data('og:type')} AS og_type,
          {data('og:url')} AS og_url, {data('og:image')} AS og_image, {data('twitter:card')} AS twitter_card, {data('twitter:image')} AS twitter_image FROM a)
      SELECT page_id, url, html, site, route, relative_path, concat('crawl/', relative_path) AS path, {t.page_kind('relative_path', 'route')} AS page_kind,
          title, h1_texts, h1_count, description, canonical, {routes} AS canonical_route, alternates, html_lang, robots,
          CASE WHEN robots IS NULL THEN CAST({empty} AS {'VARCHAR[]' if duckdb else 'ARRAY<STRING>'}) ELSE {directives} END AS directives,
          og_title, og_description, og_type, og_url, og_image, twitter_card, twitter_image, visible, CAST({d.octets('visible')} AS INT) AS visible_bytes,
          CAST(nosnippets AS INT) AS nosnippets, blocks, images, details, pres, ld, cleaned, {t.lower('cleaned')} AS markup,
          CAST({d.size('details')} + {d.size('pres')} + {d.size(d.keep('blocks', d.fn('b', own)))} AS INT) AS answer_blocks,
          CAST({d.size(d.keep('blocks', d.fn('b', f"{d.like('b', '<h[1-6]')} AND {d.octets(t.strip_tags('b'))} >= {BLOCK_BYTES} AND NOT {d.like('coalesce(' + t.lower(t.attribute(d.one('b', '^<[^>]*>', 0), 'data-ui')) + ', ' + chr(39) * 2 + ')', '|'.join(SUPPORTING))}")))} AS INT) AS strong_blocks
      FROM b"""


def links(parsed_table: str, duckdb: bool = False) -> str:
    """A SELECT of (page_id, site, route, relative_path, path, place, href, target, text) for each ``<a`` with an href of ranked pages."""
    d = DuckDB() if duckdb else Spark()
    t = Text(d)
    found = d.all("html", r"(?s)<a[^>]*href=[\"'][^>]*>.*?</a>", 0)
    rows = d.rows("page_id, site, route, relative_path, path, place", found, "a", parsed_table)
    opened = d.one("a", r"^(<a[^>]*>)", 1)
    inner = d.one("a", r"(?s)^<a[^>]*>(.*)</a>$", 1)
    return f"SELECT page_id, site, route, relative_path, path, place, href, {t.internal('href')} AS target, text FROM (SELECT page_id, site, route, relative_path, path, place, {t.attribute(opened, 'href')} AS href, {t.strip_tags(inner)} AS text FROM ({rows}) r) q WHERE href IS NOT NULL"


def ranked(parsed_table: str) -> str:
    """Pages with their place among those of one (site, route), of which place 1 stands for all: a clean path first, then the shorter, then the first."""
    clean = "CASE WHEN relative_path LIKE '%index.html' THEN 0 ELSE 1 END"
    return f"SELECT *, row_number() OVER (PARTITION BY site, route ORDER BY {clean}, length(relative_path), page_id) AS place FROM {parsed_table}"
