"""What operators.facts computes, as SQL of another engine: votes and phrases are exploded rows, terms are looked for in every page of their site."""

from __future__ import annotations

from spanlight.operators import structured
from spanlight.operators.facts import ADDRESS, CEILINGS, CORES, CURATED_DESCRIPTORS, CURATED_FEATURES, CURATED_POINTS, DESCRIPTORS, ERRORS, FORBIDDEN, GENERIC, LEAST_POINTS, LEAST_WEIGHT, MISMATCH, NAME_WEIGHTS, NO_ORGANIZATION, NO_WEBSITE, OBSERVED, OVERLAP, PRODUCT_DESCRIPTORS, PRODUCT_FEATURES, STOPS, TWO_WORDS, UNNAMED, WORD_POINTS
from spanlight.plans.intelligence_sql import low


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def viable(x: str) -> str:
    return f"(trim({x}) <> '' AND len(regexp_extract_all({x}, '[^\\s]+')) <= 6 AND regexp_matches({x}, '\\pL'))"


def generic(x: str) -> str:
    return f"({low(f'trim({x})')} IN ({quoted(GENERIC)}) OR regexp_matches(trim({x}), '^[0-9]+$'))"


def quality(x: str) -> str:
    return f"(CASE WHEN len(regexp_extract_all(trim({x}), '[^\\s]+')) <= 3 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(trim({x}), '^[A-Z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches({x}, '[0-9]') THEN 0 ELSE 2 END + CASE WHEN {generic(x)} THEN 0 ELSE 3 END)"


def meta(p, kind: str, key: str) -> str:
    d, t = p.d, p.t
    found = d.keep(t.tags("s.html", "meta"), d.fn("m", f"coalesce({t.lower(t.attribute('m', kind))}, '') = '{key}' AND coalesce({t.attribute('m', 'content')}, '') <> ''"))
    return t.attribute(d.nth(found, -1), "content")


def points(x: str) -> str:
    words = f"list_distinct(string_split({x}, ' '))"
    each = " ".join(f"+ {n} * len(list_intersect({words}, [{quoted(some)}]))" for some, n in WORD_POINTS)
    return f"(0 {each} + CASE WHEN len({words}) = 2 THEN {TWO_WORDS} ELSE 0 END + CASE WHEN list_has_any({words}, [{quoted(CORES)}]) THEN 2 ELSE 0 END)"


def apart(ranked: str, most: int) -> str:
    """Kept phrases of a list in order."""
    bag = lambda x: f"list_distinct(string_split({x}, ' '))"
    repeats = f"100 * len(list_intersect({bag('k')}, {bag('q[1]')})) >= {OVERLAP} * greatest(len({bag('k')}), len({bag('q[1]')}))"
    step = f"CASE WHEN len(a) < {most} AND len(list_filter(a, lambda k: {repeats})) = 0 THEN list_concat(a, q) ELSE a END"
    return f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({ranked}, lambda x: [x])), lambda a, q: {step})"


def homes() -> str:
    """Pages of which each site's first is its home page and some are feature pages, as the test data has neither; over site."""
    told = "CASE length(s.site) % 3 WHEN 0 THEN 'Open source terminal tools for local coding workflows and open source terminal work' WHEN 1 THEN 'The approval dashboard for developer agents, built to see developer agents run' ELSE 'Analytics and privacy control for your mac' END"
    return f"SELECT s.site, s.path, CASE WHEN s.route = f.first THEN '' WHEN s.page_id % 3 = 0 THEN concat('features/', s.route) ELSE s.route END AS route, s.page_kind, CASE WHEN s.route = f.first AND length(s.site) % 2 = 0 THEN concat('Open Terminal — ', coalesce(s.title, 'Home'), ' | ', s.site) ELSE s.title END AS title, s.h1_texts, CASE WHEN s.route = f.first THEN {told} ELSE s.description END AS description, CASE WHEN s.route = f.first AND length(s.site) % 5 = 0 THEN concat('HTTPS://', upper(s.site), ':8080/x') ELSE s.canonical END AS canonical, s.ld, CASE WHEN s.route = f.first THEN concat('<meta property=\"og:description\" content=\"terminal workflow agents for macos\"><meta name=\"twitter:description\" content=\"free local agents everything, local agents\">', s.html) ELSE s.html END AS html FROM site s JOIN (SELECT site, min(route) AS first FROM site GROUP BY site) f ON s.site = f.site"


def ctes(p) -> str:
    return f"WITH {p.base()}, ld_pages AS MATERIALIZED ({structured.pages(p)}),{body(p)}"


def body(p, home: bool = True) -> str:
    """After site and ld_pages, up to mis and assessed."""
    fields = "SELECT site, path, v.block, v.value FROM (SELECT site, path, unnest(vals) AS v FROM ld_pages) q WHERE v.kind IN ('string', 'item') AND v.key ="
    segments = "SELECT site, path, route, trim(x) AS name, i FROM (SELECT site, path, route, unnest(regexp_split_to_array(title, '[|—·-]')) AS x, generate_subscripts(regexp_split_to_array(title, '[|—·-]'), 1) AS i FROM pf) q"
    (th, ta), (hh, ha), (sh, sa) = (NAME_WEIGHTS[k] for k in ("title", "h1", "schema"))
    vote = lambda home, away: f"CASE WHEN route = '' THEN {home} ELSE 0 END AS home, CASE WHEN route = '' THEN {home} ELSE {away} END AS votes"
    wrong = " OR ".join(f"contains({low('x')}, {quoted([e])})" for e in ERRORS)
    words = f"list_filter(string_split(regexp_replace({low('said')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    sources = " UNION ALL ".join(f"SELECT site, {c} AS said, {n} AS n FROM pf WHERE route = ''" for c, n in (("description", 4), ("og_description", 3), ("twitter_description", 2), ("h1_texts[1]", 2), ("title", 1)))
    runs = " UNION ALL ".join(f"SELECT site, brand, n, w[i:i + {k - 1}] AS run FROM (SELECT *, unnest(range(1, len(w) - {k - 2})) AS i FROM f_told) t{k}" for k in (2, 3))
    rows = lambda kind, c: f"SELECT site, '{kind}' AS kind, {c} AS term, CAST(NULL AS VARCHAR) AS preferred, 0 AS position FROM manifest WHERE {c} IS NOT NULL"
    many = lambda kind, c: f"SELECT site, '{kind}', unnest({c}), NULL, unnest(range(len({c}))) FROM manifest"
    return f"""
      pf AS MATERIALIZED (SELECT s.site, s.path, s.route, s.page_kind, s.title, s.h1_texts, s.description, s.canonical, len(s.ld) AS blocks, s.html, {meta(p, 'property', 'og:title')} AS og_title, {meta(p, 'property', 'og:description')} AS og_description, {meta(p, 'name', 'twitter:description')} AS twitter_description,
        len(list_filter(list_prepend(s.title, s.h1_texts), lambda x: {wrong})) > 0 AS error FROM ({homes() if home else 'SELECT * FROM site'}) s),
      f_name AS MATERIALIZED ({fields} 'name'), f_url AS MATERIALIZED ({fields} 'url'), f_type AS MATERIALIZED ({fields} '@type'),
      named AS (SELECT site, route, name, {vote(th, ta)} FROM ({segments}) a WHERE {viable('name')} AND NOT {generic('name')} AND path NOT IN (SELECT path FROM pf e WHERE e.error AND e.site = a.site)
        UNION ALL SELECT site, route, name, {vote(hh, ha)} FROM (SELECT site, route, unnest(h1_texts) AS name FROM pf WHERE NOT error) b WHERE {viable('name')} AND NOT {generic('name')}
        UNION ALL SELECT p.site, p.route, f.value, {vote(sh, sa)} FROM pf p JOIN f_name f ON p.site = f.site AND p.path = f.path WHERE NOT error AND {viable('f.value')} AND NOT {generic('f.value')}),
      ballots AS (SELECT site, name, sum(home) AS home, sum(votes) AS votes, {quality('name')} AS q FROM named GROUP BY site, name),
      at_home AS (SELECT site, name, row_number() OVER (PARTITION BY site ORDER BY home DESC, q, votes, name DESC) AS nr FROM ballots WHERE home > 0),
      anywhere AS (SELECT site, name, row_number() OVER (PARTITION BY site ORDER BY votes DESC, q, strlen(name), name DESC) AS nr FROM ballots),
      orgs AS (SELECT w.site, coalesce(h.name, w.name) AS organization FROM anywhere w LEFT JOIN at_home h ON w.site = h.site AND h.nr = 1 WHERE w.nr = 1),
      roots AS (SELECT site, CASE WHEN regexp_extract(url, '{ADDRESS}', 2) <> '' THEN concat(lower(regexp_extract(url, '{ADDRESS}', 1)), '://', lower(regexp_extract(url, '{ADDRESS}', 2))) ELSE url END AS website, n
        FROM (SELECT site, value AS url, 3 AS n FROM f_url UNION ALL SELECT site, canonical, 5 FROM pf WHERE route = '' AND canonical IS NOT NULL) q WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:')),
      webs AS (SELECT site, arg_max(website, (n, website)) AS website FROM (SELECT site, website, sum(n) AS n FROM roots GROUP BY ALL) q GROUP BY site),
      cats AS (SELECT site, CASE WHEN bool_or(value = 'SoftwareApplication') THEN 'software_application' WHEN bool_or(value = 'Product') THEN 'product' WHEN bool_or(value IN ('WebSite', 'Organization')) THEN 'website' END AS category FROM f_type GROUP BY site),
      sold AS (SELECT site, name, row_number() OVER (PARTITION BY site ORDER BY n DESC, {quality('name')}, strlen(name), name DESC) AS nr FROM (SELECT f.site, f.value AS name, count(*) AS n FROM f_name f JOIN pf p ON p.site = f.site AND p.path = f.path
        WHERE NOT p.error AND {viable('f.value')} AND NOT {generic('f.value')} AND EXISTS (SELECT 1 FROM f_type t WHERE t.site = f.site AND t.path = f.path AND t.block = f.block AND t.value IN ('SoftwareApplication', 'Product')) GROUP BY ALL) q),
      leads AS (SELECT site, path, route, arg_min(name, i) AS lead FROM ({segments}) q WHERE {viable('name')} GROUP BY ALL),
      feats AS (SELECT site, list(feature ORDER BY feature)[1:{PRODUCT_FEATURES}] AS features FROM (SELECT DISTINCT p.site, coalesce(p.h1_texts[1], l.lead) AS feature FROM pf p LEFT JOIN leads l ON p.site = l.site AND p.path = l.path WHERE starts_with(p.route, 'features/')) q WHERE feature IS NOT NULL GROUP BY site),
      f_told AS (SELECT q.site, q.n, list_filter(string_split(regexp_replace({low("coalesce(o.organization, '')")}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS brand, {words} AS w FROM ({sources}) q LEFT JOIN orgs o ON q.site = o.site WHERE said IS NOT NULL),
      mined AS (SELECT site, array_to_string(run, ' ') AS phrase, sum(n) AS n FROM ({runs}) q WHERE NOT list_has_any(run, [{quoted(STOPS)}]) AND NOT list_has_any(run, brand) AND NOT regexp_matches(array_to_string(run, ' '), '[0-9]') AND length(run[1]) >= 4 AND length(run[-1]) >= 4 AND length(array_to_string(run, ' ')) >= 8 GROUP BY ALL),
      phrased AS (SELECT site, list(phrase ORDER BY s DESC, n DESC, len(string_split(phrase, ' ')), phrase) AS ranked FROM (SELECT *, {points('phrase')} AS s FROM mined) q WHERE s >= {LEAST_POINTS} AND n >= {LEAST_WEIGHT} GROUP BY site),
      descs AS (SELECT site, {apart('ranked', DESCRIPTORS)} AS descriptors FROM phrased),
      other AS (SELECT site, list_sort(list(DISTINCT name)) AS aliases FROM (SELECT site, lead AS name FROM leads WHERE route = '' AND NOT {generic('lead')} UNION ALL SELECT site, name FROM (SELECT site, unnest(h1_texts) AS name FROM pf WHERE route = '') q WHERE {viable('name')} AND NOT {generic('name')}) z GROUP BY site),
      manifest AS MATERIALIZED (SELECT s.site, organization, CASE WHEN organization IS NULL THEN [] ELSE coalesce(aliases, []) END AS aliases, website, category, CASE WHEN organization IS NULL THEN [] ELSE coalesce(descriptors, []) END AS descriptors, coalesce(d.name, organization) AS product, d.name IS NOT NULL AS product_found,
        CASE WHEN coalesce(d.name, organization) IS NULL THEN [] ELSE coalesce(descriptors, [])[1:{PRODUCT_DESCRIPTORS}] END AS product_descriptors, CASE WHEN coalesce(d.name, organization) IS NULL THEN [] ELSE coalesce(features, []) END AS features
        FROM (SELECT DISTINCT site FROM pf) s LEFT JOIN orgs USING (site) LEFT JOIN other USING (site) LEFT JOIN webs USING (site) LEFT JOIN cats USING (site) LEFT JOIN descs USING (site) LEFT JOIN sold d ON s.site = d.site AND d.nr = 1 LEFT JOIN feats USING (site)),
      facts AS MATERIALIZED ({rows('organization', 'organization')} UNION ALL {many('alias', 'aliases')} UNION ALL {rows('website', 'website')} UNION ALL {rows('product', 'product')} UNION ALL {many('descriptor', 'descriptors')} UNION ALL {added()}),
      surfaces AS MATERIALIZED (SELECT site, path, route, {low("concat_ws(' ', coalesce(title, ''), array_to_string(h1_texts, ' '), coalesce(og_title, ''), html)")} AS text FROM pf),
      hits AS MATERIALIZED (SELECT s.site, s.path, s.route, f.kind, f.term, f.preferred FROM surfaces s JOIN facts f ON s.site = f.site AND contains(s.text, {low("CASE WHEN f.kind = 'preferred' THEN f.preferred ELSE f.term END")})),
      who AS (SELECT site, 0 AS o, term AS name, low_ AS names FROM (SELECT site, term, [{low('term')}] AS low_ FROM facts WHERE kind = 'product') q
        UNION ALL SELECT g.site, 1, g.term, list_distinct(list_concat([{low('g.term')}], coalesce(a.names, []))) FROM facts g LEFT JOIN (SELECT site, list({low('term')}) AS names FROM facts WHERE kind = 'alias' GROUP BY site) a ON g.site = a.site WHERE g.kind = 'organization'),
      f_met AS (SELECT p.site, p.path, p.route, p.title, p.og_title, p.description, p.h1_texts, arg_min(w.name, o) AS name, arg_min(w.names, o) AS names FROM pf p JOIN surfaces s ON p.site = s.site AND p.path = s.path JOIN who w ON p.site = w.site AND len(list_filter(w.names, lambda n: contains(s.text, n))) > 0
        WHERE p.title IS NOT NULL AND p.route <> '' AND p.page_kind NOT IN ({quoted(UNNAMED)}) GROUP BY ALL),
      declares AS (SELECT site FROM pf GROUP BY site HAVING max(blocks) > 0),
      schema AS (SELECT DISTINCT site, 'name' AS what, value FROM f_name UNION SELECT DISTINCT site, 'url', value FROM f_url),
      shown AS (SELECT site, what, concat(array_to_string(list(value ORDER BY value)[1:{OBSERVED}], ', '), CASE WHEN count(*) > {OBSERVED} THEN concat(' and ', count(*) - {OBSERVED}, ' more') ELSE '' END) AS observed FROM schema GROUP BY ALL),
      mis AS MATERIALIZED (SELECT site, route, 'terminology' AS field, coalesce(preferred, '') AS expected, term AS observed, 'visible_text' AS source, 'warning' AS severity FROM hits WHERE kind = 'forbidden'
        UNION ALL SELECT m.site, m.route, 'title', m.name, m.title, 'manifest', 'warning' FROM f_met m WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(m.names) AS n) k, (SELECT unnest(list_concat([m.title, m.og_title, m.description], m.h1_texts, coalesce((SELECT list(value) FROM f_name f WHERE f.site = m.site AND f.path = m.path), []))) AS said) z WHERE contains({low('said')}, n))
        UNION ALL SELECT w.site, '(sitewide)', 'organization_schema.name', w.name, coalesce(x.observed, ''), 'schema', 'error' FROM who w JOIN declares USING (site) LEFT JOIN shown x ON w.site = x.site AND x.what = 'name' WHERE w.o = 1 AND NOT EXISTS (SELECT 1 FROM schema c WHERE c.site = w.site AND c.what = 'name' AND len(list_filter(w.names, lambda n: contains({low('c.value')}, n))) > 0)
        UNION ALL SELECT f.site, '(sitewide)', 'organization_schema.url', f.term, coalesce(x.observed, ''), 'schema', 'warning' FROM facts f JOIN declares USING (site) LEFT JOIN shown x ON f.site = x.site AND x.what = 'url' WHERE f.kind = 'website' AND EXISTS (SELECT 1 FROM who w WHERE w.site = f.site AND w.o = 1) AND NOT EXISTS (SELECT 1 FROM schema c WHERE c.site = f.site AND c.what = 'url' AND c.value = f.term)),
      f_typed AS (SELECT site, value, count(*) AS n FROM (SELECT DISTINCT site, path, block, value FROM f_type) q GROUP BY ALL),
      assessed AS MATERIALIZED (SELECT *, greatest(0, ceiling - least({MISMATCH[1]}, mismatches) * {MISMATCH[0]} - least({FORBIDDEN[1]}, forbidden_hits) * {FORBIDDEN[0]} - CASE WHEN organization_blocks = 0 THEN {NO_ORGANIZATION} ELSE 0 END - CASE WHEN website_blocks = 0 THEN {NO_WEBSITE} ELSE 0 END) AS score FROM (
        SELECT *, CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CEILINGS.items())} END AS ceiling FROM (
        SELECT site, CASE WHEN pages_with_schema > 0 AND given THEN 'schema_and_manifest' WHEN pages_with_schema > 0 THEN 'schema' WHEN given THEN 'manifest' ELSE 'none' END AS source, pages, pages_with_schema,
          coalesce((SELECT n FROM f_typed t WHERE t.site = a.site AND t.value = 'Organization'), 0) AS organization_blocks, coalesce((SELECT n FROM f_typed t WHERE t.site = a.site AND t.value = 'WebSite'), 0) AS website_blocks,
          (SELECT count(*) FROM hits h WHERE h.site = a.site AND h.kind IN ('organization', 'product', 'preferred')) AS preferred_hits, (SELECT count(*) FROM hits h WHERE h.site = a.site AND h.kind = 'forbidden') AS forbidden_hits, (SELECT count(*) FROM mis m WHERE m.site = a.site) AS mismatches
        FROM (SELECT site, count(*) AS pages, count(*) FILTER (WHERE blocks > 0) AS pages_with_schema, EXISTS (SELECT 1 FROM facts f WHERE f.site = pf.site) AS given FROM pf GROUP BY site) a) b) c)"""


def added() -> str:
    """Stand-in terms that a draft never has, alike in both engines."""
    return "SELECT DISTINCT site, 'forbidden' AS kind, 'And ' AS term, 'plus' AS preferred, 0 AS position FROM site WHERE length(site) % 4 = 0 UNION ALL SELECT DISTINCT site, 'forbidden', 'ere', NULL, 0 FROM site WHERE length(site) % 5 = 0 UNION ALL SELECT DISTINCT site, 'forbidden', '/>', 'html', 0 FROM site WHERE length(site) % 7 = 0 UNION ALL SELECT DISTINCT site, 'preferred', 'key', 'In the', 0 FROM site WHERE length(site) % 3 = 0"


def texts(p) -> dict[str, str]:
    head = ctes(p)
    joined = lambda *cs: ", ".join(f"array_to_string({c}, ' | ') AS {c}" for c in cs)
    kept = f"list_sort(list_distinct(list_filter(list_transform(aliases, lambda a: trim(a)), lambda b: b <> '' AND {low('b')} <> {low('trim(organization)')} AND NOT {generic('b')})))"
    strong = lambda c: apart(f"list_filter({c}, lambda s: {points('s')} >= {CURATED_POINTS})", CURATED_DESCRIPTORS)
    lists = ("aliases", "descriptors", "product_descriptors", "features")
    lacks = lambda *pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL), ' | ')"
    has, sells, bad = "organization IS NOT NULL", "product IS NOT NULL", f"coalesce(NOT regexp_matches(website, '{ADDRESS}'), false)"
    errors = lacks(("organization IS NULL AND product IS NULL", "no entity"), (f"{has} AND trim(organization) = ''", "organization.name"), (f"{has} AND {bad}", "organization.website"), (f"{has} AND len(list_filter(aliases, lambda a: trim(a) = '')) > 0", "organization.aliases"), (f"{sells} AND trim(product) = ''", "products[0].name"), (f"{sells} AND {bad}", "products[0].website"), (f"{sells} AND len(list_filter(features, lambda a: trim(a) = '')) > 0", "products[0].features"))
    none = "coalesce(trim(category), '') = ''"
    warnings = lacks(("organization IS NULL", "no organization"), (f"{has} AND {none}", "organization.category"), (f"{has} AND len(descriptors) = 0", "organization.descriptors"), (f"{sells} AND {none}", "products[0].category"), (f"{sells} AND len(product_descriptors) = 0", "products[0].descriptors"))
    return {
        "facts_manifest": f"{head} SELECT site, organization, website, category, product, product_found, {joined(*lists)} FROM manifest",
        "facts_curated": f"{head}, c AS (SELECT site, organization, product, CASE WHEN organization IS NULL THEN aliases ELSE {kept} END AS aliases, {strong('descriptors')} AS descriptors, {strong('product_descriptors')} AS product_descriptors, list_sort(list_distinct(list_filter(list_transform(features, lambda f: trim(f)), lambda g: g <> '')))[1:{CURATED_FEATURES}] AS features FROM manifest) SELECT site, organization, product, {joined(*lists)} FROM c",
        "facts_validation": f"{head} SELECT site, errors = '' AS valid, errors, warnings FROM (SELECT site, {errors} AS errors, {warnings} AS warnings FROM manifest) q",
        "facts_mismatches": f"{head} SELECT * FROM mis",
        "facts_assessment": f"{head} SELECT site, source, score, ceiling, pages, pages_with_schema, organization_blocks, website_blocks, preferred_hits, forbidden_hits, mismatches FROM assessed",
    }
