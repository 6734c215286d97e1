"""What operators.identity computes, as SQL of another engine: signals are exploded rows."""

from __future__ import annotations

from spanlight.operators import structured
from spanlight.operators.identity import AT_ODDS, ENTITIES, LEAST_NAME, TYPES, UNJUDGED
from spanlight.plans.intelligence_sql import listed, low


def normal(x: str) -> str:
    return low(f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))")


def texts(p) -> dict[str, str]:
    words = lambda x: f"list_distinct(string_split({x}, ' '))"
    stripped = lambda x: f"list_reduce(list_prepend({normal(x)}, entities), lambda a, n: {normal("replace(a, n, ' ')")})"
    head = f"""WITH {p.base()}, ld_pages AS MATERIALIZED ({structured.pages(p)}), v AS MATERIALIZED (SELECT site, path, v.* FROM (SELECT site, path, unnest(vals) AS v FROM ld_pages) q),
      outer_ AS (SELECT DISTINCT site, path, block FROM v WHERE depth = 0 AND key = '@type' AND kind IN ('string', 'item') AND value IN ({listed(TYPES)})),
      said AS (SELECT DISTINCT v.site, v.path, v.key, min(v.block) AS block, v.value FROM v JOIN outer_ o ON v.site = o.site AND v.path = o.path AND v.block = o.block WHERE depth = 0 AND kind = 'string' AND key IN ('name', 'headline') GROUP BY ALL),
      signals AS MATERIALIZED (SELECT site, path, route, page_kind, 'title' AS dimension, title AS observed, 0 AS prio FROM site UNION ALL SELECT site, path, route, page_kind, 'h1', h1_texts[1], 1 FROM site UNION ALL SELECT site, path, route, page_kind, 'og_title', og_title, NULL FROM site
        UNION ALL SELECT s.site, s.path, s.route, s.page_kind, CASE key WHEN 'name' THEN 'schema_name' ELSE 'schema_headline' END, d.value, CASE WHEN row_number() OVER (PARTITION BY s.site, s.path, key ORDER BY block, d.value) > 1 THEN NULL WHEN key = 'name' THEN 2 ELSE 3 END FROM site s JOIN said d ON s.site = d.site AND s.path = d.path),
      chosen AS (SELECT site, path, arg_min(observed, prio) AS identity, arg_min(dimension, prio) AS source FROM signals WHERE prio IS NOT NULL AND coalesce({normal('observed')}, '') <> '' GROUP BY site, path),
      drifts AS MATERIALIZED (SELECT g.site, g.path, g.route, g.page_kind, g.dimension, c.identity, g.observed FROM signals g JOIN chosen c ON g.site = c.site AND g.path = c.path WHERE g.observed IS NOT NULL AND {normal('g.observed')} <> {normal('c.identity')} AND NOT (c.source IN ('title', 'h1') AND g.dimension = c.source)),
      about AS (SELECT DISTINCT v.site, v.path, v.obj FROM v WHERE key = '@type' AND kind IN ('string', 'item') AND value IN ({listed(ENTITIES)}) AND (depth = 0 OR depth = 1 AND NOT EXISTS (SELECT 1 FROM v o WHERE o.site = v.site AND o.path = v.path AND o.block = v.block AND o.depth = 0))),
      known AS (SELECT site, path, list(n ORDER BY strlen(n) DESC, n) AS entities FROM (SELECT DISTINCT v.site, v.path, {normal('v.value')} AS n FROM v JOIN about a ON v.site = a.site AND v.path = a.path AND v.obj = a.obj WHERE key = 'name' AND kind = 'string') q WHERE strlen(n) >= {LEAST_NAME} GROUP BY site, path),
      bare AS (SELECT *, {stripped('identity')} AS a, {stripped('observed')} AS b FROM (SELECT d.*, coalesce(k.entities, []) AS entities FROM drifts d LEFT JOIN known k ON d.site = k.site AND d.path = k.path) q)"""
    conflict = f"a <> '' AND b <> '' AND NOT contains(a, b) AND NOT contains(b, a) AND len(list_intersect({words('a')}, {words('b')})) < least(len({words('a')}), len({words('b')}), 2)"
    return {
        "page_identity": f"{head} SELECT s.site, s.route, c.identity, coalesce(c.source, 'none') AS source, (SELECT count(*) FROM drifts d WHERE d.site = s.site AND d.path = s.path) AS n_drift FROM site s LEFT JOIN chosen c ON s.site = c.site AND s.path = c.path",
        "identity_drift": f"{head} SELECT site, route, dimension, identity, observed FROM drifts",
        "rules_identity": f"{head} SELECT DISTINCT site, 'GEO009' AS rule_id, 'warning' AS severity, path, '{AT_ODDS}' AS message FROM bare WHERE page_kind NOT IN ({listed(UNJUDGED)}) AND {conflict}",
    }
