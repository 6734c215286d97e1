"""Stand-in tables of what test data lacks for operators.surfaces, and what those compute as SQL of another engine, by unions of rows."""

from __future__ import annotations

from spanlight.operators import artifacts, structured
from spanlight.operators.surfaces import AGENT_FILES, API_FILES, API_ROUTE, API_TYPES, BOTS, FACTS, FULL, HOME_MIRRORS, INVALID, KINDS, LARGER, MIRRORS, MISSING, NO_LINK_HEADER, NOINDEX_LISTED, OAUTH, OAUTH_RESOURCE, OAUTH_SERVERS, SKILL_CUES, SKILL_FIELDS, SURFACE_MESSAGES, WELL_KNOWN
from spanlight.plans.intelligence_sql import holds, listed, low

#: A site's files by the remainder of a number made of its name: path and text.
FILES = [
    (0, ".well-known/agent-skills/readme.txt", "x"),
    (1, ".well-known/skills/index.json", '{"$schema": "s", "skills": [{"name": "a", "type": "t", "description": "d", "url": "u", "sha256": "h"}, {"name": "b", "type": "t"}]}'),
    (1, "facts.json", "{}"),
    (2, ".well-known/agent-skills/index.json", '{"skills": []}'),
    (2, ".well-known/mcp/notes.txt", "x"),
    (3, ".well-known/mcp.json", '{"serverInfo": {"name": "n"}}'),
    (3, "llms-full.txt", "x"),
    (4, ".well-known/mcp/server-card.json", '{"serverInfo": {"name": "n", "version": "1"}}'),
    (4, "openapi.json", "{}"),
    (5, ".well-known/api-catalog", '{"linkset": [{"anchor": "a"}, 5]}'),
    (6, ".well-known/api-catalog", '{"linkset": []}'),
    (6, ".well-known/oauth-protected-resource", "{}"),
    (7, ".well-known/mcp/server-cards.json", "[1]"),
    (7, ".well-known/openid-configuration", "{}"),
    (7, ".well-known/http-message-signatures-directory", None),
    (8, ".well-known/mcp.json", "{broken"),
    (8, ".well-known/api-catalog", '{"linkset": [{"anchor": "a"}]}'),
]


def stand_ins() -> dict[str, str]:
    """files, headers and llms, over the relations site and artifacts; alike in both engines."""
    rows = ", ".join(f"({r}, '{path}', {'NULL' if text is None else repr(text)})" for r, path, text in FILES)
    return {
        "files": f"SELECT s.site, f.path, f.text FROM (SELECT DISTINCT site, (length(site) + ascii(site)) % 9 AS r FROM site) s JOIN (VALUES {rows}) AS f(r, path, text) ON s.r = f.r UNION ALL SELECT site, concat(route, '.md'), NULL FROM site WHERE page_id % 4 = 0",
        "headers": "SELECT site, route, 'X-Robots-Tag' AS name, 'NoIndex, nofollow' AS value FROM site WHERE page_id % 3 = 0 UNION ALL SELECT site, route, 'link', '</a>; rel=b' FROM site WHERE page_id % 2 = 0 UNION ALL SELECT site, route, 'WWW-Authenticate', 'Bearer' FROM site WHERE page_id % 7 = 0",
        "llms": "SELECT site, concat(llms_text, CASE WHEN length(site) % 2 = 0 THEN ' ## Skills' ELSE '' END, ' [f](/facts.json) [m](https://x.example/gone.md?a) [c]( llms-full.txt#x ) [r](/robots.txt) [p](/none)') AS text FROM artifacts WHERE llms_text IS NOT NULL",
    }


def known(p, files: str) -> str:
    return f"SELECT site, target FROM ({p.index()}) i UNION SELECT site, path FROM {files}"


def texts(p) -> dict[str, str]:
    d, t = p.d, p.t
    made = stand_ins()
    head = f"""WITH {p.base()}, {artifacts.relations(p)}, ld_pages AS ({structured.pages(p)}), files AS ({made['files']}), headers AS ({made['headers']}), llms AS ({made['llms']}), known AS ({known(p, 'files')}),
      sites AS (SELECT DISTINCT site FROM site), kinds AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(KINDS.items()))}) AS k(nr, kind, ending))"""
    path = low("regexp_extract(href, '^([^#?]*)', 1)")
    kind = f"(SELECT arg_min(kind, nr) FROM kinds WHERE regexp_matches({path}, ending))"
    attribute = lambda name: t.attribute("a", name)
    places = f"CASE WHEN route = '' THEN [{listed(HOME_MIRRORS)}] ELSE [{', '.join(f'''concat(route, '{e}')''' for e in MIRRORS)}] END"
    routes = f"""{head}, surfaced AS (SELECT site, path, bool_or(mirrored) AS mirrored, bool_or(linked) AS linked FROM (
        SELECT site, path, FALSE AS mirrored, FALSE AS linked FROM site
        UNION ALL SELECT site, path, kind = 'markdown', TRUE FROM (SELECT site, path, {kind} AS kind FROM ({p.links()}) l WHERE place = 1) q WHERE kind IS NOT NULL
        UNION ALL SELECT site, path, TRUE, TRUE FROM (SELECT site, path, unnest(alternates) AS a FROM site) q WHERE {low(attribute('type'))} = 'text/markdown' AND {attribute('href')} IS NOT NULL
        UNION ALL SELECT c.site, c.path, TRUE, FALSE FROM (SELECT site, path, unnest({places}) AS target FROM site) c JOIN known k ON c.site = k.site AND c.target = k.target) m GROUP BY site, path)"""
    wide = lambda rule, rest: f"SELECT s.site, '{rule}' AS rule_id, 'warning' AS severity, 'machine-surfaces' AS path, '{SURFACE_MESSAGES[rule]}' AS message FROM sites s WHERE {rest}"
    page = lambda rule, rest: f"SELECT site, '{rule}', 'warning', path, '{SURFACE_MESSAGES[rule]}' FROM surfaced WHERE {rest}"
    has = lambda *paths: f"EXISTS (SELECT 1 FROM known k WHERE k.site = s.site AND k.target IN ({listed(paths)}))"
    local = t.internal("concat('/', ltrim(href, '/'))")
    surfaces = f"""{routes}, named AS (SELECT DISTINCT site, href, CASE WHEN regexp_matches(href, '^https?://') THEN {t.urlish('href')} ELSE {local} END AS target FROM (SELECT site, {t.trim('h')} AS href FROM (SELECT site, unnest(regexp_extract_all(text, '\\]\\(([^)]*)\\)', 1)) AS h FROM llms) a) b WHERE {kind} IS NOT NULL)
      {wide('SRF001', 'NOT ' + has(*FACTS))} UNION ALL {wide('SRF002', 'NOT EXISTS (SELECT 1 FROM surfaced m WHERE m.site IS NOT DISTINCT FROM s.site AND m.mirrored)')}
      UNION ALL {wide('SRF003', f'NOT {has(FULL)} AND (SELECT count(*) FROM surfaced m WHERE m.site IS NOT DISTINCT FROM s.site) >= {LARGER}')}
      UNION ALL {page('SRF004', 'NOT mirrored')} UNION ALL {page('SRF005', 'mirrored AND NOT linked')}
      UNION ALL SELECT n.site, 'SRF006', 'error', 'llms.txt', concat('llms.txt references missing machine-readable artifact: ', n.target) FROM named n LEFT JOIN known k ON n.site = k.site AND n.target = k.target WHERE n.target IS NOT NULL AND k.target IS NULL"""
    mcp, skills = WELL_KNOWN["declares_mcp"], WELL_KNOWN["declares_agent_skills"]
    filed = lambda rest: f"EXISTS (SELECT 1 FROM files f WHERE f.site = s.site AND {rest})"
    signal = lambda name, nr, text, rest: f"SELECT s.site, '{name}' AS capability, {nr} AS nr, '{text}' AS signal FROM sites s WHERE {rest}"
    in_skills = f"f.path LIKE '.well-known/agent-skills/%' OR f.path LIKE '.well-known/skills/%' OR f.path IN ({listed(skills)})"
    declared = f"""{head}, declared AS (SELECT site, capability, string_agg(signal, '; ' ORDER BY nr) AS signals FROM (
        SELECT site, 'declares_api' AS capability, 1 AS nr, concat('indexed routes match `/api/*` (', count(*), ' pages)') AS signal FROM site WHERE regexp_matches(route, '{API_ROUTE}') GROUP BY site
        UNION ALL {signal('declares_api', 2, 'JSON-LD declares APIReference / WebAPI / EntryPoint', f"EXISTS (SELECT 1 FROM (SELECT site, unnest(vals) AS v FROM ld_pages) l WHERE l.site = s.site AND v.key = '@type' AND v.kind IN ('string', 'item') AND v.value IN ({listed(API_TYPES)}))")}
        UNION ALL {signal('declares_api', 3, 'partial well-known API surface present', filed(f'f.path IN ({listed(API_FILES)})'))}
        UNION ALL {signal('declares_mcp', 1, 'canonical MCP card file present', filed(f'f.path IN ({listed(mcp)})'))}
        UNION ALL {signal('declares_mcp', 2, '`.well-known/mcp/` directory exists but no canonical card inside', filed("f.path LIKE '.well-known/mcp/%'") + ' AND NOT ' + filed(f'f.path IN ({listed(mcp)})'))}
        UNION ALL {signal('declares_agent_skills', 1, 'partial `.well-known/agent-skills*` file present', filed(f'({in_skills})'))}
        UNION ALL {signal('declares_agent_skills', 2, 'llms.txt mentions agent skills / skill catalog', f"EXISTS (SELECT 1 FROM llms x WHERE x.site = s.site AND {holds(low('x.text'), SKILL_CUES)})")}
        UNION ALL {signal('declares_oauth', 1, 'at least one route response carries WWW-Authenticate', "EXISTS (SELECT 1 FROM headers h WHERE h.site = s.site AND lower(h.name) = 'www-authenticate')")}
        UNION ALL {signal('declares_oauth', 2, 'partial `.well-known/oauth-*` file present', filed(f'f.path IN ({listed((*OAUTH_SERVERS, OAUTH_RESOURCE))})'))}
        UNION ALL {signal('declares_bot_identity', 1, 'partial `.well-known/http-message-signatures-directory` present', filed(f"f.path = '{BOTS}'"))}) g GROUP BY site, capability)"""

    def items(name: str, fields: tuple[str, ...], word: str) -> str:
        at = f"concat('$.{name}[', i, ']')"
        whens = " ".join(f"WHEN NOT list_contains(json_keys(j, {at}), '{x}') THEN concat('{name}[', i, '] missing required {word}`{x}`')" for x in fields)
        return f"list_filter(list_transform(range(CAST(json_array_length(j, '$.{name}') AS BIGINT)), lambda i: CASE WHEN json_type(j, {at}) <> 'OBJECT' THEN concat('{name}[', i, '] must be an object') {whens} END), lambda x: x IS NOT NULL)[1]"

    is_a = lambda name, what: f"coalesce(json_type(j, '$.{name}'), '') = '{what}'"
    reason = f"""CASE WHEN NOT json_valid(text) THEN 'invalid JSON' WHEN json_type(j) <> 'OBJECT' THEN 'root must be a JSON object'
        WHEN capability = 'declares_agent_skills' THEN CASE WHEN NOT list_contains(json_keys(j), '$schema') THEN 'missing top-level `$schema` field' WHEN NOT {is_a('skills', 'ARRAY')} THEN 'missing `skills` array' ELSE {items('skills', SKILL_FIELDS, 'field ')} END
        WHEN capability = 'declares_mcp' THEN CASE WHEN NOT {is_a('serverInfo', 'OBJECT')} THEN 'missing `serverInfo` object' {' '.join(f"WHEN NOT list_contains(json_keys(j, '$.serverInfo'), '{x}') THEN 'serverInfo missing required field `{x}`'" for x in ('name', 'version'))} END
        ELSE CASE WHEN NOT {is_a('linkset', 'ARRAY')} THEN 'missing `linkset` array' WHEN json_array_length(j, '$.linkset') = 0 THEN '`linkset` array is empty' ELSE {items('linkset', ('anchor',), '')} END END"""
    ranks = ", ".join(f"('{name}', {nr}, '{path}')" for name, paths in WELL_KNOWN.items() for nr, path in enumerate(paths))
    words = ", ".join(f"('{n}', '{WELL_KNOWN[n][0]}', '{MISSING[n][0]}', '{MISSING[n][1]}', '{INVALID[n][0]}', '{INVALID[n][1]}', '{INVALID[n][2]}')" for n in WELL_KNOWN)
    signals = "concat(' (signal: ', signals, ')')"
    oauth = " ".join(f"UNION ALL SELECT s.site, '{rule}', 'warning', 'crawl/{paths[0]}', concat('{text}', {signals}) FROM declared s WHERE capability = 'declares_oauth' AND NOT {filed(f'f.path IN ({listed(paths)})')}" for rule, (paths, text) in OAUTH.items())
    well = f"""{declared}, words AS (SELECT * FROM (VALUES {words}) AS w(capability, first_path, missing, missing_text, wrong, wrong_text, wrong_end)),
      held AS (SELECT site, capability, arg_min(f.path, nr) AS path, arg_min(text, nr) AS text FROM files f JOIN (VALUES {ranks}) AS r(capability, nr, path) ON f.path = r.path WHERE text IS NOT NULL GROUP BY site, capability),
      asked AS (SELECT x.site, x.capability, signals, h.path, text, CASE WHEN json_valid(text) THEN text ELSE '0' END AS j, w.* EXCLUDE (capability) FROM declared x JOIN words w ON x.capability = w.capability LEFT JOIN held h ON x.site = h.site AND x.capability = h.capability)
      SELECT site, missing AS rule_id, 'warning' AS severity, concat('crawl/', first_path) AS path, concat(missing_text, {signals}) AS message FROM asked WHERE path IS NULL
      UNION ALL SELECT site, wrong, 'warning', concat('crawl/', path), concat(wrong_text, path, wrong_end, reason) FROM (SELECT *, {reason} AS reason FROM asked WHERE path IS NOT NULL) q WHERE reason IS NOT NULL {oauth}"""
    agents = " UNION ALL ".join(f"SELECT s.site, '{rule}' AS rule_id, 'warning' AS severity, '.' AS path, '{text.replace(chr(39), chr(39) * 2)}' AS message FROM sites s WHERE NOT {has(path)}" for rule, (path, text) in AGENT_FILES.items())
    noindex = "EXISTS (SELECT 1 FROM headers h WHERE h.site = s.site AND h.route = s.route AND lower(h.name) = 'x-robots-tag' AND contains(lower(h.value), 'noindex'))"
    header = f"""{head}, hidden AS (SELECT s.site, s.route, s.path, {noindex} AS noindex FROM site s)
      SELECT s.site, 'LNK020' AS rule_id, 'warning' AS severity, s.path, '{NO_LINK_HEADER.replace(chr(39), chr(39) * 2)}' AS message FROM site s WHERE s.route = '' AND EXISTS (SELECT 1 FROM headers h WHERE h.site = s.site AND h.route = '') AND NOT EXISTS (SELECT 1 FROM headers h WHERE h.site = s.site AND h.route = '' AND lower(h.name) = 'link')
      UNION ALL SELECT s.site, 'ROB008', 'warning', s.path, '{NOINDEX_LISTED}' FROM hidden s JOIN map_routes m ON s.site = m.site AND s.route = m.route JOIN artifacts a ON s.site = a.site WHERE a.robots_text IS NOT NULL AND s.noindex AND EXISTS (SELECT 1 FROM hidden o WHERE o.site = s.site AND NOT o.noindex)"""
    return {
        "route_surfaces": f"{routes} SELECT site, path, mirrored, linked FROM surfaced",
        "rules_surfaces": surfaces,
        "site_capabilities": f"{declared} SELECT site, capability, signals FROM declared",
        "rules_well_known": well,
        "rules_agents": f"{head} {agents}",
        "rules_headers": header,
    }
