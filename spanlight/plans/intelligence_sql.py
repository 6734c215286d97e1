"""What operators.intelligence computes, as SQL of another engine: by joins and groups of exploded rows, not by expressions over arrays."""

from __future__ import annotations

from spanlight.functions.dialect import LOWER, UPPER
from spanlight.operators import structured
from spanlight.operators.intelligence import ANSWER_WORDS, AUTHORITATIVE, BASELINES, BLOCKERS, COMPARATIVE, FAMILIES, GAPS, HOSTS, HOSTS_AND_BELOW, ISSUE, ISSUES_AT_MOST, LEAST_TRUST, LOST, LOST_AT_MOST, LOW_SIGNAL, MATCHES, MISMATCHES, SEEDS, SEVERAL, SIGNALS, SOME, SUFFIXES, SUPERLATIVE, TEMPORAL, TITLE_CUES, TRUE, TRUST, WEIGHTS, WEIGHTS_WITH_TRUST


def low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def holds(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in needles) + ")"


def pts(n: int, condition: str) -> str:
    return f"CASE WHEN {condition} THEN {n} ELSE 0 END"


def phrase(x: str) -> str:
    return f"trim(regexp_replace({low(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def heads(tag: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(html, '(?s)<{tag}[^>]*>(.*?)</{tag}>', 1), lambda x: {phrase('x')}), lambda y: y <> '')"


def case(column: str, pairs) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in pairs)} ELSE 0 END"


def head(p) -> str:
    return f"WITH {p.base()}, blocks AS MATERIALIZED ({p.block_rows()}), ld_pages AS MATERIALIZED ({structured.pages(p)}), links AS MATERIALIZED ({p.links()})"


def grounding() -> str:
    has = lambda t: f"list_contains(types, '{t}')"
    cue = {k: pts(n, f"{holds('t', needles)} OR {holds('h', needles)}") for k, (n, needles) in TITLE_CUES.items()}
    scores = {
        "definition": f"{cue['definition']} + CASE WHEN {holds('heads', ['what is'])} THEN 4 WHEN {holds('heads', ['overview'])} THEN 2 ELSE 0 END + {pts(2, "page_kind IN ('docs', 'listing')")} + {pts(1, 'answers >= 2')}",
        "procedural": f"{cue['procedural']} + {pts(2, holds('heads', ['how to', 'step', 'setup', 'configure']))} + {pts(2, holds('body', ['step 1', 'step one', 'step-by-step']))} + {pts(2, holds('body', ['<ol']) + ' OR ' + has('HowTo'))}",
        "comparison": f"{pts(5, 'starts_with(r, ' + chr(39) + 'compare/' + chr(39) + ') OR ' + holds('r', ['/vs-', '/vs/']))} + {cue['comparison']} + {pts(2, holds('body', ['<table']))}",
        "pricing": f"{pts(5, holds('r', ['pricing']) + ' OR ends_with(r, ' + chr(39) + '/plans' + chr(39) + ')')} + {cue['pricing']} + {pts(2, holds('heads', ['pricing', 'plans']) + ' OR ' + holds('body', ['$', '€', ' per month', '/month']))}",
        "troubleshooting": f"{pts(5, holds('r', ['troubleshoot', 'error', 'faq']))} + {cue['troubleshooting']} + {pts(2, holds('heads', ['faq', 'troubleshoot']))} + {pts(1, has('FAQPage'))}",
        "asset": f"{cue['asset']} + {pts(3, holds('r', ['template', 'checklist', 'download']))}",
        "feature": f"{pts(5, "page_kind = 'detail' OR starts_with(r, 'features/')")} + {cue['feature']}",
        "reference": f"{pts(4, "page_kind IN ('docs', 'legal')")} + {pts(2, ' OR '.join(map(has, ('HowTo', 'TechArticle', 'Article', 'FAQPage'))))}",
    }
    rows = " UNION ALL ".join(f"SELECT site, path, '{k}' AS family, {FAMILIES.index(k)} AS prio, {s} AS score FROM g2" for k, s in scores.items())
    compared = " + ".join(pts(1, holds("body", [n])) for n in (" versus ", " vs ", "alternative", "compare", "comparison", "<table"))
    wants = lambda k: f"list_contains(intents, '{k}')"
    gaps = {
        "missing_direct_answer": f"{wants('definition')} AND NOT {holds('body', ['what is', 'overview'])}",
        "thin_answer_coverage": "answers < 2",
        "weak_comparison_structure": f"{wants('comparison')} AND NOT {holds('body', ['<table'])} AND {compared} < 3",
        "missing_pricing_signals": f"priced >= 4 AND NOT {holds('body', ['$', '€', 'pricing', 'plans', 'per month', '/month'])}",
        "missing_procedural_signals": f"{wants('procedural')} AND NOT {holds('body', ['step', '<ol', 'how to'])}",
    }
    split = lambda x: f"unnest(regexp_split_to_array({x}, '[|:•—,()-]'))"
    return f"""
      deep AS (SELECT site, path, count(*) AS deep FROM blocks WHERE len(string_split(text, ' ')) >= {ANSWER_WORDS} GROUP BY site, path),
      typed AS (SELECT site, path, list_sort(list(DISTINCT v.value)) AS types FROM (SELECT site, path, unnest(vals) AS v FROM ld_pages) q WHERE v.key = '@type' AND v.kind IN ('string', 'item') AND v.value <> '' GROUP BY site, path),
      g1 AS (SELECT s.site, s.path, s.route, s.page_kind, coalesce(s.title, '') AS title, coalesce(s.h1_texts[1], '') AS h1, {low('s.html')} AS body, {heads('h2')} AS h2s, {heads('h3')} AS h3s, coalesce(d.deep, 0) AS answers, coalesce(t.types, []) AS types
        FROM site s LEFT JOIN deep d ON s.site = d.site AND s.path = d.path LEFT JOIN typed t ON s.site = t.site AND s.path = t.path),
      g2 AS (SELECT *, {low('title')} AS t, {low('h1')} AS h, {low('route')} AS r, concat(array_to_string(h2s, ' '), ' ', array_to_string(h3s, ' ')) AS heads FROM g1),
      m0 AS (SELECT * FROM ({rows}) u WHERE score > 0),
      m AS (SELECT *, row_number() OVER (PARTITION BY site, path ORDER BY score DESC, prio) AS nr, max(score) OVER (PARTITION BY site, path) AS top FROM m0),
      chosen AS (SELECT site, path, list(family ORDER BY score DESC, prio) AS intents FROM m WHERE score >= 4 OR (top = 3 AND nr = 1) GROUP BY site, path),
      price AS (SELECT site, path, score AS priced FROM m0 WHERE family = 'pricing'),
      c0 AS (SELECT site, path, {split('title')} AS x, 5 AS n FROM g2 UNION ALL SELECT site, path, {split('h1')}, 4 FROM g2 UNION ALL SELECT site, path, {split("replace(replace(route, '/', ' '), '-', ' ')")}, 3 FROM g2 UNION ALL SELECT site, path, {split('h')}, 2 FROM (SELECT site, path, unnest(h2s) AS h FROM g2) z),
      c1 AS (SELECT site, path, {phrase('x')} AS topic, n FROM c0),
      c2 AS (SELECT site, path, topic, sum(n) AS n, len(string_split(topic, ' ')) AS w FROM c1 WHERE len(string_split(topic, ' ')) BETWEEN 2 AND 8 AND topic NOT IN ({listed(LOW_SIGNAL)}) GROUP BY site, path, topic),
      topical AS (SELECT site, path, list(topic ORDER BY nr) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY site, path ORDER BY n DESC, w DESC, topic) AS nr FROM c2) k WHERE nr <= 5 GROUP BY site, path),
      g3 AS (SELECT g.*, coalesce(c.intents, ['generic']) AS intents, coalesce(p.priced, 0) AS priced, coalesce(k.topics, []) AS topics FROM g2 g LEFT JOIN chosen c ON g.site = c.site AND g.path = c.path LEFT JOIN price p ON g.site = p.site AND g.path = p.path LEFT JOIN topical k ON g.site = k.site AND g.path = k.path),
      ground AS MATERIALIZED (SELECT site, route, replace(page_kind, '_', '') AS page_kind, coalesce(topics[1], '(unclassified)') AS primary_topic, topics[2:5] AS secondary_topics, intents[1] AS primary_intent, intents,
        list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in gaps.items())}], lambda x: x IS NOT NULL) AS gaps, answers AS answer_blocks, 1 + len(h2s) + len(h3s) AS heading_count, types AS schema_types FROM g3)"""


def evidence() -> str:
    host = "lower(regexp_extract(href, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
    good = " OR ".join([f"{host} IN ({listed(HOSTS_AND_BELOW + HOSTS)})", *(f"ends_with({host}, '.{h}')" for h in HOSTS_AND_BELOW), *(f"ends_with({host}, '{s}')" for s in SUFFIXES)])
    signals = " + ".join([*(pts(n, holds("low_text", needles)) for n, needles in SIGNALS.values()), pts(SOME, "away > 0"), pts(AUTHORITATIVE, "good > 0"), pts(SEVERAL, "away >= 3")])
    plain = "trim(regexp_replace(replace(regexp_replace(html, '<[^>]*(>|\\z)', ' ', 'g'), '>', ' '), '[\\t-\\r\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"
    kinds = {"numeric": "[0-9%]", "comparative": COMPARATIVE, "temporal": TEMPORAL, "superlative": SUPERLATIVE}
    sums = ", ".join(f"sum({k}) AS {k}" for k in kinds)
    return f"""
      away AS (SELECT site, path, count(*) AS away, sum(CASE WHEN {good} THEN 1 ELSE 0 END) AS good FROM links WHERE target IS NULL AND regexp_matches(href, '^https?://') GROUP BY site, path),
      e0 AS (SELECT s.site, s.path, s.route, len(s.blocks) AS n_blocks, coalesce(b.text, {plain}) AS text, coalesce(a.away, 0) AS away, coalesce(a.good, 0) AS good FROM site s LEFT JOIN blocks b ON s.site = b.site AND s.path = b.path LEFT JOIN away a ON s.site = a.site AND s.path = a.path),
      e1 AS (SELECT *, row_number() OVER () AS id, {low('text')} AS low_text FROM e0),
      e2 AS (SELECT id, site, route, n_blocks, low_text, least(100, {signals}) AS quality, len(regexp_extract_all(text, '[^ ]+')) AS words FROM e1),
      said AS (SELECT id, trim(unnest(regexp_split_to_array(low_text, '[.!?\n]'))) AS x FROM e2),
      kinds AS (SELECT id, {', '.join(f"CAST(regexp_matches(x, '{v}') AS INT) AS {k}" for k, v in kinds.items())} FROM said WHERE len(regexp_extract_all(x, '[^ ]+')) >= 5),
      claims AS (SELECT id, count(*) AS n, sum(greatest(comparative, superlative)) AS bold, {sums} FROM kinds WHERE numeric + comparative + temporal + superlative > 0 GROUP BY id),
      e3 AS (SELECT e.site, e.route, e.n_blocks, e.quality, e.words, coalesce(c.n, 0) AS claims, CASE WHEN quality < 60 THEN coalesce(bold, 0) ELSE 0 END AS bad_bold, CASE WHEN quality < 55 THEN coalesce(n, 0) - coalesce(bold, 0) ELSE 0 END AS bad_plain, {', '.join(f'coalesce({k}, 0) AS {k}' for k in kinds)} FROM e2 e LEFT JOIN claims c ON e.id = c.id),
      e4 AS (SELECT *, bad_bold + bad_plain AS unsupported, CASE WHEN claims = 0 THEN 0 ELSE least(100, 18 * (bad_bold + bad_plain) + {pts(12, 'quality = 0')} + {pts(10, 'words > 120')} + {pts(10, 'claims > 3')} + {pts(20, 'bad_bold > 0')}) END AS risk FROM e3),
      e5 AS (SELECT site, route, n_blocks, sum(claims) AS claims, sum(unsupported) AS unsupported, sum(quality) // count(*) AS quality, max(risk) AS risk, {sums} FROM e4 GROUP BY site, route, n_blocks),
      e6 AS (SELECT *, CASE WHEN claims > 0 THEN (claims - unsupported) * 100 // claims WHEN n_blocks = 0 THEN 75 ELSE 90 END AS density FROM e5),
      found AS MATERIALIZED (SELECT site, route, claims, unsupported, quality, risk, {', '.join(kinds)}, density, greatest(0, (density * 65 + quality * 35) // 100 - {pts(10, 'n_blocks < 2')}) AS readiness FROM e6)"""


def scores() -> str:
    step = lambda c, *parts: f"CASE {' '.join(f'WHEN {c} >= {a} THEN {b}' for a, b in reversed(parts))} ELSE 0 END"
    cost = " + ".join(pts(c, f"list_contains(gaps, '{k}')") for k, (_, c) in GAPS.items())
    pack = f"{case('primary_intent', BASELINES.items())} + {step('answer_blocks', (1, 4), (2, 9), (4, 12))} + {step('heading_count', (2, 3), (3, 6), (5, 8))} + {step('len(intents) - 1', (1, 2), (2, 4))} + {pts(4, "page_kind = 'detail' AND answer_blocks >= 2")} - ({cost})"
    return f"""
      packs AS (SELECT site, route, gaps, least(100, greatest(0, {pack})) AS answer_pack FROM ground),
      oddities AS (SELECT site, route, count(*) AS odd FROM mis GROUP BY site, route),
      gravest AS (SELECT site, route, min({case('kind', TRUST.items())}) AS trust FROM issues WHERE route IS NOT NULL GROUP BY site, route),
      valued AS (SELECT p.*, f.unsupported, coalesce(f.readiness, 75) AS readiness, greatest(0, a.score - {LOST} * least({LOST_AT_MOST}, coalesce(o.odd, 0))) AS truth, coalesce(g.trust, 100) AS trust FROM packs p LEFT JOIN found f ON p.site = f.site AND p.route = f.route
        LEFT JOIN assessed a ON p.site = a.site LEFT JOIN oddities o ON p.site = o.site AND p.route = o.route LEFT JOIN gravest g ON p.site = g.site AND p.route = g.route),
      routed AS (SELECT *, list_sort(list_concat(list_filter([CASE WHEN unsupported > 0 THEN concat(unsupported, ' unsupported claims') END, CASE WHEN truth < {TRUE} THEN 'truth_consistency_gap' END], lambda x: x IS NOT NULL), gaps)) AS said, list_sort(list_concat(list_filter([CASE WHEN unsupported > 0 THEN concat(unsupported, ' unsupported claims') END, CASE WHEN truth < {TRUE} THEN 'truth_consistency_gap' END, CASE WHEN trust < 100 THEN 'external_trust_alignment_gap' END], lambda x: x IS NOT NULL), gaps)) AS said_trusted FROM valued)"""


def weighed(weights) -> str:
    return f"({' + '.join(f'{c} * {w}' for c, w in zip(('readiness', 'truth', 'answer_pack', 'trust'), weights) if w)}) // 100 AS overall"


def fanout() -> str:
    topic = lambda x: low(f"regexp_replace(trim({x}), '^[^A-Za-z0-9 ]+|[^A-Za-z0-9 ]+$', '', 'g')")
    long = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: strlen(w) > 2)"
    families = " UNION ALL ".join(f"SELECT '{k}' AS family, '{a}' AS a, '{b}' AS b, '{s}' AS expected_surface, [{listed(i)}] AS wants" for k, (a, b, s, i) in SEEDS.items())
    tokens = f"list_distinct(list_concat(flatten(list_transform(list_concat([primary_topic], secondary_topics), lambda t: {long(topic('t'))})), list_transform(list_filter(regexp_split_to_array(route, '[/_-]'), lambda q: strlen(q) > 2), lambda z: {low('z')})))"
    return f"""
      families AS ({families}),
      routes AS (SELECT site, route, {topic('primary_topic')} AS topic, {tokens} AS tokens, intents, CASE WHEN answer_blocks >= 2 THEN 15 WHEN answer_blocks = 1 THEN 8 ELSE 0 END + {pts(10, 'len(schema_types) > 0')} + {pts(5, 'heading_count >= 3')} AS fixed FROM ground),
      seeds AS (SELECT site, topic, family, concat(a, topic, b) AS query, expected_surface, wants FROM (SELECT DISTINCT site, topic FROM routes WHERE topic <> '') q, families),
      met AS (SELECT s.site, s.topic, s.family, r.route, list_has_any(r.intents, s.wants) AS fits, least(100, CASE WHEN r.topic = s.topic THEN 35 ELSE 10 * least(3, len(list_intersect(list_distinct({long('s.topic')}), r.tokens))) END + {pts(30, 'list_has_any(r.intents, s.wants)')} + r.fixed) AS score FROM seeds s JOIN routes r ON s.site = r.site),
      firsts AS (SELECT *, row_number() OVER (PARTITION BY site, topic, family ORDER BY score DESC, route) AS place FROM met WHERE score > 0),
      told AS (SELECT site, topic, family, string_agg(concat(route, ':', score), ' | ' ORDER BY place) AS routes, max(score) AS best, bool_or(fits AND place = 1) AS fits FROM firsts WHERE place <= {MATCHES} GROUP BY site, topic, family),
      asked AS (SELECT s.site, s.family, s.topic, s.query, s.expected_surface, coalesce(t.best, 0) AS coverage, coalesce(t.routes, '') AS routes, array_to_string(list_filter([CASE WHEN t.best IS NULL THEN concat('no route appears to answer the ''', s.family, ''' fan-out query') END, CASE WHEN t.best < 60 THEN concat('best route score is ', t.best, '; add a stronger ', s.expected_surface, ' surface') END, CASE WHEN NOT t.fits THEN 'matched route shares topic but lacks the expected search intent' END], lambda x: x IS NOT NULL), ' | ') AS gaps FROM seeds s LEFT JOIN told t ON s.site = t.site AND s.topic = t.topic AND s.family = t.family)"""


def texts(p) -> dict[str, str]:
    from spanlight.plans import facts_sql, suggestions_sql

    joined = lambda c: f"array_to_string({c}, ' | ') AS {c}"
    ground, found = f"{head(p)},{grounding()}", f"{head(p)},{evidence()}"
    both = f"{head(p)},{facts_sql.body(p, home=False)},{suggestions_sql.trust_ctes(p)},{grounding()},{evidence()},{scores()}"
    means = lambda *cs: ", ".join(f"sum({c}) // count(*) AS {c}" for c in cs)
    overall, trusted = weighed(WEIGHTS), weighed(WEIGHTS_WITH_TRUST)
    grave = case("message", [(k, s) for k, (s, _) in GAPS.items()])
    placed = lambda rows, order: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {order}) AS place FROM ({rows}) u) w WHERE place <= {BLOCKERS}"
    gravest = f"SELECT site, 'evidence' AS category, route, 80 AS severity, concat(unsupported, ' unsupported claims and fidelity risk ', risk) AS message FROM found WHERE unsupported > 0 UNION ALL SELECT site, 'answer_pack', route, {grave}, message FROM (SELECT site, route, unnest(gaps) AS message FROM ground) g UNION ALL SELECT site, 'truth', route, {case('severity', MISMATCHES.items())}, concat(field, ' expected \'\'', expected, '\'\' but observed \'\'', observed, '\'\'') FROM mis"
    by_trust = f"SELECT site, 'trust', route, {case('kind', TRUST.items())} - 10, message FROM issues"
    first = "severity DESC, category, route NULLS FIRST, message"
    site = f"SELECT q.site, readiness, answer_pack, a.score AS truth, CASE WHEN coalesce(t.rows, 0) = 0 THEN 100 ELSE greatest({LEAST_TRUST}, t.matched * 100 // t.rows - {ISSUE} * least({ISSUES_AT_MOST}, coalesce(i.n, 0))) END AS trust FROM (SELECT site, {means('readiness', 'answer_pack')} FROM routed GROUP BY site) q LEFT JOIN assessed a ON q.site = a.site LEFT JOIN (SELECT site, sum(rows) AS rows, sum(matched_routes) AS matched FROM sources GROUP BY site) t ON q.site = t.site LEFT JOIN (SELECT site, count(*) AS n FROM issues GROUP BY site) i ON q.site = i.site"
    scored = f"SELECT site, route, readiness, truth, answer_pack, {overall}, array_to_string(said, ' | ') AS blockers FROM routed"
    return {
        "grounding_routes": f"{ground} SELECT site, route, page_kind, primary_topic, {joined('secondary_topics')}, primary_intent, {joined('intents')}, {joined('gaps')}, answer_blocks, heading_count, {joined('schema_types')} FROM ground",
        "grounding_intents": f"{ground} SELECT site, intent, count(*) AS pages, sum(CASE WHEN intent = primary_intent THEN 1 ELSE 0 END) AS primary_pages FROM (SELECT site, primary_intent, unnest(intents) AS intent FROM ground) q GROUP BY site, intent",
        "topic_clusters": f"{ground} SELECT site, primary_topic AS topic, count(*) AS routes, min(route) AS first_route FROM ground GROUP BY site, primary_topic",
        "evidence_routes": f"{found} SELECT * FROM found",
        "evidence_sites": f"{found} SELECT site, count(*) AS pages, sum(CASE WHEN claims > 0 THEN 1 ELSE 0 END) AS routes_with_claims, sum(claims) AS claims, sum(unsupported) AS unsupported, {means('density', 'quality', 'readiness', 'risk')}, sum(numeric) AS numeric, sum(comparative) AS comparative, sum(temporal) AS temporal, sum(superlative) AS superlative FROM found GROUP BY site",
        "riskiest_routes": f"{found} {placed('SELECT site, route, risk, unsupported, claims FROM found', 'risk DESC, unsupported DESC, route')}",
        "route_scores": f"{both} {scored}",
        "route_scores_trust": f"{both} SELECT site, route, readiness, truth, answer_pack, trust, {trusted}, array_to_string(said_trusted, ' | ') AS blockers FROM routed",
        "weakest_routes": f"{both}, s AS ({scored}) SELECT * EXCLUDE (n) FROM ({placed('SELECT s.*, len(r.said) AS n FROM s JOIN routed r ON s.site = r.site AND s.route = r.route', 'overall, n DESC, route')}) z",
        "site_scores": f"{both} SELECT site, readiness, truth, answer_pack, {overall} FROM ({site}) q",
        "site_scores_trust": f"{both} SELECT site, readiness, truth, answer_pack, trust, {trusted} FROM ({site}) q",
        "intelligence_blockers": f"{both} {placed(gravest, first)}",
        "intelligence_blockers_trust": f"{both} {placed(f'{gravest} UNION ALL {by_trust}', first)}",
        "least_covered_queries": f"{ground},{fanout()} {placed('SELECT site, family, query, coverage FROM asked', 'coverage, family, query')}",
        "fanout_queries": f"{ground},{fanout()} SELECT * FROM asked",
        "fanout_sites": f"{ground},{fanout()} SELECT site, count(*) AS queries, sum(CASE WHEN coverage >= 60 AND gaps = '' THEN 1 ELSE 0 END) AS covered, sum(CASE WHEN coverage >= 60 AND gaps = '' THEN 1 ELSE 0 END) * 100 // count(*) AS coverage FROM asked GROUP BY site",
    }
