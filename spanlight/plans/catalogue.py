"""The catalogue: each query is one SQL text, rendered for Spark and for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlight.functions.dialect import DuckDB, Spark, Text
from spanlight.functions import json_ld
from spanlight.operators import artifacts, claims, elements, facts, identity, intelligence, link_suggestions, parse, positions, reports, rules, sitemaps, structured, submissions, suggestions, surfaces
from spanlight.plans import facts_sql, identity_sql, intelligence_sql, suggestions_sql, surfaces_sql
from spanlight.sources.kept import folder, fresh_folder, kept
from spanlight.streaming import crawl

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Plan:
    """The audit's relations in one dialect, as common table expressions."""

    def __init__(self, duckdb: bool, files: bool = False):
        """With ``files``, a site's files are those of the view site_files, else stand-ins."""
        self.duckdb, self.files = duckdb, files
        self.d = DuckDB() if duckdb else Spark()
        self.t = Text(self.d)

    def sql(self, text: str) -> str:
        return text.replace("AS STRING)", "AS VARCHAR)") if self.duckdb else text

    def base(self, rich: bool = True) -> str:
        if not self.duckdb:
            return f"every AS (SELECT * FROM {'parsed_rich' if rich else 'parsed_raw'}), site AS (SELECT * FROM every WHERE place = 1)"
        pages = parse.richer() if rich else "SELECT page_id, url, html FROM pages"
        return f"parsed_pages AS ({parse.parsed(pages, self.duckdb)}), every AS ({parse.ranked('parsed_pages')}), site AS (SELECT * FROM every WHERE place = 1)"

    def page_findings(self, chosen=rules.PAGE_RULES) -> str:
        """All page-local rules in one pass: an array of findings for each page, exploded."""
        d = self.d
        snippet = d.nth(d.keep("directives", d.fn("x", d.like("x", "^max-snippet: *(-[0-9]+|0+)$"))), 1)
        facts = f"SELECT *, {d.has('directives', chr(39) + 'nosnippet' + chr(39))} AS has_nosnippet, {snippet} AS max_snippet FROM site"
        if self.duckdb:
            return f"WITH facts AS ({facts}) {self.one_pass('facts', chosen)}"
        return self.one_pass(f"({facts}) q", chosen)

    def one_pass(self, source: str, chosen) -> str:
        """Findings of all (rule, severity, condition, message) over a relation with site and path, read once."""
        if self.duckdb:
            return " UNION ALL ".join(f"SELECT site, '{r}' AS rule_id, '{s}' AS severity, path, {m} AS message FROM {source} WHERE {c}" for r, s, c, m in chosen)
        each = ", ".join(f"CASE WHEN {c} THEN named_struct('rule_id', '{r}', 'severity', '{s}', 'message', {m}) END" for r, s, c, m in chosen)
        return f"SELECT site, f.rule_id, f.severity, path, f.message FROM (SELECT site, path, explode(filter(array({each}), x -> x IS NOT NULL)) AS f FROM {source}) r"

    def block_rows(self) -> str:
        t, d = self.t, self.d
        rows = "SELECT site, path, page_kind, strong_blocks, unnest(blocks) AS b FROM site" if self.duckdb else "SELECT site, path, page_kind, strong_blocks, b FROM site LATERAL VIEW explode(blocks) e AS b"
        ui = t.attribute(d.one("b", "^<[^>]*>", 0), "data-ui")
        inner = d.one("b", "(?s)^<[^>]*>(.*)</(?:section|article)>$", 1)
        return f"""SELECT *, {d.octets('text')} AS bytes, {d.like('coalesce(' + t.lower('data_ui') + ', ' + chr(39) * 2 + ')', '|'.join(parse.SUPPORTING))} AS supporting FROM (
            SELECT site, path, page_kind, strong_blocks, {d.one('b', '^<(section|article)', 1)} AS tag, {ui} AS data_ui, {d.like('b', '<h[1-6]')} AS has_heading, {t.strip_tags(inner)} AS text FROM ({rows}) r) q"""

    def block_findings(self) -> str:
        return " UNION ALL ".join([*(f"SELECT site, '{r}' AS rule_id, '{s}' AS severity, path, {m} AS message FROM blocks WHERE {c}" for r, s, c, m in rules.BLOCK_RULES), *elements.block_groups(self)])

    def index(self) -> str:
        return "SELECT DISTINCT site, target FROM (SELECT site, route AS target FROM every UNION ALL SELECT site, relative_path FROM every UNION ALL SELECT site, concat(route, '/') FROM every UNION ALL SELECT site, 'robots.txt' FROM every UNION ALL SELECT site, 'llms.txt' FROM every UNION ALL SELECT site, 'sitemap.xml' FROM every) i"

    def link_findings(self) -> str:
        d = self.d
        last = d.one("l.target", "([^/]*)$", 1)
        checked = f"NOT {d.starts('l.target', chr(39) + 'cdn-cgi/' + chr(39))} AND (NOT {d.like(last, '^.+[.][^.]*$')} OR lower({d.one(last, '[.]([^.]*)$', 1)}) = 'html')"
        weak = self.t.lower("l.text")
        return f"""SELECT l.site, 'LNK001' AS rule_id, 'error' AS severity, l.path, concat('broken internal link: /', l.target) AS message
              FROM own_links l LEFT JOIN known k ON l.site = k.site AND l.target = k.target WHERE l.target IS NOT NULL AND k.target IS NULL AND {checked}
            UNION ALL SELECT l.site, 'LNK003', 'warning', l.path, concat('weak internal anchor text ''', l.text, ''' for /', l.target)
              FROM own_links l JOIN site s ON l.site = s.site AND l.target = s.route WHERE {weak} IN {rules.WEAK_ANCHORS}
            UNION ALL SELECT s.site, 'LNK002', 'warning', s.path, concat('orphan page: /', s.route)
              FROM site s LEFT JOIN (SELECT site, target, relative_path FROM all_links WHERE target IS NOT NULL) l ON s.site = l.site AND s.route = l.target AND s.relative_path <> l.relative_path
              WHERE l.target IS NULL AND s.route <> '' AND s.relative_path <> '404.html' AND s.route <> '404'"""

    def cluster_findings(self) -> str:
        """Pages that share a title and description, or their whole visible text, with others."""
        d, t = self.d, self.t
        others = (lambda a: f"array_to_string(({a})[1:3], ', ')") if self.duckdb else (lambda a: f"array_join(slice({a}, 1, 3), ', ')")
        all_ = "list_sort(list(route))" if self.duckdb else "array_sort(collect_list(route))"
        group = "(PARTITION BY site, k ORDER BY route)"

        def shared(rule: str, source: str, key: str, text: str, fits: str) -> str:
            # Of a key's members the first four are gathered, as three besides the page itself are told.
            members = f"SELECT site, path, route, {key} AS k FROM {source} WHERE {fits}"
            return f"""SELECT m.site, '{rule}' AS rule_id, 'warning' AS severity, m.path, concat('{text}', CAST(n.n - 1 AS STRING), ' other route(s): ',
                  {others(d.keep('g.routes', d.fn('x', 'x <> m.route')))}) AS message
                FROM ({members}) m
                JOIN (SELECT site, k, count(*) AS n FROM ({members}) c GROUP BY site, k HAVING count(*) > 1) n ON m.site = n.site AND m.k = n.k
                JOIN (SELECT site, k, {all_} AS routes FROM (SELECT site, k, route, row_number() OVER {group} AS nr FROM ({members}) o) z WHERE nr <= 4 GROUP BY site, k) g ON m.site = g.site AND m.k = g.k"""

        meta = f"concat({t.lower('title')}, chr(1), {t.lower(t.trim('description'))})"
        visible = f"md5({t.lower('visible')})"
        return shared("SEO017", "site", meta, "page shares the same title and meta description as ", "title IS NOT NULL AND description IS NOT NULL") + " UNION ALL " + shared("CNT005", "site", visible, "page duplicates the visible text of ", f"page_kind NOT IN {rules.THIN} AND visible_bytes >= 500")

    def canonical_findings(self) -> str:
        return "SELECT s.site, 'SEO016' AS rule_id, 'warning' AS severity, s.path, concat('page canonicals to another crawlable internal route: /', s.canonical_route) AS message FROM site s JOIN site o ON s.site = o.site AND s.canonical_route = o.route WHERE s.canonical_route <> s.route"

    def image_findings(self) -> str:
        t = self.t
        rows = "SELECT site, path, unnest(images) AS i FROM site" if self.duckdb else "SELECT site, path, i FROM site LATERAL VIEW explode(images) e AS i"
        found = f"SELECT site, path, {t.attribute('i', 'src')} AS src, {t.attribute('i', 'alt')} AS alt, {t.attribute('i', 'role')} AS role, {t.attribute('i', 'aria-hidden')} AS hidden FROM ({rows}) r"
        return " UNION ALL ".join(f"SELECT site, '{r}' AS rule_id, '{s}' AS severity, path, {m} AS message FROM ({found}) q WHERE {c}" for r, s, c, m in elements.image_rules(self))

    def alternate_findings(self) -> str:
        t, d = self.t, self.d
        rows = "SELECT site, path, route, unnest(alternates) AS a FROM site" if self.duckdb else "SELECT site, path, route, a FROM site LATERAL VIEW explode(alternates) e AS a"
        lang, href = t.attribute("a", "hreflang"), t.attribute("a", "href")
        found = f"SELECT site, path, route, nullif({lang}, '') AS hreflang, {href} AS href, coalesce({t.internal(href)}, CASE WHEN {d.like(href, '^https?://')} THEN {t.urlish(href)} END) AS target, {t.lower(t.trim('coalesce(' + t.attribute('a', 'type') + ', ' + chr(39) * 2 + ')'))} AS media FROM ({rows}) r"
        return f"""WITH alt AS ({found})
            SELECT site, 'SEO010' AS rule_id, 'warning' AS severity, path, concat('invalid hreflang value: ', hreflang) AS message FROM alt WHERE hreflang <> 'x-default' AND NOT {d.like('hreflang', '^[a-z]{2,3}(-[A-Z]{2})?$')}
            UNION ALL SELECT site, 'SEO011', 'warning', path, 'hreflang cluster is missing x-default' FROM alt GROUP BY site, path HAVING max(CASE WHEN hreflang = 'x-default' THEN 1 ELSE 0 END) = 0
            UNION ALL SELECT a.site, 'SEO009', 'warning', a.path, concat('hreflang alternate points to missing internal path: ', a.href)
              FROM alt a LEFT JOIN known k ON a.site = k.site AND a.target = k.target WHERE a.target IS NOT NULL AND k.target IS NULL AND (a.hreflang IS NOT NULL OR {t.trim(d.one('a.media', '^([^;]*)', 1))} NOT IN {elements.MACHINE_MEDIA})
            UNION ALL SELECT a.site, 'SEO012', 'warning', a.path, concat('hreflang alternate /', a.target, ' does not reciprocally reference this page')
              FROM alt a JOIN site s ON a.site = s.site AND a.target = s.route LEFT JOIN (SELECT DISTINCT site, route, target FROM alt) b ON a.site = b.site AND a.target = b.route AND a.route = b.target WHERE b.target IS NULL"""

    def asset_findings(self) -> str:
        """Social images at a root-relative path that the site does not have."""
        values = f"SELECT site, path, 'og:image' AS k, og_image AS v FROM site WHERE {rules.FILE_404} UNION ALL SELECT site, path, 'twitter:image', twitter_image FROM site WHERE {rules.FILE_404}"
        return f"""SELECT v.site, 'SOC008' AS rule_id, 'warning' AS severity, v.path, concat(v.k, ' points to missing internal asset: ', v.v) AS message
            FROM (SELECT *, {self.t.internal('v')} AS target FROM ({values}) w) v LEFT JOIN known k ON v.site = k.site AND v.target = k.target WHERE v.target IS NOT NULL AND k.target IS NULL"""

    def spots(self) -> str:
        """Relations for the places of findings, after base() and known."""
        return f"elements AS ({positions.elements(self)}), spots AS ({positions.places(self)})"

    def links(self) -> str:
        return parse.links("every", self.duckdb)

    def derived(self) -> dict[str, str]:
        """What is read from parsed pages for many rules, by the name it is kept under."""
        facts = f"WITH ld_pages AS (SELECT * FROM parsed_ld) {structured.facts(self)}"
        return {"parsed_links": f"WITH {self.base()} {self.links()}", "parsed_blocks": f"WITH {self.base()} {self.block_rows()}", "parsed_ld": f"WITH {self.base()} {structured.pages(self)}", "parsed_ld_facts": facts}

    def parts(self) -> dict[str, str]:
        return {
            "page": self.page_findings(),
            "block": self.block_findings(),
            "link": self.link_findings(),
            "cluster": self.cluster_findings(),
            "canonical": self.canonical_findings(),
            "image": self.image_findings(),
            "alternate": self.alternate_findings(),
            "asset": self.asset_findings(),
            "control": elements.control_findings(self),
            "id": elements.id_findings(self),
            "heading": elements.heading_findings(self),
            "robots": artifacts.robots_findings(self),
            "sitemap": artifacts.sitemap_findings(self),
            "llms": artifacts.llms_findings(self),
            "structured": structured.findings(self),
        }

    def optional(self) -> dict[str, str]:
        """Parts that are off unless asked for."""
        t, d = self.t, self.d
        own = "coalesce(canonical_route, route)"
        href = t.attribute("x", "href")
        target = f"coalesce({t.internal(href)}, CASE WHEN {d.like(href, '^https?://')} THEN {t.urlish(href)} END)"
        back = d.size(d.keep("alternates", d.fn("x", f"{target} = {own}")))
        return {
            "structured_optional": structured.findings(self, optional=True),
            "page_optional": self.page_findings((("SOC007", "warning", f"{rules.FILE_404} AND twitter_image IS NULL", "'missing twitter:image'"), ("SEO008", "warning", f"{d.size('alternates')} > 0 AND {back} = 0", "'page has hreflang alternates but no self-referencing hreflang'"))),
        }

    def findings(self, *names: str) -> str:
        """The head of a query whose table ``findings`` has the named parts."""
        parts = self.parts()
        chosen = [(parts | self.optional())[n] for n in names or parts]
        union = " UNION ALL ".join(f"SELECT site, rule_id, severity, path, message FROM ({p}) f{i}" for i, p in enumerate(chosen))
        kept_links, kept_blocks = (self.links(), self.block_rows()) if self.duckdb else ("SELECT * FROM parsed_links", "SELECT * FROM parsed_blocks")
        links = f", all_links AS ({kept_links}), own_links AS (SELECT * FROM all_links WHERE place = 1)" if not names or {"link", "structured"} & set(names) else ""
        known = f", known AS ({self.index()})" if not names or {"link", "alternate", "asset", "llms"} & set(names) else ""
        files = f", {artifacts.relations(self)}" if not names or {"robots", "sitemap", "llms"} & set(names) else ""
        blocks = f", blocks AS ({kept_blocks})" if not names or "block" in names else ""
        ld = f", ld_pages AS ({structured.pages(self) if self.duckdb else 'SELECT * FROM parsed_ld'})" if not names or {"structured", "structured_optional"} & set(names) else ""
        return f"WITH {self.base()}{links}{known}{files}{blocks}{ld}, findings AS ({union}) "


GROUPED = "SELECT rule_id, severity, count(*) AS n, count(DISTINCT site) AS sites FROM findings GROUP BY rule_id, severity"
FINDING = "SELECT site, rule_id, severity, path, message FROM findings"
#: Stand-ins for what the test data lacks: a policy, an export of citations, two runs' metrics.
POLICY = {
    "ignore_rules": ["SOC006", "SEO001"],
    "ignore_paths": ["/es/"],
    "severity_overrides": {"SEO004": "warning"},
    "suppressions": [{"rule_id": "CNT001", "path_pattern": "/de/"}, {"rule_id": "SOC004", "path_pattern": "/fr/"}, {"rule_id": "SEO005", "path_pattern": "/", "expires": "2020-01-01"}],
}
ROUTE_KINDS = {"first": {"match": ["/en/1"], "skip_rules": ["CNT001", "A11Y005", "GEO008"]}}
CITATIONS = "SELECT url, page_id % 5 + 1 AS citations FROM pages UNION ALL SELECT concat(url, '/gone'), 2 FROM pages WHERE page_id % 50 = 0 UNION ALL SELECT url, 3 FROM pages WHERE page_id % 7 = 0"
WAS, NOW = "rule_id NOT LIKE 'SOC00%' OR path LIKE '%1%'", "rule_id NOT LIKE 'SEO00%' OR path LIKE '%2%'"
BUDGET = {"phase.click.elapsed_ms": 1, "phase.view.elapsed_ms": 10**12, "phase.none.elapsed_ms": 5, "crawl.click.per_minute": 3}


def metrics(k: int) -> str:
    return f"SELECT concat('phase.', event_type, '.elapsed_ms') AS metric, 'ms' AS unit, 'lower_is_better' AS direction, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS value FROM events WHERE event_id % 2 = {k} GROUP BY event_type UNION ALL SELECT concat('crawl.', event_type, '.per_minute'), 'per_minute', 'higher_is_better', count(*) FROM events WHERE event_id % 3 = {k} GROUP BY event_type"


def whole_audit(p: Plan) -> str:
    """The oracle's head whose table ``findings`` has those of all rules that are on by default."""
    apart = suggestions_sql.texts(p) | surfaces_sql.texts(p) | identity_sql.texts(p)
    more = "".join(f" UNION ALL SELECT site, rule_id, severity, path, message FROM ({apart[name]}) {name}" for name in APART)
    return f"WITH first AS ({p.findings()}{FINDING}), findings AS MATERIALIZED (SELECT * FROM first{more}) "


def report_texts() -> dict[str, str]:
    """The reports' SQL for the oracle; the reports themselves are DataFrame functions."""
    p = Plan(duckdb=True)
    every = whole_audit(p)
    error, warning = "sum(CASE WHEN severity <> 'warning' THEN 1 ELSE 0 END)", "sum(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END)"
    heuristic = f"{rules.rule_class()} = 'heuristic'"
    layers = " UNION ALL ".join(f"SELECT '{x}' AS layer" for x in reports.LAYERS)
    filled = lambda name, text, values: f"SELECT s.site, '{name}' AS dimension, v.value, coalesce(n, 0) AS n FROM (SELECT DISTINCT site FROM findings) s CROSS JOIN ({' UNION ALL '.join(f'SELECT {x!r} AS value' for x in values)}) v LEFT JOIN (SELECT site, {text} AS value, count(*) AS n FROM findings GROUP BY ALL) f ON s.site IS NOT DISTINCT FROM f.site AND v.value = f.value"
    keys = "site, rule_id, path, 1 AS line, 1 AS \"column\", message"
    route = "regexp_extract(path, '^crawl/(.*?)(/?index[.]html)?$', 1)"
    return {
        "summary_counts": f"{every}SELECT site, count(*) AS total, {error} AS errors, {warning} AS warnings, sum(CASE WHEN {heuristic} THEN 0 ELSE 1 END) AS actionable, sum(CASE WHEN {heuristic} THEN 1 ELSE 0 END) AS heuristic FROM findings GROUP BY site",
        "summary_by_layer": f"{every}, layers AS ({layers}), n AS (SELECT site, {rules.layer()} AS layer, count(*) AS total, {error} AS errors FROM findings GROUP BY ALL) SELECT s.site, l.layer, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, coalesce(total - errors, 0) AS warnings FROM (SELECT DISTINCT site FROM findings) s CROSS JOIN layers l LEFT JOIN n ON s.site IS NOT DISTINCT FROM n.site AND l.layer = n.layer",
        "rule_mix": f"{every}{filled('class', rules.rule_class(), reports.CLASSES)} UNION ALL {filled('confidence', rules.confidence(), reports.CONFIDENCES)}",
        "rule_metadata": f"{every}SELECT site, rule_id, {rules.rule_class()} AS class, {rules.confidence()} AS confidence, {rules.layer()} AS layer, {rules.group()} AS rule_group, count(*) AS n FROM findings GROUP BY site, rule_id",
        "finding_scope": f"{every}SELECT site, rule_id, path, message, CASE WHEN {rules.sitewide()} THEN 'sitewide' WHEN count(*) OVER (PARTITION BY site, rule_id, message) >= 3 THEN 'template' ELSE 'page' END AS scope FROM findings",
        "finding_scopes": f"{every}, s AS (SELECT site, CASE WHEN {rules.sitewide()} THEN 'sitewide' WHEN count(*) OVER (PARTITION BY site, rule_id, message) >= 3 THEN 'template' ELSE 'page' END AS scope FROM findings) SELECT site, scope, n FROM (SELECT site, count(*) FILTER (WHERE scope = 'sitewide') AS sitewide, count(*) FILTER (WHERE scope = 'template') AS template, count(*) FILTER (WHERE scope = 'page') AS page FROM s GROUP BY site) UNPIVOT (n FOR scope IN (sitewide, template, page))",
        "finding_regressions": f"{every}SELECT DISTINCT {keys} FROM findings WHERE {NOW} EXCEPT SELECT {keys} FROM findings WHERE {WAS}",
        "finding_clusters": f"{every}SELECT site, {rules.group()} AS rule_group, rule_id, message, severity, count(*) AS n, array_to_string(list_sort(list(DISTINCT path))[1:5], ' | ') AS examples FROM findings GROUP BY site, rule_id, message, severity",
        "repeated_issues": f"{every}SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, kind ORDER BY n DESC, rule_id, message) AS place FROM (SELECT site, CASE WHEN {heuristic} THEN 'heuristic' ELSE 'actionable' END AS kind, rule_id, message, count(*) AS n FROM findings GROUP BY ALL HAVING count(*) > 1) a) b WHERE place <= 3",
        "largest_groups": f"{every}SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, rule_group) AS place FROM (SELECT site, {rules.group()} AS rule_group, count(*) AS n FROM findings GROUP BY ALL) a) b WHERE place <= 5",
        "policy_applied": f"{every}SELECT site, rule_id, CASE WHEN rule_id = 'SEO004' THEN 'warning' ELSE severity END AS severity, path, message FROM findings WHERE rule_id NOT IN ('SOC006', 'SEO001') AND NOT contains(path, '/es/') AND NOT (rule_id = 'CNT001' AND contains(path, '/de/')) AND NOT (rule_id = 'SOC004' AND contains(path, '/fr/')) AND NOT (rule_id IN ('CNT001', 'GEO008') AND contains(path, '/en/1'))",
        "finding_diff": f"{every}, was AS (SELECT DISTINCT {keys} FROM findings WHERE {WAS}), now AS (SELECT DISTINCT {keys} FROM findings WHERE {NOW}) SELECT *, 'unchanged' AS status FROM (SELECT * FROM was INTERSECT SELECT * FROM now) a UNION ALL SELECT *, 'new' FROM (SELECT * FROM now EXCEPT SELECT * FROM was) b UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM was EXCEPT SELECT * FROM now) c",
        "search_export": f"{every}SELECT site, path, count(*) AS findings, {error} AS errors, {warning} AS warnings, array_to_string(list_sort(list(DISTINCT rule_id)), ' | ') AS rules FROM findings GROUP BY site, path",
        "opportunity_score": f"{every}, c AS (SELECT url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site, trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS route, sum(citations) AS citations, count(*) AS rows FROM ({CITATIONS}) q GROUP BY ALL), f AS (SELECT site, {route} AS route, count(*) AS n, {error} AS e, {warning} AS w FROM findings GROUP BY ALL), o AS (SELECT c.*, coalesce(n, 0) AS audit_findings, coalesce(e, 0) AS audit_errors, coalesce(w, 0) AS audit_warnings, n IS NOT NULL AS matched, 5 * citations + 50 * coalesce(e, 0) + 10 * coalesce(w, 0) + CASE WHEN n IS NULL THEN 75 ELSE 0 END AS score FROM c LEFT JOIN f ON c.site = f.site AND c.route = f.route) SELECT site, url, route, citations, rows, audit_findings, audit_errors, audit_warnings, matched, score, CASE WHEN score >= 200 THEN 'critical' WHEN score >= 80 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS priority FROM o WHERE score > 0",
        "performance_diff": f"SELECT *, CASE WHEN delta IS NULL THEN 'missing' WHEN delta = 0 OR abs(basis_points) < 1000 THEN 'unchanged' WHEN (delta > 0) = (direction = 'lower_is_better') THEN 'regressed' ELSE 'improved' END AS status FROM (SELECT coalesce(a.metric, b.metric) AS metric, coalesce(a.unit, b.unit) AS unit, coalesce(a.direction, b.direction) AS direction, a.value AS baseline, b.value AS current, b.value - a.value AS delta, CASE WHEN a.value <> 0 THEN CAST(trunc((b.value - a.value) * 10000 / a.value) AS BIGINT) END AS basis_points FROM ({metrics(0)}) a FULL OUTER JOIN ({metrics(1)}) b ON a.metric = b.metric) q",
        "performance_budget": f"SELECT l.metric, value, budget, CASE WHEN value IS NULL THEN 'unknown' WHEN value > budget THEN 'over' ELSE 'within' END AS status FROM ({' UNION ALL '.join(f'SELECT {k!r} AS metric, {v} AS budget' for k, v in BUDGET.items())}) l LEFT JOIN ({metrics(0)}) m ON l.metric = m.metric",
        "phase_percentiles": f"SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, {', '.join(f'list_sort(list(value))[1 + CAST(ceil((count(*) - 1) * {q}) AS INT)] AS p{int(q * 100)}' for q in SHARES)} FROM events GROUP BY event_type",
    }


SHARES = (0.5, 0.75, 0.95, 0.99)
#: Queries whose findings are part of the whole audit beside those of Plan.parts().
APART = ("rules_claims", "rules_surfaces", "rules_well_known", "rules_headers", "rules_identity")


def percentiles(events: DataFrame, scratch: str) -> DataFrame:
    """By event_type: how many, least, most and the values at shares of the order, by places in a sorted table and so without gathering a type's values."""
    sorted_ = events.select("event_type", "value").repartitionByRange("event_type", "value").sortWithinPartitions("event_type", "value").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    sorted_.write.mode("overwrite").parquet(scratch)
    rows = events.sparkSession.read.parquet(scratch)
    # A row for each type in each part of the sorted table.
    parts = rows.groupBy("event_type", "part").agg(F.count("*").alias("k"), F.min("at").alias("first"), F.min("value").alias("low"), F.max("value").alias("high"))
    before = parts.withColumn("before", F.sum("k").over(Window.partitionBy("event_type").orderBy("part")) - F.col("k"))
    totals = parts.groupBy("event_type").agg(F.sum("k").alias("n"), F.min("low").alias("least"), F.max("high").alias("most"))
    wanted = lambda q: (1 + F.ceil((F.col("n") - 1) * q)).cast("long")
    placed = rows.join(F.broadcast(before.select("event_type", "part", "first", "before")), ["event_type", "part"]).join(F.broadcast(totals), "event_type").withColumn("place", F.col("at") - F.col("first") + F.col("before") + 1)
    at = [F.max(F.when(F.col("place") == wanted(q), F.col("value"))).alias(f"p{int(q * 100)}") for q in SHARES]
    return placed.groupBy("event_type", "n", "least", "most").agg(*at)


def texts(duckdb: bool) -> dict[str, str]:
    """Each query's SQL in one dialect."""
    p = Plan(duckdb)
    base = f"WITH {p.base()} "
    raw = f"WITH {p.base(rich=False)} "
    join = (lambda a: f"array_to_string({a}, ' | ')") if duckdb else (lambda a: f"array_join({a}, ' | ')")
    out = {
        "page_parse": f"{base}SELECT page_id, site, route, relative_path, page_kind, title, h1_count, description, canonical, canonical_route, html_lang, robots, twitter_card, nosnippets, answer_blocks, strong_blocks FROM every",
        "visible_text": f"{raw}SELECT page_id, visible, visible_bytes FROM every",
        "title_h1": f"{raw}SELECT page_id, title, {join('h1_texts')} AS h1 FROM every",
        "page_links": f"{raw}SELECT page_id, site, href, target, text FROM ({parse.links('every', duckdb)}) l",
        "route_dedup": f"{raw}SELECT page_id, site, route FROM site",
        "robots_directives": f"{base}SELECT page_id, {join('directives')} AS directives FROM every",
        "inbound_degree": f"{raw}, l AS ({parse.links('every', duckdb)}) SELECT s.site, s.route, count(DISTINCT l.relative_path) AS inbound FROM site s LEFT JOIN l ON s.site = l.site AND s.route = l.target AND s.relative_path <> l.relative_path GROUP BY s.site, s.route",
        "rules_page": f"{p.findings('page')}{FINDING}",
        "rules_blocks": f"{p.findings('block')}{FINDING}",
        "rules_links": f"{p.findings('link')}{FINDING}",
        "rules_clusters": f"{p.findings('cluster')}{FINDING}",
        "rules_canonical": f"{p.findings('canonical')}{FINDING}",
        "rules_images": f"{p.findings('image')}{FINDING}",
        "rules_alternates": f"{p.findings('alternate')}{FINDING}",
        "rules_assets": f"{p.findings('asset')}{FINDING}",
        "rules_accessibility": f"{p.findings('control', 'id', 'heading')}{FINDING}",
        "rules_robots": f"{p.findings('robots')}{FINDING}",
        "rules_sitemap": f"{p.findings('sitemap')}{FINDING}",
        "rules_llms": f"{p.findings('llms')}{FINDING}",
        "rules_structured": f"{p.findings('structured')}{FINDING}",
        "rules_optional": f"{p.findings('page_optional', 'structured_optional')}{FINDING}",
        "finding_positions": f"{p.findings('block', 'link', 'image', 'control')}, {p.spots()} SELECT site, rule_id, path, message, line, col FROM ({positions.located(p)}) x",
        "audit_findings": f"{whole_audit(p) if duckdb else p.findings()}{FINDING}",
        "audit_summary": f"{whole_audit(p) if duckdb else p.findings()}{GROUPED}",
        "phase_shares": f"SELECT event_type, n, CAST(floor(n * 10000 / total) AS BIGINT) AS basis_points FROM (SELECT event_type, n, sum(n) OVER () AS total FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) a) b",
        "trend_delta": f"SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS was, coalesce(b.n, 0) AS now, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'lost' WHEN b.n > a.n THEN 'increased' WHEN b.n < a.n THEN 'decreased' ELSE 'unchanged' END AS status FROM (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY user_id) a FULL OUTER JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY user_id) b ON a.user_id = b.user_id",
        "citation_rollup": f"{raw}SELECT site, route, count(*) AS rows, sum(page_id % 5 + 1) AS citations, max(page_id) AS last_page FROM every GROUP BY site, route",
        "llms_index": f"{raw}SELECT site, count(*) AS routes, {join('list_sort(list(route))' if duckdb else 'array_sort(collect_list(route))')} AS routes_text FROM site GROUP BY site",
        "sitemap_xml": f"{raw}SELECT site, route, concat('<url><loc>https://', site, '/', replace(replace(replace(route, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</loc></url>') AS entry FROM site",
    }
    return {k: p.sql(v) for k, v in out.items()}


def parsed_pages(spark: SparkSession, pages: DataFrame, rich: bool) -> DataFrame:
    """Pages parsed and ranked.  A source of fewer parts than there are cores is dealt out first, as parsing is what takes the time."""
    cores = spark.sparkContext.defaultParallelism
    (pages if pages.rdd.getNumPartitions() >= cores else pages.repartition(cores)).createOrReplaceTempView("pages")
    text = f"WITH parsed_pages AS ({parse.parsed(parse.richer() if rich else 'SELECT page_id, url, html FROM pages')}) {parse.ranked('parsed_pages')}"
    return spark.sql(text)


def prepare(spark: SparkSession, sf_dir: str, text: str) -> None:
    """The views that a text names, parsed or derived once a session."""
    derived = Plan(duckdb=False).derived()
    if "parsed_ld_facts" in text:
        text += "parsed_ld "
    if any(view in text for view in derived):
        text += "parsed_rich"
    for rich, view in ((True, "parsed_rich"), (False, "parsed_raw")):
        if view in text:
            pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
            kept(spark, (view, sf_dir), partial(parsed_pages, spark, pages, rich)).createOrReplaceTempView(view)
    json_ld.register(spark)
    for view, sql in derived.items():
        if view in text:
            kept(spark, (view, sf_dir), partial(spark.sql, sql)).createOrReplaceTempView(view)
    if "FROM events" in text:
        spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    text = texts(duckdb=False)[name]
    prepare(spark, sf_dir, text)
    return spark.sql(text)


def found_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit's findings: those of the parts, and of the rules that are DataFrame functions."""
    text = texts(duckdb=False)["audit_findings"]
    prepare(spark, sf_dir, text)
    found = spark.sql(text)
    more = surface_queries() | suggestion_queries() | identity_queries()
    for name in APART:
        found = found.unionByName(more[name](spark, sf_dir).select("site", "rule_id", "severity", "path", "message"))
    return found


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit's findings, written once a session, as every report reads them."""
    return kept(spark, ("findings", sf_dir), lambda: found_anew(spark, sf_dir))


def stand_in(spark: SparkSession, sf_dir: str, table: str, text: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(text)


def placed(findings: DataFrame) -> DataFrame:
    return findings.withColumn("line", F.lit(1)).withColumn("column", F.lit(1))


def report_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = {"summary_counts": reports.summary, "summary_by_layer": reports.by_layer, "rule_mix": reports.mix, "rule_metadata": reports.by_rule, "finding_scopes": reports.by_scope, "finding_clusters": reports.clusters, "repeated_issues": reports.repeated, "largest_groups": reports.largest_groups, "search_export": reports.search_export}
    out = {name: partial(lambda f, spark, sf_dir: f(all_findings(spark, sf_dir)), f) for name, f in plain.items()}
    out["audit_findings"] = all_findings
    out["audit_summary"] = lambda spark, sf_dir: all_findings(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.countDistinct("site").alias("sites"))
    out["finding_scope"] = lambda spark, sf_dir: reports.with_scope(all_findings(spark, sf_dir)).select("site", "rule_id", "path", "message", "scope")
    out["policy_applied"] = lambda spark, sf_dir: reports.apply_policy(all_findings(spark, sf_dir), POLICY, ROUTE_KINDS)
    out["finding_diff"] = lambda spark, sf_dir: reports.diff(placed(all_findings(spark, sf_dir).where(WAS)), placed(all_findings(spark, sf_dir).where(NOW)))
    out["finding_regressions"] = lambda spark, sf_dir: reports.regressions(placed(all_findings(spark, sf_dir).where(WAS)), placed(all_findings(spark, sf_dir).where(NOW)))
    out["opportunity_score"] = lambda spark, sf_dir: reports.opportunities(stand_in(spark, sf_dir, "pages", CITATIONS), all_findings(spark, sf_dir))
    out["performance_diff"] = lambda spark, sf_dir: reports.metric_diff(stand_in(spark, sf_dir, "events", metrics(0)), stand_in(spark, sf_dir, "events", metrics(1)))
    out["performance_budget"] = lambda spark, sf_dir: reports.over_budget(stand_in(spark, sf_dir, "events", metrics(0)), BUDGET)
    out["phase_percentiles"] = lambda spark, sf_dir: percentiles(spark.read.parquet(f"{sf_dir}/events.parquet"), f"{fresh_folder(spark, 'sorted')}/rows")
    return out


def intelligence_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
        prepare(spark, sf_dir, "parsed_rich parsed_links parsed_blocks parsed_ld")
        read = lambda view: spark.table(view)
        return [read("parsed_rich").where("place = 1"), read("parsed_blocks"), read("parsed_ld"), read("parsed_links").where("place = 1")]

    def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages, blocks, ld, _ = tables(spark, sf_dir)
        return kept(spark, ("grounding", sf_dir), lambda: intelligence.grounding(pages, blocks, ld))

    def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
        return intelligence.fanout(ground(spark, sf_dir), save=lambda rows, name: kept(spark, (f"fanout_{name}", sf_dir), lambda: rows))

    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages, blocks, _, links = tables(spark, sf_dir)
        return kept(spark, ("evidence", sf_dir), lambda: intelligence.evidence(intelligence.evidence_sections(pages, blocks, links)))

    def trust(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
        pages, made = tables(spark, sf_dir)[0], suggestions_sql.stand_ins()
        records, terms = (spark.sql(f"WITH {Plan(duckdb=False).base()} {made[k]}") for k in ("records", "facts"))
        return [kept(spark, ("trust_issues", sf_dir), lambda: suggestions.trust_issues(records, pages, terms)), suggestions.trust_sources(records, pages, terms)]

    def scores(spark: SparkSession, sf_dir: str, trusted: bool = False) -> DataFrame:
        known = SiteFacts(spark, sf_dir, home=False)
        return intelligence.route_scores(ground(spark, sf_dir), found(spark, sf_dir), known.assessment(), known.mismatches(), trust(spark, sf_dir)[0] if trusted else None)

    def blocked(spark: SparkSession, sf_dir: str, trusted: bool = False) -> DataFrame:
        return intelligence.blockers(ground(spark, sf_dir), found(spark, sf_dir), SiteFacts(spark, sf_dir, home=False).mismatches(), trust(spark, sf_dir)[0] if trusted else None)

    return {
        "grounding_routes": lambda s, d: intelligence.routes_report(ground(s, d)),
        "grounding_intents": lambda s, d: intelligence.intent_counts(ground(s, d)),
        "topic_clusters": lambda s, d: intelligence.topic_counts(ground(s, d)),
        "evidence_routes": found,
        "evidence_sites": lambda s, d: intelligence.evidence_by_site(found(s, d)),
        "riskiest_routes": lambda s, d: intelligence.riskiest_routes(found(s, d)),
        "route_scores": scores,
        "route_scores_trust": lambda s, d: scores(s, d, True),
        "weakest_routes": lambda s, d: intelligence.weakest_routes(scores(s, d)),
        "site_scores": lambda s, d: intelligence.site_scores(scores(s, d), SiteFacts(s, d, home=False).assessment()),
        "site_scores_trust": lambda s, d: intelligence.site_scores(scores(s, d, True), SiteFacts(s, d, home=False).assessment(), *trust(s, d)),
        "intelligence_blockers": blocked,
        "intelligence_blockers_trust": lambda s, d: blocked(s, d, True),
        "fanout_queries": asked,
        "fanout_sites": lambda s, d: intelligence.fanout_by_site(asked(s, d)),
        "least_covered_queries": lambda s, d: intelligence.least_covered(asked(s, d)),
    }


class SiteFacts:
    """A site's facts and how its pages keep to them, each written once a session; with ``home``, over pages that have home pages."""

    def __init__(self, spark: SparkSession, sf_dir: str, home: bool = True):
        self.spark, self.sf_dir, self.home = spark, sf_dir, home

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return kept(self.spark, (f"facts_{name}_{self.home}", self.sf_dir), make)

    def pages(self) -> DataFrame:
        def made() -> DataFrame:
            prepare(self.spark, self.sf_dir, "parsed_rich parsed_ld")
            pages = self.spark.sql(f"WITH {Plan(duckdb=False).base()} {facts_sql.homes()}") if self.home else self.spark.table("parsed_rich").where("place = 1")
            return facts.page_facts(pages, self.spark.table("parsed_ld"))

        return self.kept("pages", made)

    def drafts(self) -> DataFrame:
        return self.kept("drafts", lambda: facts.manifest(self.pages()))

    def given(self) -> DataFrame:
        """The site's draft, and stand-ins for terms that a draft never has."""

        def made() -> DataFrame:
            self.pages().createOrReplaceTempView("pages_of_facts")
            return facts.terms(self.drafts()).union(self.spark.sql(facts_sql.added().replace("FROM site ", "FROM pages_of_facts ")))

        return self.kept("given", made)

    def mismatches(self) -> DataFrame:
        return self.kept("mismatches", lambda: facts.mismatches(self.pages(), self.given()))

    def assessment(self) -> DataFrame:
        return self.kept("assessment", lambda: facts.assessment(self.pages(), self.given(), self.mismatches()))


def facts_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    joined = lambda rows, *names: rows.withColumns({c: F.array_join(c, " | ") for c in names})
    lists = ("aliases", "descriptors", "product_descriptors", "features")
    return {
        "facts_manifest": lambda s, d: joined(SiteFacts(s, d).drafts(), *lists),
        "facts_curated": lambda s, d: joined(facts.curated(SiteFacts(s, d).drafts()), *lists).select("site", "organization", "product", *lists),
        "facts_validation": lambda s, d: joined(facts.validation(SiteFacts(s, d).drafts()), "errors", "warnings"),
        "facts_mismatches": lambda s, d: SiteFacts(s, d).mismatches(),
        "facts_assessment": lambda s, d: SiteFacts(s, d).assessment(),
    }


def surface_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
        prepare(spark, sf_dir, "parsed_rich parsed_links parsed_ld")
        p, made = Plan(duckdb=False), surfaces_sql.stand_ins()
        head = f"WITH {p.base()}, {artifacts.relations(p)}, files AS ({made['files']})"
        read = lambda text: spark.sql(p.sql(f"{head} {text}"))
        return {"pages": spark.table("parsed_rich").where("place = 1"), "links": spark.table("parsed_links").where("place = 1"), "ld": spark.table("parsed_ld"), "known": read(surfaces_sql.known(p, "files")), "listed": read("SELECT site, route FROM map_routes"), "robots": read("SELECT site FROM artifacts WHERE robots_text IS NOT NULL")} | {k: read(v if k != "files" else "SELECT * FROM files") for k, v in made.items()}

    def with_tables(function: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: function(*map(tables(spark, sf_dir).get, names))

    capable = ("pages", "ld", "files", "headers", "llms")
    return {
        "route_surfaces": with_tables(surfaces.route_surfaces, "pages", "links", "known"),
        "rules_surfaces": with_tables(surfaces.surface_findings, "pages", "links", "known", "llms"),
        "site_capabilities": with_tables(surfaces.capabilities, *capable),
        "rules_well_known": with_tables(lambda files, *of: surfaces.well_known_findings(surfaces.capabilities(*of), files), "files", *capable),
        "rules_agents": with_tables(surfaces.agent_findings, "pages", "known"),
        "rules_headers": with_tables(surfaces.header_findings, "pages", "headers", "listed", "robots"),
    }


#: Bounds of the queries' crawl.
CRAWLED, RETRIES, DEEPEST = 12, 1, 40


def crawl_inputs() -> dict[str, str]:
    """Stand-in starts and attempts over site, alike in both engines: a site's first route, and attempts that fail by page_id."""
    return {
        "starts": "SELECT site, min(route) AS route FROM site GROUP BY site",
        "fetches": "SELECT site, route, CAST(1 AS INT) AS attempt, page_id % 5 <> 0 AS ok, CAST(page_id % 97 AS BIGINT) AS fetch_ms, CAST(page_id % 7 AS BIGINT) AS process_ms FROM site UNION ALL SELECT site, route, 2, page_id % 10 <> 0, CAST(page_id % 31 AS BIGINT), 1 FROM site WHERE page_id % 5 = 0 UNION ALL SELECT site, route, 3, TRUE, 1, 1 FROM site WHERE page_id % 5 = 0",
    }


def crawl_texts(p: Plan) -> dict[str, str]:
    made = crawl_inputs()
    head = f"""WITH RECURSIVE {p.base()}, links AS MATERIALIZED ({p.links()}), fetches AS ({made['fetches']}),
      ends AS (SELECT site, route, min(attempt) FILTER (WHERE ok) AS won, max(attempt) AS most FROM fetches WHERE attempt BETWEEN 1 AND {1 + RETRIES} GROUP BY ALL),
      done AS MATERIALIZED (SELECT e.site, e.route, won IS NOT NULL AS ok, coalesce(won, most) AS attempts, CAST(sum(f.fetch_ms) AS BIGINT) AS fetch_ms, CAST(sum(f.process_ms) AS BIGINT) AS process_ms FROM ends e JOIN fetches f ON e.site = f.site AND e.route = f.route AND f.attempt <= coalesce(won, most) GROUP BY ALL),
      edges AS MATERIALIZED (SELECT DISTINCT l.site, l.route, l.target FROM links l JOIN done d ON l.site = d.site AND l.route = d.route WHERE d.ok AND l.place = 1 AND l.target IS NOT NULL),
      walked AS (SELECT site, route, 0 AS depth FROM ({made['starts']}) s UNION SELECT w.site, e.target, w.depth + 1 FROM walked w JOIN edges e ON w.site = e.site AND w.route = e.route WHERE w.depth < {DEEPEST}),
      ranked AS MATERIALIZED (SELECT site, route, depth, row_number() OVER (PARTITION BY site ORDER BY depth, route) AS place FROM (SELECT site, route, min(depth) AS depth FROM walked GROUP BY ALL) q),
      seen AS MATERIALIZED (SELECT r.*, d.ok, d.attempts, d.fetch_ms, d.process_ms FROM ranked r LEFT JOIN done d ON r.site = d.site AND r.route = d.route WHERE place <= {CRAWLED})"""
    return {
        "crawl_visited": f"{head} SELECT site, route, depth, place FROM seen",
        "crawl_stats": f"""{head} SELECT *, fetch_ms // visited_pages AS average_fetch_ms, process_ms // visited_pages AS average_process_ms, coalesce(visited_pages * 60000 // nullif(fetch_ms + process_ms, 0), 0) AS pages_per_minute FROM (SELECT site, count(*) AS visited_pages, count(*) FILTER (WHERE NOT coalesce(ok, FALSE)) AS fetch_failures, CAST(coalesce(sum(attempts - 1), 0) AS BIGINT) AS fetch_retries, CAST(coalesce(sum(fetch_ms), 0) AS BIGINT) AS fetch_ms, CAST(coalesce(sum(process_ms), 0) AS BIGINT) AS process_ms FROM seen GROUP BY site) q""",
        "crawl_slowest": f"{head} SELECT * FROM (SELECT site, route, fetch_ms, process_ms, row_number() OVER (PARTITION BY site ORDER BY fetch_ms + process_ms DESC, route) AS place FROM seen WHERE fetch_ms IS NOT NULL) q WHERE place <= {crawl.SLOWEST}",
        "crawl_failures": f"{head} SELECT site, 'CRW001' AS rule_id, 'error' AS severity, CASE WHEN route = '' THEN 'crawl/index.html' ELSE concat('crawl/', route, '/index.html') END AS path, concat('{crawl.UNFETCHED}https://', site, '/', route) AS message FROM seen WHERE NOT coalesce(ok, FALSE)",
    }


def crawl_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """A crawl along the pages' links that is stopped after its first step and taken up again."""

    def crawled(spark: SparkSession, sf_dir: str) -> tuple[crawl.Crawl, DataFrame]:
        prepare(spark, sf_dir, "parsed_rich parsed_links")
        spark.table("parsed_rich").where("place = 1").createOrReplaceTempView("site_of_crawl")
        made = {k: spark.sql(v.replace("FROM site ", "FROM site_of_crawl ")) for k, v in crawl_inputs().items()}
        done = kept(spark, ("crawl_done", sf_dir), lambda: crawl.outcomes(made["fetches"], RETRIES))
        whole = crawl.Crawl(spark, folder(spark, ("crawl", sf_dir)), CRAWLED)
        edges = spark.table("parsed_links").where("place = 1 AND target IS NOT NULL").select("site", "route", "target")
        if not whole.steps():
            whole.advance(made["starts"], edges, done, most=1)
        whole.advance(made["starts"], edges, done)
        return whole, done

    return {
        "crawl_visited": lambda s, d: crawled(s, d)[0].visited(),
        "crawl_stats": lambda s, d: (lambda c, done: c.stats(done).drop("queued_pages"))(*crawled(s, d)),
        "crawl_slowest": lambda s, d: (lambda c, done: c.slowest(done))(*crawled(s, d)),
        "crawl_failures": lambda s, d: (lambda c, done: c.findings(done).where("rule_id = 'CRW001'"))(*crawled(s, d)),
    }


def identity_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(function: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark, sf_dir, "parsed_rich parsed_ld")
            return function(spark.table("parsed_rich").where("place = 1"), spark.table("parsed_ld"))

        return query

    return {
        "page_identity": over(lambda pages, ld: identity.identities(pages, ld).select("site", "route", "identity", "source", F.size("drift").alias("n_drift"))),
        "identity_drift": over(lambda pages, ld: identity.drift_rows(identity.identities(pages, ld))),
        "rules_identity": over(identity.identity_findings),
    }


#: Addresses of the queries' payloads, and batches of a site that are tried again.
PACKED, AGAIN = 3, 2


def submission_inputs() -> dict[str, str]:
    """Stand-in addresses and a ledger over site, alike in both engines: some addresses odd, attempts that fail by page_id."""
    url = "concat('https://', site, '/', route)"
    return {
        "addresses": f"SELECT site, CASE page_id % 9 WHEN 1 THEN concat(' ', {url}, ' ') WHEN 2 THEN concat('ftp://', site, '/', route) WHEN 3 THEN 'https://other.example/x' WHEN 4 THEN route WHEN 5 THEN ' ' ELSE {url} END AS url FROM site UNION ALL SELECT site, {url} FROM site ",
        "ledger": f"SELECT CAST(NULL AS TIMESTAMP) AS submitted_at, CAST(n AS INT) AS attempt, CASE WHEN page_id % 2 = 0 THEN 'https://one.example' ELSE 'https://two.example' END AS endpoint, site, concat('d', CAST(page_id % 4 AS STRING)) AS digest, route, CASE (page_id + n) % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 END AS status_code, CASE WHEN (page_id + n) % 5 = 4 THEN 'timed out' END AS error FROM (SELECT *, page_id % 3 AS n FROM site) s",
    }


def submission_texts(p: Plan) -> dict[str, str]:
    made, address = submission_inputs(), submissions.ADDRESS
    head = f"WITH {p.base()}, urls AS MATERIALIZED (SELECT DISTINCT site, trim(url) AS url FROM ({made['addresses']}) q WHERE trim(url) <> ''), parts AS (SELECT *, lower(regexp_extract(url, '{address}', 1)) AS scheme, lower(regexp_extract(url, '{address}', 2)) AS host FROM urls)"
    ledger = f"WITH {p.base()}, entries AS ({made['ledger'].replace(', route, CASE', ', [route] AS urls, CASE')}), numbered AS (SELECT *, row_number() OVER (PARTITION BY endpoint, site, digest ORDER BY attempt DESC, urls DESC) AS nr FROM entries)"
    again = "status_code IS NULL OR status_code = 429 OR status_code >= 500"
    return {
        "submission_rejected": f"{head} SELECT site, url, 'invalid URL' AS error FROM parts WHERE host = '' UNION ALL SELECT site, url, 'must use http or https' FROM parts WHERE host <> '' AND scheme NOT IN ('http', 'https') UNION ALL SELECT site, url, 'is not owned by the site' FROM parts WHERE host <> '' AND host <> site",
        "submission_batches": f"{head}, good AS (SELECT site, url, (row_number() OVER (PARTITION BY site ORDER BY url) - 1) // {PACKED} AS number FROM parts WHERE host = site AND scheme IN ('http', 'https')) SELECT site, number, count(*) AS n_urls, sha256(string_agg(url, chr(10) ORDER BY url)) AS digest FROM good GROUP BY site, number",
        "submission_retries": f"{ledger} SELECT site, endpoint, digest, attempt, place FROM (SELECT site, endpoint, digest, attempt + 1 AS attempt, row_number() OVER (PARTITION BY site ORDER BY endpoint, urls) AS place FROM numbered WHERE nr = 1 AND ({again})) q WHERE place <= {AGAIN}",
    }


def submission_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
        prepare(spark, sf_dir, "parsed_rich")
        spark.table("parsed_rich").where("place = 1").createOrReplaceTempView("site_of_submissions")
        return spark.sql(submission_inputs()[name].replace("FROM site ", "FROM site_of_submissions ").replace("FROM site)", "FROM site_of_submissions)").replace("FROM site UNION", "FROM site_of_submissions UNION") + " ")

    def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Of what one attempt's number has several of, the last address stands for the batch.
        rows = made(spark, sf_dir, "ledger").withColumn("urls", F.array("route")).drop("route")
        return rows.groupBy("attempt", "endpoint", "site", "digest").agg(F.max_by(F.struct("submitted_at", "urls", "status_code", "error"), "urls").alias("r")).select("attempt", "endpoint", "site", "digest", "r.*")

    return {
        "submission_rejected": lambda s, d: submissions.rejected(made(s, d, "addresses")),
        "submission_batches": lambda s, d: submissions.batches(made(s, d, "addresses"), PACKED).select("site", "number", F.size("urls").alias("n_urls"), "digest"),
        "submission_retries": lambda s, d: submissions.retries(ledger(s, d), AGAIN).select("site", "endpoint", "digest", "attempt", "place"),
    }


def suggestion_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark, sf_dir, "parsed_rich parsed_links")
        return spark.table("parsed_rich").where("place = 1")

    def with_records(function: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows, made = pages(spark, sf_dir), suggestions_sql.stand_ins()
            records, facts = (spark.sql(f"WITH {Plan(duckdb=False).base()} {made[k]}") for k in ("records", "facts"))
            return function(records, rows, facts)

        return query

    def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark, sf_dir, "parsed_rich parsed_links parsed_blocks")
        save = lambda rows, name: kept(spark, (f"link_{name}", sf_dir), lambda: rows)
        return link_suggestions.link_suggestions(pages(spark, sf_dir), spark.table("parsed_blocks"), spark.table("parsed_links"), save)

    def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages(spark, sf_dir).createOrReplaceTempView("site_of_maps")
        files = spark.sql(suggestions_sql.sitemap_files().replace("FROM site)", "FROM site_of_maps)").replace("FROM site GROUP", "FROM site_of_maps GROUP"))
        found, routes = sitemaps.sitemap_sets(files, lambda rows, name: kept(spark, (f"maps_{name}", sf_dir), lambda: rows))
        return found.join(routes, "site", "left")

    return {
        "sitemap_sets": sets,
        "link_suggestions": suggested,
        "schema_suggestions": lambda s, d: suggestions.schema_suggestions(pages(s, d)),
        "top_routes": lambda s, d: suggestions.top_routes(pages(s, d), s.table("parsed_links")),
        "trust_issues": with_records(suggestions.trust_issues),
        "trust_sources": with_records(suggestions.trust_sources),
        "rules_claims": lambda s, d: claims.generic_findings(pages(s, d).withColumn("visible", F.expr(suggestions_sql.COPY))),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, name) for name in texts(duckdb=False)} | report_queries() | intelligence_queries() | facts_queries() | crawl_queries() | submission_queries() | identity_queries() | surface_queries() | suggestion_queries()


def oracle_sql() -> dict[str, str]:
    p = Plan(duckdb=True)
    return texts(duckdb=True) | {k: p.sql(v) for k, v in (report_texts() | intelligence_sql.texts(p) | facts_sql.texts(p) | crawl_texts(p) | submission_texts(p) | identity_sql.texts(p) | surfaces_sql.texts(p) | suggestions_sql.texts(p)).items()}
