"""What a site offers to machines: mirrors, manifests, well-known files, response headers, and the rules over them.

Inputs are parsed pages of one per route, their links, and three small tables:
``files`` (site, path, text), a site's files besides its pages, where text may
be null; ``headers`` (site, route, name, value), its responses' headers; and
``known`` (site, target), the paths that a site has.  Each page is judged with
joins on its own key, each site with sums over its rows, so nothing gathers a
site's pages.  A null site or path in ``files`` or ``headers`` matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.functions.dialect import Spark, Text
from spanlight.operators.intelligence import holds, low

#: What a link leads to, by the end of its path; the first that fits.
KINDS = {
    "llms": "llms[.]txt$",
    "llms_full": "llms-full[.]txt$",
    "facts": "(^|/)facts[.]json$",
    "sitemap": "(^|/)sitemap[.]xml$",
    "robots": "(^|/)robots[.]txt$",
    "markdown": "[.]md([.]txt)?$",
    "feed": "[.]rss$|[.]atom$|/feed$|/feed[.]xml$|rss[.]xml$",
}
#: Where a page's Markdown mirror may lie: the home page's, another route's endings.
HOME_MIRRORS = ("index.md", "index.md.txt", "index.html.md", "index.html.md.txt")
MIRRORS = (".md", ".md.txt", "/index.md", "/index.md.txt", "/index.html.md", "/index.html.md.txt")
FACTS, FULL, LARGER = ("facts.json", ".well-known/facts.json"), "llms-full.txt", 10
#: Well-known files by what they declare, in the order in which they are looked for.
WELL_KNOWN = {
    "declares_agent_skills": (".well-known/agent-skills/index.json", ".well-known/skills/index.json"),
    "declares_mcp": (".well-known/mcp/server-card.json", ".well-known/mcp/server-cards.json", ".well-known/mcp.json"),
    "declares_api": (".well-known/api-catalog",),
}
API_FILES = (".well-known/api-catalog", "openapi.json", "openapi.yaml")
API_TYPES = ("APIReference", "WebAPI", "WebApi", "APIDescription", "EntryPoint")
API_ROUTE = "^/*(api|graphql)(/|$)"
OAUTH_SERVERS = (".well-known/openid-configuration", ".well-known/oauth-authorization-server")
OAUTH_RESOURCE = ".well-known/oauth-protected-resource"
BOTS = ".well-known/http-message-signatures-directory"
SKILL_CUES = ("agent skills", "agent-skills", "skill catalog", "# skills")
SKILL_FIELDS = ("name", "type", "description", "url", "sha256")
#: Rule, message and path where a declared file is missing, and rule and message where it is not as it should be.
MISSING = {
    "declares_agent_skills": ("SRF010", "site declares agent-skills surface but `.well-known/agent-skills/index.json` is missing"),
    "declares_mcp": ("SRF015", "site declares MCP server but no server card at any standard path"),
    "declares_api": ("SRF020", "site declares an API surface but `.well-known/api-catalog` is missing"),
}
INVALID = {"declares_agent_skills": ("SRF011", "agent-skills index at ", " is invalid: "), "declares_mcp": ("SRF016", "MCP server card at ", " is invalid: "), "declares_api": ("SRF021", "API catalog at ", " has invalid linkset: ")}
OAUTH = {
    "SRF025": (OAUTH_SERVERS, "site has OAuth-protected APIs but no discovery metadata at `.well-known/openid-configuration` or `.well-known/oauth-authorization-server`"),
    "SRF026": ((OAUTH_RESOURCE,), "site has OAuth-protected APIs but no resource metadata at `.well-known/oauth-protected-resource`"),
}
AGENT_FILES = {
    "AGT001": (".well-known/api-catalog", "missing /.well-known/api-catalog (RFC 9727); agents have no machine-readable list of the site's APIs"),
    "AGT002": (".well-known/mcp/server-card.json", "missing /.well-known/mcp/server-card.json (SEP-1649); MCP clients have no static way to discover the site's MCP server"),
}
SURFACE_MESSAGES = {
    "SRF001": "missing /facts.json machine-readable facts manifest",
    "SRF002": "no per-page Markdown mirrors were discovered",
    "SRF003": "larger site is missing llms-full.txt compiled context",
    "SRF004": "route has no discovered Markdown mirror",
    "SRF005": "route has a Markdown mirror but no static machine-readable discovery link",
}
NO_LINK_HEADER = "homepage response sends no Link headers; agents can't discover related resources (api-catalog, service-doc, …) via RFC 8288"
NOINDEX_LISTED = "page is listed in sitemap.xml but declares noindex via X-Robots-Tag"
TEXT = Text(Spark())


def kind(href: Column) -> Column:
    path = low(F.regexp_extract(href, "^([^#?]*)", 1))
    return F.coalesce(*[F.when(path.rlike(p), F.lit(k)) for k, p in KINDS.items()])


def finding(rows: DataFrame, rule: str, severity: str, path: str | Column, message: str | Column) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("site", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), text(path).alias("path"), text(message).alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def flag(condition: Column) -> Column:
    """Whether some row of a group fits; false where none does or it is null."""
    return F.max(F.coalesce(condition, F.lit(False)))


def route_surfaces(pages: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """(site, path, mirrored, linked) for each page: whether it has a Markdown mirror, and whether it links a file for machines."""
    marked = F.expr(f"size(filter(alternates, x -> {TEXT.lower(TEXT.attribute('x', 'type'))} = 'text/markdown' AND {TEXT.attribute('x', 'href')} IS NOT NULL)) > 0")
    own = links.select("site", "path", kind(F.col("href")).alias("kind")).where("kind IS NOT NULL").groupBy("site", "path").agg(F.lit(True).alias("any_link"), flag(F.col("kind") == "markdown").alias("markdown_link"))
    places = F.when(F.col("route") == "", F.array(*map(F.lit, HOME_MIRRORS))).otherwise(F.array(*[F.concat("route", F.lit(e)) for e in MIRRORS]))
    probed = pages.select("site", "path", F.explode(places).alias("target")).join(known, ["site", "target"], "left_semi").select("site", "path").distinct().withColumn("found", F.lit(True))
    every = pages.select("site", "path", marked.alias("marked")).join(own, ["site", "path"], "left").join(probed, ["site", "path"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return every.select("site", "path", (no(F.col("marked")) | no(F.col("markdown_link")) | no(F.col("found"))).alias("mirrored"), (no(F.col("marked")) | no(F.col("any_link"))).alias("linked"))


def surface_findings(pages: DataFrame, links: DataFrame, known: DataFrame, llms: DataFrame) -> DataFrame:
    """SRF001-006.  ``llms`` (site, text) has the llms.txt of sites that have one."""
    routes = route_surfaces(pages, links, known)
    has = known.groupBy("site").agg(flag(F.col("target").isin(*FACTS)).alias("facts"), flag(F.col("target") == FULL).alias("full"))
    sites = routes.groupBy("site").agg(F.count("*").alias("n"), flag(F.col("mirrored")).alias("mirrored")).join(has, "site", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    wide = lambda rule, rows: finding(rows, rule, "warning", "machine-surfaces", SURFACE_MESSAGES[rule])
    page = lambda rule, rows: finding(rows, rule, "warning", F.col("path"), SURFACE_MESSAGES[rule])
    local = TEXT.internal("concat('/', trim(LEADING '/' FROM href))")
    target = F.expr(f"CASE WHEN href rlike '^https?://' THEN {TEXT.urlish('href')} ELSE {local} END")
    named = llms.select("site", F.explode(F.expr(f"regexp_extract_all(text, {TEXT.d.pattern(r'\]\(([^)]*)\)')}, 1)")).alias("href")).withColumn("href", F.expr(TEXT.trim("href")))
    gone = named.where(kind(F.col("href")).isNotNull()).withColumn("target", target).where("target IS NOT NULL").select("site", "href", "target").distinct().join(known, ["site", "target"], "left_anti")
    return union([
        wide("SRF001", sites.where(no("facts"))),
        wide("SRF002", sites.where(no("mirrored"))),
        wide("SRF003", sites.where(no("full") & (F.col("n") >= LARGER))),
        page("SRF004", routes.where(no("mirrored"))),
        page("SRF005", routes.where(F.col("mirrored") & no("linked"))),
        finding(gone, "SRF006", "error", "llms.txt", F.concat(F.lit("llms.txt references missing machine-readable artifact: "), "target")),
    ])


def capabilities(pages: DataFrame, ld: DataFrame, files: DataFrame, headers: DataFrame, llms: DataFrame) -> DataFrame:
    """(site, capability, signals) for what a site's own routes, files, headers and texts say it has."""
    api = F.coalesce(F.col("route").rlike(API_ROUTE), F.lit(False))
    sites = pages.groupBy("site").agg(F.sum(api.cast("long")).alias("api_routes"))
    types = F.exists("vals", lambda v: (v.key == "@type") & v.kind.isin("string", "item") & v.value.isin(*API_TYPES))
    schemas = ld.groupBy("site").agg(flag(types).alias("api_schema"))
    path = F.col("path")
    under = lambda folder: flag(path.startswith(folder + "/"))
    filed = files.groupBy("site").agg(
        flag(path.isin(*API_FILES)).alias("api_file"),
        flag(path.isin(*WELL_KNOWN["declares_mcp"])).alias("mcp_card"),
        under(".well-known/mcp").alias("mcp_folder"),
        flag(path.isin(*WELL_KNOWN["declares_agent_skills"])).alias("skills_index"),
        (under(".well-known/agent-skills") | under(".well-known/skills")).alias("skills_folder"),
        flag(path.isin(*OAUTH_SERVERS, OAUTH_RESOURCE)).alias("oauth_file"),
        flag(path == BOTS).alias("bots_file"),
    )
    asked = headers.groupBy("site").agg(flag(low(F.col("name")) == "www-authenticate").alias("oauth_header"))
    spoken = llms.groupBy("site").agg(flag(holds(low(F.col("text")), SKILL_CUES)).alias("skills_text"))
    row = reduce(lambda a, b: a.join(b, "site", "left"), (schemas, filed, asked, spoken), sites)
    c = {name: F.coalesce(F.col(name), F.lit(False)) for name in row.columns if name not in ("site", "api_routes")}
    signals = {
        "declares_api": [
            (F.col("api_routes") > 0, F.concat(F.lit("indexed routes match `/api/*` ("), F.col("api_routes").cast("string"), F.lit(" pages)"))),
            (c["api_schema"], F.lit("JSON-LD declares APIReference / WebAPI / EntryPoint")),
            (c["api_file"], F.lit("partial well-known API surface present")),
        ],
        "declares_mcp": [
            (c["mcp_card"], F.lit("canonical MCP card file present")),
            (c["mcp_folder"] & ~c["mcp_card"], F.lit("`.well-known/mcp/` directory exists but no canonical card inside")),
        ],
        "declares_agent_skills": [
            (c["skills_index"] | c["skills_folder"], F.lit("partial `.well-known/agent-skills*` file present")),
            (c["skills_text"], F.lit("llms.txt mentions agent skills / skill catalog")),
        ],
        "declares_oauth": [
            (c["oauth_header"], F.lit("at least one route response carries WWW-Authenticate")),
            (c["oauth_file"], F.lit("partial `.well-known/oauth-*` file present")),
        ],
        "declares_bot_identity": [(c["bots_file"], F.lit("partial `.well-known/http-message-signatures-directory` present"))],
    }
    each = [F.struct(F.lit(name).alias("capability"), F.array_join(F.array_compact(F.array(*[F.when(on, text) for on, text in found])), "; ").alias("signals")) for name, found in signals.items()]
    return row.select("site", F.explode(F.array(*each)).alias("s")).select("site", "s.capability", "s.signals").where("signals <> ''")


def first_fault(items: Column, name: str, fields: tuple[str, ...]) -> Column:
    """Of an array of JSON texts the first that is no object or lacks a field, in words; null if none is."""

    def fault(entry: Column, at: Column) -> Column:
        keys, here = F.json_object_keys(entry), F.concat(F.lit(f"{name}["), at.cast("string"), F.lit("]"))
        words = " missing required field `{}`" if name == "skills" else " missing required `{}`"
        return F.coalesce(F.when(keys.isNull(), F.concat(here, F.lit(" must be an object"))), *[F.when(~F.array_contains(keys, f), F.concat(here, F.lit(words.format(f)))) for f in fields])

    return F.get(F.array_compact(F.transform(items, fault)), 0)


def invalid(capability: Column, text: Column) -> Column:
    """Why a well-known file's text is not as it should be, or null."""
    keys = F.json_object_keys(text)
    some = F.coalesce(F.json_array_length(text).cast("string"), F.get_json_object(text, "$"))
    has = lambda k: F.array_contains(keys, k)
    within = lambda k: F.get_json_object(text, f"$.{k}")
    items = lambda k: F.from_json(within(k), "array<string>")
    server = F.json_object_keys(within("serverInfo"))
    own = (
        F.when(capability == "declares_agent_skills", F.coalesce(F.when(~has("$schema"), "missing top-level `$schema` field"), F.when(F.json_array_length(within("skills")).isNull(), "missing `skills` array"), first_fault(items("skills"), "skills", SKILL_FIELDS)))
        .when(capability == "declares_mcp", F.coalesce(F.when(server.isNull(), "missing `serverInfo` object"), *[F.when(~F.array_contains(server, f), f"serverInfo missing required field `{f}`") for f in ("name", "version")]))
        .otherwise(F.coalesce(F.when(F.json_array_length(within("linkset")).isNull(), "missing `linkset` array"), F.when(F.json_array_length(within("linkset")) == 0, "`linkset` array is empty"), first_fault(items("linkset"), "linkset", ("anchor",))))
    )
    return F.when(keys.isNull() & some.isNull(), "invalid JSON").when(keys.isNull(), "root must be a JSON object").otherwise(own)


def well_known_findings(declared: DataFrame, files: DataFrame) -> DataFrame:
    """SRF010-026 of what capabilities() gives: declared files that are missing, or are there and not as they should be."""
    ranks = {path: (name, rank) for name, paths in WELL_KNOWN.items() for rank, path in enumerate(paths)}
    pick = lambda k: reduce(lambda c, p: c.when(F.col("path") == p, F.lit(ranks[p][k])), list(ranks)[1:], F.when(F.col("path") == list(ranks)[0], F.lit(ranks[list(ranks)[0]][k])))
    held = files.where(F.col("path").isin(*ranks) & F.col("text").isNotNull()).select("site", pick(0).alias("capability"), F.struct(pick(1).alias("rank"), "path", "text").alias("f")).groupBy("site", "capability").agg(F.min("f").alias("f"))
    asked = declared.where(F.col("capability").isin(*WELL_KNOWN)).join(held, ["site", "capability"], "left")
    by = lambda table, k: reduce(lambda c, n: c.when(F.col("capability") == n, F.lit(table[n][k])), list(table)[1:], F.when(F.col("capability") == list(table)[0], F.lit(table[list(table)[0]][k])))
    signal = F.concat(F.lit(" (signal: "), "signals", F.lit(")"))
    firsts = {name: (paths[0],) for name, paths in WELL_KNOWN.items()}
    row = lambda rows, rule, path, message: rows.select("site", rule.alias("rule_id"), F.lit("warning").alias("severity"), F.concat(F.lit("crawl/"), path).alias("path"), message.alias("message"))
    wrong = asked.where("f IS NOT NULL").withColumn("reason", invalid(F.col("capability"), F.col("f.text"))).where("reason IS NOT NULL")
    oauth = declared.where("capability = 'declares_oauth'").join(files.groupBy("site").agg(*[flag(F.col("path").isin(*paths)).alias(rule) for rule, (paths, _) in OAUTH.items()]), "site", "left")
    return union([
        row(asked.where("f IS NULL"), by(MISSING, 0), by(firsts, 0), F.concat(by(MISSING, 1), signal)),
        row(wrong, by(INVALID, 0), F.col("f.path"), F.concat(by(INVALID, 1), F.col("f.path"), by(INVALID, 2), "reason")),
        *[row(oauth.where(~F.coalesce(F.col(rule), F.lit(False))), F.lit(rule), F.lit(paths[0]), F.concat(F.lit(text), signal)) for rule, (paths, text) in OAUTH.items()],
    ])


def agent_findings(pages: DataFrame, known: DataFrame) -> DataFrame:
    """AGT001 and AGT002, which are off unless asked for."""
    sites = pages.select("site").distinct()
    return union([finding(sites.join(known.where(F.col("target") == path).select("site"), "site", "left_anti"), rule, "warning", ".", text) for rule, (path, text) in AGENT_FILES.items()])


def header_findings(pages: DataFrame, headers: DataFrame, listed: DataFrame, robots: DataFrame) -> DataFrame:
    """LNK020 and ROB008.  ``listed`` (site, route) is the sitemap's, ``robots`` (site) has sites with a robots.txt.

    A site whose pages all say noindex, as a preview does, gives no ROB008.
    """
    name = low(F.col("name"))
    of = headers.groupBy("site", "route").agg(F.lit(True).alias("any_header"), flag(name == "link").alias("link"), flag((name == "x-robots-tag") & F.contains(low(F.col("value")), F.lit("noindex"))).alias("noindex"))
    rows = pages.select("site", "route", "path").join(of, ["site", "route"], "left")
    no = F.coalesce(F.col("noindex"), F.lit(False))
    mixed = rows.groupBy("site").agg((F.min(no.cast("int")) == 0).alias("mixed")).where("mixed").select("site").join(robots.select("site").distinct(), "site", "left_semi")
    return union([
        finding(rows.where("route = '' AND any_header AND NOT link"), "LNK020", "warning", F.col("path"), NO_LINK_HEADER),
        finding(rows.where(no).join(listed, ["site", "route"], "left_semi").join(mixed, "site", "left_semi"), "ROB008", "warning", F.col("path"), NOINDEX_LISTED),
    ])
