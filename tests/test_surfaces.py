"""Rules over what sites offer to machines, on hand-worked sites, and the same as in another engine."""

import json

import duckdb
import pytest

from spanlight.operators import surfaces
from spanlight.plans import oracle_sql, queries
from spanlight.plans.audit import audit

SF = "/root/testdata/sf0.001"
FILES = "site string, kind string, text string"
PATHS = "site string, path string, text string"
DECLARED = "site string, capability string, signals string"
HEADERS = "site string, route string, name string, value string"


def plain(rows):
    return sorted(tuple("-" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["route_surfaces", "rules_surfaces", "site_capabilities", "rules_well_known", "rules_agents", "rules_headers"])
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    cur = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert plain(queries()[name](spark, SF).select(*columns).collect()) == plain(cur.fetchall())


@pytest.mark.parametrize(
    ("href", "kind"),
    [("/LLMS.txt?a", "llms"), ("https://x.example/llms-full.txt#b", "llms_full"), ("facts.json", "facts"), ("/xfacts.json", None), ("/a.md.txt", "markdown"), ("/a.md?x.html", "markdown"), ("/feed", "feed"), ("feed", None), ("/sitemap.xml", "sitemap"), ("/a/robots.txt", "robots"), ("", None), (None, None)],
)
def test_kind_of_link(spark, href, kind):
    row = spark.createDataFrame([(href,)], "href string").select(surfaces.kind(surfaces.F.col("href")).alias("k")).first()
    assert row.k == kind


SKILL = {k: "x" for k in surfaces.SKILL_FIELDS}


@pytest.mark.parametrize(
    ("capability", "text", "reason"),
    [
        ("declares_agent_skills", "{", "invalid JSON"),
        ("declares_agent_skills", "[1]", "root must be a JSON object"),
        ("declares_agent_skills", "7", "root must be a JSON object"),
        ("declares_agent_skills", "{}", "missing top-level `$schema` field"),
        ("declares_agent_skills", '{"$schema": 1, "skills": {}}', "missing `skills` array"),
        ("declares_agent_skills", json.dumps({"$schema": 1, "skills": [SKILL, 3]}), "skills[1] must be an object"),
        ("declares_agent_skills", json.dumps({"$schema": 1, "skills": [SKILL, {"name": 1}]}), "skills[1] missing required field `type`"),
        ("declares_agent_skills", json.dumps({"$schema": 1, "skills": [SKILL]}), None),
        ("declares_agent_skills", '{"$schema": 1, "skills": []}', None),
        ("declares_mcp", '{"serverInfo": []}', "missing `serverInfo` object"),
        ("declares_mcp", '{"serverInfo": {"name": "n"}}', "serverInfo missing required field `version`"),
        ("declares_mcp", '{"serverInfo": {"name": "n", "version": "1"}}', None),
        ("declares_api", "{}", "missing `linkset` array"),
        ("declares_api", '{"linkset": []}', "`linkset` array is empty"),
        ("declares_api", '{"linkset": [{"anchor": 1}, {}]}', "linkset[1] missing required `anchor`"),
        ("declares_api", '{"linkset": [{"anchor": 1}]}', None),
    ],
)
def test_shape_of_well_known_files(spark, capability, text, reason):
    row = spark.createDataFrame([(capability, text)], "c string, t string").select(surfaces.invalid(surfaces.F.col("c"), surfaces.F.col("t")).alias("r")).first()
    assert row.r == reason


def test_missing_well_known_files(spark):
    """A file without a text is passed over for the next place; repeated rows and odd paths do no harm."""
    declared = spark.createDataFrame([("a", "declares_mcp", "s"), ("b", "declares_mcp", "s"), ("a", "declares_oauth", "t"), ("b", "declares_bot_identity", "u")], DECLARED)
    card = '{"serverInfo": {"name": "n"}}'
    files = spark.createDataFrame([("b", ".well-known/mcp/server-card.json", None), ("b", ".well-known/mcp.json", card), ("b", ".well-known/mcp.json", card), ("a", None, "x"), (None, ".well-known/mcp.json", "{}"), ("a", ".well-known/openid-configuration", None)], PATHS)
    found = surfaces.well_known_findings(declared, files).collect()
    assert {(r.site, r.rule_id, r.path) for r in found} == {("a", "SRF015", "crawl/.well-known/mcp/server-card.json"), ("b", "SRF016", "crawl/.well-known/mcp.json"), ("a", "SRF026", "crawl/.well-known/oauth-protected-resource")}
    assert next(r.message for r in found if r.rule_id == "SRF015").endswith("at any standard path (signal: s)")
    assert surfaces.well_known_findings(declared.limit(0), files.limit(0)).count() == 0


def test_headers(spark):
    pages = spark.createDataFrame([("a", "", "h"), ("a", "x", "px"), ("b", "", "h"), ("b", "y", "py"), ("c", "", "h"), (None, "", "h")], "site string, route string, path string")
    listed = spark.createDataFrame([("a", "x"), ("b", ""), ("b", "y")], "site string, route string")
    robots = spark.createDataFrame([("a",), ("b",), ("a",)], "site string")
    headers = spark.createDataFrame([("a", "", "Content-Type", "t"), ("a", "x", "X-Robots-TAG", "NoIndex"), ("a", "x", "x-robots-tag", "noindex"), ("b", "", "Link", None), ("b", "", "x-robots-tag", "noindex"), ("b", "y", "x-robots-tag", "none, noindex"), ("c", None, None, None)], HEADERS)
    found = {(r.site, r.rule_id, r.path) for r in surfaces.header_findings(pages, headers, listed, robots).collect()}
    assert found == {("a", "LNK020", "h"), ("a", "ROB008", "px")}, "all of b is noindex, c sends nothing"
    assert surfaces.header_findings(pages.limit(0), headers.limit(0), listed, robots).count() == 0


def test_audit_reads_files_and_headers(spark):
    page = "<html lang='en'><head><title>{0} of it</title>{1}</head><body><h1>x</h1>{2}</body></html>"
    rows = [("https://a.example/", "", ""), ("https://a.example/b", "", "<a href='/b.md'>m</a>"), ("https://a.example/c", "", ""), ("https://a.example/api/d", "<link rel=\"alternate\" type=\"text/markdown\" href=\"/d.txt\">", "")]
    pages = spark.createDataFrame([(i, url, page.format(i, head, body)) for i, (url, head, body) in enumerate(rows)], "page_id long, url string, html string")
    files = spark.createDataFrame([("a.example", "llms", "# A\n## Skills\n[x](/gone.md) [y](/c.md) [z](/llms.txt)"), ("a.example", "c.md", None), ("a.example", "facts.json", "{}"), ("a.example", ".well-known/mcp/x", None)], FILES)
    headers = spark.createDataFrame([("a.example", "", "Server", "s")], HEADERS)
    rows = audit(spark, pages, files, {"agent_discovery": {"enabled": True}}, headers).collect()
    assert {r.rule_id: r.scope for r in rows if r.rule_id in ("SRF004", "SRF006", "LNK020", "AGT001")} == {"SRF004": "page", "SRF006": "sitewide", "LNK020": "sitewide", "AGT001": "sitewide"}
    found = {(r.rule_id, r.path) for r in rows}
    mine = {(r, p) for r, p in found if r[:3] in ("SRF", "AGT") or r == "LNK020"}
    assert mine == {
        ("SRF004", "crawl/index.html"), ("SRF005", "crawl/c/index.html"), ("SRF006", "llms.txt"),
        ("SRF010", "crawl/.well-known/agent-skills/index.json"), ("SRF015", "crawl/.well-known/mcp/server-card.json"), ("SRF020", "crawl/.well-known/api-catalog"),
        ("AGT001", "."), ("AGT002", "."), ("LNK020", "crawl/index.html"),
    }
    bare = {r.rule_id for r in audit(spark, pages).collect()}
    assert {"SRF001", "SRF020"} <= bare and not bare & {"AGT001", "LNK020", "SRF003"}
