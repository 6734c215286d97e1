"""Facts of a site by hand, pages held against them, scores with and without other sites' records, and engine against engine on more pages."""

import duckdb
import pytest

from spanlight.functions import json_ld
from spanlight.operators import facts, intelligence
from spanlight.plans import oracle_sql, queries
from spanlight.plans.catalogue import parsed_pages

SF = "/root/testdata/sf0.01"
LARGER = ["evidence_routes", "route_scores_trust", "facts_mismatches", "link_suggestions"]
ROWS = "site string, kind string, term string, preferred string, position int"


def plain(rows):
    return sorted(tuple("-" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", LARGER)
def test_same_as_duckdb_on_more_pages(spark, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    cur = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert plain(queries()[name](spark, SF).select(*columns).collect()) == plain(cur.fetchall())


def ld(text):
    return f'<script type="application/ld+json">{text}</script>'


PAGES = {
    "": '<title>Acme | Home</title><meta name="description" content="Open source terminal tools. Acme open source terminal tools"><meta property="og:description" content="local coding agents"><link rel="canonical" href="https://Acme.example:8/x"><h1>Acme Tools</h1>' + ld('{"@type": "Organization", "name": "Acme", "url": "https://acme.example/about"}'),
    "blog": '<title>Blog — Acme News of the week for all who read it</title><h1>Blog</h1>',
    "blog/1": "<title>Why we like cats</title><h1>Cats</h1><p>acme likes Cats, not RoboDogs</p>",
    "features/b": "<title>Bees | Acme</title>" + ld('{"@type": "Product", "name": "Bee Box"}') + ld('{"@type": "Person", "name": "Ann"}'),
    "features/a": "<title>x</title><h1>Ants</h1><h1>More</h1>",
    "gone": "<title>404 Page not found</title><h1>Acme</h1>",
}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Pages of a site as page_facts gives them, written once."""
    made = {}

    def read(pages, site="acme.example"):
        key = str(pages)
        if key not in made:
            rows = [(k, f"https://{site}/{route}", html) for k, (route, html) in enumerate(pages.items())]
            json_ld.register(spark)
            parsed = parsed_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), False)
            walked = parsed.selectExpr("site", "path", "walk_json_ld(ld) AS w").select("site", "path", "w.vals")
            made[key] = str(tmp_path_factory.mktemp("facts") / "pages")
            facts.page_facts(parsed, walked).write.parquet(made[key])
        return spark.read.parquet(made[key])

    return read


def test_a_draft_by_hand(table):
    found = facts.manifest(table(PAGES)).collect()
    assert len(found) == 1
    site = found[0]
    # Home: "Acme" 5 by the title and 4 by JSON-LD, "Acme Tools" 4; "Home" is no name.
    assert (site.organization, site.aliases) == ("Acme", ["Acme", "Acme Tools"])
    # 5 for the canonical link's root, 3 for the declared one's: the same but for the port.
    assert site.website == "https://acme.example" and site.category == "product"
    assert (site.product, site.product_found) == ("Bee Box", True)
    assert site.features == ["Ants", "Bees"]
    # "open source terminal": 4 + 4, two anchors and more; what shares its words is passed over.
    assert site.descriptors[0] == "open source terminal" and "local coding agents" in site.descriptors and len(site.descriptors) <= 6
    drafts = facts.manifest(table(PAGES))
    curated = facts.curated(drafts).collect()[0]
    assert curated.aliases == ["Acme Tools"] and len(curated.descriptors) <= 4
    checked = facts.validation(drafts).collect()[0]
    assert (checked.valid, checked.errors, checked.warnings) == (True, [], [])


def test_sites_without_a_home_page_or_a_name(table):
    elsewhere = facts.manifest(table({"a": "<title>One Two | Site</title>", "b": "<title>Three | Site</title>", "c": "<title>404</title><h1>Error One</h1>"})).collect()[0]
    assert (elsewhere.organization, elsewhere.product, elsewhere.product_found, elsewhere.aliases, elsewhere.descriptors) == ("Site", "Site", False, [], [])
    none = facts.manifest(table({"a": "<p>x</p>"})).collect()[0]
    assert none.organization is None and none.product is None and none.features == []
    assert facts.validation(facts.manifest(table({"a": "<p>x</p>"}))).collect()[0].errors == ["no entity"]


def test_mentions_within_words_and_across_them(spark, table):
    pages = table({"a": "<p>geography of Cafés, e-mail</p>", "b": "<b>GEO</b> | x"})
    wanted = spark.createDataFrame([("acme.example", t) for t in ("geo", "Cafés, e", "mail</p", "| x", "|", "nowhere", "phy of", "GRA", "")] + [("other", "geo")], "site string, term string")
    found = {(r.path.split("/")[1], r.term) for r in facts.mentions(pages, wanted).collect()}
    texts = {"a": "<p>geography of cafés, e-mail</p>", "b": "<b>geo</b> | x"}
    terms = ("geo", "cafés, e", "mail</p", "| x", "|", "nowhere", "phy of", "gra")
    assert found == {(p, t) for p, text in texts.items() for t in terms if t in text}


def test_pages_against_facts_by_hand(spark, table):
    pages = table(PAGES)
    rows = spark.createDataFrame([("acme.example", "organization", "Acme", None, 0), ("acme.example", "website", "https://acme.example/about", None, 0), ("acme.example", "product", "Hive", None, 0), ("acme.example", "forbidden", "robodogs", "dogs", 0), ("acme.example", "preferred", "k", "Cats", 0)], ROWS)
    odd = facts.mismatches(pages, rows).collect()
    assert {(r.route, r.field, r.expected, r.observed) for r in odd} == {("blog/1", "terminology", "dogs", "robodogs"), ("blog/1", "title", "Acme", "Why we like cats")}
    got = facts.assessment(pages, rows, facts.mismatches(pages, rows)).collect()[0]
    # 100 less 2 * 4 for mismatches, 3 for a forbidden word, 6 as no block is a WebSite.
    assert (got.source, got.ceiling, got.score) == ("schema_and_manifest", 100, 83)
    assert (got.pages, got.pages_with_schema, got.organization_blocks, got.website_blocks, got.forbidden_hits) == (6, 2, 1, 0, 1)
    # "acme" in five pages of six, "cats" in one.
    assert got.preferred_hits == 6
    other = spark.createDataFrame([("acme.example", "organization", "Zed", None, 0), ("acme.example", "website", "https://zed.example", None, 0)], ROWS)
    whole = {(r.field, r.observed, r.severity) for r in facts.mismatches(pages, other).where("route = '(sitewide)'").collect()}
    assert whole == {("organization_schema.name", "Acme, Ann, Bee Box", "error"), ("organization_schema.url", "https://acme.example/about", "warning")}
    nothing = spark.createDataFrame([], ROWS)
    bare = facts.assessment(pages, nothing, facts.mismatches(pages, nothing)).collect()[0]
    assert (bare.source, bare.ceiling, bare.score, bare.mismatches) == ("schema", 79, 73, 0)
    assert facts.mismatches(pages.limit(0), nothing).count() == 0


def test_scores_by_hand(spark):
    ground = spark.createDataFrame([("a", "x", "generic", "generic", ["generic"], ["thin_answer_coverage"], 2, 3), ("a", "y", "generic", "generic", ["generic"], [], 0, 1)], "site string, route string, page_kind string, primary_intent string, intents array<string>, gaps array<string>, answer_blocks int, heading_count int")
    found = spark.createDataFrame([("a", "x", 50, 2, 30)], "site string, route string, readiness long, unsupported long, risk int")
    assessed = spark.createDataFrame([("a", 90)], "site string, score long")
    odd = spark.createDataFrame([("a", "x", "title", "A", "B", "warning")] * 2, "site string, route string, field string, expected string, observed string, severity string")
    issues = spark.createDataFrame([("a", "review", "u", "y", "descriptor_gap", "m"), ("a", "review", "u", "y", "route_not_in_site", "n"), ("a", "review", "u", None, "missing_canonical_entity", "o")], "site string, source_type string, url string, route string, kind string, message string")
    sources = spark.createDataFrame([("a", "review", 4, 3, 1)], "site string, source_type string, rows long, matched_routes long, offsite long")
    rows = {r.route: r for r in intelligence.route_scores(ground, found, assessed, odd).collect()}
    assert (rows["x"].truth, rows["x"].answer_pack, rows["x"].overall, rows["x"].blockers) == (70, 64, (50 * 40 + 70 * 35 + 64 * 25) // 100, "2 unsupported claims | thin_answer_coverage | truth_consistency_gap")
    assert (rows["y"].readiness, rows["y"].truth, rows["y"].answer_pack) == (75, 90, 64)
    trusted = intelligence.route_scores(ground, found, assessed, odd, issues)
    both = {r.route: r for r in trusted.collect()}
    assert both["x"].trust == 100 and both["y"].trust == 45 and both["y"].blockers == "external_trust_alignment_gap"
    assert both["y"].overall == (75 * 35 + 90 * 30 + 64 * 25 + 45 * 10) // 100
    site = intelligence.site_scores(trusted, assessed, issues, sources).collect()[0]
    assert (site.truth, site.trust, site.overall) == (90, 75 - 21, (62 * 35 + 90 * 30 + 64 * 25 + 54 * 10) // 100)
    first = intelligence.blockers(ground, found, odd, issues).collect()
    assert [(r.category, r.severity) for r in sorted(first, key=lambda r: r.place)] == [("evidence", 80), ("answer_pack", 65), ("truth", 65), ("truth", 65), ("trust", 60), ("trust", 45), ("trust", 35)]
    assert [(r.route, r.place) for r in intelligence.weakest_routes(trusted).orderBy("place").collect()] == [("x", 1), ("y", 2)]
