"""Suggested structured data, linked routes and records of other sites, on hand-worked sites, and the same as in another engine."""

import duckdb
import pytest

from spanlight.operators import claims, suggestions
from spanlight.plans import oracle_sql, queries

SF = "/root/testdata/sf0.001"
PAGES = "site string, route string, page_kind string, title string, h1_texts array<string>, description string, relative_path string"
RECORDS = "site string, source_type string, url string, title string, snippet string, entity string"
FACTS = "site string, kind string, term string, preferred string"


def plain(rows):
    return sorted(tuple("-" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["schema_suggestions", "top_routes", "trust_issues", "trust_sources", "rules_claims", "finding_scopes", "finding_regressions"])
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    cur = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    found = plain(queries()[name](spark, SF).select(*columns).collect())
    assert found and found == plain(cur.fetchall())


def page(route, kind="generic", title=None, h1=(), description=None, site="a.example"):
    return (site, route, kind, title, list(h1), description, f"{route}/index.html" if route else "index.html")


def test_schema_suggestions(spark):
    rows = [page("", "home", h1=["H"]), page("search", "search"), page("my-docs", title="Docs"), page("my-docs/b-c", "docs", h1=["B"], description="d"), page("my-docs/a", "legal"), page("my-docs/x/y"), page("404", "not_found"), page("", "home", site=None), page("", "home", site="b.example")]
    found = plain(suggestions.schema_suggestions(spark.createDataFrame(rows, PAGES)).where("site = 'a.example'").drop("site").collect())
    top = "https://a.example/"
    crumb = lambda route, *items: [(route, "BreadcrumbList", "1", "Home", top, "-"), *((route, "BreadcrumbList", str(i + 2), name, top + url, "-") for i, (name, url) in enumerate(items))]
    assert found == sorted([
        ("", "WebSite", "0", "H", top, top + "search?q={search_term_string}"),
        *crumb("my-docs", ("Docs", "my-docs")), *crumb("my-docs/b-c", ("Docs", "my-docs"), ("B C", "my-docs/b-c")), *crumb("my-docs/x/y", ("Docs", "my-docs"), ("X", "my-docs/x"), ("Y", "my-docs/x/y")),
        ("my-docs", "ItemList", "1", "A", top + "my-docs/a", "-"), ("my-docs", "ItemList", "2", "B", top + "my-docs/b-c", "-"),
        ("my-docs/b-c", "TechArticle", "0", "B", top + "my-docs/b-c", "d"),
    ])
    assert suggestions.schema_suggestions(spark.createDataFrame([], PAGES)).count() == 0


def test_top_routes(spark):
    pages = spark.createDataFrame([page(""), page("a", title="A"), page("b"), page("404")], PAGES)
    links = spark.createDataFrame([("a.example", "b", "index.html"), ("a.example", "b", "index.html"), ("a.example", "b", "b/index.html"), ("a.example", "a", "index.html"), ("a.example", "a", "b/index.html"), ("a.example", None, "x"), ("a.example", "gone", "x")], "site string, target string, relative_path string")
    found = suggestions.top_routes(pages, links, 2).collect()
    assert sorted((r.place, r.route, r.inbound, r.title) for r in found) == [(1, "a", 2, "A"), (2, "b", 1, None)]
    assert suggestions.top_routes(pages.limit(0), links).count() == 0


def test_trust(spark):
    """Case of hosts and terms does not matter; records without a text, a url or a known site do no harm; repeated ones are told again."""
    pages = spark.createDataFrame([page("x")], PAGES)
    facts = spark.createDataFrame([("a.example", "label", "Acme", None), ("a.example", "descriptor", "fast", None), ("a.example", "forbidden", "Slow", "steady"), ("a.example", "label", None, None)], FACTS)
    rows = [("a.example", "news", "https://u@A.example:80/x?q", "ACME is Fast", None, None), ("a.example", "news", "https://a.example/gone", "acme", "SLOW", None), ("a.example", "blog", "https://o.example/x", None, None, None), ("a.example", "blog", "https://o.example/x", None, None, None), ("a.example", None, None, None, None, "acme"), ("z.example", "news", "https://z.example/x", "t", None, None), (None, "news", "https://z.example/x", "slow", None, None)]
    records = spark.createDataFrame(rows, RECORDS)
    found = sorted((r.url, r.kind, r.route) for r in suggestions.trust_issues(records, pages, facts).collect())
    gone, other = "https://a.example/gone", "https://o.example/x"
    assert found == [(gone, "descriptor_gap", "gone"), (gone, "forbidden_terminology", "gone"), (gone, "route_not_in_site", "gone"), (other, "missing_canonical_entity", None), (other, "missing_canonical_entity", None), ("https://z.example/x", "route_not_in_site", "x")]
    counted = {(r.site, r.source_type): (r.rows, r.matched_routes, r.offsite) for r in suggestions.trust_sources(records, pages, facts).collect()}
    assert counted == {("a.example", "news"): (2, 1, 0), ("a.example", "blog"): (2, 0, 2), ("a.example", None): (1, 0, 1), ("z.example", "news"): (1, 0, 0), (None, "news"): (1, 0, 1)}
    assert suggestions.trust_issues(records.limit(0), pages, facts.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "near"),
    [("It Needs Speed.", "needs speed."), ("needs speedo", None), ("needs speed 9", None), ("needs a team's speed", None), ('needs "speed"', None), ("needs 1 wants focus", "wants focus"), ("needs 1 and more of the many things that are told of at such a great length here; needs focus a b c d e f", "needs focus a b c d e"), ("designed for ease, needs growth", "needs growth"), ("needs " + "x" * 75 + " ease", "needs " + "x" * 75 + " ease"), ("needs " + "x" * 75 + " speed", None), ("", None), (None, None)],
)
def test_generic_copy(spark, text, near):
    rows = spark.createDataFrame([("a", "p", "generic", text), ("a", "q", "search", text)], "site string, path string, page_kind string, visible string")
    found = claims.generic_findings(rows).collect()
    assert [(r.path, r.message) for r in found] == ([("p", claims.BEFORE + near + claims.AFTER)] if near else [])
