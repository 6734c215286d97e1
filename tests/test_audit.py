"""The audit's queries against DuckDB, and small pages worked out by hand."""

import os

import duckdb
import pytest

from spanlight.functions import json_ld
from spanlight.operators.parse import links, parsed, ranked
from spanlight.plans import oracle_sql, queries
from spanlight.plans.catalogue import Plan

SF = "/root/testdata/sf0.001"
CHECKED = ["page_parse", "page_links", "rules_page", "rules_blocks", "rules_links", "rules_images", "rules_alternates", "rules_assets", "rules_accessibility", "rules_robots", "rules_sitemap", "rules_llms", "rules_structured", "rules_optional", "audit_summary", "finding_scope", "finding_diff", "phase_percentiles"]


def plain(rows):
    return sorted(tuple("-" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("pages", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    found = queries()[name](spark, SF).select(*columns).collect()
    assert plain(found) == plain(cur.fetchall())


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
    assert not any(os.sep + "reference" in q for q in oracle_sql().values())


def page(spark, html, url="https://A.example/x/y/?q#f"):
    spark.createDataFrame([(1, url, html)], "page_id long, url string, html string").createOrReplaceTempView("one")
    return spark.sql(parsed("SELECT * FROM one")).first()


def test_page_columns(spark):
    html = "<html lang='fr'><head><title> </title><title>A <b>b</b>\u00a0c</title><meta name=\"Description\" content=\"\"><meta name='DESCRIPTION' content=' d '></head><body><article><h2>x</h2></article><a href=\"/et.?x\">go</a></body>"
    row = page(spark, html)
    assert (row.site, row.route, row.relative_path) == ("a.example", "x/y", "x/y/index.html")
    assert (row.title, row.description, row.html_lang) == ("A b c", "d", "fr")
    assert len(row.blocks) == 1 and row.answer_blocks == 0


def test_bytes_not_characters(spark):
    assert page(spark, "é" * 10).visible_bytes == 20


def test_article_is_no_link(spark):
    spark.createDataFrame([(1, "https://a/b", "<article><a href='/c'>t</a></article>")], "page_id long, url string, html string").createOrReplaceTempView("one")
    spark.sql(f"WITH parsed_pages AS ({parsed('SELECT * FROM one')}) {ranked('parsed_pages')}").createOrReplaceTempView("every_one")
    rows = spark.sql(links("every_one")).collect()
    assert [(r.href, r.target, r.text) for r in rows] == [("/c", "c", "t")]


def test_empty_and_null_pages(spark):
    assert page(spark, None).title is None
    assert page(spark, "").visible_bytes == 0
    assert page(spark, "<p>x", None).site is None


def findings(spark, pages, part, **files):
    """(rule, path) of a part's findings over hand-made pages of one site, whose files are as told."""
    plan = Plan(duckdb=False)
    rows = [(k, url, html) for k, (url, html) in enumerate(pages, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").createOrReplaceTempView("hand_pages")
    spark.sql(f"WITH parsed_pages AS ({parsed('SELECT * FROM hand_pages')}) {ranked('parsed_pages')}").createOrReplaceTempView("parsed_rich")
    json_ld.register(spark)
    for view, derived in plan.derived().items():
        spark.sql(derived).createOrReplaceTempView(view)
    text = plan.findings(part)
    if files:
        kinds = ", ".join(f"CAST({'NULL' if files.get(k) is None else 'unhex(' + repr(files[k].encode().hex()) + ')'} AS STRING) AS {k}_text" for k in ("robots", "sitemap", "llms"))
        head, rest = text.split("robots_lines AS", 1)
        text = f"{head}told AS (SELECT 'a.example' AS site, {kinds}), robots_lines AS{rest.replace('FROM artifacts', 'FROM told')}"
    return sorted((r.rule_id, r.path) for r in spark.sql(text + "SELECT * FROM findings").collect())


def test_alternates_not_returned(spark):
    there = '<link rel="alternate" hreflang="x-default" href="/b">'
    found = findings(spark, [("https://a.example/a", there), ("https://a.example/b", '<link rel="alternate" hreflang="x-default" href="/b">')], "alternate")
    assert found == [("SEO012", "crawl/a/index.html")]


def test_headings_and_ids(spark):
    html = '<h2>a</h2><h4>b</h4><script><h6 id="x"></script><h3>c</h3><header></header><p id="x"><p id="x"><p id="">'
    assert findings(spark, [("https://a.example/a", html)], "heading") == [("A11Y004", "crawl/a/index.html")]
    assert findings(spark, [("https://a.example/a", html)], "id") == [("A11Y003", "crawl/a/index.html")]


def test_controls(spark):
    html = '<a href="/x"> <b></b></a><abbr></abbr><a href="/x" aria-label="t"></a><button><img src="/i" alt="go"></button><button><img src="/i" alt=" "></button>'
    assert [r for r, _ in findings(spark, [("https://a.example/a", html)], "control")] == ["A11Y002", "A11Y002"]


def test_robots_groups(spark):
    page = [("https://a.example/a", "")]
    first = "User-agent: *\nAllow: /\nUser-agent: x\nAllow: /\nAllow: /\nAllow: /\nDisallow: /\nUser-agent: *\nDisallow: /a\nDisallow: /b # b\n\nDisallow: /c\nSitemap: s\nContent-Signal: ai-train=no\nUser-agent: GPTBot/1"
    assert [r for r, _ in findings(spark, page, "robots", robots=first)] == ["ROB007"]
    assert [r for r, _ in findings(spark, page, "robots", robots=None, llms="x")] == ["ROB001"]


def test_sitemap_kinds(spark):
    page = [("https://a.example/a", '<link rel="canonical" href="https://a.example/a">')]
    kinds = {" ": "MAP005", "<html>": "MAP006", "text": "MAP007", "<URLSET>": "MAP002", "<urlset>": "MAP003", "<urlset></urlset>": "MAP003"}
    for text, rule in kinds.items():
        assert [r for r, _ in findings(spark, page, "sitemap", sitemap=text)] == [rule]
    good = "<urlset><url><loc>https://a.example/{}</loc>{}</url></urlset>"
    assert findings(spark, page, "sitemap", sitemap=good.format("a", "<lastmod>2024-01-02T03:04:05Z</lastmod>")) == []
    assert [r for r, _ in findings(spark, page, "sitemap", sitemap=good.format("b", "<lastmod>2024-1-2</lastmod>"))] == ["MAP004", "MAP009"]
    assert [r for r, _ in findings(spark, page, "sitemap", sitemap=good.format("a", ""))] == ["MAP008"]
    assert [r for r, _ in findings(spark, page, "sitemap", robots="x")] == ["MAP001"]


def test_llms_sections_and_links(spark):
    pages = [("https://a.example/a", ""), ("https://a.example/features/b", "")]
    assert [r for r, _ in findings(spark, pages, "llms", llms="## Pages\n[x](a) [y](//a#z) [z](https://o.example/q)\n## Feature Pages (1)")] == []
    assert [r for r, _ in findings(spark, pages, "llms", llms="## Pages\n[x](gone.html)")] == ["LLM003", "LLM004", "LLM005"]
    assert [r for r, _ in findings(spark, pages, "llms", llms=" \n")] == ["LLM002"]


def test_blocks_in_groups(spark):
    html = '<section data-ui="faq"><h2>How</h2></section><section data-ui="faq"><h2>How</h2></section><article data-ui="x-card"></article><article data-ui="x-card"></article>' + "<section data-ui=\"p\"><h2>In 1999</h2>" + "word " * 40 + "</section>"
    found = [r for r, _ in findings(spark, [("https://a.example/a", html)], "block")]
    assert {r: found.count(r) for r in set(found) if r >= "GEO010"} == {"GEO010": 1, "GEO012": 1, "GEO013": 1}
    assert found.count("GEO003") == 1


def test_canonical_elsewhere_and_clusters(spark):
    same = '<title>Same page</title><meta name="description" content="d">'
    pages = [("https://a.example/a", same + '<link rel="canonical" href="https://o.example/b">'), ("https://a.example/b", same), ("https://b.example/b", same)]
    assert findings(spark, pages, "canonical") == [("SEO016", "crawl/a/index.html")]
    assert findings(spark, pages, "cluster") == [("SEO017", "crawl/a/index.html"), ("SEO017", "crawl/b/index.html")]


def ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


def test_json_ld_values():
    walk = json_ld.block_values
    assert walk("{") is None and walk("NaN") is None and walk('"\\ud800"') is None
    assert walk("[" * 127 + "]" * 127) is not None and walk("[" * 128 + "]" * 128) is None and walk("[" * 100000) is None
    assert walk("3") == [] and json_ld.page_values(None) == {"bads": [], "vals": []}
    found = walk('{"@type": ["A", 1, "B"], "x": {"name": null, "url": 3}}')
    assert sorted((v["depth"], v["key"], v["kind"], v["value"]) for v in found if v["value"] or v["kind"] != "item") == [(0, "@type", "array", None), (0, "@type", "item", "A"), (0, "@type", "item", "B"), (1, "name", "null", None), (1, "url", "other", None)]
    both = json_ld.page_values(['{"name": "a"}', "", "{", '{"name": "b"}'])
    assert both["bads"] == [2] and [v["obj"] for v in both["vals"]] == [0, 1]


def structured_rules(spark, cases):
    """The rules found on each case, a list of (host, route, html), and how many site-wide ones there are."""
    found = findings(spark, [(f"https://{host}.example/{route}", html) for host, route, html in cases], "structured")
    return {route: [r for r, path in found if path == f"crawl/{route}/index.html".replace("//", "/")] for _, route, _ in cases} | {"graph": sum(r == "SCH009" for r, _ in found)}


def test_structured_by_intent(spark):
    cases = {
        "": ("", ["SCH011"]),
        "docs/x": ("", ["SCH010", "SCH014"]),
        "docs/y": (ld('{"@type": "HowTo", "name": "a", "step": 1}'), []),
        "search": ("", ["SCH015"]),
        "privacy": (ld('{"publisher": {"@type": "Organization", "name": "n"}}'), ["SCH016"]),
        "tag/x": ('<a href="/y">y</a>' * 8, []),
        "tag/y": ('<a href="/y">y</a>' * 9, ["SCH012"]),
        "tag/z": ("<section></section>" * 4, ["SCH012"]),
        "product/x": (ld('{"@type": "Offer", "price": 1, "priceCurrency": "e"}'), ["SCH013"]),
        "product/y": ("<title>A manual</title>" + ld('{"@type": "SoftwareApplication", "name": "A manual"}'), ["SCH006", "SCH013"]),
    }
    found = structured_rules(spark, [("a", route, html) for route, (html, _) in cases.items()])
    assert found == {route: rules for route, (_, rules) in cases.items()} | {"graph": 0}


def test_structured_values(spark):
    article = ld('{"@type": "Article", "headline": "%s", "author": "Ann B", "datePublished": "2001-02-03"}')
    org = ld('{"@type": "Organization", "name": "%s", "url": "https://a.example/%s"}')
    canonical = '<link rel="canonical" href="https://a.example/%s">'
    cases = {
        "p0": ("a", "<title>The story, told</title>by ANN b in 2001" + canonical % "z" + article % "Story the", []),
        "p1": ("a", "<title>The story</title><noscript>Ann B 2001</noscript>" + article % "Other", ["SCH005", "SCH017", "SCH018"]),
        "p2": ("b", org % ("n", "p2") + canonical % "p2", []),
        "p3": ("b", org % (" n", "p2"), []),
        "p4": ("c", org % ("n", "p5") + canonical % "p4", ["SCH007"]),
        "p5": ("c", org % ("m", "p5"), []),
        "p6": ("d", ld("{", "", "[]"), ["SCH001"]),
        "p7": ("d", ld('{"x": {"y": {"@type": "Offer"}}}'), []),
        "p8": ("d", ld('{"x": {"@type": "Offer", "price": null}}'), ["SCH006"]),
    }
    found = structured_rules(spark, [(host, route, html) for route, (host, html, _) in cases.items()])
    assert found == {route: rules for route, (_, _, rules) in cases.items()} | {"graph": 1}
