"""Sets of sitemaps by hand: nested, circular, broken, missing."""

import pytest

from spanlight.operators.sitemaps import sitemap_sets
from spanlight.plans.audit import audit

KIND = "site string, path string, text string"


def index(*names):
    return "<sitemapindex>" + "".join(f"<sitemap><loc> https://a/maps/{n} </loc></sitemap>" for n in names) + "</sitemapindex>"


def listing(*routes):
    return "<urlset>" + "".join(f"<url><loc>https://a/{r}</loc></url>" for r in routes) + "</urlset>"


FILES = [
    ("deep", "sitemap.xml", index("one.xml?v=2", "two.xml#x", "gone.xml")), ("deep", "one.xml", index("three.xml", "sitemap.xml", "one.xml")), ("deep", "two.xml", listing("a", "b")), ("deep", "three.xml", listing("b", "c")), ("deep", "apart.xml", listing("no")),
    ("plain", "sitemap.xml", listing("x", "")), ("bad", "sitemap.xml", index("p.xml", "q.xml")), ("bad", "p.xml", listing("x")), ("bad", "q.xml", "<html>"), ("worse", "sitemap.xml", " "), ("none", "other.xml", listing("x")), (None, "sitemap.xml", listing("x")), ("null", "sitemap.xml", None),
    ("odd", "sitemap.xml", index("notes")), ("odd", "notes", "plain text"),
]


@pytest.fixture
def save(spark, tmp_path):
    def write(rows, name):
        rows.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return write


def test_sets_by_hand(spark, save):
    sets, routes = sitemap_sets(spark.createDataFrame(FILES, KIND), save)
    assert {(r.site, r.files_read, r.broken) for r in sets.collect()} == {("deep", 4, False), ("plain", 1, False), ("bad", 3, True), ("worse", 1, True), ("odd", 2, True)}
    assert sorted((r.site, r.route) for r in routes.collect()) == [("deep", "a"), ("deep", "b"), ("deep", "c"), ("plain", ""), ("plain", "x")]


def test_no_files(spark, save):
    sets, routes = sitemap_sets(spark.createDataFrame([], KIND), save)
    assert sets.count() == 0 and routes.count() == 0 and sets.columns == ["site", "files_read", "broken"]


def test_audit_follows_an_index(spark):
    """A page that only a nested list names is listed."""
    page = "<html lang='en'><head><title>Of it</title><link rel='canonical' href='https://a.example/{}'></head></html>"
    pages = spark.createDataFrame([(1, "https://a.example/x", page.format("x")), (2, "https://a.example/y", page.format("y"))], "page_id long, url string, html string")
    files = lambda nested: spark.createDataFrame([("a.example", "sitemap", index("more.xml")), ("a.example", "more.xml", nested)], "site string, kind string, text string")
    found = lambda nested: sorted((r.rule_id, r.path) for r in audit(spark, pages, files(nested)).where("rule_id LIKE 'MAP%'").collect())
    assert found("<urlset><url><loc>https://a.example/x</loc><lastmod>2024-01-01</lastmod></url></urlset>") == [("MAP004", "crawl/y/index.html"), ("MAP008", "crawl/sitemap.xml")]
