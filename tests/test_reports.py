"""The audit of given input, reports worked out by hand, and what pages answer and claim."""

import datetime
import subprocess
import sys

import duckdb
import pytest

from spanlight.operators import intelligence, reports
from spanlight.plans import oracle_sql, queries
from spanlight.plans.audit import audit
from spanlight.sources.config import settings
from spanlight.sources.files import html_pages

SF = "/root/testdata/sf0.001"
NEW = ["summary_counts", "rule_mix", "finding_clusters", "repeated_issues", "policy_applied", "finding_diff", "opportunity_score", "performance_diff", "performance_budget", "phase_percentiles", "grounding_routes", "evidence_routes", "intelligence_blockers", "fanout_queries"]
FINDING = "site string, rule_id string, severity string, path string, message string"


def plain(rows):
    return sorted(tuple("-" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NEW)
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("pages", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert plain(queries()[name](spark, SF).select(*columns).collect()) == plain(cur.fetchall())


def test_audit_of_a_folder(spark, tmp_path):
    """Two pages, of which one lacks a description and links to a page that the site hasn't."""
    (tmp_path / "site/about").mkdir(parents=True)
    (tmp_path / "site/index.html").write_text("<html lang='en'><head><title>Start of it</title></head><body><h1>x</h1><a href='/missing'>gone</a></body></html>")
    (tmp_path / "site/about/index.html").write_text("<html lang='en'><head><title>About it</title><meta name='description' content='d'></head><body><h1>x</h1><a href='/'>back</a></body></html>")
    (tmp_path / "a.toml").write_text("[policy]\nignore_rules = ['SOC006']\n[policy.severity_overrides]\nSEO002 = 'warning'\n[route_kinds.info]\nmatch = ['about/']\nskip_rules = ['CNT001']\n")
    pages = html_pages(spark, str(tmp_path / "site"), "a.example")
    files = spark.createDataFrame([("a.example", "robots", "User-agent: GPTBot\nDisallow:\nSitemap: /sitemap.xml\nContent-Signal: ai-train=no"), ("a.example", "sitemap", "<urlset><url><loc>https://a.example/</loc><lastmod>2024-01-01</lastmod></url></urlset>")], "site string, kind string, text string")
    every = {(r.rule_id, r.path, r.severity) for r in audit(spark, pages, files).collect()}
    assert ("SEO002", "crawl/index.html", "error") in every and ("LNK001", "crawl/index.html", "error") in every
    assert ("SEO002", "crawl/about/index.html", "error") not in every and ("LLM001", "crawl/llms.txt", "error") in every
    assert not {r for r, _, _ in every} & {"ROB001", "ROB002", "ROB010", "ROB011", "MAP001", "MAP008", "SEO008", "SOC007"}
    some = audit(spark, pages, files, settings(tmp_path / "a.toml")).collect()
    assert {(r.severity, r.scope) for r in some if r.rule_id == "SEO002"} == {("warning", "page")}
    assert {r.path for r in some if r.rule_id == "CNT001"} == {"crawl/index.html"} and "SOC006" not in {r.rule_id for r in some}
    assert "SOC007" in {r.rule_id for r in audit(spark, pages, None, {"rules": {"optional": True}}).collect()}
    assert audit(spark, pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unknown settings"):
        audit(spark, pages, None, {"polices": {}})


def test_audit_runs_where_workers_lack_the_library(tmp_path):
    """From another folder, with the library on the driver's path only."""
    code = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", __spark_entry__.queries()["rules_structured"](spark, "/root/testdata/sf0.001").count())
"""
    root = __file__.rsplit("/tests/", 1)[0]
    out = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert int(out.stdout.split("ROWS ")[1]) > 0, out.stderr[-2000:]


@pytest.fixture(scope="module")
def findings(spark):
    rows = [("a", "SEO001", "error", f"crawl/p{k}/index.html", "m") for k in range(7)] + [("a", "GEO011", "warning", "crawl/index.html", "g"), ("a", "GEO011", "warning", "crawl/x/index.html", "g"), ("b", "SEO001", "error", "crawl/index.html", "m"), ("b", "A11Y001", "warning", "crawl/index.html", "i"), (None, "ROB001", "warning", "crawl/robots.txt", "r")]
    return spark.createDataFrame(rows, FINDING)


def test_reports_by_hand(findings):
    rows = lambda df, *c: {tuple(r[k] for k in c) for r in df.collect()}
    assert rows(reports.summary(findings), "site", "total", "errors", "warnings", "actionable", "heuristic") == {("a", 9, 7, 2, 7, 2), ("b", 2, 1, 1, 2, 0), (None, 1, 0, 1, 1, 0)}
    layers = rows(reports.by_layer(findings), "site", "layer", "total")
    assert len(layers) == 15 and ("a", "citability", 9) in layers and ("b", "accessibility", 1) in layers and (None, "retrievability", 1) in layers and ("a", "accessibility", 0) in layers
    assert rows(reports.with_scope(findings), "site", "rule_id", "scope") == {("a", "SEO001", "template"), ("a", "GEO011", "page"), ("b", "SEO001", "page"), ("b", "A11Y001", "page"), (None, "ROB001", "sitewide")}
    clusters = {(r.site, r.rule_id): (r.n, r.examples) for r in reports.clusters(findings).collect()}
    assert clusters["a", "SEO001"] == (7, " | ".join(f"crawl/p{k}/index.html" for k in range(5))) and clusters[None, "ROB001"] == (1, "crawl/robots.txt")
    assert rows(reports.repeated(findings), "site", "kind", "rule_id", "n") == {("a", "actionable", "SEO001", 7), ("a", "heuristic", "GEO011", 2)}


def test_policy_by_hand(findings):
    policy = {"ignore_paths": ["", "p1/"], "suppressions": [{"rule_id": "SEO001", "path_pattern": "p2/"}, {"rule_id": "SEO001", "path_pattern": "p3/", "expires": "2024-01-01"}, {"rule_id": "SEO001", "path_pattern": "p4/", "expires": "2024-01-02"}, {"rule_id": "GEO011", "path_pattern": " "}]}
    kinds = {"all": {"match": ["index"], "skip_rules": ["GEO011", "A11Y001"]}}
    left = {(r.site, r.rule_id, r.path) for r in reports.apply_policy(findings, policy, kinds, datetime.date(2024, 1, 2)).collect()}
    assert {p for s, r, p in left if s == "a"} == {f"crawl/p{k}/index.html" for k in (0, 3, 5, 6)}
    assert ("b", "A11Y001", "crawl/index.html") in left and (None, "ROB001", "crawl/robots.txt") in left


def test_opportunities_and_trend_by_hand(spark, findings):
    cited = spark.createDataFrame([("https://a/p1", 3), ("https://a/p1", 2), ("https://a/none?q", 1), ("https://B/", 1)], "url string, citations long")
    found = {r.url: (r.route, r.citations, r.rows, r.audit_errors, r.matched, r.score, r.priority) for r in reports.opportunities(cited, findings).collect()}
    assert found == {"https://a/p1": ("p1", 5, 2, 1, True, 75, "medium"), "https://a/none?q": ("none", 1, 1, 0, False, 80, "high"), "https://B/": ("", 1, 1, 1, True, 65, "medium")}
    kind = "site string, route string, citations long"
    trend = reports.citation_trend(spark.createDataFrame([("a", "docs", 2), ("a", "old", 1), ("a", "same", 4)], kind), spark.createDataFrame([("a", "docs", 5), ("a", "new", 1), ("a", "same", 4)], kind))
    assert {r.route: (r.delta, r.status) for r in trend.collect()} == {"docs": (3, "increased"), "old": (-1, "no_longer_cited"), "new": (1, "newly_cited"), "same": (0, "unchanged")}


def test_metrics_by_hand(spark):
    kind = "metric string, unit string, direction string, value long"
    low, high = "lower_is_better", "higher_is_better"
    a = spark.createDataFrame([("t", "ms", low, 100), ("u", "ms", low, 100), ("p", "pages/min", high, 50), ("z", "count", low, 0), ("gone", "ms", low, 1)], kind)
    b = spark.createDataFrame([("t", "ms", low, 111), ("u", "ms", low, 109), ("p", "pages/min", high, 60), ("z", "count", low, 1), ("new", "ms", low, 1)], kind)
    assert {r.metric: r.status for r in reports.metric_diff(a, b).collect()} == {"t": "regressed", "u": "unchanged", "p": "improved", "z": "regressed", "gone": "missing", "new": "missing"}
    assert {r.metric: r.status for r in reports.metric_diff(a, b, absolute=20).collect()}["t"] == "unchanged"
    assert {r.metric: r.status for r in reports.over_budget(a, {"t": 99, "u": 100, "none": 1}).collect()} == {"t": "over", "u": "within", "none": "unknown"}


def page(route, title, body, kind="generic"):
    return ("a", f"crawl/{route}", route, kind, f"<h1>{title}</h1>{body}", title, [title], ["b"])


def intel(spark, rows, blocks=()):
    pages = spark.createDataFrame(rows, "site string, path string, route string, page_kind string, html string, title string, h1_texts array<string>, blocks array<string>")
    block = spark.createDataFrame(list(blocks), "site string, path string, text string")
    ld = spark.createDataFrame([], "site string, path string, vals array<struct<obj:int,block:int,depth:int,key:string,kind:string,value:string>>")
    return pages, block, ld


def test_intents_topics_and_gaps_by_hand(spark):
    rows = [page("", "Contract Lifecycle Software | X", "<h2>What is contract lifecycle software</h2><h2>How to implement CLM</h2><p>Step 1 audit contracts."), page("compare/vs-other", "X vs other tools", "<h2>Overview</h2>"), page("cost", "Observe your agents", "<h2>Cost visibility</h2>")]
    found = {r.route: r for r in intelligence.grounding(*intel(spark, rows)).collect()}
    assert found[""].primary_topic == "contract lifecycle software" and set(found[""].intents) == {"definition", "procedural"}
    assert found["compare/vs-other"].primary_intent == "comparison" and "weak_comparison_structure" in found["compare/vs-other"].gaps
    assert found["cost"].intents == ["generic"] and found["cost"].heading_count == 2


def test_evidence_by_hand(spark):
    rows = [page("x", "t", ""), page("y", "t", "")]
    blocks = [("a", "crawl/x", "Our tool is faster than all of the others. Nothing here. It serves 30 percent of all users"), ("a", "crawl/y", "According to a study it is the best tool by far")]
    pages, block, _ = intel(spark, rows, blocks)
    links = spark.createDataFrame([("a", "crawl/y", "https://nasa.GOV:443/x", None), ("a", "crawl/y", "/z", "z")], "site string, path string, href string, target string")
    found = {r.route: r for r in intelligence.evidence(intelligence.evidence_sections(pages, block, links)).collect()}
    assert (found["x"].claims, found["x"].unsupported, found["x"].quality, found["x"].risk, found["x"].density) == (2, 2, 0, 68, 0)
    assert (found["y"].claims, found["y"].unsupported, found["y"].quality, found["y"].density) == (1, 0, 91, 100)
    assert found["y"].readiness == (100 * 65 + 91 * 35) // 100 - 10
