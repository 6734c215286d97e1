"""The audit of given pages and site files under given settings."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.functions import json_ld
from spanlight.operators import artifacts, claims, identity, parse, positions, reports, sitemaps, surfaces
from spanlight.plans import surfaces_sql
from spanlight.plans.catalogue import Plan
from spanlight.sources.kept import fresh_folder

FILES = "site string, kind string, text string"
HEADERS = "site string, route string, name string, value string"
#: Settings that audit() reads.
KNOWN = {"agent_discovery", "policy", "route_kinds", "rules"}


def named_apart(text: str, mark: str) -> str:
    """The text with the names of an audit's views marked, so that audits of one session don't share any."""
    return re.sub(r"\b(parsed_rich|parsed_links|parsed_blocks|parsed_ld_facts|parsed_ld|site_files|site_map_sets|site_map_routes)\b", rf"\1_{mark}", text)


def audit(spark: SparkSession, pages: DataFrame, files: DataFrame | None = None, settings: dict | None = None, headers: DataFrame | None = None) -> DataFrame:
    """(site, rule_id, message, path, line, column, severity, suggestion, scope) of pages(page_id, url, html).

    ``files`` (site, kind, text) holds the sites' own files, of kind robots,
    sitemap or llms, or else with the path as the kind, such as
    ``.well-known/mcp.json`` or ``docs.md``; a site without one lacks it.
    ``headers`` (site, route, name, value) are the pages' response headers.
    ``settings`` may have ``rules`` with ``optional = true`` for the rules that
    are off unless asked for, ``agent_discovery`` with ``enabled = true``, and
    ``policy`` and ``route_kinds`` as in reports.apply_policy.  Parsed
    pages and what is derived from them are written to the session's shared
    folder, so each is computed once.  Findings over links, blocks,
    images and controls have their element's line and column, others 1 and 1;
    suggestions are null.  No pages give no findings.
    """
    settings = settings or {}
    if odd := sorted(set(settings) - KNOWN):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    mark, plan = uuid.uuid4().hex, Plan(duckdb=False, files=True)
    folder = fresh_folder(spark, "audit")

    def keep(frame: DataFrame, name: str) -> None:
        frame.write.parquet(f"{folder}/{name}")
        spark.read.schema(frame.schema).parquet(f"{folder}/{name}").createOrReplaceTempView(f"{name}_{mark}")

    pages.select("page_id", "url", "html").createOrReplaceTempView(f"pages_{mark}")
    (spark.createDataFrame([], FILES) if files is None else files.select("site", "kind", "text")).createOrReplaceTempView(f"site_files_{mark}")
    own = "SELECT site, CASE kind WHEN 'robots' THEN 'robots.txt' WHEN 'sitemap' THEN 'sitemap.xml' WHEN 'llms' THEN 'llms.txt' ELSE kind END AS path, text FROM site_files"

    def save(rows: DataFrame, name: str) -> DataFrame:
        keep(rows, f"sitemap_{name}")
        return spark.table(f"sitemap_{name}_{mark}")

    for rows, name in zip(sitemaps.sitemap_sets(spark.sql(named_apart(own, mark)), save), ("site_map_sets", "site_map_routes"), strict=True):
        rows.createOrReplaceTempView(f"{name}_{mark}")
    parsed = parse.parsed(f"SELECT * FROM pages_{mark}")
    keep(spark.sql(f"WITH parsed_pages AS ({parsed}) {parse.ranked('parsed_pages')}"), "parsed_rich")
    json_ld.register(spark)
    for name, text in plan.derived().items():
        keep(spark.sql(named_apart(text, mark)), name)
    parts = list(plan.parts()) + (list(plan.optional()) if settings.get("rules", {}).get("optional") else [])
    found = spark.sql(named_apart(f"{plan.findings(*parts)}, {plan.spots()} SELECT site, rule_id, severity, path, message, line, col FROM ({positions.located(plan)}) x", mark))
    head = f"WITH {plan.base()}, {artifacts.relations(plan)}"
    read = lambda text: spark.sql(named_apart(plan.sql(f"{head} {text}"), mark))
    site, links, known = spark.table(f"parsed_rich_{mark}").where("place = 1"), spark.table(f"parsed_links_{mark}").where("place = 1"), read(surfaces_sql.known(plan, f"({own})"))
    paths, llms = read(own), read("SELECT site, llms_text AS text FROM artifacts WHERE llms_text IS NOT NULL")
    sent = (spark.createDataFrame([], HEADERS) if headers is None else headers).select("site", "route", "name", "value")
    more = [
        claims.generic_findings(site),
        identity.identity_findings(site, spark.table(f"parsed_ld_{mark}")),
        surfaces.surface_findings(site, links, known, llms),
        surfaces.well_known_findings(surfaces.capabilities(site, spark.table(f"parsed_ld_{mark}"), paths, sent, llms), paths),
        surfaces.header_findings(site, sent, read("SELECT site, route FROM map_routes"), read("SELECT site FROM artifacts WHERE robots_text IS NOT NULL")),
    ]
    if settings.get("agent_discovery", {}).get("enabled"):
        more.append(surfaces.agent_findings(site, known))
    # Written, as scopes count what policy reads again.
    at_start = {c: F.lit(1).cast("long") for c in ("line", "col")}
    keep(found.unionByName(surfaces.union(more).withColumns(at_start)), "all_findings")
    found = spark.table(f"all_findings_{mark}")
    judged = reports.apply_policy(reports.with_scope(found), settings.get("policy", {}), settings.get("route_kinds"))
    return judged.select("site", "rule_id", "message", "path", "line", F.col("col").alias("column"), "severity", F.lit(None).cast("string").alias("suggestion"), "scope")
