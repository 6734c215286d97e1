"""Structured data that a site's pages could carry, its most linked routes, and what records of other sites say of it.

Each result is rows, not documents: a list's items are numbered and never
gathered.  Nulls: a page without a title goes by its first heading or its
route; a site without a name takes part in no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.functions.dialect import LOWER, UPPER, Spark, Text
from spanlight.operators.reports import best

#: Kinds of pages that are given no structured data.
BARE = ("admin", "legal", "feed", "not_found", "search", "utility")
#: Issues of records of other sites, with their messages.
NO_ROUTE = "first-party trust surface route {} does not exist in the audited site graph"
NO_LABEL = "record does not mention any canonical organization or product label"
NO_DESCRIPTOR = "record does not reflect any canonical product or organization descriptor"
TOP_ROUTES = 10
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
CHILD = r"(?s)^(?:(.*)/)?([^/]+)$"
TEXT = Text(Spark())


def title_case(slug: Column) -> Column:
    parts = F.filter(F.split(slug, "-"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.translate(F.substring(p, 1, 1), LOWER, UPPER), p.substr(F.lit(2), F.length(p)))), " ")


def schema_suggestions(pages: DataFrame) -> DataFrame:
    """(site, route, type, position, name, url, detail) of pages of one per route.

    A home page gets WebSite, whose detail is where a search page looks things
    up; others BreadcrumbList with an item for each level, ItemList over the
    routes one level below, and TechArticle for docs, whose detail is the
    description.  Position is 0 for what is no list's item.  One listing's
    children are numbered in one task, by a sort that spills.
    """
    base = F.concat(F.lit("https://"), "site")
    at = lambda route: F.concat(base, F.lit("/"), route)
    none = F.lit(None).cast("string")
    row = lambda kind, position, name, url, detail: (F.lit(kind).alias("type"), position.cast("long").alias("position"), name.alias("name"), url.alias("url"), detail.alias("detail"))
    pages = pages.select("site", "route", "page_kind", "title", F.get("h1_texts", F.lit(0)).alias("h1"), "description")
    chosen = pages.where((F.col("route") != "404") & ~F.col("page_kind").isin(*BARE))
    home, inner = chosen.where("page_kind = 'home'"), chosen.where("page_kind <> 'home'")

    searched = pages.where("page_kind = 'search'").select("site").distinct().withColumn("searched", F.lit(True))
    target = F.when(F.col("searched"), at(F.lit("search?q={search_term_string}")))
    websites = home.join(searched, "site", "left").select("site", "route", *row("WebSite", F.lit(0), F.coalesce("title", "h1", base), at(F.lit("")), target))

    first = inner.select("site", "route", *row("BreadcrumbList", F.lit(1), F.lit("Home"), at(F.lit("")), none))
    level = inner.select("site", "route", F.posexplode(F.split("route", "/")).alias("at", "part"), F.split("route", "/").alias("parts")).where("part <> ''")
    above = F.array_join(F.filter(F.slice("parts", F.lit(1), F.col("at") + 1), lambda x: x != ""), "/")
    level = level.select("site", "route", "at", "part", above.alias("above"))
    titles = pages.select("site", F.col("route").alias("above"), "title")
    crumbs = level.join(titles, ["site", "above"], "left").select("site", "route", *row("BreadcrumbList", F.col("at") + 2, F.coalesce(F.col("title"), title_case(F.col("part"))), at(F.col("above")), none))

    child = pages.select("site", F.col("route").alias("below"), "title", "h1", F.regexp_extract("route", CHILD, 1).alias("route"), F.regexp_extract("route", CHILD, 2).alias("part")).where("part <> ''")
    child = child.join(inner.select("site", "route"), ["site", "route"])
    nr = F.row_number().over(Window.partitionBy("site", "route").orderBy("below"))
    items = child.select("site", "route", *row("ItemList", nr, F.coalesce("title", "h1", title_case(F.col("part"))), at(F.col("below")), none))

    articles = inner.where("page_kind = 'docs'").select("site", "route", *row("TechArticle", F.lit(0), F.coalesce("title", "h1", title_case(F.col("route"))), at(F.col("route")), F.col("description")))
    return websites.union(first).union(crumbs).union(items).union(articles)


def top_routes(pages: DataFrame, links: DataFrame, top: int = TOP_ROUTES) -> DataFrame:
    """(site, route, inbound, title, place): a site's routes that most of its other files link to."""
    sources = links.where("target IS NOT NULL").select("site", F.col("target").alias("route"), F.col("relative_path").alias("source")).distinct()
    linked = pages.select("site", "route", "title", "relative_path").where("route <> '404'")
    inbound = sources.join(linked.select("site", "route", "relative_path"), ["site", "route"]).where("source <> relative_path").groupBy("site", "route").agg(F.count("*").alias("inbound"))
    rows = linked.join(inbound, ["site", "route"], "left").select("site", "route", F.coalesce("inbound", F.lit(0)).alias("inbound"), "title")
    return best(rows, ["site"], [F.desc("inbound"), "route"], top)


def judged(records: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Records (site, source_type, url, title, snippet, entity) with what is told of them.

    ``site`` is whom a record is about.  ``facts`` (site, kind, term,
    preferred) holds terms of kind label, descriptor and forbidden; a site's
    facts are a file of its own and gathered in a row.
    """
    term = F.translate(F.col("term"), UPPER, LOWER)
    of = lambda kind, what: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, what)))
    known = facts.where("term IS NOT NULL").groupBy("site").agg(of("label", term).alias("labels"), of("descriptor", term).alias("descriptors"), of("forbidden", F.struct(F.col("term"), F.coalesce("preferred", F.lit("")).alias("preferred"))).alias("forbidden"))
    routes = pages.select("site", "route", F.lit(True).alias("known_route")).distinct()
    text = F.translate(F.concat_ws(" ", "title", "snippet", "entity"), UPPER, LOWER)
    own = F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)) == F.col("site"), F.lit(False))
    rows = records.select("site", "source_type", "url", text.alias("text"), own.alias("own"), F.expr(TEXT.urlish("url")).alias("route"))
    return rows.join(known, "site", "left").join(routes, ["site", "route"], "left").withColumn("known_route", F.coalesce("known_route", F.lit(False)))


def trust_issues(records: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """(site, source_type, url, route, kind, message): what in records of other sites is at odds with a site and its facts, a row for each record and issue."""
    rows = judged(records, pages, facts)
    own_route = F.when(F.col("own"), F.col("route"))
    silent = lambda c: (F.coalesce(F.size(c), F.lit(0)) > 0) & ~F.coalesce(F.exists(c, lambda x: F.contains(F.col("text"), x)), F.lit(False))
    issue = lambda kind, route, message: F.struct(route.alias("route"), F.lit(kind).alias("kind"), message.alias("message"))
    before, after = NO_ROUTE.split("{}")
    said = F.filter("forbidden", lambda f: F.contains(F.col("text"), F.translate(f.term, UPPER, LOWER)))
    bad = F.transform(said, lambda f: issue("forbidden_terminology", own_route, F.concat(F.lit("record uses forbidden term '"), f.term, F.lit("' instead of preferred '"), f.preferred, F.lit("'"))))
    found = F.filter(F.array(
        F.when(F.col("own") & ~F.col("known_route"), issue("route_not_in_site", F.col("route"), F.concat(F.lit(before), F.coalesce("route", F.lit("(unresolved)")), F.lit(after)))),
        F.when(silent(F.col("labels")), issue("missing_canonical_entity", own_route, F.lit(NO_LABEL))),
        F.when(F.col("own") & silent(F.col("descriptors")), issue("descriptor_gap", F.col("route"), F.lit(NO_DESCRIPTOR))),
    ), lambda x: x.isNotNull())
    return rows.select("site", "source_type", "url", F.explode(F.concat(found, F.coalesce(bad, F.array().cast(found_type())))).alias("i")).select("site", "source_type", "url", "i.*")


def found_type() -> str:
    return "array<struct<route:string,kind:string,message:string>>"


def trust_sources(records: DataFrame, pages: DataFrame, facts: DataFrame) -> DataFrame:
    """(site, source_type, rows, matched_routes, offsite): records by source, those of a route that the site has, those from elsewhere."""
    return judged(records, pages, facts).groupBy("site", "source_type").agg(F.count("*").alias("rows"), F.count_if(F.col("own") & F.col("known_route")).alias("matched_routes"), F.count_if(~F.col("own")).alias("offsite"))
