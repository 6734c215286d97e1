"""What a page says that it is, and what of it says otherwise.

A page goes by its title, else its first heading, else the first name or
headline of its JSON-LD, of which only the outermost object of a block counts,
and only if its type is one that a page can be: a list's items are other
pages.  What differs from that, white space and case apart, is drift.  All of
it is in the page's own row; nothing is shuffled but the page's JSON-LD beside
it.  A page without any of these has no identity and no drift.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.functions.dialect import LOWER, UPPER

#: Types of a block's outermost object that say what the page is.
TYPES = (
    "Article", "BlogPosting", "NewsArticle", "TechArticle", "Report", "Book", "Course", "CreativeWork", "HowTo", "Recipe", "ImageObject", "VideoObject", "Movie", "Episode", "Organization", "Corporation",
    "EducationalOrganization", "GovernmentOrganization", "LocalBusiness", "NewsMediaOrganization", "NGO", "Person", "Product", "SoftwareApplication", "MobileApplication", "WebPage", "AboutPage", "ContactPage", "ProfilePage", "WebSite", "Service", "Event",
)
SOURCES = ("title", "h1", "schema_name", "schema_headline")


def low(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def normal(c: Column) -> Column:
    return low(F.trim(F.regexp_replace(c, r"\s+", " ")))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) == ""


def outermost(key: str) -> Column:
    """The strings under a key of the outermost objects that say what the page is, each once, in order."""
    typed = F.transform(F.filter("vals", lambda v: (v.key == "@type") & (v.depth == 0) & v.kind.isin("string", "item") & v.value.isin(*TYPES)), lambda v: v.block)
    found = F.filter("vals", lambda v: (v.key == key) & (v.depth == 0) & (v.kind == "string") & F.array_contains(typed, v.block))
    return F.array_distinct(F.transform(F.array_sort(F.transform(found, lambda v: F.struct(v.block.alias("block"), v.value.alias("value")))), lambda x: x.value))


def identities(pages: DataFrame, ld: DataFrame) -> DataFrame:
    """(site, path, route, identity, source, drift, agrees): drift is an array of (dimension, observed)."""
    none = F.array().cast("array<string>")
    said = ld.select("site", "path", outermost("name").alias("names"), outermost("headline").alias("headlines"))
    rows = pages.select("site", "path", "route", "title", F.get("h1_texts", F.lit(0)).alias("h1"), "og_title").join(said, ["site", "path"], "left").withColumns({"names": F.coalesce("names", none), "headlines": F.coalesce("headlines", none)})
    first = {"title": F.col("title"), "h1": F.col("h1"), "schema_name": F.get("names", F.lit(0)), "schema_headline": F.get("headlines", F.lit(0))}
    source = reduce(lambda otherwise, k: F.when(~blank(first[k]), k).otherwise(otherwise), reversed(SOURCES), F.lit("none"))
    rows = rows.withColumn("source", source)
    rows = rows.withColumn("identity", reduce(lambda otherwise, k: F.when(F.col("source") == k, first[k]).otherwise(otherwise), SOURCES, F.lit(None).cast("string")))
    told = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("dimension"), x.alias("observed")))
    every = F.concat(told("title", F.array("title")), told("h1", F.array("h1")), told("og_title", F.array("og_title")), told("schema_name", F.col("names")), told("schema_headline", F.col("headlines")))
    own = F.col("source").isin("title", "h1")
    differs = F.filter(every, lambda d: d.observed.isNotNull() & (normal(d.observed) != normal(F.col("identity"))) & ~(own & (d.dimension == F.col("source"))))
    kind = "array<struct<dimension:string,observed:string>>"
    drift = F.when(F.col("identity").isNull(), F.array().cast(kind)).otherwise(differs.cast(kind))
    return rows.select("site", "path", "route", "identity", "source", drift.alias("drift")).withColumn("agrees", F.size("drift") == 0)


def drift_rows(found: DataFrame) -> DataFrame:
    """(site, route, dimension, identity, observed), a row for each signal that differs."""
    return found.select("site", "route", "identity", F.explode("drift").alias("d")).select("site", "route", "d.dimension", "identity", "d.observed")


#: Types whose names a title may carry beside its own, least letters of such a name, kinds of pages that are not judged, and what is told.
ENTITIES, LEAST_NAME, UNJUDGED = ("SoftwareApplication", "Product", "Organization", "WebSite"), 3, ("search", "admin", "utility", "feed")
AT_ODDS = "core page facts do not align across title, H1, OpenGraph, and schema"


def entity_names() -> Column:
    """Names of what a page's outermost objects are about, in lower case, the longest first.

    A block that is a list has its items for outermost objects.
    """
    outer = lambda v: (v.depth == 0) | ((v.depth == 1) & ~F.exists("vals", lambda o: (o.block == v.block) & (o.depth == 0)))
    typed = F.transform(F.filter("vals", lambda v: (v.key == "@type") & v.kind.isin("string", "item") & v.value.isin(*ENTITIES) & outer(v)), lambda v: v.obj)
    names = F.transform(F.filter("vals", lambda v: (v.key == "name") & (v.kind == "string") & F.array_contains(typed, v.obj)), lambda v: normal(v.value))
    known = F.filter(F.array_distinct(names), lambda n: F.octet_length(n) >= LEAST_NAME)
    return F.transform(F.array_sort(F.transform(known, lambda n: F.struct((-F.octet_length(n)).alias("size"), n.alias("n")))), lambda x: x.n)


def without(text: Column, names: Column) -> Column:
    """A text without names, in their order."""
    return F.aggregate(names, normal(text), lambda left, n: normal(F.replace(left, n, F.lit(" "))))


def at_odds(a: Column, b: Column) -> Column:
    """Whether neither text holds the other and they share too few words."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    shared = F.size(F.array_intersect(words(a), words(b)))
    return (a != "") & (b != "") & ~F.contains(a, b) & ~F.contains(b, a) & (shared < F.least(F.size(words(a)), F.size(words(b)), F.lit(2)))


def identity_findings(pages: DataFrame, ld: DataFrame) -> DataFrame:
    """GEO009: pages some of whose signals are at odds with what they go by, names of their entities apart."""
    kinds, names = pages.select("site", "path", "page_kind"), ld.select("site", "path", entity_names().alias("entities"))
    rows = identities(pages, ld).where("NOT agrees").join(kinds, ["site", "path"]).join(names, ["site", "path"], "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    rows = rows.where(~F.col("page_kind").isin(*UNJUDGED)).withColumn("own", without(F.col("identity"), F.col("entities")))
    rows = rows.where(F.exists("drift", lambda d: at_odds(F.col("own"), without(d.observed, F.col("entities")))))
    return rows.select("site", F.lit("GEO009").alias("rule_id"), F.lit("warning").alias("severity"), "path", F.lit(AT_ODDS).alias("message"))
