"""A site's set of sitemaps: what its index files lead to, over many sites at once.

The frontier starts with every site's sitemap.xml.  A round reads its files:
an index names further files of the site by the last part of their addresses,
of which those that exist and have not been read are the next frontier.  A
file is read once however often it is named, so circles end; a round is one
join, and there are as many rounds as the deepest index has levels.  A file
that is neither an index nor a list makes the whole set of its site broken.
A site without a name or without sitemap.xml has no set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.functions.dialect import Spark, Text

ROOT = "sitemap.xml"
TEXT = Text(Spark())


def locations(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)<loc>(.*?)</loc>"), 1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def sitemap_sets(files: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(site, files_read, broken) of each site with a sitemap.xml among files(site, path, text), and (site, route) of its routes.

    ``save(rows, name)`` writes a round's rows and gives them back.
    """
    maps = files.where("site IS NOT NULL AND text IS NOT NULL AND path IS NOT NULL")
    maps = maps.select("site", "path", F.contains("text", F.lit("<sitemapindex")).alias("is_index"), F.contains("text", F.lit("<urlset")).alias("is_list"), locations(F.col("text")).alias("locs"))
    maps = save(maps.where((F.col("path") == ROOT) | F.col("is_index") | F.col("path").rlike(r"\.xml$") | F.col("is_list")).dropDuplicates(["site", "path"]), "maps")
    every = files.where("site IS NOT NULL AND text IS NOT NULL").select("site", "path").distinct()
    frontier, read, step = save(maps.where(F.col("path") == ROOT).select("site", "path"), "read0"), [], 0
    while not frontier.isEmpty():
        read.append(frontier)
        step += 1
        name = F.element_at(F.split(F.regexp_extract("loc", r"(?s)^([^?#]*)", 1), "/"), -1)
        named = maps.where("is_index").join(frontier, ["site", "path"]).select("site", F.explode("locs").alias("loc")).select("site", name.alias("path")).distinct().join(every, ["site", "path"], "left_semi")
        for seen in read:
            named = named.join(seen, ["site", "path"], "left_anti")
        frontier = save(named, f"read{step}")
    if not read:
        return frontier.select("site", F.lit(0).cast("long").alias("files_read"), F.lit(False).alias("broken")), frontier.select("site", F.col("path").alias("route"))
    reached = read[0]
    for more in read[1:]:
        reached = reached.union(more)
    rows = reached.join(maps, ["site", "path"], "left")
    # What was not kept as a map has neither mark.
    bad = ~F.coalesce("is_index", F.lit(False)) & ~F.coalesce("is_list", F.lit(False))
    sets = save(rows.groupBy("site").agg(F.count("*").alias("files_read"), F.max(bad).alias("broken")), "sets")
    listed = rows.where("is_list AND NOT is_index").join(sets.where("NOT broken").select("site"), "site", "left_semi").select("site", F.explode("locs").alias("loc"))
    routes = listed.select("site", F.expr(TEXT.urlish("loc")).alias("route")).where("route IS NOT NULL").distinct()
    return sets, routes
