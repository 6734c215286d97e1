"""The order in which a crawler would reach pages: breadth first, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanlight.sources.kept import fresh_folder


def frontier(spark: SparkSession, starts: DataFrame, edges: DataFrame, max_pages: int, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(site, route, depth, place): the first max_pages routes of each site from its starts along edges.

    starts has (site, route), edges (site, route, target).  Within a level
    routes come in their own order.  A route holding one of exclude, or none of
    include if there are any, is not visited.  Each level is written, so a lost
    executor costs one level at most; the driver sees one number a level.
    """
    folder = fresh_folder(spark, "frontier")
    wanted = F.lit(True)
    if include:
        wanted = wanted & F.exists(F.array(*[F.lit(x) for x in include]), lambda x: F.contains(F.col("route"), x))
    for x in exclude:
        wanted = wanted & ~F.contains(F.col("route"), F.lit(x))
    order = Window.partitionBy("site").orderBy("route")

    def level(routes: DataFrame, depth: int, before: DataFrame | None) -> DataFrame:
        fresh = routes.where(wanted).distinct()
        if before is None:
            counted = fresh.withColumn("base", F.lit(0).cast("long"))
        else:
            taken = before.groupBy("site").agg(F.max("place").alias("base"))
            counted = fresh.join(before.select("site", "route"), ["site", "route"], "left_anti").join(taken, "site")
        placed = counted.select("site", "route", F.lit(depth).alias("depth"), (F.col("base") + F.row_number().over(order)).alias("place"))
        placed.where(F.col("place") <= max_pages).write.parquet(f"{folder}/level={depth}")
        return spark.read.parquet(f"{folder}/level={depth}")

    newest, depth = level(starts.select("site", "route"), 0, None), 0
    while not newest.isEmpty():
        depth += 1
        reached = newest.join(edges.select("site", "route", "target"), ["site", "route"]).select("site", F.col("target").alias("route"))
        newest = level(reached, depth, spark.read.parquet(f"{folder}/level=*").select("site", "route", "depth", "place"))
    return spark.read.parquet(f"{folder}/level=*").select("site", "route", "depth", "place")
