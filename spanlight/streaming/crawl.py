"""A crawl that can be stopped and taken up again, over many sites at once.

Its state is a folder of tables, one for each step: (site, route, depth,
place) of the routes that the step found.  A step is done when its table is
committed, so a crawl that ends in the middle is taken up where it stood, and
a lost executor costs one step at most.  A route's place in its site's order
is breadth first, within a level by its letters; the first ``max_pages`` are
visited, what lies beyond waits.  A site with routes that wait is truncated
and goes no further; taken up with a higher bound it goes on from there, so
the places are those of one run.

Fetching is not done here: ``fetches`` has what each attempt gave.  A route is
tried at most 1 + ``retries`` times, until an attempt succeeds; only routes
that did are followed.  Null sites and routes take no part, repeated links and
starts count once, and no starts give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlight.operators.reports import best

STATE = "site string, route string, depth int, place long"
#: Messages of a route that cannot be fetched and of a crawl that is cut short; slowest routes told.
UNFETCHED, CUT, SLOWEST = "failed to fetch URL: ", "crawl stopped at max_pages={} after visiting {} pages; discovered at least {} internal routes, so graph-dependent findings may be incomplete", 5


def outcomes(fetches: DataFrame, retries: int) -> DataFrame:
    """(site, route, ok, attempts, fetch_ms, process_ms): how each route's attempts end, later ones than the budget or the first success left out."""
    known = fetches.where(F.col("attempt").between(1, 1 + retries) & F.col("site").isNotNull() & F.col("route").isNotNull())
    first = F.min(F.when(F.col("ok"), F.col("attempt")))
    ends = known.groupBy("site", "route").agg(F.coalesce(first, F.max("attempt")).alias("attempts"), first.isNotNull().alias("ok"))
    times = known.drop("ok").join(ends, ["site", "route"]).where("attempt <= attempts").groupBy("site", "route", "ok", "attempts")
    return times.agg(F.sum("fetch_ms").alias("fetch_ms"), F.sum("process_ms").alias("process_ms"))


class Crawl:
    """The state in a folder of a store that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, max_pages: int, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()):
        self.spark, self.folder, self.max_pages = spark, folder.rstrip("/"), max_pages
        self.include, self.exclude = include, exclude

    def steps(self) -> int:
        """How many steps are committed."""
        n = 0
        while self.committed(n):
            n += 1
        return n

    def committed(self, step: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/step={step}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def state(self, steps: int | None = None) -> DataFrame:
        """All routes found so far."""
        n = self.steps() if steps is None else steps
        paths = [f"{self.folder}/step={k}" for k in range(n)]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def allowed(self) -> Column:
        route, fits = F.col("route"), F.lit(True)
        if self.include:
            fits = F.exists(F.array(*map(F.lit, self.include)), lambda x: F.contains(route, x)) | (route == "")
        for x in self.exclude:
            fits = fits & ~F.contains(route, F.lit(x))
        return fits

    def advance(self, starts: DataFrame, edges: DataFrame, done: DataFrame, most: int | None = None) -> bool:
        """Take up to ``most`` steps, or all that are left; tells whether the crawl is at its end.

        ``starts`` has (site, route), ``edges`` (site, route, target) and
        ``done`` is what outcomes() gives.
        """
        links = edges.select("site", "route", "target").join(done.where("ok").select("site", "route"), ["site", "route"], "left_semi").distinct()
        n, taken = self.steps(), 0
        newest = None
        while most is None or taken < most:
            if n == 0:
                fresh = starts.select("site", "route").where("site IS NOT NULL AND route IS NOT NULL").where(self.allowed()).distinct().withColumns({"depth": F.lit(0), "base": F.lit(0).cast("long")})
            else:
                found = self.state(n)
                sites = found.groupBy("site").agg(F.max("place").alias("base"), F.max("depth").alias("deepest")).where(F.col("base") <= self.max_pages)
                if newest is not None:
                    sites = sites.join(newest.select("site").distinct(), "site", "left_semi")
                level = found.join(sites, "site").where("depth = deepest").select("site", "route", "base", "depth")
                reached = level.join(links, ["site", "route"]).select("site", F.col("target").alias("route"), (F.col("depth") + 1).alias("depth"), "base").where(F.col("route").isNotNull() & self.allowed()).distinct()
                fresh = reached.join(found.select("site", "route"), ["site", "route"], "left_anti")
            order = Window.partitionBy("site").orderBy("route")
            placed = fresh.select("site", "route", "depth", (F.col("base") + F.row_number().over(order)).alias("place"))
            placed.write.mode("overwrite").parquet(f"{self.folder}/step={n}")
            newest = self.spark.read.schema(STATE).parquet(f"{self.folder}/step={n}")
            n, taken = n + 1, taken + 1
            if newest.isEmpty():
                return True
        return False

    def visited(self) -> DataFrame:
        return self.state().where(F.col("place") <= self.max_pages)

    def truncated(self) -> DataFrame:
        """(site): sites whose crawl the bound cuts short; a higher bound makes them anew."""
        return self.state().where(F.col("place") > self.max_pages).select("site").distinct()

    def stats(self, done: DataFrame) -> DataFrame:
        """One row a site: visited, queued, failures, retries, mean times and pages a minute of fetching and processing."""
        seen = self.state().join(done, ["site", "route"], "left").withColumn("visited", F.col("place") <= self.max_pages)
        own = F.col("visited")
        many = lambda c: F.count_if(own & c)
        spent = lambda c: F.sum(F.when(own, F.coalesce(c, F.lit(0))).otherwise(0))
        rows = seen.groupBy("site").agg(
            many(F.lit(True)).alias("visited_pages"), F.count_if(~own).alias("queued_pages"), many(~F.coalesce("ok", F.lit(False))).alias("fetch_failures"), spent(F.col("attempts") - 1).alias("fetch_retries"), spent(F.col("fetch_ms")).alias("fetch_ms"), spent(F.col("process_ms")).alias("process_ms"),
        )
        mean = lambda c: F.expr(f"coalesce({c} div nullif(visited_pages, 0), 0)")
        return rows.withColumns({"average_fetch_ms": mean("fetch_ms"), "average_process_ms": mean("process_ms"), "pages_per_minute": F.expr("coalesce(visited_pages * 60000 div nullif(fetch_ms + process_ms, 0), 0)")})

    def slowest(self, done: DataFrame, top: int = SLOWEST) -> DataFrame:
        """(site, route, fetch_ms, process_ms, place): the routes of a site that took longest."""
        rows = self.visited().select("site", "route").join(done.select("site", "route", "fetch_ms", "process_ms"), ["site", "route"])
        return best(rows, ["site"], [F.desc(F.col("fetch_ms") + F.col("process_ms")), "route"], top)

    def findings(self, done: DataFrame) -> DataFrame:
        """CRW001 for visited routes that no attempt fetched, CRW003 for sites cut short."""
        failed = self.visited().join(done.where("ok"), ["site", "route"], "left_anti")
        path = F.when(F.col("route") == "", "crawl/index.html").otherwise(F.concat(F.lit("crawl/"), "route", F.lit("/index.html")))
        one = failed.select("site", F.lit("CRW001").alias("rule_id"), F.lit("error").alias("severity"), path.alias("path"), F.concat(F.lit(UNFETCHED + "https://"), "site", F.lit("/"), "route").alias("message"))
        counts = self.state().groupBy("site").agg(F.count_if(F.col("place") <= self.max_pages).alias("seen"), F.count("*").alias("known")).where("known > seen")
        head, after, end, rest = CUT.split("{}")
        told = F.concat(F.lit(f"{head}{self.max_pages}{after}"), F.col("seen").cast("string"), F.lit(end), F.col("known").cast("string"), F.lit(rest))
        return one.union(counts.select("site", F.lit("CRW003"), F.lit("warning"), F.lit("crawl/index.html"), told))
