"""Addresses that search engines are told of: batches, a ledger of attempts, and what is to be tried again.

Nothing is sent here.  ``batches`` packs each site's distinct addresses, in
their order, into payloads of MOST, of which only a site's last may have fewer.
An address's place in its site is that in its range of a sorted table and what
stands before the range, so no task sorts a site; PART payloads one after the
other are a part.  A batch is known by the digest of its addresses, so the same
addresses are the same batch whenever they are planned.  The ledger is only ever appended to, by runs
that replace themselves when they are written again.

Blank and null addresses are left out, repeated ones count once; a site
without a name has no batches.  No addresses give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlight.operators.reports import best
from spanlight.sources.kept import fresh_folder

#: Addresses of a payload; statuses from which a submission may be tried again.
MOST, BUSY, BROKEN = 10_000, 429, 500
#: Payloads of a part.
PART = 100
LEDGER = "submitted_at timestamp, attempt int, endpoint string, site string, digest string, urls array<string>, status_code int, error string"
ADDRESS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)"


def normalized(addresses: DataFrame) -> DataFrame:
    """(site, url), trimmed, not blank, each once."""
    rows = addresses.where("site IS NOT NULL").select("site", F.regexp_replace("url", r"^\s+|\s+$", "").alias("url"))
    return rows.where("url <> ''").distinct()


def rejected(addresses: DataFrame) -> DataFrame:
    """(site, url, error): addresses that a site must not submit."""
    rows = normalized(addresses).withColumns({"scheme": F.lower(F.regexp_extract("url", ADDRESS, 1)), "host": F.lower(F.regexp_extract("url", ADDRESS, 2))})
    errors = F.filter(F.array(
        F.when(F.col("host") == "", "invalid URL"),
        F.when((F.col("host") != "") & ~F.col("scheme").isin("http", "https"), "must use http or https"),
        F.when((F.col("host") != "") & (F.col("host") != F.col("site")), "is not owned by the site"),
    ), lambda x: x.isNotNull())
    return rows.select("site", "url", F.explode(errors).alias("error"))


def batches(addresses: DataFrame, most: int = MOST) -> DataFrame:
    """(site, part, number, digest, urls): payloads of the addresses that a site may submit, numbered in their order.

    The sorted addresses are written once, as they are counted and then numbered.
    """
    spark = addresses.sparkSession
    good = normalized(addresses).join(rejected(addresses).select("site", "url").distinct().hint("merge"), ["site", "url"], "left_anti")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = good.repartitionByRange("site", "url").sortWithinPartitions("site", "url").select("site", "url", F.spark_partition_id().alias("range"), inside.alias("at"))
    ranges.write.parquet(path := f"{fresh_folder(spark, 'addresses')}/rows")
    rows = spark.read.schema(ranges.schema).parquet(path)
    parts = rows.groupBy("site", "range").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    before = parts.select("site", "range", (F.sum("k").over(Window.partitionBy("site").orderBy("range")) - F.col("k") - F.col("first")).alias("before"))
    number = F.floor((F.col("before") + F.col("at")) / most).cast("int")
    packed = rows.join(before.hint("merge"), ["site", "range"]).groupBy("site", number.alias("number")).agg(F.array_sort(F.collect_list("url")).alias("urls"))
    return packed.select("site", F.floor(F.col("number") / PART).cast("int").alias("part"), "number", F.sha2(F.array_join("urls", "\n"), 256).alias("digest"), "urls")


def attempts(planned: DataFrame, ledger: DataFrame, endpoint: str) -> DataFrame:
    """Batches with the number of their next attempt at an endpoint."""
    made = ledger.where(F.col("endpoint") == endpoint).groupBy("site", "digest").agg(F.max("attempt").alias("made"))
    return planned.join(made, ["site", "digest"], "left").withColumn("attempt", (F.coalesce("made", F.lit(0)) + 1).cast("int")).drop("made")


def append(results: DataFrame, folder: str, run_id: str) -> None:
    """Add a run's results, of the columns of LEDGER; written again it replaces itself, so a lost run may simply be repeated."""
    results.select(*[c.split()[0] for c in LEDGER.split(", ")]).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/run_id={run_id}")


def latest(ledger: DataFrame) -> DataFrame:
    """Of each endpoint, site and batch the last attempt, with whether it succeeded or may be tried again."""
    rows = ledger.groupBy("endpoint", "site", "digest").agg(F.max_by(F.struct("submitted_at", "attempt", "urls", "status_code", "error"), "attempt").alias("last")).select("endpoint", "site", "digest", "last.*")
    good = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    # No status at all is a failure on the way.
    again = ~good & (F.col("status_code").isNull() | (F.col("status_code") == BUSY) | (F.col("status_code") >= BROKEN))
    return rows.withColumns({"success": good, "retryable": again})


def retries(ledger: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` batches of a site that are to be tried again, with their next attempt's number."""
    rows = latest(ledger).where("retryable").select("endpoint", "site", "digest", "urls", (F.col("attempt") + 1).alias("attempt"))
    return best(rows, ["site"], ["endpoint", "urls"], limit)
