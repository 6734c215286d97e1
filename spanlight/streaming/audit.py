"""The page audit over a stream of page snapshots.

Pages arrive as Parquet files.  A micro-batch is parsed and judged by the same
SQL as in batch, and its pages and findings go to a folder named after the
batch, so that a batch that is run again after a failure replaces itself.  What
holds of a route is what its newest snapshot says: an older batch's findings of
a route that was seen again no longer count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanlight.operators.parse import parsed, ranked
from spanlight.plans.catalogue import Plan

PAGES = "page_id long, url string, html string"
#: Sites may have very many routes but a batch only so many files, which bounds its size.
FILES_A_BATCH = 64


def judged(spark: SparkSession, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, findings) of page-local rules; of a route that comes twice in the batch one snapshot counts, as in batch."""
    pages.createOrReplaceTempView("stream_pages")
    spark.sql(f"WITH parsed_pages AS ({parsed('SELECT * FROM stream_pages')}) {ranked('parsed_pages')}").createOrReplaceTempView("parsed_rich")
    seen = spark.table("parsed_rich").where("place = 1").select("site", "route", "path")
    return seen, spark.sql(Plan(duckdb=False).findings("page") + "SELECT * FROM findings")


def run(spark: SparkSession, pages_dir: str, out: str, files: int = FILES_A_BATCH) -> None:
    """Judges all files that have not been judged yet, then stops; out keeps the progress."""

    def one(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession.newSession()
        kept = session.read.schema(PAGES).parquet(_saved(batch, f"{out}/raw/batch={batch_id}"))
        for frame, name in zip(judged(session, kept), ("pages", "findings")):
            _saved(frame, f"{out}/{name}/batch={batch_id}")

    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(pages_dir)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def _saved(frame: DataFrame, path: str) -> str:
    frame.write.mode("overwrite").parquet(path)
    return path


def current(spark: SparkSession, out: str) -> DataFrame:
    """(site, rule_id, severity, path, message) of each route's newest snapshot; a route without a row is clean."""
    newest = Window.partitionBy("site", "route").orderBy(F.desc("batch"))
    pages = spark.read.parquet(f"{out}/pages").withColumn("age", F.row_number().over(newest)).where("age = 1").select(F.col("site").alias("s"), F.col("path").alias("p"), F.col("batch").alias("b"))
    found = spark.read.parquet(f"{out}/findings")
    fits = found.site.eqNullSafe(pages.s) & found.path.eqNullSafe(pages.p) & (found.batch == pages.b)
    return found.join(pages, fits, "left_semi").drop("batch")
