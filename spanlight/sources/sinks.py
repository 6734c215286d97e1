"""Outputs of the audit: findings by run, SARIF documents, history of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the interchange format.
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"
#: Parts that the findings of one site are dealt to, so that a large site is not numbered by one task.
PARTS = 256
#: Runs that a history keeps.
TREND_RUNS = 50


def write_findings(findings: DataFrame, path: str, run_id: str) -> None:
    """One folder of JSON lines a run; a run that is written again replaces itself."""
    findings.write.mode("overwrite").json(f"{path.rstrip('/')}/run_id={run_id}")


def sarif_results(findings: DataFrame) -> DataFrame:
    """The findings with ``result``, each as a SARIF result in JSON; without line and column it is at 1, 1."""
    known = lambda c: F.coalesce(F.col(c), F.lit(1)) if c in findings.columns else F.lit(1)
    region = F.struct(known("line").alias("startLine"), known("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    level = F.when(F.col("severity") == "warning", "warning").otherwise("error")
    return findings.withColumn("result", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))))


def sarif_documents(findings: DataFrame, tool: str, most: int = 5000) -> DataFrame:
    """(site, part, number, value): SARIF documents of at most ``most`` results, by path, rule and message.

    All findings are in some document; those of one page are in the same part.
    """
    part = F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")
    order = Window.partitionBy("site", "part").orderBy("path", "rule_id", "message")
    rows = sarif_results(findings).select("site", part.alias("part"), "path", "rule_id", "message", "result").withColumn("nr", F.row_number().over(order))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nr", "result"))), lambda r: r.result)
    head = f'{{"version":"{SARIF_VERSION}","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":{{"driver":{{"name":"{tool}"}}}},"results":['
    return rows.groupBy("site", "part", F.floor((F.col("nr") - 1) / most).cast("int").alias("number")).agg(F.concat(F.lit(head), F.array_join(ordered, ","), F.lit("]}]}")).alias("value"))


def trend(history: DataFrame, run: DataFrame) -> DataFrame:
    """The newest TREND_RUNS of a history of (run_id, generated_at, total, errors, warnings) and one more run."""
    return history.unionByName(run).orderBy(F.desc("generated_at"), F.desc("run_id")).limit(TREND_RUNS)


def expired(runs: DataFrame, keep: int) -> DataFrame:
    """Of (command, run_id, generated_at) the runs past the newest ``keep`` of their command."""
    order = Window.partitionBy("command").orderBy(F.desc("generated_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(order)).where(F.col("place") > keep).drop("place")
