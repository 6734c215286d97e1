"""Inputs of the audit from files: pages, exports of citations, records of other sites, earlier audits.

All are Spark readers and built-in expressions; nothing is listed or opened on
the driver, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names a column of a citation export may have, letters and digits only.
CITATION_NAMES = {
    "url": ("url", "page", "pageurl", "landingpage"),
    "query": ("query", "prompt", "keyword"),
    "citations": ("citations", "citationcount", "count"),
    "clicks": ("clicks",),
    "impressions": ("impressions",),
}
FINDINGS = "array<struct<rule_id:string,message:string,path:string,line:long,column:long,severity:string,suggestion:string,scope:string>>"
RECORD = ("source_type", "url", "title", "snippet", "entity", "observed_at")


def html_pages(spark: SparkSession, folder: str, site: str) -> DataFrame:
    """(page_id, url, html) of all files under a folder whose extension is exactly ``html``.

    A page's url is ``https://{site}/`` and its path there without a closing
    ``index.html``.  page_id is a hash of the path, so it does not depend on the
    order files are listed in.  Files without a byte are passed over, as Spark's
    readers do not give them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder)
    root = F.lit(folder.rstrip("/").partition("://")[2] or folder.rstrip("/"))
    relative = F.substring(F.col("path"), F.instr("path", root) + F.length(root) + 1, 1 << 30)
    route = F.regexp_replace(relative, r"(^|/)index\.html$", "$1")
    return found.select(F.xxhash64(relative).alias("page_id"), F.concat(F.lit(f"https://{site}/"), route).alias("url"), F.decode("content", "UTF-8").alias("html"))


def plain_name(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def named(rows: DataFrame, names: tuple[str, ...]) -> Column:
    """The first not empty of the columns that go by one of the names, in the names' order; null without any."""
    fits = [F.col(f"`{c}`") for n in names for c in rows.columns if plain_name(c) == n]
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in fits]) if fits else F.lit(None).cast("string")


def citations(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """(url, query, citations, clicks, impressions) of an export; rows without url go, and a row without a count counts once.

    JSON may be an array of rows or ``{"rows": [...]}``.
    """
    if form == "csv":
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        rows = spark.read.option("multiLine", True).json(path)
        if "rows" in rows.columns:
            rows = rows.select(F.explode("rows").alias("r")).select("r.*")
    number = {k: F.try_to_number(named(rows, CITATION_NAMES[k]), F.lit("999999999999999999")).cast("long") for k in ("citations", "clicks", "impressions")}
    text = {k: named(rows, CITATION_NAMES[k]) for k in ("url", "query")}
    out = rows.select(text["url"].alias("url"), text["query"].alias("query"), F.coalesce(number["citations"], F.lit(1)).alias("citations"), number["clicks"].alias("clicks"), number["impressions"].alias("impressions"))
    return out.where("url IS NOT NULL")


def records(spark: SparkSession, path: str) -> DataFrame:
    """What other sites say, from CSV: six named columns, and ``metrics`` with all others that hold whole numbers.

    A row without source_type or url is an error when it is read.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    others = [c for c in rows.columns if c not in RECORD]
    pairs = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").try_cast("long").alias("value")) for c in others]
    metrics = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.value.isNotNull())) if pairs else F.create_map().cast("map<string,bigint>")
    known = {c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string") for c in RECORD}
    needed = lambda c: F.when(known[c].isNull(), F.raise_error(F.lit(f"a record lacks {c}")).cast("string")).otherwise(known[c])
    return rows.select(*[(needed(c) if c in ("source_type", "url") else known[c]).alias(c) for c in RECORD], metrics.alias("metrics"))


def audit(spark: SparkSession, path: str) -> DataFrame:
    """The findings of earlier audits in JSON: each file has ``{"findings": [...]}`` or only the array."""
    text = spark.read.text(path, wholetext=True)
    both = F.coalesce(F.from_json(F.get_json_object("value", "$.findings"), FINDINGS), F.from_json("value", FINDINGS))
    f = F.col("f")
    return text.select(F.explode(both).alias("f")).select(
        f.rule_id.alias("rule_id"), f.message.alias("message"), f.path.alias("path"), F.coalesce(f.line, F.lit(1)).alias("line"), F.coalesce(f["column"], F.lit(1)).alias("column"),
        F.coalesce(f.severity, F.lit("error")).alias("severity"), f.suggestion.alias("suggestion"), F.coalesce(f.scope, F.lit("page")).alias("scope"),
    )
