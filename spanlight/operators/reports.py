"""Reports over findings(site, rule_id, severity, path, message), each by site."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.operators import rules

LAYERS = ("retrievability", "citability", "absorbability", "entity_legitimacy", "accessibility")
CLASSES, CONFIDENCES = ("hard", "policy", "heuristic"), ("high", "medium", "low")
SCOPES = ("sitewide", "template", "page")
#: What makes a finding the same in two audits.
FINGERPRINT = ("site", "rule_id", "path", "line", "column", "message")
#: Findings of a rule with one message from which they are taken for a template's.
TEMPLATE = 3
#: Weights of an opportunity: a citation, an error, a warning, a page that the audit does not know; least scores of its bands.
CITED, ERROR, WARNING, UNKNOWN = 5, 50, 10, 75
BANDS = (("critical", 200), ("high", 80), ("medium", 40))


def is_error() -> Column:
    return F.col("severity") != "warning"


def is_heuristic() -> Column:
    return F.expr(rules.rule_class()) == "heuristic"


def counted(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def same(a: DataFrame, b: DataFrame, keys) -> Column:
    """Equality of keys, in which a null is a value."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"b_{k}"]) for k in keys])


def beside(a: DataFrame, b: DataFrame, keys, how: str = "left") -> DataFrame:
    """a with the columns of b for the same keys."""
    b = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    return a.join(b, same(a, b, keys), how).drop(*[f"b_{k}" for k in keys])


def best(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in an order, with their ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("site").agg(F.count("*").alias("total"), counted(is_error()).alias("errors"), counted(~is_error()).alias("warnings"), counted(~is_heuristic()).alias("actionable"), counted(is_heuristic()).alias("heuristic"))


def filled(findings: DataFrame, name: str, values, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates by site and the column ``name``, with a row of zeros for each value that a site lacks."""
    found = findings.groupBy("site", name).agg(*[a.alias(k) for k, a in aggregates.items()])
    every = findings.select("site").distinct().select("site", F.explode(F.array(*map(F.lit, values))).alias(name))
    rows = beside(every, found, ("site", name))
    return rows.select("site", name, *[F.coalesce(k, F.lit(0)).alias(k) for k in aggregates])


def by_layer(findings: DataFrame) -> DataFrame:
    """Totals of the five layers; a finding counts once, at its rule's first layer."""
    return filled(findings.withColumn("layer", F.expr(rules.layer())), "layer", LAYERS, {"total": F.count("*"), "errors": counted(is_error()), "warnings": counted(~is_error())})


def mix(findings: DataFrame) -> DataFrame:
    """(site, dimension, value, n): findings by class and by confidence of their rules."""
    parts = [filled(findings.withColumn("value", F.expr(text)), "value", values, {"n": F.count("*")}).select("site", F.lit(name).alias("dimension"), "value", "n") for name, text, values in (("class", rules.rule_class(), CLASSES), ("confidence", rules.confidence(), CONFIDENCES))]
    return parts[0].union(parts[1])


def by_rule(findings: DataFrame) -> DataFrame:
    n = findings.groupBy("site", "rule_id").agg(F.count("*").alias("n"))
    return n.select("site", "rule_id", F.expr(rules.rule_class()).alias("class"), F.expr(rules.confidence()).alias("confidence"), F.expr(rules.layer()).alias("layer"), F.expr(rules.group()).alias("rule_group"), "n")


def with_scope(findings: DataFrame) -> DataFrame:
    """findings with ``scope``: sitewide by the rule, template if a site has the message often, else page."""
    often = findings.groupBy("site", "rule_id", "message").agg(F.count("*").alias("n_same"))
    rows = beside(findings, often, ("site", "rule_id", "message"))
    return rows.withColumn("scope", F.when(F.expr(rules.sitewide()), "sitewide").when(F.col("n_same") >= TEMPLATE, "template").otherwise("page")).drop("n_same")


def by_scope(findings: DataFrame) -> DataFrame:
    return filled(with_scope(findings), "scope", SCOPES, {"n": F.count("*")})


def clusters(findings: DataFrame, examples: int = 5) -> DataFrame:
    """Findings that say the same, with the first paths by name; no group's paths are gathered beyond those."""
    keys = ["site", "rule_id", "message", "severity"]
    n = findings.groupBy(*keys).agg(F.count("*").alias("n"))
    few = best(findings.select(*keys, "path").distinct(), keys, ["path"], examples)
    few = few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("path")), " | ").alias("examples"))
    return beside(n, few, keys).select("site", F.expr(rules.group()).alias("rule_group"), "rule_id", "message", "severity", "n", "examples")


def repeated(findings: DataFrame, top: int = 3) -> DataFrame:
    """The messages that a site has most often, of heuristic rules and of others."""
    n = findings.groupBy("site", F.when(is_heuristic(), "heuristic").otherwise("actionable").alias("kind"), "rule_id", "message").agg(F.count("*").alias("n"))
    return best(n.where("n > 1"), ["site", "kind"], [F.desc("n"), "rule_id", "message"], top)


def largest_groups(findings: DataFrame, top: int = 5) -> DataFrame:
    n = findings.groupBy("site", F.expr(rules.group()).alias("rule_group")).agg(F.count("*").alias("n"))
    return best(n, ["site"], [F.desc("n"), "rule_group"], top)


def holds_any(column: Column, patterns) -> Column:
    """Whether a text holds one of some patterns; blank ones are none."""
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(p)) for p in patterns if p.strip()], F.lit(False))


def apply_policy(findings: DataFrame, policy: dict, route_kinds: dict | None = None, today: date | None = None) -> DataFrame:
    """The findings that a policy leaves, with its severities.

    In this order: ``ignore_rules``, ``ignore_paths`` (parts of paths),
    ``severity_overrides`` by rule, ``suppressions`` (rule_id, path_pattern,
    expires; one past its day is none), and ``route_kinds`` by name, whose
    ``skip_rules`` do not hold for paths with a ``match``.  Accessibility is
    never skipped by a kind of route.
    """
    now = (today or date.today()).isoformat()
    rule, path = F.col("rule_id"), F.col("path")
    rows = findings.where(~rule.isin(*policy.get("ignore_rules", ())) & ~holds_any(path, policy.get("ignore_paths", ())))
    severity = F.col("severity")
    for name, says in policy.get("severity_overrides", {}).items():
        severity = F.when(rule == name, says).otherwise(severity)
    rows = rows.withColumn("severity", severity)
    for s in policy.get("suppressions", ()):
        if not s.get("expires") or s["expires"][:10] >= now:
            rows = rows.where(~((rule == s["rule_id"]) & holds_any(path, [s["path_pattern"]])))
    for kind in (route_kinds or {}).values():
        skipped = rule.isin(*kind.get("skip_rules", ())) & holds_any(path, kind.get("match", ())) & (F.expr(rules.layer()) != "accessibility")
        rows = rows.where(~skipped)
    return rows


def diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """The fingerprints of two audits with ``status``: new, resolved or unchanged."""
    was = baseline.select(*FINGERPRINT).distinct().withColumn("was", F.lit(True))
    now = current.select(*FINGERPRINT).distinct().withColumn("now", F.lit(True))
    both = was.select(*[F.col(k).alias(f"b_{k}") for k in FINGERPRINT], "was")
    rows = now.join(both, same(now, both, FINGERPRINT), "full")
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("unchanged")
    value = lambda k: F.when(F.col("now").isNull(), both[f"b_{k}"]).otherwise(now[k]).alias(k)
    return rows.select(*map(value, FINGERPRINT), status.alias("status"))


def regressions(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """The fingerprints that the baseline does not have."""
    return diff(baseline, current).where("status = 'new'").drop("status")


def search_export(findings: DataFrame) -> DataFrame:
    """By page: findings, errors, warnings and rules; there are no more rules in a list than the audit has."""
    return findings.groupBy("site", "path").agg(F.count("*").alias("findings"), counted(is_error()).alias("errors"), counted(~is_error()).alias("warnings"), F.array_join(F.array_sort(F.collect_set("rule_id")), " | ").alias("rules"))


def route_of_path() -> Column:
    return F.regexp_extract("path", r"^crawl/(.*?)(/?index[.]html)?$", 1)


def cited(citations: DataFrame, findings: DataFrame) -> DataFrame:
    """By url of citations(url, citations): their sum and rows, and what the audit found at its route; null counts where it found nothing."""
    url = F.col("url")
    site = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    route = F.expr(r"trim(BOTH '/' FROM regexp_extract(url, '://[^/?#]*([^?#]*)', 1))")
    rows = citations.select("url", "citations", site.alias("site"), route.alias("route")).groupBy("url", "site", "route").agg(F.sum("citations").alias("citations"), F.count("*").alias("rows"))
    found = findings.select("site", route_of_path().alias("route"), "severity").groupBy("site", "route").agg(F.count("*").alias("audit_findings"), counted(is_error()).alias("audit_errors"), counted(~is_error()).alias("audit_warnings"))
    return beside(rows, found, ("site", "route"))


def opportunities(citations: DataFrame, findings: DataFrame) -> DataFrame:
    """What is gained by mending cited pages: (site, url, route, citations, rows, audit counts, matched, score, priority)."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    matched = F.col("audit_findings").isNotNull()
    score = CITED * F.col("citations") + ERROR * count("audit_errors") + WARNING * count("audit_warnings") + F.when(matched, 0).otherwise(UNKNOWN)
    band = reduce(lambda otherwise, b: F.when(F.col("score") >= b[1], b[0]).otherwise(otherwise), reversed(BANDS), F.lit("low"))
    rows = cited(citations, findings).select("site", "url", "route", "citations", "rows", *[count(c).alias(c) for c in ("audit_findings", "audit_errors", "audit_warnings")], matched.alias("matched"), score.alias("score"))
    return rows.where("score > 0").withColumn("priority", band)


def citation_trend(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Two snapshots (site, route, citations) against each other: (site, route, was, now, delta, status)."""
    a = previous.groupBy("site", "route").agg(F.sum("citations").alias("was"))
    b = current.groupBy("site", "route").agg(F.sum("citations").alias("now"))
    rows = a.join(b, ["site", "route"], "full")
    delta = F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))
    status = F.when(F.col("was").isNull(), "newly_cited").when(F.col("now").isNull(), "no_longer_cited").when(delta > 0, "increased").when(delta < 0, "decreased").otherwise("unchanged")
    return rows.select("site", "route", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"), delta.alias("delta"), status.alias("status"))


def metric_diff(baseline: DataFrame, current: DataFrame, relative: int = 1000, absolute: int = 0) -> DataFrame:
    """Two runs' metrics (metric, unit, direction, value) against each other.

    ``relative`` is in basis points and ``absolute`` in ms; a change counts from
    the one and beyond the other.  direction is lower_is_better or
    higher_is_better; a metric that one run lacks is missing.
    """
    a = baseline.select("metric", F.col("unit").alias("u1"), F.col("direction").alias("d1"), F.col("value").alias("baseline"))
    b = current.select("metric", F.col("unit").alias("u2"), F.col("direction").alias("d2"), F.col("value").alias("current"))
    rows = a.join(b, "metric", "full").select("metric", F.coalesce("u1", "u2").alias("unit"), F.coalesce("d1", "d2").alias("direction"), "baseline", "current", (F.col("current") - F.col("baseline")).alias("delta"))
    points = F.when(F.col("baseline") != 0, F.expr("delta * 10000 div baseline"))
    rows = rows.withColumn("basis_points", points)
    matters = (F.abs("delta") > F.when(F.col("unit") == "ms", absolute).otherwise(0)) & F.coalesce(F.abs("basis_points") >= relative, F.lit(True))
    worse = F.when(F.col("direction") == "lower_is_better", F.col("delta") > 0).otherwise(F.col("delta") < 0)
    status = F.when(F.col("delta").isNull(), "missing").when(~matters, "unchanged").when(worse, "regressed").otherwise("improved")
    return rows.withColumn("status", status)


def over_budget(metrics: DataFrame, budget: dict[str, int]) -> DataFrame:
    """(metric, value, budget, status) for each limit: over, within, or unknown if the run lacks the metric."""
    limits = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(v).cast("long").alias("budget")) for k, v in sorted(budget.items())])).alias("limit")
    rows = metrics.sparkSession.range(1).select(limits).select("limit.*").join(metrics.select("metric", "value"), "metric", "left")
    status = F.when(F.col("value").isNull(), "unknown").when(F.col("value") > F.col("budget"), "over").otherwise("within")
    return rows.select("metric", "value", "budget", status.alias("status"))
