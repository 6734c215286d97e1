"""Host reputation by empirical Bayes, and url rules that come before it.

Labelled outcomes of pages are counted by host.  A host's share of bad pages is
shrunk to its registered domain's, that to its suffix's and that to the share
of all pages.  How strongly is learned at each level from the spread of the
shares beyond chance (the moments of the beta-binomial).  A host is blocked
when the lower bound of its posterior share is above a limit.  All steps are
DataFrame functions; counts are aggregated before any shuffle.  Each level's
counts are written once, as the level above and its own strength both read
them.  Hosts with more than a share of all pages are few, so they are joined to
their pages without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import Scratch

#: (rule, verdict); a rule is a host, then a path that starts with a slash.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Highest accepted share of bad pages; standard deviations below the mean that the bound lies.
MOST_BAD, DEVIATIONS = 0.3, 1.645
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "co.za")
#: Hosts with more than one of so many pages are joined by themselves; there are fewer of them than this.
HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and trailing dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")


def suffix_of(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.index("/")
        name, start = text[:at], text[at:]
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def strength(level: DataFrame) -> DataFrame:
    """One row: how many outcomes the prior of a level counts for, from rows (n, bad, m), m being the parent's share."""
    chance = F.col("m") * (1 - F.col("m"))
    beyond = F.sum((F.col("bad") - F.col("n") * F.col("m")) ** 2 - F.col("n") * chance)
    rho = F.coalesce(F.try_divide(beyond, F.sum(F.col("n") * (F.col("n") - 1) * chance)), F.lit(0.5))  # without evidence, the weakest prior
    return level.agg(F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.5)).alias("rho")).select((1 / F.col("rho") - 1).alias("k"))


def shrunk(level: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, bad, alpha, beta, share) of rows (keys, n, bad, m)."""
    out = level.crossJoin(F.broadcast(strength(level)))  # one row
    out = out.withColumn("alpha", F.col("bad") + F.col("k") * F.col("m")).withColumn("beta", F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("m")))
    return out.select(*keys, "n", "bad", "alpha", "beta", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("share"))


def reputations(outcomes: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, pages, n, bad, alpha, beta, share, low) from outcomes(host, bad); a null outcome only makes the host known.

    ``pages`` counts the rows with a null outcome.

    ``low`` is the lower bound of the posterior share of bad pages.
    """
    hosts = outcomes.groupBy("host").agg(F.count_if(F.col("bad").isNull()).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    name = name_of(F.col("host"))
    hosts = scratch.save(hosts.withColumn("domain", domain_of(name)).withColumn("suffix", suffix_of(name)), "hosts")
    domains = scratch.save(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = scratch.save(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    whole = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))
    by_suffix = shrunk(scratch.save(suffixes.crossJoin(F.broadcast(whole)), "suffix_means"), "suffix").select("suffix", F.col("share").alias("m"))  # one row
    by_domain = shrunk(scratch.save(domains.join(by_suffix, "suffix"), "domain_means"), "domain").select("domain", F.col("share").alias("m"))
    means = scratch.save(hosts.join(by_domain, "domain").select("host", "pages", "n", "bad", "m"), "host_means")
    by_host = shrunk(means, "host", "pages")
    size = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (size * size * (size + 1)))
    return by_host.withColumn("low", F.greatest(F.lit(0.0), F.col("share") - DEVIATIONS * deviation))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = MOST_BAD) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_share, bad_low) for each row of pages(page_id, url).

    ``outcomes`` (host, bad) holds labelled pages' outcomes, 1 for bad.  The
    longest rule that fits decides; else the host's posterior bound.  A null
    url, or one without ``://``, has an empty host, which is judged like any
    other; a host without outcomes takes its domain's share.  Repeated rows
    give a row each; null ids are kept; no rows give no rows.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.select("host", F.col("bad").cast("long").alias("bad")).unionByName(rows.select("host", F.lit(None).cast("long").alias("bad")))
    found = Scratch(pages.sparkSession, "hosts")
    found = found.save(reputations(known, found).select("host", "pages", F.col("share").alias("bad_share"), F.col("low").alias("bad_low")), "found")
    # Fewer than HOT rows, whatever the pages; a broadcast of proven size.
    hot = found.crossJoin(F.broadcast(found.agg(F.sum("pages").alias("all")))).where(F.col("pages") * HOT > F.col("all")).select("host", "bad_share", "bad_low")
    rows = rows.join(F.broadcast(hot), "host", "left")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_low") > most_bad, F.lit("block")).otherwise(F.lit("allow"))
    others = rows.where("bad_low IS NULL").select("page_id", "host", "path").join(found.select("host", "bad_share", "bad_low"), "host")
    judged = rows.where("bad_low IS NOT NULL").unionByName(others)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "bad_share", "bad_low")
