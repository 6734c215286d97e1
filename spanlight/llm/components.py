"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link.

    Each round takes the least label among a node's neighbours and then
    replaces labels by their own labels, so chains shorten by more than half.
    Only the number of changed rows reaches the driver.
    """
    edges = scratch.save(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).where("u <> v").distinct(), "edges"
    )
    labels = scratch.save(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("l")).withColumnRenamed("u", "n"), "labels0")
    step = 0
    while True:
        step += 1
        near = (
            edges.join(labels.select(F.col("n").alias("v"), "l"), "v")
            .groupBy(F.col("u").alias("n"))
            .agg(F.min("l").alias("m"))
        )
        lower = labels.join(near, "n", "left").select("n", F.col("l").alias("was"), F.least("l", F.coalesce("m", "l")).alias("l"))
        lower = scratch.save(lower, f"lower{step}")
        jump = lower.select(F.col("n").alias("j"), F.col("l").alias("jl"))
        new = lower.join(jump, F.col("l") == F.col("j"), "left").select("n", "was", F.least("l", F.coalesce("jl", "l")).alias("l"))
        new = scratch.save(new, f"labels{step}")
        scratch.drop(f"lower{step}", f"labels{step - 1}")
        changed = new.where("l <> was").limit(1).count()
        labels = new.select("n", "l")
        if not changed:
            scratch.drop("edges")
            return labels.select(F.col("n").alias("node"), F.col("l").alias("component"))
