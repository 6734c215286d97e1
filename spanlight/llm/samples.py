"""Bounded, repeatable samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_ids(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """(doc_id, y): the ids that labelled() samples from."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & train)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("z"))
        .where("y = z")
        .select("doc_id", "y")
    )


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most per_class labelled rows of each class.

    ``train`` is a condition on doc_id.  The rows with the least hashes of
    their ids are taken, so the sample does not depend on partitioning.  A
    null label or id drops the row; an id with both labels is left out.
    """
    rows = label_ids(labels, label, train).select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    picked = [rows.where(f"y = {y}").orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    picked = picked[0].union(picked[1]).select("doc_id", "y")
    # At most 2 * per_class rows of two numbers: the bound is the parameter.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")
