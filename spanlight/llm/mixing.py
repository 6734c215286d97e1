"""Mixing sources to target weights, by subset sums over exact lengths.

Each source has a target number of words.  As many whole passes over it as fit
are taken; the rest of the budget is spent on single documents.  Documents are
counted by exact length.  A proportional part of each length is taken, rounded
down, and of what the rounding left all but the last ``EXACT`` words are spent
in proportion too, carried from length to length.  What is left is filled by a
bounded-knapsack dynamic program over the lengths, so the total meets the
target to the word where the lengths allow it.  Which documents of a length are
taken is decided by seeded hashes.

Sources are counted, ordered and given their targets in Spark, however many
there are.  A source's lengths go through one task; they are no more than the
words of its longest document.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import Scratch, whole_row

#: Weights by order of sources, share of all words, most passes over a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Words that are left to the exact program, about.
EXACT = 1 << 16
#: Parts into which the documents of one length are hashed, so that ranks are needed in one part only.
PARTS = 1 << 12
WORDS = r"[^\x20\x09-\x0D]+"


def sizes(text: str = "text"):
    """The number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def ordered(totals: DataFrame, scratch: Scratch) -> DataFrame:
    """totals with ``rank``, the place of a row's key from 0, without gathering them in one task."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = totals.repartitionByRange("key").sortWithinPartitions("key").select("*", F.spark_partition_id().alias("part"), inside.alias("inside"))
    parts = scratch.save(parts, "ordered")
    # A row for each part: no more than the shuffle has partitions.
    before = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return parts.join(F.broadcast(before), "part").select(*totals.columns, (F.col("before") + F.col("inside")).alias("rank"))


def source_targets(totals: DataFrame, scratch: Scratch, weights, share: float, most: float) -> DataFrame:
    """(key, source_size, target) from totals (key, total), as targets() gives them.

    Words for a unit of weight rise until the sources that they do not fill take
    what the filled ones leave; the driver sees two sums a round.
    """
    ranked = ordered(totals, scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = scratch.save(ranked.select("key", F.col("total").alias("source_size"), weight.alias("weight"), (F.col("total") * most).alias("most")), "sources")
    whole = rows.agg(F.sum("source_size").alias("words"), F.sum("most").alias("most")).first()
    budget, unit = float(min(share * whole.words, whole.most)), 0.0
    while True:
        full = F.col("weight") * unit > F.col("most")
        got = rows.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("filled"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        higher = (budget - got.filled) / got.open if got.open else unit
        if higher <= unit:
            break
        unit = higher
    return rows.select("key", "source_size", F.least("most", F.col("weight") * unit).alias("target"))


def targets(totals: list[int], weights: list[float], budget: float, most: float = MOST) -> list[float]:
    """Shares of the budget by weight, none above most times its total; excess goes to the others by weight."""
    caps = [most * t for t in totals]
    out, open_ = [0.0] * len(totals), set(range(len(totals)))
    left = float(min(budget, sum(caps)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if weights[i] * unit > caps[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
            open_.discard(i)
    return out


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their total comes as close to the budget as can be, from below."""
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return taken
    share = budget / total
    taken = np.floor(counts * share).astype(np.int64)
    left = budget - int((taken * lengths).sum())
    spare = counts - taken
    if left > EXACT:
        part = (counts * share - taken) * lengths * (1 - EXACT / left)
        carry = 0.0
        for i in np.argsort(-lengths, kind="stable"):  # what a length leaves goes to the next shorter one
            carry += float(part[i])
            k = int(min(spare[i], carry // max(1, int(lengths[i]))))
            taken[i] += k
            spare[i] -= k
            carry -= k * int(lengths[i])
            left -= k * int(lengths[i])
    left_ = int(left)
    first = np.full(left_ + 1, -1, np.int64)  # the item that first reached a sum
    first[0] = 0
    items = [(0, 0, 0)]
    for i in np.argsort(lengths, kind="stable"):
        n, k = int(spare[i]) if lengths[i] > 0 else 0, 1
        n = min(n, left_ // int(lengths[i])) if n else 0
        while n > 0 and first[left_] < 0:
            part = min(k, n)
            n, k = n - part, k * 2
            w = part * int(lengths[i])
            items.append((int(i), part, w))
            new = (first[: left_ + 1 - w] >= 0) & (first[w:] < 0)
            first[w:][new] = len(items) - 1
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        i, part, w = items[first[at]]
        taken[i] += part
        at -= w
    return taken


def plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source: how many documents of each length are taken once more than the whole passes."""
    pdf = pdf.sort_values("size")
    source_size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(target // source_size) if source_size else 0
    more = fill(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(round(target)) - passes * source_size)
    return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "passes": passes, "more": more})


def mixed(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17, whole: bool = False) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for each row of docs(doc_id, text, source); with ``whole`` also ``doc``, the row with all its columns.

    Sources come by code point, null last, with the weights repeating.  A
    text's size is its number of words, 0 for null.  Repeated rows are
    documents of their own; a null id, or one that several texts have, is taken
    like another.  Rows of a source
    without words have target 0.  No rows give no rows.  The same rows and
    seed give the same mix; equal rows may change places with each other.
    """
    scratch = Scratch(spark, "mixing")
    extra = ["doc"] * whole
    # The seeded hashes take the text in, so that rows of one id are told apart.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("hash"), F.col("source").cast("string").alias("source"), sizes().alias("size"), *[whole_row(docs).alias("doc")] * whole)
    rows = scratch.save(rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))), "rows")
    hist = scratch.save(rows.groupBy("key", "size").agg(F.count("*").alias("n")), "hist")
    if hist.isEmpty():
        return rows.select("doc_id", "size", "source", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"), *extra)
    sources = scratch.save(source_targets(hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("total")), scratch, weights, share, most), "targets")
    plans = scratch.save(hist.join(sources, "key").groupBy("key").applyInPandas(plan, "key string, size long, passes long, more long"), "plans")
    # Documents of a length are hashed into parts; parts below the cut are
    # taken whole, and only the part that the cut falls in is ranked.
    part = F.pmod(F.xxhash64("hash", F.lit(seed)), F.lit(PARTS)).cast("int")
    hashed = rows.withColumn("part", part)
    parts = hashed.groupBy("key", "size", "part").agg(F.count("*").alias("n")).join(plans.where("more > 0"), ["key", "size"])
    running = F.sum("n").over(Window.partitionBy("key", "size").orderBy("part"))
    cuts = parts.withColumn("until", running).where("until >= more").groupBy("key", "size").agg(F.min(F.struct("part", (F.col("more") - F.col("until") + F.col("n")).alias("of_part"))).alias("cut"))
    cuts = scratch.save(cuts.select("key", "size", F.col("cut.part").alias("cut"), F.col("cut.of_part").alias("of_part")), "cuts")
    plans = scratch.save(plans.join(cuts, ["key", "size"], "left").join(sources, "key"), "cut_plans")
    joined = hashed.join(plans, ["key", "size"])
    sure = joined.where("cut is null or part <> cut").withColumn("extra", F.coalesce((F.col("part") < F.col("cut")).cast("long"), F.lit(0)))
    edge = joined.where("part = cut")
    rank = F.row_number().over(Window.partitionBy("key", "size").orderBy(F.xxhash64("hash", F.lit(seed + 1)), "hash", "doc_id"))
    edge = edge.withColumn("extra", (rank <= F.col("of_part")).cast("long"))
    out = sure.unionByName(edge).withColumn("copies", F.col("passes") + F.col("extra"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *extra)
