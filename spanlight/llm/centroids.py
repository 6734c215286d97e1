"""Centroid clustering of integer vectors, with partial-distance search.

A vector meets the centroids over the dimensions of highest variance first.  A
centroid whose sum of squared differences so far is strictly above the best
whole distance is abandoned; one that isn't goes through all dimensions, so
ties go to the smaller number.  All arithmetic is in integers, so results don't
depend on how rows are dealt.

Vectors stay where they are: a round sends the centroids, at most k times 64
numbers, to the tasks, and a task gives one row of sums for each centroid.

A vector of another length, or with a null or non-finite component, or a null
one is left out.  Rows of one vec_id count each.  Where fewer vectors than k
are kept each starts a centroid; none give no rows.  A null vec_id starts a
centroid only after all others.  A component beyond +-2^27 / 256 is an error,
as a distance could leave the 64 bits that it is told in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import Scratch

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Dimensions that are added up between two looks at the best; vectors that are searched at once; largest component.
STEP, BLOCK, LARGEST = 8, 4096, 1 << 27


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<int>): the kept vectors with components floor(SCALE * x)."""
    finite = F.forall("embedding", lambda x: F.coalesce(x.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == DIMENSIONS) & finite)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall("embedding", lambda x: F.abs(x.cast("double")) <= LARGEST / SCALE)
    return kept.select("vec_id", F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit("a component is beyond what distances of 64 bits allow"))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors whose ``salt:vec_id`` have the least sha256; of one vec_id's rows the least vector first."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()  # k rows
    return [list(r.v) for r in rows]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row, dimensions being in the order in which they are added up."""
    n, rows = len(x), np.arange(len(x))
    partial = np.zeros((n, len(centroids)), np.int64)
    for d in range(STEP):
        gap = x[:, d, None] - centroids[None, :, d]
        partial += gap * gap
    # The one that leads so far is taken through first, as a low best ends the others early.
    which = partial.argmin(1)
    gap = x[:, STEP:] - centroids[which, STEP:]
    best = partial[rows, which] + (gap * gap).sum(1)
    for c in range(len(centroids)):
        alive = np.flatnonzero((partial[:, c] <= best) & (which != c))
        sums = partial[alive, c]
        for d in range(STEP, x.shape[1], STEP):
            gap = x[alive, d : d + STEP] - centroids[c, d : d + STEP]
            sums += (gap * gap).sum(1)
            on = sums <= best[alive]
            alive, sums = alive[on], sums[on]
        won = (sums < best[alive]) | (c < which[alive])
        which[alive[won]], best[alive[won]] = c, sums[won]
    return which, best


def blocks(batches: Iterator) -> Iterator[tuple]:
    """(batch, matrix) of at most BLOCK vectors."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            yield batch, batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)


def by_variance(vectors: DataFrame) -> np.ndarray:
    """The dimensions, the one of the highest variance first.  Only speed depends on it."""
    spread = vectors.agg(*[F.var_pop(F.get("v", F.lit(d)).cast("double")).alias(f"d{d}") for d in range(DIMENSIONS)]).first()
    return np.argsort([-(x or 0.0) for x in spread], kind="stable")


def sums(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(count, componentwise sum) of the vectors nearest to each centroid that has any."""
    ordered = np.array(centroids, np.int64)[:, order]

    def tasks(batches):
        import pyarrow as pa

        counts, totals = np.zeros(len(ordered), np.int64), np.zeros((len(ordered), ordered.shape[1]), np.int64)
        for _, x in blocks(batches):
            which, _ = nearest(x[:, order], ordered)
            counts += np.bincount(which, minlength=len(ordered))
            for c in np.unique(which):
                totals[c] += x[which == c].sum(0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), *(pa.array(totals[some, d]) for d in range(totals.shape[1]))], ["c", "n", *(f"d{d}" for d in range(totals.shape[1]))])

    names = [f"d{d}" for d in range(DIMENSIONS)]
    parts = vectors.select("v").mapInArrow(tasks, ", ".join(f"{c} long" for c in ("c", "n", *names)))
    rows = parts.groupBy("c").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect()  # a row for each centroid
    return {r.c: (r.n, [r[c] for c in names]) for r in rows}


def assigned(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    ordered = np.array(centroids, np.int64)[:, order]

    def tasks(batches):
        import pyarrow as pa

        for batch, x in blocks(batches):
            which, best = nearest(x[:, order], ordered)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(tasks, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def clusters(spark: SparkSession, vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "2") -> tuple[DataFrame, list[list[int]]]:
    """The assignment of every kept vector of (vec_id, embedding) after the rounds, and the centroids."""
    scratch = Scratch(spark, "centroids")
    kept = scratch.save(scaled(vectors), "vectors")
    centroids = first_centroids(kept, k, salt)
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    order = by_variance(kept)
    for _ in range(rounds):
        for c, (n, total) in sums(kept, centroids, order).items():
            centroids[c] = [s // n for s in total]
    return scratch.save(assigned(kept, centroids, order), "assigned"), centroids


def cluster_report(spark: SparkSession, found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assignment with each cluster's and all distances' sum and its centroid's digest."""
    from hashlib import sha256

    digests = [(c, sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # A row for each centroid: at most k.
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = each.agg(F.sum("cluster_inertia").alias("inertia"))
    told = each.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(whole))
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
