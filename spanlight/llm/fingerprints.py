"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash space.

Unlike a sketch of fixed size, such sketches of any two texts are samples of
the same hashes.  They merge by union, and the likeness or containment of texts
of very unequal length is read off them directly.  Shingles are runs of 16
bytes of the UTF-8 text; a shorter text is one shingle, an empty one has none.
A fingerprint is written as ``count:digest:hashes``: the number of distinct
shingles, a digest of all of them, and the highest 32 bits of what varies in
the retained hashes, rising, in base 64; about a third of the text's size.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import arrow_batches
from .ranges import LOWEST, partitions, range_bounds, range_of, tie_order
from .words import BASE, BASE_INVERSE, mix, powers

#: Bytes of a shingle; one of so many hashes is retained (a power of two); bytes written of a hash.
WIDTH, SCALE, WRITTEN = 16, 16, 4
WEIGHTS = powers(BASE, WIDTH)


def shingle_hashes(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Hashes of all byte shingles, by a polynomial of each window."""
    if not data:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    if len(x) <= width:
        return mix(np.array([(x * powers(BASE, len(x))).sum(dtype=np.uint64) ^ np.uint64(len(x))], np.uint64))
    # A window of 2k bytes is a window of k bytes and, times a power, the one after it.
    done = 1
    while done * 2 <= width:
        x = x[: len(x) - done] + x[done:] * np.uint64(pow(BASE, done, 1 << 64))
        done *= 2
    assert done == width
    return mix(x)


def sketch(text: str | None) -> tuple[int, int, np.ndarray]:
    """Distinct shingles, their digest and the retained hashes, sorted."""
    hashes = shingle_hashes((text or "").encode())
    kept = np.unique(hashes[hashes < np.uint64((1 << 64) // SCALE)])
    distinct = np.unique(hashes)
    return len(distinct), int(mix(distinct ^ np.uint64(len(distinct))).sum(dtype=np.uint64)), kept


def written(s: tuple[int, int, np.ndarray]) -> str:
    raw = (s[2] * np.uint64(SCALE)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WRITTEN]
    return f"{s[0]}:{s[1]:016x}:{base64.b64encode(raw.tobytes()).decode()}"


def read(text: str) -> tuple[int, int, np.ndarray]:
    """A written fingerprint, for likeness, containment and merged; hashes that agree in what is written are one."""
    count, digest, hashes = text.split(":")
    return int(count), int(digest, 16), np.unique(np.frombuffer(base64.b64decode(hashes), f">u{WRITTEN}"))


def likeness(a, b) -> float:
    """The estimated Jaccard likeness of two sketches: 1 if the whole sets agree, 0 if nothing retained is shared."""
    if a[:2] == b[:2]:
        return 1.0
    both = len(np.intersect1d(a[2], b[2], assume_unique=True))
    union = len(a[2]) + len(b[2]) - both
    return both / union if union else 0.0


def containment(a, b) -> float:
    """The estimated share of a's shingles that b has."""
    if a[:2] == b[:2]:
        return 1.0
    return len(np.intersect1d(a[2], b[2], assume_unique=True)) / len(a[2]) if len(a[2]) else 0.0


def merged(a, b) -> np.ndarray:
    """The retained hashes of two texts together."""
    return np.union1d(a[2], b[2])


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as many code points of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"


def compare(batches):
    """Rows (range, doc_id, text, role) in order; a row of role 1 only stands after the last of its range."""
    import pyarrow as pa

    where = last = None
    for batch in batches:
        out = [[] for _ in range(8)]
        for r, doc, text, role in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = text or ""
            here = (doc, text, sketch(text))
            if last is not None and r == where:
                changed = edited(last[1], text)
                other = sketch(changed)
                values = (last[0], len(last[1]), hashlib.sha256(changed.encode()).hexdigest(), written(last[2]), written(other), likeness(last[2], other), likeness(last[2], here[2]), containment(last[2], other))
                for x, y in zip(out, values, strict=True):
                    x.append(y)
            where, last = r, None if role else here
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in OUT.split(", ")])


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row of OUT for each row of docs(doc_id, text): its fingerprint, and its edited text's.

    Documents follow each other by rising doc_id, null ids first, ties by a
    hash of the text, so that an id of many rows is dealt to many tasks; after
    the last comes the first.  A null text is an empty one.  A
    single document follows itself; no rows give no rows.
    """
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions(docs)
    bounds = range_bounds(docs.select("doc_id"), "doc_id", 3 * n)
    tie = F.xxhash64("text")
    dealt = docs.withColumn("range", range_of("doc_id", bounds, tie)).withColumn("tie", tie_order(tie))
    # The first document of each range also closes the range before it.  There
    # are as many such rows as ranges, which the shuffle partitions bound.
    key = F.coalesce("doc_id", F.lit(LOWEST))
    firsts = dealt.groupBy("range").agg(F.min(F.struct(key.alias("low"), "tie")).alias("s")).select("range", "s.low", "s.tie").collect()
    order = sorted(tuple(r) for r in firsts)
    if not order:
        return spark.createDataFrame([], OUT)
    closes = spark.createDataFrame([(low, tie, order[k - 1][0], r) for k, (r, low, tie) in enumerate(order)], "low long, low_tie long, closed int, own int")
    first = dealt.join(F.broadcast(closes), (F.col("range") == F.col("own")) & (key == F.col("low")) & (F.col("tie") == F.col("low_tie"))).groupBy("closed").agg(F.min(F.struct("text", "doc_id", "tie")).alias("s"))
    first = first.select(F.col("closed").alias("range"), "s.doc_id", "s.text", F.lit(1).alias("role"), "s.tie")
    rows = dealt.select("range", "doc_id", "text", F.lit(0).alias("role"), "tie").union(first)
    return rows.repartition(n, "range").sortWithinPartitions("range", "role", "doc_id", "tie", "text").drop("tie").mapInArrow(compare, OUT)
