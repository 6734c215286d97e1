"""Quality from compression: how much better a text packs with a dictionary of good text than of bad.

Two zstandard dictionaries are built from labelled blocks, one of good and one
of bad text.  A text is cut into blocks, each packed by itself with either, so
that a long text cannot become its own dictionary.  Of the three sizes, raw,
packed with good and packed with bad, each two give a normalised difference,
which is that of the two over the larger one.  These go through a logistic
curve of second degree that is fitted on labelled texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import arrow_batches
from .logistic import fit_dense, sigmoid
from .samples import labelled

#: Bytes of a block and of each dictionary, packing level.
BLOCK, DICTIONARY, LEVEL = 2048, 112_640, 3
#: Bounds of the fit: labelled rows of each class for the dictionaries and for
#: the curve; blocks, spread over the whole text, that one document gives to a
#: dictionary, so that a few long documents don't make it up.
DICTIONARY_ROWS, CURVE_ROWS, BLOCKS_OF_ONE = 400, 3000, 4


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def packers(good: bytes, bad: bytes):
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
    out = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
        d.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
    return out


def packed_sizes(text: str | None, good, bad) -> tuple[int, int, int]:
    """Raw bytes and bytes packed with the good and the bad dictionary."""
    data = (text or "").encode()
    parts = blocks(data)
    return len(data), sum(len(good.compress(x)) for x in parts), sum(len(bad.compress(x)) for x in parts)


def features(sizes: np.ndarray) -> np.ndarray:
    """Columns for the curve from rows (raw, good, bad): normalised differences of two sizes, their squares and a product; an empty text has neutral ones."""
    raw, good, bad = np.maximum(sizes, 1).astype(float).T
    between, by_good, by_bad = (bad - good) / np.maximum(bad, good) * 10, (raw - good) / np.maximum(raw, good) * 4 - 2, (raw - bad) / np.maximum(raw, bad) * 4 - 2
    x = np.stack([np.ones_like(raw), between, by_good, by_bad, between**2, between * by_good, by_good**2, by_bad**2], axis=1)
    x[sizes[:, 0] == 0, 1:] = 0
    return x


def train_dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-DICTIONARY:] or b"\n" * 8


def sample_blocks(batches):
    """(y, block): a few evenly spread blocks of each text."""
    import pyarrow as pa

    for batch in batches:
        out = ([], [])
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = blocks((text or "").encode())
            for k in sorted({k * len(parts) // BLOCKS_OF_ONE for k in range(BLOCKS_OF_ONE)} if parts else ()):
                out[0].append(y)
                out[1].append(parts[k])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["y", "block"])


def sizes_of(good: bytes, bad: bytes):
    def run(batches):
        import pyarrow as pa

        pack = packers(good, bad)
        for batch in batches:
            rows = [packed_sizes(t, *pack) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], names=["y", "raw", "good", "bad"])

    return run


def scores_of(good: bytes, bad: bytes, weights: list[float]):
    def run(batches):
        import pyarrow as pa

        pack, w = packers(good, bad), np.array(weights)
        for batch in batches:
            sizes = np.array([packed_sizes(t, *pack) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 3)
            p = sigmoid(features(sizes) @ w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), *(pa.array(sizes[:, k]) for k in range(3))], names=["doc_id", "score", "raw_bytes", "good_bytes", "bad_bytes"])

    return run


def quality_model(docs: DataFrame, labels: DataFrame, train: Column) -> tuple[bytes, bytes, list[float]]:
    """Dictionaries and curve weights, from bounded samples of labels(doc_id, quality)."""
    arrow_batches(docs.sparkSession)
    found = labelled(docs, labels, "quality", train, DICTIONARY_ROWS).select("text", "y").mapInArrow(sample_blocks, "y int, block binary").collect()
    found.sort(key=lambda r: (r.y, bytes(r.block)))
    good, bad = (train_dictionary([bytes(r.block) for r in found if r.y == y]) for y in (1, 0))
    sizes = labelled(docs, labels, "quality", train, CURVE_ROWS).select("text", "y").mapInArrow(sizes_of(good, bad), "y int, raw long, good long, bad long").toPandas()
    sizes = sizes.sort_values(list(sizes.columns))
    y = sizes["y"].to_numpy(float)
    counts = {int(r.y): r["n"] for r in labels.where(F.col("quality").isin(0, 1) & train).groupBy(F.col("quality").alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(set(y)) < 2:  # one class or none: its share is the score
        return good, bad, [float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))] + [0.0] * 7
    share = {k: counts[k] / max(1, (y == k).sum()) for k in (0, 1)}  # the sample's classes weigh as in all labels
    weight = np.where(y == 1, share[1], share[0])
    return good, bad, fit_dense(features(sizes[["raw", "good", "bad"]].to_numpy()), y, weight / weight.mean()).tolist()


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(doc_id, score, raw_bytes, good_bytes, bad_bytes) for each row of docs(doc_id, text).

    ``train`` is the condition on labels' doc_id that admits a label to the
    fit.  A null or empty text scores as an empty one; a repeated row scores
    each time; ids may be null.  Without labels every score is a half.
    """
    arrow_batches(spark)
    model = quality_model(docs, labels, train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scores_of(*model), "doc_id long, score double, raw_bytes long, good_bytes long, bad_bytes long")
