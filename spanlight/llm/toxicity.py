"""Toxicity with a classifier that must not care who is mentioned.

Features are the presence of words and of word starts.  The most telling ones
are chosen from a bounded labelled sample.  In the fit, every labelled text
that mentions an identity term is paired with copies in which the term is
swapped for others of its kind, and texts labelled clean with copies that gain
a mention; the squared change of the score is part of the loss, so a mention
alone moves no score.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import arrow_batches, forget
from .logistic import sigmoid
from .samples import label_ids, labelled

#: Groups of interchangeable mentions; a parameter of the operator.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden", "musulmans", "juifs", "chrétiens", "musulmanes", "judíos", "cristianos"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "ausländer", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes", "refugiados"),
    ("deaf", "blind", "disabled", "elderly", "young", "autistic"),
)
#: Bounds of the fit: labelled rows of each class, features kept, hash space.
FIT_ROWS, FEATURES, SPACE = 4000, 8192, 1 << 21
#: Lengths of word starts that count as features besides whole words.
STARTS = (4, 5, 6)
#: Weights of the ridge and of the counterfactual penalty.
RIDGE, FAIR = 2e-4, 4.0
#: Standard errors by which a feature's share must differ between the classes.
TELLING = 5.0
#: Rows whose features are looked up at once.
SOME = 256
WORD = re.compile(r"[^\W\d_]+")


def slot(feature: str) -> int:
    import zlib

    return zlib.crc32(feature.encode()) % SPACE


def word_slots(word: str) -> tuple[int, ...]:
    return (slot(word), *(slot(f"{word[:k]}*") for k in STARTS if len(word) >= k))


class Slots:
    """Feature slots of texts; words seen are remembered, up to a bound."""

    def __init__(self, keep: dict[int, int] | None = None, bound: int = 400_000):
        self.keep, self.bound, self.seen = keep, bound, {}

    def __call__(self, text: str | None) -> set[int]:
        out: set[int] = set()
        for w in set(WORD.findall((text or "").lower())):
            got = self.seen.get(w)
            if got is None:
                got = word_slots(w)
                if self.keep is not None:
                    got = tuple(self.keep[s] for s in got if s in self.keep)
                if len(self.seen) >= self.bound:
                    self.seen.clear()
                self.seen[w] = got
            out.update(got)
        return out


def swaps(text: str, groups, most: int = 4) -> list[str]:
    """Copies of a text in which its identity terms are replaced by others of their group."""
    found = {w for w in WORD.findall(text.lower())}
    out = []
    for group in groups:
        for term in sorted(found & set(group)):
            others = [o for o in group if o != term]
            at = sum(map(ord, term)) % len(others)
            for other in (others[at:] + others[:at])[:most]:
                out.append(re.sub(rf"(?<![^\W\d_]){re.escape(term)}(?![^\W\d_])", other, text, flags=re.I))
    return out


def sample_slots(groups):
    """(y, slots, change): a row for each text, and for each counterfactual copy its slots gained and lost."""
    terms = [t for g in groups for t in g]

    def run(batches):
        import pyarrow as pa

        slots = Slots()
        for batch in batches:
            y_, key, plus, minus = [], [], [], []
            for doc, text, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = slots(text)
                rows = [(y, sorted(own), [])]
                for other in swaps(text or "", groups):
                    new = slots(other)
                    rows.append((2, sorted(new - own), sorted(own - new)))
                if y == 0:
                    rows.append((2, sorted(slots(terms[doc % len(terms)]) - own), []))
                for a, b, c in rows:
                    y_.append(a), key.append(doc), plus.append(b), minus.append(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(y_, pa.int32()), pa.array(key, pa.int64()), pa.array(plus, pa.list_(pa.int32())), pa.array(minus, pa.list_(pa.int32()))], names=["y", "doc_id", "plus", "minus"]
            )

    return run


def flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as it lies in memory: where each row begins and the last ends, and all values."""
    lists = lists.combine_chunks()
    return np.asarray(lists.offsets), np.asarray(lists.values)


def sparse(begins: np.ndarray, values: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and place of each value that has one, and the number of rows; some rows at a time, as most values have none."""
    n, row, column = len(begins) - 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, n, SOME):
        some = begins[low : low + SOME + 1]
        at = place[values[some[0] : some[-1]]]
        row.append(np.repeat(np.arange(low, low + len(some) - 1), np.diff(some))[at >= 0])
        column.append(at[at >= 0].astype(np.int64))
    return np.concatenate(row), np.concatenate(column), n


def fit(sample, steps: int = 300, weights: tuple[float, float] = (1.0, 1.0)) -> tuple[dict[int, float], float]:
    """Weights by slot and the intercept; Adam on the loss, weighted by class, with the counterfactual penalty.

    The sample is an Arrow table (y, plus, minus) with rising y, as of
    sample_slots(); its lists are read where they lie, not as an object a row.
    """
    y = sample.column("y").to_numpy()
    total = [int((y == k).sum()) for k in (0, 1)]
    texts = sum(total)
    y = y[:texts].astype(float)
    weight = np.where(y == 1, weights[1], weights[0])
    if not all(total):
        return {}, float(np.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1))) if texts else 0.0
    weight /= weight.sum()
    begins, values = flat(sample.column("plus"))
    lost_begins, lost = flat(sample.column("minus"))
    n = np.zeros((2, SPACE), np.int32)
    for k, part in enumerate((slice(begins[0], begins[total[0]]), slice(begins[total[0]], begins[texts]))):
        np.add.at(n[k], values[part], 1)
    often = np.flatnonzero(n.sum(axis=0, dtype=np.int32) >= 3)
    n = n[:, often].astype(np.int64)
    rate = [(n[k] + 0.5) / (total[k] + 1) for k in (0, 1)]
    pooled = (n[0] + n[1]) / texts
    z = np.abs(rate[1] - rate[0]) / np.sqrt(pooled * (1 - pooled) * (1 / total[0] + 1 / total[1]) + 1e-9)
    often, z = often[z >= TELLING], z[z >= TELLING]
    top = often[np.argsort(-z, kind="stable")[:FEATURES]].tolist()
    named = np.unique(np.concatenate((values[begins[texts] : begins[-1]], lost[lost_begins[texts] : lost_begins[-1]]))).tolist()
    keep = {s: i for i, s in enumerate(dict.fromkeys([*named[: FEATURES // 2], *top]))}
    place = np.full(SPACE, -1, np.int32)
    place[list(keep)] = list(keep.values())

    xr, xc, xn = sparse(begins[: texts + 1], values, place)
    pr, pc, pn = sparse(begins[texts:], values, place)
    mr, mc, _ = sparse(lost_begins[texts:], lost, place)
    w, b, m, v = np.zeros(len(keep)), 0.0, np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for t in range(1, steps + 1):
        p = sigmoid(np.bincount(xr, w[xc], xn) + b)
        err = (p - y) * weight
        change = (np.bincount(pr, w[pc], pn) - np.bincount(mr, w[mc], pn)) * (FAIR / max(1, pn))
        g = np.append(np.bincount(xc, err[xr], len(w)) + np.bincount(pc, change[pr], len(w)) - np.bincount(mc, change[mr], len(w)) + RIDGE * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return {s: float(w[i]) for s, i in keep.items() if abs(w[i]) > 1e-4}, float(b)


def scores_of(weights: dict[int, float], intercept: float):
    def run(batches):
        import pyarrow as pa

        forget()
        keys = sorted(weights)
        w = [weights[k] for k in keys]
        slots = Slots({s: i for i, s in enumerate(keys)})
        for batch in batches:
            p = [sigmoid(intercept + sum(w[i] for i in sorted(slots(t)))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), *batch.columns[2:]], names=["doc_id", "score", *batch.schema.names[2:]])

    return run


def toxicity_model(docs: DataFrame, labels: DataFrame, train: Column, groups=IDENTITY_TERMS) -> tuple[dict[int, float], float]:
    """Weights and intercept from a bounded sample of labels(doc_id, toxic)."""
    import pyarrow as pa

    arrow_batches(docs.sparkSession)
    rows = labelled(docs, labels, "toxic", train, FIT_ROWS).select("doc_id", "text", "y").mapInArrow(sample_slots(groups), "y int, doc_id long, plus array<int>, minus array<int>").toArrow()
    rows = rows.sort_by([("y", "ascending"), ("doc_id", "ascending")])
    counts = {r.y: r["count"] for r in label_ids(labels, "toxic", train).groupBy("y").count().collect()}
    # The sample's classes weigh as in all labels.
    model = fit(rows, weights=tuple(max(1.0, counts.get(y, 0) / FIT_ROWS) for y in (0, 1)))
    del rows
    pa.default_memory_pool().release_unused()
    return model


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: Column, groups=IDENTITY_TERMS, hashed: bool = False) -> DataFrame:
    """(doc_id, score) for each row of docs(doc_id, text); with ``hashed`` also ``text_hash``, the text's xxhash64.

    ``train`` is the condition on labels' doc_id that admits a label to the
    fit.  A null or empty text scores the intercept; a repeated row scores
    each time; ids may be null.  Without labels every score is a half.
    """
    arrow_batches(spark)
    model = toxicity_model(docs, labels, train, groups)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.xxhash64("text").alias("text_hash")] * hashed)
    return rows.mapInArrow(scores_of(*model), "doc_id long, score double" + ", text_hash long" * hashed)
