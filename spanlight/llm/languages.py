"""Language of pages by fusing evidence.

A page's text gives a likelihood under each language's letter trigrams.  Its
declared language counts by how often pages of each language declare it.  Its
host gives a prior: the languages of the host's other pages, smoothed by those
of its address suffix, and these by those of all pages.  The declarations' and
hosts' counts are grouped sums over all pages of the text's own posterior, each
page's own share taken out of its host's.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import Scratch, arrow_batches
from .url_filters import host_of, name_of, suffix_of

#: Labelled texts of each language for the trigrams, which are counted whole; most languages, as a model has half a megabyte for each.
FIT_ROWS, MOST_LANGUAGES = 1500, 128
#: What one trigram's evidence counts for, as neighbours overlap, and the most trigrams that count.
TEMPER, ENOUGH = 0.3, 400
#: Pages that a parent's shares count for, in a suffix and in a host.
SUFFIX_PAGES, HOST_PAGES, DECLARED_PAGES = 50.0, 10.0, 5.0
TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
LETTERS = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Numbers of the trigrams of the letters of a text, words set apart by a space."""
    x = np.frombuffer(f" {LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return (x[:-2] * 961 + x[1:-1] * 31 + x[2:]) % (1 << 16) if len(x) > 2 else np.zeros(0, np.int64)


def visible(html: str | None) -> str:
    return TAGS.sub(" ", html or "")


def count_trigrams(batches):
    import pyarrow as pa

    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total.setdefault(lang, np.zeros(1 << 16, np.int64))
            total[lang] += np.bincount(trigrams(text or ""), minlength=1 << 16)
    rows = [(lang, int(t), int(c[t])) for lang, c in total.items() for t in np.flatnonzero(c)]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["lang", "gram", "n"])


def language_model(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log shares of trigrams, from a bounded sample of texts(text, lang)."""
    known = texts.where("lang is not null and lang <> ''").select("lang", "text", F.xxhash64("text").alias("h"))
    langs = sorted(r.lang for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than MOST_LANGUAGES = {MOST_LANGUAGES} languages")
    if not langs:
        return [], np.zeros((0, 1 << 16))
    # The FIT_ROWS least hashes of each language; of copies one is taken.
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = known.select("lang", "h").distinct().withColumn("nr", least).where(F.col("nr") <= FIT_ROWS).select("lang", "h")
    rows = known.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")  # MOST_LANGUAGES * FIT_ROWS pairs at most
    counts = np.zeros((len(langs), 1 << 16))
    for r in rows.mapInArrow(count_trigrams, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        counts[langs.index(r.lang), r.gram] = r["n"]
    counts += 0.5
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def likelihoods(logs: np.ndarray):
    """(page_id, host, suffix, declared, weight, post): the text's posterior under equal priors, weight 0 without text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            post = []
            for html in batch.column(4).to_pylist():
                grams = trigrams(visible(html))
                ll = logs[:, grams].sum(axis=1) * (TEMPER * min(1.0, ENOUGH / max(1, len(grams)))) if len(grams) > 1 else np.zeros(len(logs))
                p = np.exp(ll - ll.max()) + 1e-12
                post.append((p / p.sum()).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(post, pa.list_(pa.float64()))], names=["page_id", "host", "suffix", "declared", "post"])

    return run


def languages(spark: SparkSession, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(page_id, host, declared, lang, probability, text_lang) for each row of pages(page_id, url, html).

    ``texts`` (text, lang) are labelled examples.  A page without text or a
    null one is judged by its declaration and host; without a host by the
    empty host's pages.  Ties go to the first language by code point.  Ids may
    be null, repeated rows give a row each.  Without examples lang is null.
    """
    arrow_batches(spark)
    langs, logs = language_model(texts)
    host = host_of(F.col("url"))
    declared = F.lower(F.regexp_extract(F.col("html"), r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1))
    rows = pages.select("page_id", host.alias("host"), suffix_of(name_of(host)).alias("suffix"), F.coalesce(declared, F.lit("")).alias("declared"), "html")
    if not langs:
        return rows.select("page_id", "host", "declared", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    kind = T.StructType([*rows.drop("html").schema.fields, T.StructField("post", T.ArrayType(T.DoubleType()))])
    # Written, as both the counts and the scores read it and it takes the most time.
    seen = Scratch(spark, "languages").save(rows.mapInArrow(likelihoods(logs), kind), "seen")
    sums = [F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(len(langs))]

    def total(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*sums)

    pieces = total(seen, "host", "suffix", "declared")  # all counts below are sums of these
    again = [F.sum(f"s{k}").alias(f"s{k}") for k in range(len(langs))]
    n = len(langs)
    whole = pieces.agg(*again).select(*[(F.coalesce(f"s{k}", F.lit(0.0)) + 1).alias(f"w{k}") for k in range(n)])
    shares = whole.select(*[(F.col(f"w{k}") / sum(F.col(f"w{j}") for j in range(n))).alias(f"w{k}") for k in range(n)])
    suffixes = pieces.groupBy("suffix").agg(*again).crossJoin(F.broadcast(shares))  # one row
    suffixes = suffixes.select("suffix", *[((F.col(f"s{k}") + SUFFIX_PAGES * F.col(f"w{k}")) / (sum(F.col(f"s{j}") for j in range(n)) + SUFFIX_PAGES)).alias(f"x{k}") for k in range(n)])
    hosts = pieces.groupBy("host", "suffix").agg(*again).join(suffixes, "suffix")
    hosts = hosts.select("host", F.array(*[F.col(f"s{k}") for k in range(n)]).alias("host_sums"), F.array(*[F.col(f"x{k}") for k in range(n)]).alias("suffix_shares"))
    says = pieces.groupBy("declared").agg(*again).crossJoin(F.broadcast(whole))  # one row
    says = says.select("declared", F.array(*[F.log((F.col(f"s{k}") + DECLARED_PAGES / n) / (F.col(f"w{k}") + DECLARED_PAGES)) for k in range(n)]).alias("declared_logs"))
    joined = seen.join(hosts, "host").join(says, "declared")
    own = F.aggregate("host_sums", F.lit(0.0), lambda a, x: a + x)

    def score(k: int):
        prior = (F.col("host_sums")[k] - F.col("post")[k] + HOST_PAGES * F.col("suffix_shares")[k]) / (own - 1 + HOST_PAGES)
        return F.log(F.col("post")[k]) + F.col("declared_logs")[k] + F.log(F.greatest(prior, F.lit(1e-9)))

    scored = joined.withColumn("scores", F.array(*[score(k) for k in range(n)]))
    top = F.array_max("scores")
    names = F.array(*map(F.lit, langs))
    return scored.select(
        "page_id",
        "host",
        "declared",
        names[F.array_position("scores", top).cast("int") - 1].alias("lang"),
        (1 / F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("probability"),
        names[F.array_position("post", F.array_max("post")).cast("int") - 1].alias("text_lang"),
    )
