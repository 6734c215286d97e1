"""Documents to token files, in five stages of the operators for training data.

Decisions are taken on rows, not on ids: an operator carries the row, has a
number of its own for it, or gives the hash of its text.  So in every stage null ids, ids that several rows
share, repeated rows and further columns are allowed, and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm.core import Scratch, label_bucket, table
from spanlight.llm.decontamination import contamination
from spanlight.llm.mixing import mixed
from spanlight.llm.near_dup import without_near_duplicates
from spanlight.llm.queries import END, THRESHOLD, tokenizer_path
from spanlight.llm.token_files import read_token_files, write_token_files
from spanlight.llm.toxicity import toxicity_scores


def kept_by(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs whose id, which may be null, and text are among the decisions (doc_id, text_hash)."""
    keys = decisions.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash")), "left_semi")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay; learned as in op8.

    Each row is scored by its own text; a null or empty one scores as the
    intercept says.
    """
    scores = toxicity_scores(spark, docs, table(spark, sf_dir, "labels"), label_bucket(F.col("doc_id"), 4) != 2, hashed=True)
    return kept_by(docs, scores.where(F.col("score") < THRESHOLD))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id, a null one last.

    Of repeated rows one stays; rows without words stay all.
    """
    return without_near_duplicates(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item stay, null and empty texts among them."""
    return kept_by(docs, contamination(spark, docs, table(spark, sf_dir, "benchmark"), hashed=True).where("not contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; one not taken goes, one without words counts nothing."""
    taken = mixed(spark, docs, whole=True).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold: (doc_id, start, n_tokens, ids_crc32), a row for each row."""
    scratch = Scratch(spark, "token_files")
    write_token_files(spark, docs, scratch.root, tokenizer_path(), END)
    scratch.mark()
    return read_token_files(spark, scratch.root, digest=True)


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("source_mixing", mix), ("token_binary", tokens)]
#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
