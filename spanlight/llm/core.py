"""Pieces that every operator of this subpackage shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.sources.kept import shared_folder

#: Rows of an Arrow batch: whole texts are long, so batches stay small.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to what whole texts allow."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def label_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive lost executors.

    The folder is the one in ``spark.checkpoint.dir``; where that is unset the
    warehouse, or a temporary one if all runs on this machine.  Tables that are
    not dropped before go when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.marked = False

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.mark()
        return self.spark.read.schema(df.schema).parquet(path)

    def mark(self) -> None:
        """Have the folder, which must exist, deleted when the process ends."""
        if not self.marked:
            files, path = self.store("")
            self.marked = files.deleteOnExit(path)

    def store(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names or ("",):
            files, path = self.store(name)
            files.delete(path, True)


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def remembered(key, make):
    """An object that a Python worker keeps for the tasks that follow."""
    import sys
    import types

    memory = sys.modules.setdefault("_worker_memory", types.ModuleType("_worker_memory")).__dict__
    if key not in memory:
        memory[key] = make()
    return memory[key]


def forget() -> None:
    """Give up what the worker remembers, at the start of work that has other needs."""
    import sys

    import pyarrow as pa

    sys.modules.pop("_worker_memory", None)
    pa.default_memory_pool().release_unused()
