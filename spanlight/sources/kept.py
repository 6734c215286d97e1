"""Tables that a session derives once and that its queries read from Parquet.

A scan of a written table reads only the columns a rule needs, has a short plan
however long the derivation is, and outlives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, ...], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset the warehouse, or a temporary folder if all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local["):
        return tempfile.mkdtemp(prefix="spanlight-")
    return spark.conf.get("spark.sql.warehouse.dir")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, dropped with the session."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def folder(spark: SparkSession, key: tuple[str, ...]) -> str:
    """A folder of its own for each key of a session."""
    key = (spark.sparkContext.applicationId, "folder", *key)
    if key not in _written:
        _written[key] = fresh_folder(spark, "kept")
    return _written[key]


def kept(spark: SparkSession, key: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written at the first call of the session with this key and dropped with the session.

    Later calls read what was written, so a source that changes meanwhile is
    seen as it was at the first.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key not in _written:
        path = f"{shared_folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
        make().write.parquet(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        _written[key] = path
    return spark.read.parquet(_written[key])
