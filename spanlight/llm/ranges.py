"""Dealing rows into ranges of a key that are known before the shuffle.

Rows of one key may be more than a range should hold.  Such a key is among the
quantiles several times, and its rows are dealt by a hash to as many ranges.
Within a key the order of ranges is then that of the hash.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null key, which comes first.
LOWEST = -(1 << 63)


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 bounds that cut the keys into ranges of about equal counts; a frequent key is there several times."""
    shares = [k / n for k in range(1, n)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(F.coalesce(key, F.lit(LOWEST)), F.array(*map(F.lit, shares)), 100 * n).alias("q")).first().q
    return sorted(found or [])


def range_of(key: str, bounds: list[int], tie: Column) -> Column:
    """The range of a key: the number of bounds below it, and for a key that is several bounds a part of them by the hash ``tie``."""
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(keys: pd.Series, ties: pd.Series) -> pd.Series:
        values = keys.to_numpy(np.int64)
        low, high = np.searchsorted(cuts, values), np.searchsorted(cuts, values, "right")
        # The bound itself starts a range, so k equal bounds leave k ranges to their key.
        share = (ties.to_numpy(np.int64).view(np.uint64) >> np.uint64(40)).astype(np.float64) / (1 << 24)
        return pd.Series(np.where(high > low, low + 1 + np.floor(share * (high - low)).astype(np.int64), low).astype(np.int32))

    return place(F.coalesce(key, F.lit(LOWEST)), tie)


def tie_order(tie: Column) -> Column:
    """What sorts rows of one key as range_of deals them: the hash as an unsigned number."""
    return tie.bitwiseXOR(F.lit(LOWEST))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
