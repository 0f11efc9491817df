"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 31


def smallest_hashes(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k rows of smallest key hash. Rows above a threshold that leaves half as many again are dropped before the
    ordered limit, so tasks send about 1.5 k rows in all, whatever their number; fewer than k rows pass only by chance
    of the hash. Keys should be unique."""
    n = df.count()
    h = F.pmod(F.xxhash64(*keys), F.lit(_SPACE))
    some = df.withColumn("_h", h)
    if n > 2 * k:
        some = some.where(F.col("_h") < int(_SPACE * 1.5 * k / n))
    return some.orderBy("_h", *keys).limit(k).drop("_h")
