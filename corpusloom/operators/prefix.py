"""Cumulative sums that no single task computes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, by: list[str], order: list[str | Column], bucket: Column, value: str, out: str, total: str) -> DataFrame:
    """Adds the sum of `value` over the rows before this one and over all rows, within `by`, ordered by bucket, then
    `order`. Rows are ranked only inside their bucket; the offsets of the buckets (at most groups times buckets rows)
    are ranked on their own, so a group that holds most rows is spread over its buckets. NULL is a group of its own."""
    marked = df.withColumn("_bucket", bucket)
    sums = marked.groupBy(*by, "_bucket").agg(F.sum(value).alias("_in"))
    w = Window.partitionBy(*by)
    offsets = sums.select(*by, "_bucket", (F.sum("_in").over(w.orderBy("_bucket")) - F.col("_in")).alias("_before"), F.sum("_in").over(w).alias(total))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = marked.withColumn("_cum", F.sum(value).over(inside) - F.col(value))
    named = offsets.select(*(F.col(c).alias(f"_by_{k}") for k, c in enumerate(by)), F.col("_bucket").alias("_of"), "_before", total)
    same = F.col("_bucket").eqNullSafe(F.col("_of"))
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by_{k}"))
    return ranked.join(named, same).withColumn(out, F.col("_before") + F.col("_cum")).drop("_bucket", "_cum", "_before", "_of", *(f"_by_{k}" for k in range(len(by))))
