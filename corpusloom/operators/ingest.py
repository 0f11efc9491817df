"""The message relation: wide tables to long ones with an explicit row order, and ordered duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_text
from corpusloom.operators.prefix import running_total


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "text" or c.startswith("text_")]


def widen(messages: DataFrame, languages: list[str]) -> DataFrame:
    """group_id, labels and one text column per language: the first row of each."""
    named = messages.where(F.col("group_id").isNotNull() & F.col("language_column").isin(languages))
    return named.groupBy("group_id").pivot("language_column", languages).agg(F.min_by("raw_text", "row_index")).join(named.groupBy("group_id").agg(F.min_by("labels", "row_index").alias("labels")), "group_id")


def melt(wide: DataFrame) -> DataFrame:
    """row order (column, then group), group_id, labels, language_column, raw_text; NULL texts stay."""
    columns = text_columns(wide)
    long = wide.unpivot(["group_id", "labels"], columns, "language_column", "raw_text")
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("language_column")) - 1
    return long.withColumn("column_place", place.cast("bigint"))


def load_long(wide: DataFrame) -> DataFrame:
    """row_index, group_id, language_column, label, clean_text: NULL texts dropped, the first of equal (labels, text)
    kept in row order, everything but ham positive. Row numbers are running totals over column and group ranges, so no
    task numbers all rows."""
    long = melt(wide).where("raw_text is not null")
    kept = keep_first(long, ["labels", "raw_text"], ["column_place", "group_id"]).withColumn("one", F.lit(1)).withColumn("all_rows", F.lit(0))
    bucket = F.col("column_place") * 1048576 + F.floor(F.col("group_id") / 4096)
    n = running_total(kept, ["all_rows"], ["column_place", "group_id"], bucket, "one", "row_index", "of")
    return n.select(F.col("row_index").cast("bigint").alias("row_index"), "group_id", "language_column", (~F.col("labels").eqNullSafe("ham")).cast("tinyint").alias("label"), clean_text(F.col("raw_text")).alias("clean_text"))


def keep_first(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in the given order. An aggregate that is combined map-side, so the rows of a
    hot key never meet in one task."""
    pick = F.max_by if last else F.min_by
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*others), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicates"), F.count("*").alias("distinct_rows"))
