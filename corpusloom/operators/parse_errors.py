"""Rows that fail to parse: exploded cells, a rule table, aggregated errors, and the clean rows by anti-join.

A line is cut into cells by splitting at quote characters: pieces at even places lie outside quotes, so only there is
the delimiter a cell border. Cells explode into (row, column, value), meet the rule table of their dataset, and each
failed validation is an error of the row; the errors of a row are aggregated to the first reason that applies. Lines
without an error, found by anti-join, are pivoted into records.

All JVM-side and without regular expressions that recurse over the text, so long lines are safe. The rule table is a
constant of a few rows and is broadcast; the aggregate per line is combined map-side, because all cells of a line come
out of the same task.

Defined cases: a NULL line has the reason column_count, as has a line of a dataset without rules; an empty line is one
empty cell; line ids are taken to be unique (a repeated id is one row with the first reason of all its lines); extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = ("quoting", "column_count", "invalid_value")
_CUT = "\u0001d"
_KEPT = "\u0001e"


@dataclass(frozen=True)
class Rule:
    dataset: str
    column: int
    name: str
    kind: str  # any, not_blank, positive, moment, or a list of values a|b
    loose: bool = False  # any case, blanks around allowed


@dataclass(frozen=True)
class Format:
    dataset: str
    delimiter: str
    rules: tuple[Rule, ...]


def fmt(dataset: str, delimiter: str, *columns: tuple) -> Format:
    return Format(dataset, delimiter, tuple(Rule(dataset, i, *c) for i, c in enumerate(columns)))


#: The line formats of the external collections.
FORMATS = (
    fmt("campus_sms", ",", ("user", "not_blank"), ("seq", "positive"), ("sent_at", "moment"), ("direction", "in|out"), ("network", "any"), ("n_parts", "positive"), ("label", "ham|spam", True), ("message", "not_blank")),
    fmt("bosphor_sms", ";", ("group", "1|2"), ("message", "not_blank"), ("sent_at", "moment")),
    fmt("tube_comments", ",", ("comment_id", "not_blank"), ("author", "any"), ("sent_at", "moment"), ("content", "not_blank"), ("class", "0|1")),
)


def cells(text: Column, delimiter: Column) -> Column:
    """The raw cells of a line, quotes kept."""
    safe = F.replace(text, F.lit("\u0001"), F.lit(_KEPT))
    outside = F.transform(F.split(safe, '"', -1), lambda s, i: F.when(i % 2 == 0, F.replace(s, delimiter, F.lit(_CUT))).otherwise(s))
    return F.transform(F.split(F.array_join(outside, '"'), _CUT, -1), lambda c: F.replace(c, F.lit(_KEPT), F.lit("\u0001")))


def well_quoted(cell: Column) -> Column:
    """A cell without quotes and line breaks, or one wholly in quotes with every quote inside doubled."""
    plain = ~F.contains(cell, F.lit('"')) & ~F.contains(cell, F.lit("\n")) & ~F.contains(cell, F.lit("\r"))
    inner = F.substring(cell, F.lit(2), F.length(cell) - 2)
    wrapped = (F.length(cell) >= 2) & F.startswith(cell, F.lit('"')) & F.endswith(cell, F.lit('"')) & ~F.contains(F.replace(inner, F.lit('""'), F.lit("")), F.lit('"'))
    return plain | wrapped


def unquoted(cell: Column) -> Column:
    return F.when(F.startswith(cell, F.lit('"')), F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)


def valid(value: Column, kind: Column, loose: Column) -> Column:
    """Whether a value fits its rule."""
    not_blank = value.rlike(r"[^\s\p{Z}]")
    positive = value.rlike(r"^[0-9]+\z") & value.rlike("[1-9]")
    moment = value.rlike(r"^\d{4}-\d{2}-\d{2} ([01]\d|2[0-3]):[0-5]\d:[0-5]\d\z") & F.substring(value, 1, 10).try_cast("date").isNotNull() & ~F.startswith(value, F.lit("0000"))
    listed = F.array_contains(F.split(kind, r"\|"), F.when(loose, F.lower(F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+\z", ""))).otherwise(value))
    return F.when(kind == "any", F.lit(True)).when(kind == "not_blank", not_blank).when(kind == "positive", positive).when(kind == "moment", moment).otherwise(listed)


def rule_table(spark, formats: tuple[Format, ...] = FORMATS) -> DataFrame:
    rows = [(r.dataset, r.column, r.name, r.kind, r.loose) for f in formats for r in f.rules]
    return spark.createDataFrame(rows, "dataset string, column int, name string, kind string, loose boolean")


def _with_format(lines: DataFrame, formats: tuple[Format, ...]) -> DataFrame:
    known = lines.sparkSession.createDataFrame([(f.dataset, f.delimiter, len(f.rules)) for f in formats], "dataset string, delimiter string, width int")
    return lines.select("line_id", "dataset", "source_record", "raw_text").join(F.broadcast(known), "dataset", "left").withColumn("cells", cells(F.col("raw_text"), F.col("delimiter")))


def errors(lines: DataFrame, formats: tuple[Format, ...] = FORMATS) -> DataFrame:
    """line_id, dataset, source_record, reason of each failing line, with the columns that failed."""
    cut = _with_format(lines, formats).select("line_id", "dataset", "source_record", "width", "cells")
    good = F.coalesce(F.forall("cells", well_quoted), F.lit(True))
    fits = F.coalesce(F.size("cells") == F.col("width"), F.lit(False))
    whole = cut.withColumn("fault", F.when(~good, 1).when(~fits, 2))
    early = whole.where("fault is not null").select("line_id", "dataset", "source_record", "fault", F.lit(None).cast("string").alias("name"))
    exploded = whole.where("fault is null").select("line_id", "dataset", "source_record", F.posexplode("cells").alias("column", "cell"))
    checked = exploded.join(F.broadcast(rule_table(lines.sparkSession, formats)), ["dataset", "column"])
    late = checked.where(~F.coalesce(valid(unquoted(F.col("cell")), F.col("kind"), F.col("loose")), F.lit(False))).select("line_id", "dataset", "source_record", F.lit(3).alias("fault"), "name")
    found = early.unionByName(late).groupBy("line_id").agg(F.min("dataset").alias("dataset"), F.min("source_record").alias("source_record"), F.min("fault").alias("fault"), F.sort_array(F.collect_set("name")).alias("columns"))
    return found.select("line_id", "dataset", "source_record", F.element_at(F.array(*map(F.lit, REASONS)), F.col("fault")).alias("reason"), "columns")


def records(lines: DataFrame, dataset: str, formats: tuple[Format, ...] = FORMATS) -> DataFrame:
    """The valid lines of one dataset as records with its columns."""
    f = next(x for x in formats if x.dataset == dataset)
    own = lines.where(F.col("dataset") == dataset)
    clean = _with_format(own, formats).join(errors(own, formats).select("line_id"), "line_id", "left_anti")
    value = lambda r: unquoted(F.col("cells")[r.column])
    return clean.select("line_id", "source_record", *((F.lower(F.trim(value(r))) if r.loose else value(r)).alias(r.name) for r in f.rules))
