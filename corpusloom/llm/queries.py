"""Queries of the training-data problems; `__spark_entry__.py` adds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import abuse, confusables, encoding_repair, eval_leaks, formatting_duplicates, language_id, mixing, split_components, split_overlap
from corpusloom.llm.oracle import SQL
from corpusloom.runtime import table


def _sides(spark, d):
    return split_overlap.sides(table(spark, d, "long_messages"), table(spark, d, "fold_split"), table(spark, d, "external_audited"))


def p1_found(spark, d):
    return split_overlap.overlaps(*_sides(spark, d)).select("split_name", "eval_id")


def p1_report(spark, d):
    return split_overlap.report(*_sides(spark, d))


def p2_found(spark, d):
    return split_components.tied(table(spark, d, "group_sources"))


def p2_split(spark, d):
    return split_components.splits(table(spark, d, "long_messages"), table(spark, d, "group_sources"))


def p3_found(spark, d):
    return confusables.look_alikes(table(spark, d, "long_messages"))


def p3_classes(spark, d):
    return confusables.classes(table(spark, d, "long_messages"))


def p3_form(spark, d):
    return confusables.consistent_form(table(spark, d, "long_messages").select("row_index", "raw_text"), "raw_text").select("row_index", "skeleton")


def _languages(spark, d):
    rows = table(spark, d, "long_messages").select("row_index", "language_column", "raw_text")
    return rows, language_id.learn(rows)


def p5_found(spark, d):
    return language_id.foreign_languages(*_languages(spark, d))


def p5_segments(spark, d):
    return language_id.segments(*_languages(spark, d))


def p5_documents(spark, d):
    return language_id.documents(*_languages(spark, d))


def _garbled(spark, d):
    records = table(spark, d, "external_audited")
    return encoding_repair.garbled(records, encoding_repair.fit(records, table(spark, d, "long_messages").select(F.col("raw_text").alias("text"))))


def p6_found(spark, d):
    return _garbled(spark, d).select("record_id")


def p6_restored(spark, d):
    return _garbled(spark, d)


def p7_found(spark, d):
    return formatting_duplicates.copies(table(spark, d, "external_audited"))


def p7_collapsed(spark, d):
    return formatting_duplicates.collapsed(table(spark, d, "external_audited")).select("keeper_id", "n_copies")


def p8_found(spark, d):
    return eval_leaks.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p8_passages(spark, d):
    return eval_leaks.passages(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p8_items(spark, d):
    return eval_leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p9_mixture(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "source_weights"))


def p9_report(spark, d):
    return mixing.report(table(spark, d, "documents"), table(spark, d, "source_weights"))


def _abuse(spark, d):
    docs = table(spark, d, "documents")
    return docs, abuse.learn(docs, table(spark, d, "review_labels"))


def p10_found(spark, d):
    return abuse.scores(*_abuse(spark, d)).where("score >= 0.5").select("doc_id")


def p10_scores(spark, d):
    return abuse.scores(*_abuse(spark, d))


def p10_rates(spark, d):
    return abuse.rates(*_abuse(spark, d))


def queries():
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


def oracle_sql():
    return dict(SQL)
