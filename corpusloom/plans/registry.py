"""All queries of the core with their SQL."""

from __future__ import annotations

from corpusloom.plans import auditing, base, evaluation, parsing, relational, splitting, studies, text, vectors  # noqa: F401  (importing registers)


def queries():
    return base.QUERIES | parsing.QUERIES


def oracle_sql():
    return base.SQL | parsing.SQL


def flagship(spark, sf_dir):
    """Vocabulary of the training part and its coverage of each part and language."""
    return text.a19_vocabulary_coverage(spark, sf_dir)
