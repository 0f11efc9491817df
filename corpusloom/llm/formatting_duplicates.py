"""Duplicates hidden by formatting: Merkle-style hashing of nested records.

A record is a tree: the root (dataset, label) has one unordered set of `Field: value` children where the dataset writes
mail records, else a single text leaf. A leaf is normalised to its words: letter case folded, punctuation at the edges
of words and standing alone removed, blanks collapsed. Child digests are sorted at the unordered node, so the order of
fields does not count, and hashed into the root digest. Records are grouped by root digest; a last comparison of the
whole normalised tree with that of the keeper confirms every copy.

Everything is JVM-side. All records are normalised once, to their digests. The grouping is a min/count aggregate
(combined map-side, so a group that holds a third of all rows is small after the first stage); only records whose digest
occurs more than once are read again for the comparison with their keeper, in a join whose skew adaptive execution
splits. Collapsed sets are counted after that comparison.

Defined cases: a NULL text belongs to no set; NULL label equals NULL, NULL dataset equals NULL; an empty text and one of
nothing but punctuation are copies of each other; equal strings are copies; rows of equal record id (not expected) are one
record of that id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import cut

FIELDS = ("subject", "sender", "list", "body")
FIELD_SETS = ("mail_archive",)


def fold_case(text: Column) -> Column:
    """Full case folding as far as the languages here need it: sharp s, dotted and dotless i, final sigma."""
    low = F.lower(F.regexp_replace(text, "[İı]", "i"))
    return F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), "ς̇", "σ")


def leaf(text: Column) -> Column:
    """The words of a text, as one string with single blanks."""
    words = F.split(F.regexp_replace(fold_case(text), r"[\s\p{Z}]+", " "), " ")
    trimmed = F.transform(words, lambda w: F.regexp_replace(w, r"^[\p{P}|]+|[\p{P}|]+$", ""))
    return F.array_join(F.filter(trimmed, lambda w: w != ""), " ")


def children(text: Column, dataset: Column, field_sets: tuple[str, ...] = FIELD_SETS) -> Column:
    """The child leaves of a record, sorted: `field=words` of each field, or the words of the whole text."""
    names = "|".join(FIELDS)
    cut = F.split(F.regexp_replace(text, rf"(?i)(^|[\n\r|;])\s*({names})\s*:", "\u0001$2\u0002"), "\u0001")
    part = lambda p: F.concat_ws("=", fold_case(F.trim(F.substring_index(p, "\u0002", 1))), leaf(F.substring_index(p, "\u0002", -1)))
    fields = F.array_sort(F.filter(F.transform(cut, lambda p: F.when(F.contains(p, F.lit("\u0002")), part(p)).otherwise(leaf(p))), lambda p: p != ""))
    return F.when(dataset.isin(*field_sets), fields).otherwise(F.array(leaf(text)))


def merkle(records: DataFrame, field_sets: tuple[str, ...] = FIELD_SETS) -> DataFrame:
    """record_id, tree (canonical form) and root (its digest) of every record with a text."""
    kids = records.where(F.col("raw_text").isNotNull()).select(
        "record_id",
        F.to_json(F.struct(F.col("dataset").alias("d"), F.col("label").alias("l"))).alias("head"),
        children(F.col("raw_text"), F.col("dataset"), field_sets).alias("kids"),
    )
    digest = F.md5(F.concat_ws("", F.array_sort(F.transform("kids", lambda k: F.md5(k)))))
    return kids.select("record_id", F.concat_ws("\u0001", "head", F.array_join("kids", "\u0001")).alias("tree"), F.md5(F.concat_ws("\u0001", "head", digest)).alias("root"))


def _confirmed(records: DataFrame, roots: DataFrame, field_sets: tuple[str, ...]) -> DataFrame:
    """keeper_id, record_id of records whose whole tree equals that of the first record of their digest."""
    sets = roots.groupBy("root").agg(F.min("record_id").alias("keeper_id"), F.count("*").alias("n")).where("n > 1").select("root", "keeper_id")
    inside = roots.join(sets, "root").select("record_id", "keeper_id")
    trees = merkle(records.select("record_id", "dataset", "label", "raw_text").join(inside.select("record_id").distinct(), "record_id", "left_semi"), field_sets).select("record_id", "tree")
    inside = cut(inside.distinct().join(trees, "record_id"))
    keepers = inside.where("record_id = keeper_id").select("keeper_id", F.col("tree").alias("kept"))
    return inside.where("record_id <> keeper_id").join(keepers, "keeper_id").where("tree = kept").select("keeper_id", "record_id")


def copies(records: DataFrame, field_sets: tuple[str, ...] = FIELD_SETS) -> DataFrame:
    """keeper_id, record_id of every copy: the found duplicates."""
    return _confirmed(records, cut(merkle(records, field_sets).select("record_id", "root")), field_sets)


def collapsed(records: DataFrame, field_sets: tuple[str, ...] = FIELD_SETS) -> DataFrame:
    """One row per distinct record: its smallest record_id, its digest and the number of its copies, itself included."""
    roots = cut(merkle(records, field_sets).select("record_id", "root"))
    found = cut(_confirmed(records, roots, field_sets))
    n = found.groupBy("keeper_id").agg(F.count("*").alias("n"))
    kept = roots.join(found.select("record_id"), "record_id", "left_anti").withColumnRenamed("record_id", "keeper_id")
    return kept.join(n, "keeper_id", "left").select("keeper_id", "root", (F.coalesce("n", F.lit(0)) + 1).alias("n_copies"))
