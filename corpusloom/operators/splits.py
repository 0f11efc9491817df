"""Leakage-controlled splits by source group, and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.prefix import running_total

_P = 2147483647


def shuffled(key: Column, seed: int) -> Column:
    """A portable hash of an id: modular arithmetic with squaring, the same in any engine."""
    x = F.pmod(key.cast("bigint") * 48271 + seed * 7919, F.lit(_P))
    x = F.pmod(x * x, F.lit(_P))
    x = F.pmod((x + F.pmod(key.cast("bigint"), F.lit(_P))) * 69621, F.lit(_P))
    return F.pmod(x * x, F.lit(_P))


def group_labels(messages: DataFrame) -> DataFrame:
    """group_id, label: the label of the group's first row."""
    return messages.where("group_id is not null").groupBy("group_id").agg(F.min_by("label", "row_index").alias("label"))


def _ranked(df: DataFrame, strata: list[str], h: str, key: str) -> DataFrame:
    """Adds _k, the 1-based rank by hash and id within the strata, and _n, their size, over 65,536 ranges of the hash."""
    r = running_total(df.withColumn("_one", F.lit(1)), strata, [h, key], F.floor(F.col(h) / 32768), "_one", "_before_me", "_n")
    return r.withColumn("_k", F.col("_before_me") + 1).drop("_one", "_before_me")


def _stratified(df: DataFrame, key: str, strata: list[str], seed: int) -> DataFrame:
    return _ranked(df.withColumn("_h", shuffled(F.col(key), seed)), strata, "_h", key)


def three_way(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """train, validation, test in the proportions 64:16:20 within each label."""
    u = (F.col("_k") - 0.5) / F.col("_n")
    s = _stratified(df, key, ["label"], seed)
    return s.select(key, F.when(u < 0.64, "train").when(u < 0.80, "validation").otherwise("test").alias("part"))


def folds(groups: DataFrame, n: int = 5, seed: int = 42, inner: float = 0.2) -> DataFrame:
    """fold, group_id, part: each group is test in one fold; the rest of a fold is split again into train and
    validation with a seed of its own."""
    base = _stratified(groups, "group_id", ["label"], seed).select("group_id", "label", F.pmod(F.col("_k") - 1, F.lit(n)).cast("int").alias("own"))
    each = base.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    test = each.where("own = fold").select("fold", "group_id", F.lit("test").alias("part"))
    rest = each.where("own <> fold").withColumn("h", shuffled(F.col("group_id") + F.col("fold") * 1000003, seed))
    k = _ranked(rest, ["fold", "label"], "h", "group_id").withColumn("u", (F.col("_k") - 0.5) / F.col("_n"))
    return test.unionByName(k.select("fold", "group_id", F.when(F.col("u") < inner, "validation").otherwise("train").alias("part")))


def leakage(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """How many keys stand in several parts: pairs of parts and all three."""
    parts = rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg(*(F.max((F.col("part") == p).cast("int")).alias(p) for p in ("train", "validation", "test")))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t, v, e = (F.col(p) == 1 for p in ("train", "validation", "test"))
    return parts.groupBy(*by).agg(F.count("*").alias("n_keys"), count(t & v).alias("train_validation"), count(t & e).alias("train_test"), count(v & e).alias("validation_test"), count(t & v & e).alias("all_three"))


def class_weights(df: DataFrame) -> DataFrame:
    """Inverse-frequency weight n / (2 n_c) of each label and the positive weight neg / max(pos, 1)."""
    c = df.where("label is not null").groupBy("label").agg(F.count("*").alias("n_c"))
    w = Window.partitionBy(F.lit(1))  # one row a label
    pos, neg = (F.sum(F.when(F.col("label") == k, F.col("n_c")).otherwise(0)).over(w) for k in (1, 0))
    return c.select("label", "n_c", F.round(F.sum("n_c").over(w) / (2 * F.col("n_c")), 6).alias("sample_weight"), F.round(neg / F.greatest(pos, F.lit(1)), 6).alias("pos_weight"))
