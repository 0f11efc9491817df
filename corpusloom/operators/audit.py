"""Audit of external records against development messages: conflicts, duplicates, exact and near overlap, eligibility."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import clean_text, exact_key, strip
from corpusloom.operators.ingest import keep_first

BITS, BANDS, HAMMING, NEAR = 64, 4, 12, 0.90


def simhashes(texts: list[str]) -> np.ndarray:
    """64-bit similarity hashes over the sets of 4-grams of texts (blanks as _, two blanks at either end): bit b is set if
    at least half of the 64-bit digests have it. Works on the letters of all texts at once; each distinct gram of the
    batch is digested once, and every text adds up the bit rows of its own grams."""
    framed = [f"  {t.replace(' ', '_')}  " for t in texts]
    sizes = np.array([len(t) for t in framed], dtype=np.int64)
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = np.repeat(np.arange(len(texts)), sizes)
    whole = np.flatnonzero(of[3:] == of[:-3]) if len(codes) > 3 else np.zeros(0, dtype=np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(codes, 4)[whole]
    kinds, number = np.unique(np.ascontiguousarray(grams).view("V16").ravel(), return_inverse=True)
    digests = b"".join(hashlib.blake2b(k.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), digest_size=8).digest() for k in kinds)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    pairs = np.unique(of[whole] * max(1, len(kinds)) + number)
    owner = pairs // max(1, len(kinds))
    many = np.bincount(owner, minlength=len(texts))
    ones = np.add.reduceat(bits[pairs % max(1, len(kinds))], np.cumsum(many) - many, axis=0)
    return np.packbits(2 * ones >= many[:, None], axis=1, bitorder="little").view(np.int64).ravel()


@F.pandas_udf(T.LongType())
def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit similarity hash of each text, NULL for NULL."""
    for s in texts:
        known = s.notna()
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        if known.any():
            out[known] = simhashes(s[known].tolist())
        yield out


@F.pandas_udf(T.DoubleType())
def sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Recursive longest-block similarity of query and reference, 0 to 1."""
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype=float)


def bands(h: Column) -> Column:
    return F.array(*(F.struct(F.lit(b).alias("band"), F.shiftrightunsigned(h, 16 * b).bitwiseAND(0xFFFF).alias("key")) for b in range(BANDS)))


def nearest(reference: DataFrame, queries: DataFrame, key: str = "record_id") -> DataFrame:
    """key, nearest_similarity: the best similarity of each query text to a reference text that shares a band of the
    similarity hash and lies within 12 bits. Distinct texts meet on (band, key), never all with all."""
    side = lambda df, c: df.where(F.col("clean_text") != "").select("clean_text").distinct().select(F.col("clean_text").alias(c), simhash("clean_text").alias(f"{c}_hash"))
    q, r = side(queries, "q"), side(reference, "r")
    q, r = (x.select("*", F.explode(bands(F.col(f"{c}_hash"))).alias("b")).select(c, f"{c}_hash", "b.band", "b.key") for x, c in ((q, "q"), (r, "r")))
    near = q.join(r, ["band", "key"]).where(F.bit_count(F.col("q_hash").bitwiseXOR(F.col("r_hash"))) <= HAMMING).select("q", "r").distinct()
    best = near.withColumn("ratio", sequence_ratio("q", "r")).groupBy("q").agg(F.max("ratio").alias("nearest_similarity"))
    return queries.select(key, "clean_text").join(best, F.col("clean_text") == F.col("q"), "left").select(key, F.coalesce("nearest_similarity", F.lit(0.0)).cast("float").alias("nearest_similarity"))


def prepared(records: DataFrame) -> DataFrame:
    """Records with stripped text, clean text and exact key computed anew."""
    r = records.select("record_id", "dataset", strip(F.coalesce("raw_text", F.lit(""))).alias("raw_text"), "label")
    return r.withColumn("clean_text", clean_text(F.col("raw_text"))).withColumn("exact_key", exact_key(F.col("raw_text")))


def consistent(records: DataFrame) -> DataFrame:
    """Per dataset: without keys of conflicting labels and texts that are empty after cleaning; the first of equal keys."""
    conflicts = records.groupBy("dataset", "exact_key").agg(F.countDistinct("label").alias("n")).where("n > 1").select("dataset", "exact_key")
    return keep_first(records.where("clean_text <> ''").join(conflicts, ["dataset", "exact_key"], "left_anti"), ["dataset", "exact_key", "label"], ["record_id"])


def exact_flags(records: DataFrame, development: DataFrame) -> DataFrame:
    """Flags for raw and clean overlap with the development texts: two left joins with distinct keys."""
    raw = development.where("raw_text is not null").select(exact_key(F.col("raw_text")).alias("exact_key")).distinct().withColumn("in_raw", F.lit(True))
    clean = development.where("clean_text is not null and clean_text <> ''").select("clean_text").distinct().withColumn("in_clean", F.lit(True))
    f = records.join(raw, "exact_key", "left").join(clean, "clean_text", "left")
    return f.withColumn("raw_overlap", F.coalesce("in_raw", F.lit(False))).withColumn("clean_overlap", F.coalesce("in_clean", F.lit(False))).drop("in_raw", "in_clean")


def audited(records: DataFrame, development: DataFrame) -> DataFrame:
    """All audit columns of the consistent records."""
    base = exact_flags(consistent(prepared(records)), development)
    near = nearest(development, base).withColumnRenamed("record_id", "id")
    j = base.join(near, F.col("record_id") == F.col("id")).drop("id")
    flag = (F.col("nearest_similarity") >= NEAR) & ~F.col("clean_overlap")
    return j.withColumn("near_overlap", flag).withColumn("eligible_primary", ~F.col("clean_overlap")).withColumn("eligible_strict", ~F.col("clean_overlap") & ~flag)


def summary(records: DataFrame) -> DataFrame:
    """Counts per dataset at each step of the audit that needs no similarity."""
    p = prepared(records)
    steps = p.groupBy("dataset").agg(F.count("*").alias("raw_records"), F.count_if(F.col("clean_text") == "").alias("empty_after_cleaning"))
    c = p.groupBy("dataset", "exact_key").agg(F.countDistinct("label").alias("n"), F.count("*").alias("rows")).where("n > 1").groupBy("dataset").agg(F.sum("rows").alias("conflicting"))
    u = consistent(p).groupBy("dataset").agg(F.count("*").alias("unique_records"))
    return steps.join(c, "dataset", "left").join(u, "dataset", "left").select("dataset", "raw_records", "empty_after_cleaning", F.coalesce("conflicting", F.lit(0)).alias("conflicting"), F.coalesce("unique_records", F.lit(0)).alias("unique_records"))
