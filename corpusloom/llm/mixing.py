"""Mixing sources to target weights: a low-discrepancy source schedule over equal-token blocks.

Token counts come from a public tokenizer. Each source's documents are shuffled by a hash, anew for every repeat, and
laid end to end; the running total of tokens gives each document its block of `BLOCK_TOKENS`. A source is used until its
target share of all tokens is reached or its documents were used max_repeats times. The schedule has one slot for each
block: van der Corput points (the reversed bits of the slot number) are mapped through the cumulative weights, so every
stretch of the schedule holds the sources in their proportions; the slots of a source are ranked, and rank k takes its
block k.

No source is ranked by one task: running totals are computed per hash bucket with bucket offsets, and the number of
buckets grows with the documents. Points meet sources by cells of the unit interval. The tables that are broadcast have
one row per source or cell.

Shares are of all tokens of the documents. What a source cannot fill because its repeats are used up stays unfilled: it
goes to no other source, whose tokens stay as wanted, and the mixture is that much smaller. The report gives the share
reached of all tokens and the share of the mixture.

Defined cases: documents with NULL text or NULL source or of a source without a weight are not used; a source without
documents reaches 0; NULL or non-positive shares and repeats count as 0; an empty table gives an empty mixture; repeated
rows are separate documents; ties in the shuffle are broken by doc_id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.prefix import running_total
from corpusloom.runtime import cut

BLOCK_TOKENS = 8192
BUCKET_ROWS = 50_000
CELLS = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counter(path: str = TOKENIZER):
    """A function column -> number of tokens of a text (NULL for NULL)."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for s in texts:
            yield pd.Series([None if t is None else len(coder.encode_ordinary(t)) for t in s], dtype="Int64")

    return count


def sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of every document with a text."""
    return cut(documents.where(F.col("text").isNotNull()).select("doc_id", "source", token_counter(path)(F.col("text")).alias("tokens")))


def plan(counted: DataFrame, weights: DataFrame) -> DataFrame:
    """One row per weighted source: target_share, max_repeats, available and wanted tokens, tokens to use and slots."""
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    have = counted.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n_documents"))
    w = weights.where(F.col("source").isNotNull()).select("source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    p = w.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))
    p = p.withColumn("wanted", F.round(F.col("target_share") * total).cast("bigint"))
    p = p.withColumn("to_use", F.least("wanted", F.col("available") * F.col("max_repeats")))
    return p.withColumn("slots", F.ceil(F.col("to_use") / BLOCK_TOKENS).cast("bigint"))


def van_der_corput(i: Column, bits: int = 52) -> Column:
    """The reversed bits of a number below 2 ** bits, as a point in [0, 1)."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("double") / float(1 << bits)


def schedule(p: DataFrame) -> DataFrame:
    """slot, source, block: which block of which source stands at which place."""
    spark = p.sparkSession
    rows = [(r["source"], r["slots"]) for r in p.select("source", "slots").orderBy("source").collect()]  # one row a source
    whole, borders, at = sum(n for _, n in rows), [], 0
    for source, n in rows:
        lo, hi = at / whole if whole else 0.0, (at + n) / whole if whole else 0.0
        if n:
            borders += [(cell, source, lo, hi, n) for cell in range(int(lo * CELLS), min(int(hi * CELLS), CELLS - 1) + 1)]
        at += n
    edges = F.broadcast(spark.createDataFrame(borders, "cell int, source string, lo double, hi double, n bigint"))
    # Points fill the unit interval only roughly, so a source may get a few slots less than its blocks; some slots more
    # are drawn, and surplus slots are dropped by rank.
    n_points = int(whole * 1.02) + 64 * max(1, len(rows))
    points = spark.range(n_points).select(F.col("id").alias("point"), van_der_corput(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    drawn = points.join(edges, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).withColumn("one", F.lit(1))
    ranked = running_total(drawn.select("point", "source", "n", "one"), ["source"], ["point"], F.floor(F.col("point") / 65536), "one", "block", "of")
    placed = ranked.where(F.col("block") < F.col("n")).select("point", "source", "block")
    # Blocks whose slot lies beyond the last point, a few for each source at most, come at the end.
    got = placed.groupBy("source").agg(F.count("*").alias("got"))
    short = spark.createDataFrame([r for r in rows if r[1]], "source string, n bigint").join(got, "source", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("bigint"))).where("got < n")
    rest = short.select("source", F.explode(F.sequence(F.col("got"), F.col("n") - 1)).alias("block")).select((F.lit(n_points) + F.col("block")).alias("point"), "source", "block")
    return placed.unionByName(rest).select(F.col("point").alias("slot"), "source", "block")


def mixture(documents: DataFrame, weights: DataFrame, path: str = TOKENIZER, seed: int = 11) -> DataFrame:
    """slot, source, block, doc_id, copy, tokens: the mixed corpus, to be read in the order of slots."""
    return _mixed(sizes(documents, path), weights, seed)


def _mixed(counted: DataFrame, weights: DataFrame, seed: int = 11) -> DataFrame:
    p = cut(plan(counted, weights))
    use = F.broadcast(p.where("to_use > 0").select("source", "available", "to_use"))
    docs = counted.where("tokens > 0").join(use, "source")
    copies = docs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("to_use") - 1) / F.col("available")).cast("int"))))
    h = copies.withColumn("h", F.xxhash64("doc_id", "copy", F.lit(seed)))
    buckets = 64 + (p.agg(F.sum("n_documents")).first()[0] or 0) // BUCKET_ROWS
    laid = running_total(h, ["source", "copy"], ["h", "doc_id"], F.pmod("h", F.lit(buckets)), "tokens", "before", "whole")
    at = (F.col("copy") * F.col("available") + F.col("before")).cast("bigint")
    blocks = laid.withColumn("at", at).where(F.col("at") < F.col("to_use")).withColumn("block", F.floor(F.col("at") / BLOCK_TOKENS).cast("bigint"))
    return blocks.select("source", "block", "doc_id", "copy", "tokens").join(schedule(p), ["source", "block"]).select("slot", "source", "block", "doc_id", "copy", "tokens")


def report(documents: DataFrame, weights: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Per source: what was wanted, what was reached, and how often documents were used."""
    counted = sizes(documents, path)
    p = plan(counted, weights)
    mixed = _mixed(counted, weights).groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), (F.max("copy") + 1).alias("repeats"))
    out = p.join(mixed, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0))).withColumn("repeats", F.coalesce("repeats", F.lit(0)))
    whole, every = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))), F.lit(counted.agg(F.sum("tokens")).first()[0] or 0)  # one row a source
    share = lambda of: F.round(F.try_divide(F.col("mixed_tokens"), of), 6)
    return out.select("source", "target_share", "max_repeats", "n_documents", "available", "wanted", "mixed_tokens", "repeats", share(every).alias("reached_share"), share(whole).alias("mixture_share"), (F.col("mixed_tokens") < F.col("wanted")).alias("short"))
