"""Vocabulary, token sequences, term frequencies and coverage as long relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.operators.prefix import running_total


def occurrences(docs: DataFrame, key: str = "row_index", text: str = "clean_text", by: list[str] | None = None) -> DataFrame:
    """by, key, place, word of every word."""
    d = docs.where(F.col(text).isNotNull()).select(*(by or []), key, F.posexplode(words(F.col(text))).alias("place", "word"))
    return d


def vocabulary(docs: DataFrame, key: str = "row_index", text: str = "clean_text", by: list[str] | None = None, top: int | None = None) -> DataFrame:
    """word, cnt, idx: ranked by count, then first occurrence; 1-based, 0 is padding. The counts are combined map-side.
    A top list is an ordered limit; the full rank is a running total over ranges of (count, first row)."""
    by = by or []
    c = occurrences(docs, key, text, by).groupBy(*by, "word").agg(F.count("*").alias("cnt"), F.min(F.struct(key, "place")).alias("first"))
    if top is not None and not by:
        best = c.orderBy(F.desc("cnt"), "first").limit(top)
        return best.select("word", "cnt", F.row_number().over(Window.orderBy(F.desc("cnt"), "first")).alias("idx"))
    rare = (F.lit(1 << 20) - F.col("cnt")) * (1 << 24) + F.least(F.floor(F.col(f"first.{key}") / 4096), F.lit((1 << 24) - 1))
    ranges = F.when(F.col("cnt") >= 1 << 20, F.lit(0).cast("bigint")).otherwise(rare)
    v = running_total(c.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0)), by or ["_all"], [F.desc("cnt"), "first"], ranges, "_one", "_before_me", "_n")
    v = v.withColumn("idx", (F.col("_before_me") + 1).cast("int"))
    v = v if top is None else v.where(F.col("idx") <= top)
    return v.select(*by, "word", "cnt", "idx")


def token_rows(docs: DataFrame, vocab: DataFrame, size: int, key: str = "row_index", text: str = "clean_text") -> DataFrame:
    """key, tokens: the last `size` known words of each row as indices, zero-padded on the left."""
    known = occurrences(docs, key, text).join(vocab.select("word", "idx"), "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "idx"))).alias("s"))
    seq = F.transform("s", lambda x: x["idx"])
    last = F.slice(seq, F.greatest(F.size(seq) - size + 1, F.lit(1)), size)
    padded = F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(size) - F.size(last), F.lit(0))), last)
    return docs.select(key).join(known.select(key, padded.alias("tokens")), key, "left").select(key, F.coalesce("tokens", F.array_repeat(F.lit(0), size)).alias("tokens"))


def coverage(docs: DataFrame, vocab: DataFrame, by: list[str], key: str = "row_index", text: str = "clean_text") -> DataFrame:
    """Per group: share of known words per row, averaged, and share of rows with a known word."""
    o = occurrences(docs, key, text, by).join(vocab.select("word", F.lit(1).alias("known")), "word", "left")
    r = o.groupBy(*by, key).agg(F.count("*").alias("total"), F.count("known").alias("known"))
    rows = docs.select(*by, key).join(r.select(key, "total", "known"), key, "left")
    share = F.coalesce("known", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))
    return rows.groupBy(*by).agg(F.count("*").alias("samples"), F.round(F.avg(share), 6).alias("token_coverage"), F.count_if(F.col("known") > 0).alias("samples_with_at_least_one_known_token"), F.round(F.avg((F.coalesce("known", F.lit(0)) > 0).cast("double")), 6).alias("sample_coverage"))


def tfidf(docs: DataFrame, grams: Column, key: str = "row_index", min_df: int = 1, top: int | None = None, sublinear: bool = True) -> DataFrame:
    """key, term, w: sublinear term frequency, smooth inverse document frequency, unit length. `top` keeps the terms of
    the highest corpus frequency, ties by term."""
    tf = docs.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    if top is not None:
        df = df.orderBy(F.desc("total"), "term").limit(top)
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    local = (1 + F.ln("tf")) if sublinear else F.col("tf").cast("double")
    x = tf.join(idf, "term").select(key, "term", (local * F.col("idf")).alias("v"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return x.join(norm, key).select(key, "term", (F.col("v") / F.col("norm")).alias("w"))


def guarded(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """The current vocabulary (word, idx) if it equals the recorded one, word by word; otherwise reading it fails."""
    j = current.join(recorded.select("word", F.col("idx").alias("_idx")), "word", "full")
    same = F.when(F.col("idx") == F.col("_idx"), F.col("idx")).otherwise(F.raise_error(F.concat(F.lit("the vocabulary drifted at "), "word")).cast("int"))
    return j.select("word", same.alias("idx"))
