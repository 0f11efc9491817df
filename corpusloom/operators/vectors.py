"""Vector-table algebra over (idx, vec ARRAY<DOUBLE>): row 0 is padding, stays zero and is left out of moments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import char_ngrams
from corpusloom.operators import lexical
from corpusloom.operators.prefix import running_total
from corpusloom.runtime import cut


def from_embeddings(embeddings: DataFrame, first: int = 1, width: int = 64) -> DataFrame:
    """idx, vec: a slice of an embedding table; the row of id 0 becomes padding."""
    v = F.transform(F.slice("embedding", first, width), lambda x: x.cast("double"))
    return embeddings.select(F.col("vec_id").alias("idx"), F.when(F.col("vec_id") == 0, F.transform(v, lambda x: F.lit(0.0))).otherwise(v).alias("vec"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pooled(table: DataFrame, ids: DataFrame) -> DataFrame:
    """word, vec: the mean of the table's rows of each word's ids; a word without ids or with an unknown id fails."""
    e = ids.select("word", F.size("ids").alias("n"), F.posexplode_outer("ids").alias("k", "idx")).join(table, "idx", "left")
    bad = F.when(F.col("idx").isNull() | F.col("vec").isNull(), F.raise_error(F.concat(F.lit("empty or unknown ids for "), "word"))).otherwise(F.col("vec"))
    parts = e.select("word", F.posexplode(bad).alias("pos", "x")).groupBy("word", "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))


def moments(table: DataFrame, padding: bool = False, floor: float = 1e-12) -> DataFrame:
    """pos, mean, std (population) of each column; the aggregate is combined map-side, one row a column leaves it."""
    rows = table if padding else table.where("idx <> 0")
    c = rows.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("sq"))
    return c.select("pos", "mean", F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(floor))).alias("std"))


def standardize(table: DataFrame, padding: bool = False) -> DataFrame:
    m = moments(table, padding).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("m"))  # one entry a column
    z = F.zip_with("vec", "m", lambda x, s: (x - s["mean"]) / s["std"])
    return table.crossJoin(F.broadcast(m)).select("idx", F.when(F.col("idx") == 0, F.col("vec")).otherwise(z).alias("vec"))


def concat(tables: list[DataFrame]) -> DataFrame:
    """Side-by-side concatenation on idx; an index that one table lacks fails."""
    out = tables[0].select("idx", F.col("vec").alias("v0"))
    for k, t in enumerate(tables[1:], 1):
        out = out.join(t.select("idx", F.col("vec").alias(f"v{k}")), "idx", "full")
    parts = [F.when(F.col(f"v{k}").isNull(), F.raise_error(F.lit("tables differ in rows"))).otherwise(F.col(f"v{k}")) for k in range(len(tables))]
    return out.select("idx", F.concat(*parts).alias("vec"))


def aligned(table: DataFrame, width: int, eps: float = 1e-5) -> DataFrame:
    """Each row cut to `width` and layer-normalised; padding stays zero."""
    v = F.slice("vec", 1, width)
    t = table.select("idx", v.alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    t = t.withColumn("mean", mean).withColumn("var", F.aggregate(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda s, x: s + x) / F.size("v"))
    return t.select("idx", F.when(F.col("idx") == 0, F.transform("v", lambda x: F.lit(0.0))).otherwise(F.transform("v", lambda x: (x - F.col("mean")) / F.sqrt(F.col("var") + eps))).alias("vec"))


def mean_fusion(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("idx", F.col("vec").alias("va")).join(b.select("idx", F.col("vec").alias("vb")), "idx").select("idx", F.zip_with("va", "vb", lambda x, y: (x + y) / 2).alias("vec"))


def gated_fusion(a: DataFrame, b: DataFrame, wa: list[float], wb: list[float], bias: tuple[float, float]) -> DataFrame:
    """Softmax gate over two sources: g = softmax(w_s . concat(a, b) + bias_s), g_a * a + g_b * b."""
    j = a.select("idx", F.col("vec").alias("va")).join(b.select("idx", F.col("vec").alias("vb")), "idx")
    both = F.concat("va", "vb")
    la, lb = (dot(both, F.array(*map(F.lit, w))) + c for w, c in ((wa, bias[0]), (wb, bias[1])))
    g = j.withColumn("g", 1 / (1 + F.exp(lb - la)))
    v = F.zip_with("va", "vb", lambda x, y: F.col("g") * x + (1 - F.col("g")) * y)
    return g.select("idx", F.when(F.col("idx") == 0, F.transform("va", lambda x: F.lit(0.0))).otherwise(v).alias("vec"))


def projection_entry(row: Column, col: Column, seed: int) -> Column:
    """Portable near-normal matrix entry: the centred sum of four uniform draws, unit variance."""
    p = F.lit(2147483647)
    total = F.lit(0.0)
    for k in range(4):
        x = F.pmod(row * 7919 + col * 104729 + seed + k * 15485863, p)
        x = F.pmod(x * 48271, p)
        x = F.pmod(x * x, p)
        x = F.pmod(F.pmod(x + row * 31 + col * 17, p) * 69621, p)
        total = total + F.pmod(x * x, p) / 2147483647.0
    return (total - 2) * (3.0**0.5)


def random_projection(table: DataFrame, width: int, seed: int = 42, used: int | None = None) -> DataFrame:
    """vec . R / sqrt(width) with near-normal R, not centred. `used` keeps the first columns, rescaled to their number."""
    cols = F.sequence(F.lit(0).cast("bigint"), F.lit((used or width) - 1).cast("bigint"))
    out = F.transform(cols, lambda c: F.aggregate(F.transform("vec", lambda x, i: x * projection_entry(i.cast("bigint"), c, seed)), F.lit(0.0), lambda s, x: s + x) / float(used or width) ** 0.5)
    return table.select("idx", out.alias("vec"))


def gram(table: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of outer products, sum and number of rows without padding: one partial sum a partition, added up in a
    tree."""

    def partial(frames):
        import pandas as pd

        n, s, g = 0, 0.0, 0.0
        for f in frames:
            x = np.array(f["vec"].tolist(), dtype=float)
            if len(x):
                n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    parts = table.where("idx <> 0").select("vec").mapInPandas(partial, "n bigint, s array<double>, g array<double>")
    # Arrays are added pairwise in a tree of at most 16-fold fan-in, so the driver meets a few matrices only.
    add = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
    rows = parts.rdd.map(lambda r: (r["n"], np.array(r["s"]), np.array(r["g"])))
    total = rows.treeReduce(add, depth=3) if not parts.isEmpty() else (0, np.zeros(0), np.zeros(0))
    return total[2].reshape(len(total[1]), -1), total[1], int(total[0])


def pca(table: DataFrame, width: int, centered: bool = True) -> tuple[DataFrame, np.ndarray, float]:
    """Scores of the leading components (padding stays zero), eigenvalues S^2 / (n - 1) and the total variance. Signs
    make the largest loading positive. Only the width x width Gram matrix reaches the driver."""
    g, s, n = gram(table)
    mean = s / max(n, 1) if centered else np.zeros(len(s))
    c = (g - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, basis = np.linalg.eigh(c)
    values, basis = values[::-1][:width], basis[:, ::-1][:, :width]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])

    def apply(frames):
        for f in frames:
            x = np.array(f["vec"].tolist(), dtype=float)
            y = (x - mean) @ basis if len(x) else x
            f["vec"] = [[0.0] * basis.shape[1] if i == 0 else r for i, r in zip(f["idx"], y.tolist())]
            yield f[["idx", "vec"]]

    return table.select("idx", "vec").mapInPandas(apply, "idx bigint, vec array<double>"), values, float(np.trace(c))


def explained(spark, values: np.ndarray, total: float) -> DataFrame:
    """component, eigenvalue, ratio and its running sum."""
    e = spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(values)], "component int, eigenvalue double")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)  # one row a component
    return e.select("component", F.round("eigenvalue", 6).alias("eigenvalue"), F.round(F.col("eigenvalue") / total, 6).alias("ratio"), F.round(F.sum("eigenvalue").over(w) / total, 6).alias("cumulative"))


def union_cache(folds: DataFrame) -> DataFrame:
    """word, idx of the words of all folds in the order first seen (fold, then place): 1-based."""
    first = folds.groupBy("word").agg(F.min(F.struct("fold", "place")).alias("first")).withColumn("one", F.lit(1)).withColumn("every", F.lit(0))
    bucket = F.struct(F.col("first.fold").alias("fold"), F.floor(F.col("first.place") / 4096).alias("range"))
    return running_total(first, ["every"], ["first"], bucket, "one", "before", "of").select("word", (F.col("before") + 1).cast("int").alias("idx"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest and mean absolute difference of two tables."""
    j = a.select("idx", F.col("vec").alias("va")).join(b.select("idx", F.col("vec").alias("vb")), "idx").select(F.explode(F.zip_with("va", "vb", lambda x, y: F.abs(x - y))).alias("d"))
    return j.agg(F.count("*").alias("n"), F.round(F.max("d"), 6).alias("max_difference"), F.round(F.avg("d"), 6).alias("mean_difference"))


def _round(rows: DataFrame, q: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X'.(X.Q - shift) and the column sums of X.Q of sparse rows (at, w): each task adds up its rows, blocks of the sums
    are added over the tasks."""
    k, height = q.shape[1], 1024

    def partial(batches):
        z, total = np.zeros(q.shape), np.zeros(k)
        for batch in batches:
            at, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "w"))
            ends = np.concatenate([[0], np.cumsum(batch.column("at").value_lengths().to_numpy(zero_copy_only=False))])
            row = 0
            while row < len(ends) - 1:
                stop = max(row + 1, int(np.searchsorted(ends, ends[row] + 200_000, side="right")) - 1)
                part = slice(ends[row], ends[stop])
                y = np.add.reduceat(q[at[part]] * w[part, None], ends[row:stop] - ends[row], axis=0)
                total += y.sum(axis=0)
                back = np.repeat(y - shift, np.diff(ends[row : stop + 1]), axis=0) * w[part, None]
                for c in range(k):
                    z[:, c] += np.bincount(at[part], back[:, c], len(z))
                row = stop
        bodies = [total.tobytes(), *(z[b : b + height].tobytes() for b in range(0, len(z), height))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(bodies)), pa.int32()), pa.array(bodies, pa.binary())], names=["block", "body"])

    def added(g):
        return g.iloc[:1].assign(body=[sum(np.frombuffer(x) for x in g["body"]).tobytes()])

    few = rows.select("at", "w").coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))  # a task's sums are as large as Q
    parts = few.mapInArrow(partial, "block int, body binary").groupBy("block").applyInPandas(added, "block int, body binary").collect()
    total, *z = (np.frombuffer(r["body"]) for r in sorted(parts, key=lambda r: r["block"]))
    return np.concatenate([np.zeros(0), *z]).reshape(q.shape), total


def sparse_pca(terms: DataFrame, key: str, width: int, oversample: int = 8, rounds: int = 4, centered: bool = True, seed: int = 7) -> tuple[np.ndarray, float]:
    """Leading singular values squared over n - 1 of a long relation (key, term, w) and its total variance, without
    densifying: a round is one pass over sparse rows, centring is an implicit rank-one correction, QR runs on the driver
    on term-count x (width + oversample) numbers of the bounded vocabulary."""
    terms = cut(terms.select(key, "term", "w"))
    known = terms.groupBy("term").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).orderBy("term").toArrow()
    numbered = terms.sparkSession.createDataFrame(pa.table({"term": known["term"], "at": pa.array(np.arange(known.num_rows, dtype=np.int32))}))
    each = terms.join(F.broadcast(numbered), "term").groupBy(key).agg(F.collect_list(F.struct("at", "w")).alias("s"))
    rows = cut(each.select(F.col("s.at").alias("at"), F.col("s.w").alias("w")))
    n, size = rows.count(), known.num_rows
    k = min(width + oversample, size)
    mean = known["s"].to_numpy() / n if centered and n else np.zeros(size)
    variance = float(known["q"].to_numpy().sum()) - n * float(mean @ mean)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, k)))[0]
    values = np.zeros(k)
    for _ in range(rounds if size else 0):
        shift = mean @ q
        z, sums = _round(rows, q, shift)
        z = z - np.outer(mean, sums - n * shift)
        values = np.linalg.svd(q.T @ z, compute_uv=False)
        q = np.linalg.qr(z)[0]
    return np.sort(values)[::-1][:width] / max(n - 1, 1), variance / max(n - 1, 1)


def character_block(words: DataFrame, low: int, high: int, min_df: int, width: int) -> DataFrame:
    """idx, term, w of the words' character n-grams: sublinear weights of unit length (the commonest `width` terms of
    min_df words or more), each term divided by its standard deviation over all words."""
    n = words.agg(F.count("*").alias("n"))
    x = lexical.tfidf(words, char_ngrams(F.col("word"), low, high), key="idx", min_df=min_df, top=width)
    s = x.groupBy("term").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).crossJoin(F.broadcast(n))  # one row a term, one number
    std = F.sqrt(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))
    return x.join(F.broadcast(s.select("term", F.when(std > 0, std).otherwise(1.0).alias("std"))), "term").select("idx", "term", (F.col("w") / F.col("std")).alias("w"))
