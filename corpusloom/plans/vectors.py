"""Queries of the vector-table algebra and the models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import models, splits, vectors
from corpusloom.plans.base import parted, query
from corpusloom.operators import lexical
from corpusloom.runtime import table

_SLICE = lambda a, b: f"SELECT vec_id AS idx, CASE WHEN vec_id = 0 THEN list_transform(embedding[{a}:{b}], lambda x: 0.0::DOUBLE) ELSE list_transform(embedding[{a}:{b}], lambda x: x::DOUBLE) END AS vec FROM embeddings"
_TAB = f"ta AS ({_SLICE(1, 32)}), tb AS ({_SLICE(33, 64)})"
_STD = lambda t: f"{t}e AS (SELECT idx, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM {t}), {t}m AS (SELECT pos, avg(x) AS mean, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-12)) AS std FROM {t}e WHERE idx <> 0 GROUP BY pos)"
_LONG = lambda expr, frm: f"SELECT idx, generate_subscripts(v, 1) - 1 AS pos, round(unnest(v), 5) AS x FROM (SELECT idx, {expr} AS v FROM {frm})"


def _tables(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.from_embeddings(e, 1, 32), vectors.from_embeddings(e, 33, 32)


def _long(df, digits: int = 5):
    return df.select("idx", F.posexplode("vec").alias("pos", "x")).select("idx", "pos", F.round("x", digits).alias("x"))


@query(f"WITH {_TAB} {_LONG('vec[1:8]', 'ta')}")
def proj_p8_array_prefix(spark, d):
    return _long(_tables(spark, d)[0].select("idx", F.slice("vec", 1, 8).alias("vec")))


@query(f"""WITH {_TAB}, ids AS (SELECT vec_id AS word, [vec_id, (vec_id * 7 + 1) % (n - 1) + 1, (vec_id * 13 + 5) % (n - 1) + 1] AS ids FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id > 0), e AS (SELECT word, unnest(ids) AS idx FROM ids),
    x AS (SELECT word, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS x FROM e JOIN ta USING (idx)) SELECT word, pos, round(avg(x), 5) AS x FROM x GROUP BY ALL""")
def v2_pooled_vectors(spark, d):
    e = table(spark, d, "embeddings")
    n = e.count() - 1
    ids = e.where("vec_id > 0").select(F.col("vec_id").alias("word"), F.expr(f"array(vec_id, (vec_id * 7 + 1) % {n} + 1, (vec_id * 13 + 5) % {n} + 1)").alias("ids"))
    p = vectors.pooled(_tables(spark, d)[0], ids)
    return p.select("word", F.posexplode("vec").alias("pos", "x")).select("word", "pos", F.round("x", 5).alias("x"))


@query(f"WITH {_TAB}, {_STD('ta')} SELECT pos - 1 AS pos, round(mean, 6) AS mean, round(std, 6) AS std FROM tam")
def a11_column_moments(spark, d):
    return vectors.moments(_tables(spark, d)[0]).select("pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {_TAB}, {_STD('ta')} SELECT idx, pos - 1 AS pos, round(CASE WHEN idx = 0 THEN 0 ELSE (x - mean) / std END, 5) AS x FROM tae JOIN tam USING (pos)")
def v3_standardized(spark, d):
    return _long(vectors.standardize(_tables(spark, d)[0]))


@query(f"WITH {_TAB}, {_STD('ta')}, {_STD('tb')} SELECT idx, pos - 1 AS pos, round(CASE WHEN idx = 0 THEN 0 ELSE (x - mean) / std END, 5) AS x FROM tae JOIN tam USING (pos) UNION ALL SELECT idx, pos + 31, round(CASE WHEN idx = 0 THEN 0 ELSE (x - mean) / std END, 5) FROM tbe JOIN tbm USING (pos)")
def v4_concatenated(spark, d):
    return _long(vectors.concat([vectors.standardize(t) for t in _tables(spark, d)]))


_ALIGN = lambda t: f"{t}l AS (SELECT idx, CASE WHEN idx = 0 THEN list_transform(vec[1:16], lambda x: 0.0::DOUBLE) ELSE list_transform(vec[1:16], lambda x: (x - list_sum(vec[1:16]) / 16) / sqrt(list_sum(list_transform(vec[1:16], lambda y: (y - list_sum(vec[1:16]) / 16) * (y - list_sum(vec[1:16]) / 16))) / 16 + 1e-5)) END AS vec FROM {t})"


@query(f"WITH {_TAB}, {_ALIGN('ta')} {_LONG('vec', 'tal')}")
def v12_aligned_rows(spark, d):
    return _long(vectors.aligned(_tables(spark, d)[0], 16))


@query(f"WITH {_TAB}, {_ALIGN('ta')}, {_ALIGN('tb')}, j AS (SELECT a.idx, a.vec AS va, b.vec AS vb FROM tal a JOIN tbl b ON a.idx = b.idx) {_LONG('list_transform(range(1, 17), lambda i: (va[i] + vb[i]) / 2)', 'j')}")
def v13_mean_fusion(spark, d):
    return _long(vectors.mean_fusion(*(vectors.aligned(t, 16) for t in _tables(spark, d))))


_GA, _GB = [((k * 37) % 11 - 5) / 20 for k in range(32)], [((k * 23) % 13 - 6) / 20 for k in range(32)]


@query(f"""WITH {_TAB}, {_ALIGN('ta')}, {_ALIGN('tb')}, j AS (SELECT a.idx, a.vec AS va, b.vec AS vb, list_concat(a.vec, b.vec) AS ab FROM tal a JOIN tbl b ON a.idx = b.idx),
    g AS (SELECT *, list_sum(list_transform(range(1, 33), lambda i: ab[i] * {_GA}[i])) + 0.45 AS la, list_sum(list_transform(range(1, 33), lambda i: ab[i] * {_GB}[i])) - 0.25 AS lb FROM j), h AS (SELECT *, 1 / (1 + exp(lb - la)) AS g FROM g)
    {_LONG('CASE WHEN idx = 0 THEN list_transform(va, lambda x: 0.0::DOUBLE) ELSE list_transform(range(1, 17), lambda i: g * va[i] + (1 - g) * vb[i]) END', 'h')}""")
def v13_gated_fusion(spark, d):
    return _long(vectors.gated_fusion(*(vectors.aligned(t, 16) for t in _tables(spark, d)), _GA, _GB, (0.45, -0.25)))


def _entry(row: str, col: str, seed: int) -> str:
    p = "2147483647"
    out = []
    for k in range(4):
        x = f"[({row} * 7919 + {col} * 104729 + {seed + k * 15485863}) % {p}]"
        for s in (f"x * 48271 % {p}", f"x * x % {p}", f"((x + {row} * 31 + {col} * 17) % {p}) * 69621 % {p}", f"x * x % {p}"):
            x = f"list_transform({x}, lambda x: {s})"
        out.append(f"{x}[1] / 2147483647.0")
    return f"(({' + '.join(out)} - 2) * sqrt(3))"


_RP = lambda used: f"""WITH {_TAB}, m AS (SELECT i, c, {_entry('i', 'c', 42)} AS r FROM range(32) a(i), range({used}) b(c)), e AS (SELECT idx, generate_subscripts(vec, 1) - 1 AS i, unnest(vec) AS x FROM ta)
    SELECT idx, c::INT AS pos, round(sum(x * r) / sqrt({used}), 5) AS x FROM e JOIN m USING (i) GROUP BY ALL"""  # noqa: E731


@query(_RP(8))
def v10_random_projection(spark, d):
    return _long(vectors.random_projection(_tables(spark, d)[0], 8))


@query(_RP(4))
def v11_narrowed_projection(spark, d):
    return _long(vectors.random_projection(_tables(spark, d)[0], 8, used=4))


@query(f"WITH {_TAB}, {_ALIGN('ta')}, {_ALIGN('tb')}, j AS (SELECT a.idx, unnest(list_transform(range(1, 17), lambda i: abs(a.vec[i] - b.vec[i]))) AS x FROM tal a JOIN tbl b ON a.idx = b.idx) SELECT count(*) AS n, round(max(x), 6) AS max_difference, round(avg(x), 6) AS mean_difference FROM j")
def v16_table_difference(spark, d):
    return vectors.difference(*(vectors.aligned(t, 16) for t in _tables(spark, d)))


@query(f"WITH {_TAB}, e AS (SELECT idx, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM ta WHERE idx <> 0), v AS (SELECT var_samp(x) AS v FROM e GROUP BY pos) SELECT 32::BIGINT AS components, round(sum(v), 4) AS total_variance FROM v")
def v6_total_variance(spark, d):
    _, values, total = vectors.pca(_tables(spark, d)[0], 32)
    assert abs(values.sum() - total) < 1e-6 * max(1.0, total)
    return spark.createDataFrame([(len(values), float(values.sum()))], "components bigint, v double").select("components", F.round("v", 4).alias("total_variance"))


@query()
def v6_pca_scores(spark, d):
    return _long(vectors.pca(_tables(spark, d)[0], 8)[0])


@query()
def v7_pca_uncentered(spark, d):
    return _long(vectors.pca(_tables(spark, d)[0], 8, centered=False)[0])


@query()
def v15_w5_explained_variance(spark, d):
    _, values, total = vectors.pca(_tables(spark, d)[0], 32)
    return vectors.explained(spark, values, total)


def _terms(spark, d):
    from corpusloom.functions.text import words

    p = parted(spark, d).where("clean_text is not null and part = 'train'")
    return lexical.tfidf(p, words(F.col("clean_text")), min_df=2, top=75_000)


@query()
def v8_sparse_pca(spark, d):
    values, total = vectors.sparse_pca(_terms(spark, d), "row_index", 8)
    return spark.createDataFrame([(k + 1, float(v), float(v) / total) for k, v in enumerate(values)], "component int, eigenvalue double, ratio double")


@query()
def v9_truncated_svd(spark, d):
    values, _ = vectors.sparse_pca(_terms(spark, d), "row_index", 8, centered=False)
    return spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(values)], "component int, energy double")


@query("WITH w AS (SELECT doc_id % 5 AS fold, doc_id AS place, coalesce(lang, 'none') AS word FROM documents), f AS (SELECT word, min(fold * 1000000000 + place) AS first FROM w GROUP BY word) SELECT word, row_number() OVER (ORDER BY first)::INT AS idx FROM f")
def v17_w9_first_seen_union(spark, d):
    return vectors.union_cache(table(spark, d, "documents").select(F.pmod("doc_id", F.lit(5)).alias("fold"), F.col("doc_id").alias("place"), F.coalesce("lang", F.lit("none")).alias("word")))


@query(f"WITH {_TAB}, w AS (SELECT doc_id AS word, doc_id % (SELECT count(*) FROM embeddings) AS idx FROM documents), j AS (SELECT word, vec FROM w JOIN ta USING (idx)) SELECT word, generate_subscripts(vec, 1) - 1 AS pos, round(unnest(vec), 5) AS x FROM j")
def j8_gather_vectors(spark, d):
    w = table(spark, d, "documents").select(F.col("doc_id").alias("word"), F.pmod("doc_id", F.lit(table(spark, d, "embeddings").count())).alias("idx"))
    return w.join(_tables(spark, d)[0], "idx").select("word", F.posexplode("vec").alias("pos", "x")).select("word", "pos", F.round("x", 5).alias("x"))


@query(f"WITH {_TAB}, j AS (SELECT ta.idx, CASE WHEN ta.idx % 3 <> 0 THEN 'base' ELSE 'extra' END AS source, CASE WHEN ta.idx % 3 <> 0 THEN ta.vec ELSE tb.vec END AS vec FROM ta JOIN tb USING (idx)) SELECT idx, source, generate_subscripts(vec, 1) - 1 AS pos, round(unnest(vec), 5) AS x FROM j")
def j9_two_source_lookup(spark, d):
    """Every word takes its vector from the base table or, where that lacks it, from the extra one."""
    a, b = _tables(spark, d)
    base = a.where("idx % 3 <> 0").select("idx", F.col("vec").alias("v1"))
    extra = b.where("idx % 3 = 0").select("idx", F.col("vec").alias("v2"))
    j = a.select("idx").join(base, "idx", "left").join(extra, "idx", "left")
    found = F.coalesce("v1", "v2", F.raise_error(F.lit("a word has no vector")).cast("array<double>"))
    return j.select("idx", F.when(F.col("v1").isNotNull(), "base").otherwise("extra").alias("source"), F.posexplode(found).alias("pos", "x")).select("idx", "source", "pos", F.round("x", 5).alias("x"))


def _labelled(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_index"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), (F.col("label") >= 5).cast("int").alias("label"))
    return e.where("row_index % 5 <> 0"), e.where("row_index % 5 = 0")


def _model(name):
    def run(spark, d):
        train, test = _labelled(spark, d)
        return models.fit_predict(train, test, name, 64)

    run.__name__ = name
    return run


for _key, _name in (("m1_logistic_regression", "logistic_regression"), ("m2_linear_svm", "linear_svm"), ("m3_perceptron", "perceptron"), ("m4_boosted_trees", "boosted_trees")):
    _f = _model(_name)
    _f.__name__ = _key
    query()(_f)


def _network(spark, d, sources: int, seeds: tuple[int, ...]):
    """The token network on one fold: all words of the training part (each word takes the vector of its number modulo the
    vectors of the table), the last 128 tokens of every text."""
    p = parted(spark, d).where("clean_text is not null and label is not null")
    vocab = lexical.vocabulary(p.where("part = 'train'"))
    tokens = lexical.token_rows(p, vocab, 128).join(p.select("row_index", "part", "label"), "row_index")
    e = np.array([r["embedding"] for r in table(spark, d, "embeddings").select("embedding").orderBy("vec_id").collect()], dtype=float)  # the frozen table, as it must fit a task
    # Words of one vector are one token, so the table doesn't grow with the vocabulary.
    own = F.transform("tokens", lambda x: F.when(x == 0, 0).otherwise(F.pmod(x - 1, F.lit(len(e))) + 1).cast("int"))
    rows = tokens.select(F.lit(1).alias("fold"), "part", "row_index", F.col("label").cast("int").alias("label"), own.alias("tokens"))
    full = np.vstack([np.zeros((1, e.shape[1])), e])
    runs = spark.createDataFrame([("gated" if sources > 1 else "plain", 1, s) for s in seeds], "configuration string, fold int, seed int")
    return models.train_runs(rows, runs, full, sources=sources)


@query()
def m5_m8_token_network(spark, d):
    return _network(spark, d, 1, (1, 2))


@query()
def m6_gated_network(spark, d):
    """The same network over two halves of the vectors as sources, fused by a learnt gate."""
    return _network(spark, d, 2, (1,))


@query("SELECT label, n_c, round(sum(n_c) OVER () / (2 * n_c), 6) AS sample_weight, round(sum(CASE WHEN label = 0 THEN n_c ELSE 0 END) OVER () / greatest(sum(CASE WHEN label = 1 THEN n_c ELSE 0 END) OVER (), 1), 6) AS pos_weight FROM (SELECT (label >= 5)::INT AS label, count(*) AS n_c FROM embeddings GROUP BY 1)")
def m11_row_weights(spark, d):
    return splits.class_weights(table(spark, d, "embeddings").select((F.col("label") >= 5).cast("int").alias("label")))
