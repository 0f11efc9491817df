import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit, inference, ingest, lexical, metrics, models, splits, vectors
from corpusloom.operators.prefix import running_total
from tests.conftest import rows


def table(spark, values):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(values)], "idx bigint, vec array<double>")


def vec(df):
    return [r["vec"] for r in df.orderBy("idx").collect()]


def test_clean_text_edges(spark):
    given = ["coûte5€ rien", "@Élan #été ok là", "नमस्ते दुनिया", "<b>Big</b> <i\nx>", "http://a.b www.c.d text", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(T.clean_text(F.col("t"), normalize=False)).collect()]
    assert got == ["rien", "ok là", "नमस", "big", "text", "", None]


def test_normalized_cleaning(spark):
    df = spark.createDataFrame([("ﬁne ｆｒｅｅ Ⅳ words",)], "t string")
    assert df.select(T.clean_text(F.col("t"), normalize=True)).first()[0] == "fine free iv words"


def padded(r, n, width):
    x = r.standard_normal((n, width)) * r.uniform(0.2, 40, width) + r.uniform(-9, 9, width)
    x[0] = 0
    return x


def test_pooling_is_the_mean_of_the_named_rows(spark):
    r = np.random.default_rng(101)
    x = padded(r, 17, 3)
    ids = {f"w{k}": r.integers(1, 17, r.integers(1, 6)).tolist() for k in range(9)}
    df = spark.createDataFrame(list(ids.items()), "word string, ids array<bigint>")
    got = {q["word"]: q["vec"] for q in vectors.pooled(table(spark, x), df).collect()}
    assert got.keys() == ids.keys() and all(np.allclose(got[w], x[k].mean(axis=0)) for w, k in ids.items())


@pytest.mark.parametrize("ids", [[], [17], [3, 99]])
def test_pooling_refuses_words_without_rows(spark, ids):
    df = spark.createDataFrame([("fine", [2]), ("odd", ids)], "word string, ids array<bigint>")
    with pytest.raises(Exception, match="empty or unknown ids for odd"):
        vectors.pooled(table(spark, padded(np.random.default_rng(102), 17, 2)), df).collect()


def test_standardized_columns_side_by_side(spark):
    r = np.random.default_rng(103)
    parts = [padded(r, 23, w) for w in (4, 1, 2)]
    parts[1][1:, 0] = 7.5  # a constant column
    out = np.array(vec(vectors.concat([vectors.standardize(table(spark, x)) for x in parts])))
    want = np.hstack([np.vstack([np.zeros(x.shape[1]), (x[1:] - x[1:].mean(axis=0)) / np.maximum(x[1:].std(axis=0), 1e-6)]) for x in parts])
    assert out.shape == (23, 7) and not out[0].any()
    assert np.allclose(np.delete(out, 4, axis=1), np.delete(want, 4, axis=1), atol=1e-6) and np.allclose(out[:, 4], 0, atol=1e-3)


def test_tables_of_different_rows_are_not_concatenated(spark):
    r = np.random.default_rng(104)
    with pytest.raises(Exception, match="differ in rows"):
        vectors.concat([table(spark, padded(r, 9, 2)), table(spark, padded(r, 8, 2))]).collect()


def test_alignment_mean_and_gate_against_numpy(spark):
    r = np.random.default_rng(105)
    x, y, width = padded(r, 13, 5), padded(r, 13, 9), 4
    norm = lambda v: (v[:, :width] - v[:, :width].mean(axis=1, keepdims=True)) / np.sqrt(v[:, :width].var(axis=1, keepdims=True) + 1e-5)
    a, b = vectors.aligned(table(spark, x), width), vectors.aligned(table(spark, y), width)
    u, v = norm(x), norm(y)
    assert np.allclose(vec(a)[1:], u[1:]) and np.allclose(vec(b)[1:], v[1:])
    assert np.allclose(vec(vectors.mean_fusion(a, b))[1:], (u[1:] + v[1:]) / 2)
    wa, wb = r.standard_normal(2 * width), r.standard_normal(2 * width)
    z = np.hstack([u, v]) @ np.stack([wa, wb]).T + [-0.7, 0.45]
    g = np.exp(z[:, :1]) / np.exp(z).sum(axis=1, keepdims=True)
    got = vec(vectors.gated_fusion(a, b, wa.tolist(), wb.tolist(), (-0.7, 0.45)))
    assert np.allclose(got[1:], (g * u + (1 - g) * v)[1:]) and not any(got[0])


def test_union_keeps_the_first_sight_of_every_word(spark):
    r = np.random.default_rng(106)
    seen = [(int(f), int(p), f"t{r.integers(0, 40):02d}") for f in range(1, 7) for p in range(15)]
    df = spark.createDataFrame(seen, "fold int, place int, word string").repartition(4)
    want = list(dict.fromkeys(w for *_, w in sorted(seen)))
    assert [w for _, w in sorted((i, w) for w, i in rows(vectors.union_cache(df)))] == want


def test_simhash_against_the_definition(spark):
    r = np.random.default_rng(107)
    texts = ["", "a", "ab cd", "été \U0001f600 ok"] + ["".join(r.choice(list("abc dé"), r.integers(1, 40))) for _ in range(30)]

    def plain(t):
        t = "  " + t.replace(" ", "_") + "  "
        grams = {t[k : k + 4] for k in range(len(t) - 3)}
        d = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little") for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in d) >= len(d))

    assert [int(x) % 2**64 for x in audit.simhashes(texts)] == [plain(t) for t in texts]
    df = spark.createDataFrame([(1, "ab"), (2, None)], "k int, t string").select("k", audit.simhash("t").alias("h"))
    assert {k: h for k, h in rows(df)}[2] is None


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(0).standard_normal((60, 5)) @ np.diag([5, 3, 2, 1, 0.5])
    scores, values, total = vectors.pca(table(spark, np.vstack([np.zeros(5), x])), 3)
    c = x - x.mean(axis=0)
    s = np.linalg.svd(c, compute_uv=False)
    assert np.allclose(values, (s**2 / 59)[:3]) and np.isclose(total, c.var(axis=0, ddof=1).sum())
    y = np.array(vec(scores))
    assert not y[0].any() and np.allclose(np.abs(y[1:].mean(axis=0)), 0, atol=1e-9)


def test_sparse_pca_matches_dense(spark):
    r = np.random.default_rng(1)
    x = r.random((40, 12)) * (r.random((40, 12)) < 0.4)
    df = spark.createDataFrame([(i, f"t{j:02d}", float(x[i, j])) for i in range(40) for j in range(12) if x[i, j]], "row_index bigint, term string, w double")
    values, total = vectors.sparse_pca(df, "row_index", 3, rounds=5)
    kept = x[x.any(axis=1)]
    s = np.linalg.svd(kept - kept.mean(axis=0), compute_uv=False)
    assert np.allclose(values, (s**2 / (len(kept) - 1))[:3], rtol=1e-3) and np.isclose(total, kept.var(axis=0, ddof=1).sum())


def test_sparse_pca_sends_the_driver_blocks_not_numbers(spark, monkeypatch):
    got, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: got.append(collect(self)) or got[-1])
    r = np.random.default_rng(4)
    x = r.random((30, 40)) * (r.random((30, 40)) < 0.3)
    df = spark.createDataFrame([(i, f"t{j:02d}", float(x[i, j])) for i in range(30) for j in range(40) if x[i, j]], "row_index bigint, term string, w double")
    values, _ = vectors.sparse_pca(df, "row_index", 3, rounds=6, centered=False)
    assert np.allclose(values, (np.linalg.svd(x[x.any(axis=1)], compute_uv=False) ** 2 / (x.any(axis=1).sum() - 1))[:3], rtol=1e-3)
    assert max(map(len, got)) <= 2
    assert not vectors.sparse_pca(df.limit(0), "row_index", 3)[0].any()


# Fixed value: the first row is the published one.
@pytest.mark.parametrize("tn,fp,fn,tp,mcc", [(89291, 3120, 1535, 11497, 0.80809), (5, 0, 0, 0, 0.0), (1, 0, 0, 1, 1.0)])
def test_scores(spark, tn, fp, fn, tp, mcc):
    df = spark.createDataFrame([(tn, fp, fn, tp)], "tn bigint, fp bigint, fn bigint, tp bigint")
    assert df.select(metrics.scores()["mcc"]).first()[0] == pytest.approx(mcc, abs=1e-5)


def test_auc_threshold_and_calibration(spark):
    p = [(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.9), (1, 1.0), (0, 0.6)]
    df = spark.createDataFrame([("m", y, x) for y, x in p], "model string, label int, probability double")
    pos, neg = [x for y, x in p if y], [x for y, x in p if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 9
    assert rows(metrics.auc(df, ["model"]))[0][1] == pytest.approx(want, abs=1e-6)
    assert rows(metrics.best_threshold(df, ["model"]))[0][1] == 0.9
    tied = spark.createDataFrame([("m", 0, 0.3), ("m", 0, 0.4), ("m", 1, 0.6), ("n", 1, 0.2), ("n", 1, 0.7)], "model string, label int, probability double")
    assert rows(metrics.best_threshold(tied, ["model"])) == [("m", 0.6, 1.0), ("n", 0.7, -1.0)]
    assert 0 <= rows(metrics.calibration_error(df, ["model"]))[0][1] <= 1


def test_draws_are_as_good_as_random(spark):
    n, reps = 399, 300
    df = spark.range(reps).withColumnRenamed("id", "rep").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    k = df.select("rep", inference.draw(F.col("rep"), F.col("i"), F.lit(n).cast("bigint"), 5).alias("k"))
    distinct = k.groupBy("rep").agg(F.countDistinct("k").alias("d")).agg(F.avg("d")).first()[0]
    assert abs(distinct - n * (1 - (1 - 1 / n) ** n)) < 3


def test_mcnemar(spark):
    df = spark.createDataFrame([("p", True, False)] * 8 + [("p", False, True)] * 2 + [("q", True, True)], "pair string, correct_a boolean, correct_b boolean")
    want = min(1.0, 2 * sum(math.comb(10, i) for i in range(3)) / 2**10)
    assert rows(inference.mcnemar(df, ["pair"])) == [("p", 8, 2, pytest.approx(want, abs=1e-6)), ("q", 0, 0, 1.0)]


def test_folds_are_disjoint_and_cover(spark):
    g = spark.createDataFrame([(k, k % 3 == 0) for k in range(100)], "group_id bigint, y boolean").selectExpr("group_id", "cast(y as int) label")
    f = splits.folds(g).toPandas()
    assert (f.groupby("fold").group_id.nunique() == 100).all() and len(f) == 500
    assert (f[f.part == "test"].groupby("group_id").size() == 1).all()
    row = rows(splits.leakage(splits.folds(g), "group_id", ["fold"]))
    assert all(r[2:] == (0, 0, 0, 0) for r in row)


def test_load_long_keeps_order_and_drops_repeats(spark):
    wide = spark.createDataFrame([(0, "ham", "Hi there", None), (1, "spam", "Hi there", "zwei drei"), (2, "ham", "Hi there", "zwei drei"), (3, None, "x", "")], "group_id bigint, labels string, text string, text_de string")
    got = rows(ingest.load_long(wide).select("row_index", "group_id", "language_column", "label"))
    assert got == [(0, 0, "text", 0), (1, 1, "text", 1), (2, 3, "text", 1), (3, 1, "text_de", 1), (4, 2, "text_de", 0), (5, 3, "text_de", 1)]


def test_running_total(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("v"))
    got = {r["id"]: (r["before"], r["whole"]) for r in running_total(df, ["g"], ["id"], F.floor(F.col("id") / 100), "v", "before", "whole").collect()}
    for i in (0, 1, 998, 999, 501):
        mine = [k for k in range(1000) if k % 2 == i % 2]
        assert got[i] == (sum(k % 7 for k in mine if k < i), sum(k % 7 for k in mine))


def test_vocabulary_and_tokens(spark):
    d = spark.createDataFrame([(1, "b a a"), (2, "c b"), (3, None), (4, "")], "row_index bigint, clean_text string")
    v = lexical.vocabulary(d)
    assert [(r["word"], r["idx"]) for r in v.orderBy("idx").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    assert rows(lexical.token_rows(d, v, 2)) == [(1, [2, 2]), (2, [3, 1]), (3, [0, 0]), (4, [0, 0])]


def test_similarity_join(spark):
    ref = spark.createDataFrame([("the quick brown fox jumps over the lazy dog again",), ("something else entirely",)], "clean_text string")
    q = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog agaim"), (2, "nothing alike here"), (3, "something else entirely")], "record_id bigint, clean_text string")
    got = {k: v for k, v in rows(audit.nearest(ref, q))}
    same = [int(b) % 2**64 for b in (audit.simhashes(["the quick brown fox jumps over the lazy dog again", "the quick brown fox jumps over the lazy dog agaim"]))]
    shared = any((same[0] >> 16 * b & 0xFFFF) == (same[1] >> 16 * b & 0xFFFF) for b in range(4)) and (same[0] ^ same[1]).bit_count() <= 12
    assert got[3] == 1.0 and got[2] == 0.0 and (got[1] > 0.9) == shared


def test_token_network_learns():
    r = np.random.default_rng(0)
    t = r.standard_normal((30, 6))
    t[0] = 0
    x = r.integers(1, 30, (300, 5))
    y = (x == 7).any(axis=1).astype(float)
    net = models.TokenNetwork(6, 1)
    net.fit(t, x, y, x, y, epochs=60, rate=1e-2, dropout=0.1, patience=20)
    z = net.forward(t, x)[0]
    assert ((z > 0) == (y == 1)).mean() > 0.9


def test_gate_gradients_and_deployment():
    r = np.random.default_rng(5)
    t = r.standard_normal((12, 8))
    t[0] = 0
    x, y, w = r.integers(1, 12, (7, 5)), r.integers(0, 2, 7).astype(float), np.ones(7)
    x[:3, :2] = 0
    net = models.TokenNetwork(4, 3, filters=6, hidden=5, sources=2)
    net.p["g"], net.p["gb"] = r.standard_normal((2, 4)) * 0.5, r.standard_normal(2)

    def loss():
        z = net.forward(t, x)[0]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = net.gradients(t, x, y, w, 0.0)
    for name in ("g", "gb", "k", "a", "o"):
        v = net.p[name]
        for at in list(np.ndindex(v.shape))[:6]:
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-6 - g[name][at]) < 1e-5
    plain = models.TokenNetwork(4, 3, filters=6, hidden=5)
    plain.p = {k: v for k, v in net.p.items() if k not in ("g", "gb")}
    assert np.allclose(plain.forward(net.fused(t)[0], x)[0], net.forward(t, x)[0], atol=1e-9)


def test_networks_of_runs_take_batches_that_say_the_same(spark, monkeypatch):
    r = np.random.default_rng(8)
    t = r.standard_normal((20, 6))
    t[0] = 0
    x = np.zeros((70, 9), dtype=np.int64)
    for k in range(70):
        n = r.integers(0, 10)
        x[k, 9 - n :] = r.integers(1, 20, n)
    net = models.TokenNetwork(6, 2)
    net.p["kb"] += 0.5  # windows of padding alone count
    whole = net.forward(t, x)[0]
    e = np.pad(t[x], ((0, 0), (1, 1), (0, 0)))
    win = np.concatenate([e[:, :-2], e[:, 1:-1], e[:, 2:]], axis=2)
    m = np.maximum(win @ net.p["k"] + net.p["kb"], 0).max(axis=1)
    want = (np.maximum(m @ net.p["a"] + net.p["ab"], 0) @ net.p["o"] + net.p["ob"])[:, 0]
    assert np.allclose(whole, want) and np.allclose(net.logits(t, x, 1), want)
    parts = ["train"] * 40 + ["validation"] * 10 + ["test"] * 20
    rows_ = [(1, parts[k], k, int(k % 3 == 0), x[k].tolist()) for k in r.permutation(70).tolist()]
    df = spark.createDataFrame(rows_, "fold int, part string, row_index bigint, label int, tokens array<int>")
    runs = spark.createDataFrame([("a", 1, 4), ("b", 1, 5)], "configuration string, fold int, seed int")
    y = np.arange(70) % 3 == 0
    got = {(q["seed"], q["row_index"]): q["probability"] for q in models.train_runs(df, runs, t, epochs=2).collect()}
    for seed in (4, 5):
        n = models.TokenNetwork(6, seed)
        n.fit(t, x[:40], y[:40].astype(float), x[40:50], y[40:50].astype(float), 2)
        assert np.allclose([got[seed, k] for k in range(50, 70)], 1 / (1 + np.exp(-n.forward(t, x[50:])[0])))
    monkeypatch.setattr(models.TokenNetwork, "forward", lambda self, table, tokens, dropout=0.0: (np.zeros(len(tokens)), None) if len(tokens) <= 1024 else 1 / 0)
    assert len(net.logits(t, models.Tokens(models.pa.array([[1, 2]] * 5000, models.pa.list_(models.pa.int32())), 128))) == 5000
