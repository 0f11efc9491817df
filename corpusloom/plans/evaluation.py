"""Queries of metrics, selection, ensembles and resampling over predictions and runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.text import logit, sigmoid
from corpusloom.operators import inference, metrics, reporting
from corpusloom.plans.base import CONFUSION, MCC, PRED, RUNS, predictions, query, runs
from corpusloom.runtime import table

BY = ["configuration", "seed"]
_COUNTS = f"counts AS (SELECT configuration, seed, {CONFUSION} FROM pred GROUP BY ALL)"
_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
_F0 = "coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)"
_N = "(tn + fp + fn + tp)"
_PE = f"(((tn + fp) * (tn + fn) + (fn + tp) * (fp + tp)) / ({_N} * {_N}))"
_SCORES = f"""round((tn + tp) / {_N}, 6) AS accuracy, round({_F1}, 6) AS spam_f1, round(({_F1} + {_F0}) / 2, 6) AS macro_f1, round(({_F0} * (tn + fp) + {_F1} * (fn + tp)) / {_N}, 6) AS weighted_f1, round({MCC}, 6) AS mcc,
    round(coalesce(((tn + tp) / {_N} - {_PE}) / nullif(1 - {_PE}, 0), 0), 6) AS cohen_kappa, round((coalesce(tn / nullif(tn + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0)) / 2, 6) AS balanced_accuracy"""


@query(f"WITH {PRED} SELECT configuration, seed, fold::BIGINT AS fold, {CONFUSION.replace('::DOUBLE', '::BIGINT')} FROM pred GROUP BY ALL")
def a9_confusion_counts(spark, d):
    return metrics.confusion(predictions(spark, d), [*BY, "fold"])


@query(f"WITH {PRED} SELECT configuration, group_id, {CONFUSION.replace('::DOUBLE', '::BIGINT')} FROM pred GROUP BY ALL")
def d11_group_confusion(spark, d):
    return metrics.confusion(predictions(spark, d), ["configuration", "group_id"])


@query(f"""WITH {PRED}, {_COUNTS} SELECT configuration, seed, round(100 * tn / (tn + fp), 6) AS tn_percent, round(100 * fp / (tn + fp), 6) AS false_positive_percent, round(100 * fn / (fn + tp), 6) AS false_negative_percent, round(100 * tp / (fn + tp), 6) AS tp_percent FROM counts""")
def a10_confusion_percentages(spark, d):
    c = metrics.confusion(predictions(spark, d), BY)
    return c.select(*BY, *(v.alias(k) for k, v in metrics.rates().items()))


@query(f"WITH {PRED}, {_COUNTS} SELECT configuration, seed, {_SCORES} FROM counts")
def e1_e4_scores(spark, d):
    return metrics.with_scores(metrics.confusion(predictions(spark, d), BY), BY)


@query(f"""WITH {PRED}, v AS (SELECT configuration, seed, probability, count(*) AS n, sum(label) AS pos FROM pred GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY configuration, seed ORDER BY probability) - (n - 1) / 2.0 AS rank FROM v),
    a AS (SELECT configuration, seed, sum(rank * pos) AS s, sum(pos)::DOUBLE AS p, (sum(n) - sum(pos))::DOUBLE AS q FROM r GROUP BY ALL) SELECT configuration, seed, round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM a""")
def e5_auc(spark, d):
    return metrics.auc(predictions(spark, d), BY)


@query(f"WITH {PRED} SELECT configuration, seed, round(avg((probability - label) ** 2), 6) AS brier FROM pred GROUP BY ALL")
def e6_brier(spark, d):
    return metrics.brier(predictions(spark, d), BY)


_BINS = "b AS (SELECT configuration, seed, least(floor(probability * 15), 14)::INT AS bin, count(*) AS n, avg(probability) AS confidence, avg(label) AS observed FROM pred GROUP BY ALL)"


@query(f"WITH {PRED}, {_BINS} SELECT configuration, seed, bin, n, round(confidence + 1e-9, 6) AS confidence, round(observed + 1e-9, 6) AS observed FROM b")
def a16_calibration_bins(spark, d):
    return metrics.calibration_bins(predictions(spark, d), BY).select(*BY, "bin", "n", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), F.round(F.col("observed") + 1e-9, 6).alias("observed"))


@query(f"WITH {PRED}, {_BINS} SELECT configuration, seed, round(sum(n * abs(confidence - observed)) / sum(n), 6) AS ece FROM b GROUP BY ALL")
def e7_calibration_error(spark, d):
    return metrics.calibration_error(predictions(spark, d), BY)


@query(f"WITH {PRED}, {_COUNTS}, b AS (SELECT configuration, seed, round(avg((probability - label) ** 2), 6) AS brier FROM pred GROUP BY ALL) SELECT configuration, seed, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, {_SCORES}, brier FROM counts JOIN b USING (configuration, seed)")
def e8_metrics_and_confusion(spark, d):
    p = predictions(spark, d)
    c = metrics.confusion(p, BY)
    return c.select(*BY, "tn", "fp", "fn", "tp", *(v.alias(k) for k, v in metrics.scores().items())).join(metrics.brier(p, BY), BY)


@query(f"""WITH {PRED}, v AS (SELECT configuration, seed, probability AS threshold, count(*) AS n, sum(label) AS pos FROM pred GROUP BY ALL),
    s AS (SELECT configuration, seed, threshold, (sum(pos) OVER w)::DOUBLE AS tp, (sum(n) OVER w - sum(pos) OVER w)::DOUBLE AS fp, (sum(pos) OVER p)::DOUBLE AS pp, (sum(n) OVER p)::DOUBLE AS al FROM v WINDOW w AS (PARTITION BY configuration, seed ORDER BY threshold DESC), p AS (PARTITION BY configuration, seed)),
    t AS (SELECT *, pp - tp AS fn, al - pp - fp AS tn FROM s), m AS (SELECT configuration, seed, threshold, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), -1) AS mcc FROM t),
    n AS (SELECT *, max(mcc) OVER (PARTITION BY configuration, seed) AS top FROM m) SELECT configuration, seed, threshold, round(mcc, 6) AS mcc FROM n WHERE mcc >= top - 1e-12 - 1e-5 * abs(top) QUALIFY row_number() OVER (PARTITION BY configuration, seed ORDER BY abs(threshold - 0.5), threshold DESC) = 1""")
def e9_w7_best_threshold(spark, d):
    return metrics.best_threshold(predictions(spark, d), BY)


@query(f"""WITH {PRED}, t AS (SELECT *, (probability >= 0.4)::INT AS tuned FROM pred) SELECT configuration, seed, round(avg((prediction = label)::INT), 6) AS at_half, round(avg((tuned = label)::INT), 6) AS at_tuned FROM t GROUP BY ALL""")
def e10_two_thresholds(spark, d):
    p = predictions(spark, d)
    hit = lambda c: F.round(F.avg((c == F.col("label")).cast("double")), 6)
    return p.groupBy(*BY).agg(hit(F.col("prediction")).alias("at_half"), hit((F.col("probability") >= 0.4).cast("int")).alias("at_tuned"))


@query(f"WITH {PRED} SELECT configuration, seed, row_index, round(ln(greatest(1e-7, least(1 - 1e-7, probability)) / (1 - greatest(1e-7, least(1 - 1e-7, probability)))), 6) AS logit, round(1 / (1 + exp(-greatest(-30, least(30, probability * 100 - 50)))), 6) AS sigmoid FROM pred")
def f14_f15_logit_sigmoid(spark, d):
    p = F.col("probability")
    return predictions(spark, d).select(*BY, "row_index", F.round(logit(p), 6).alias("logit"), F.round(sigmoid(p * 100 - 50), 6).alias("sigmoid"))


@query(f"WITH {RUNS} SELECT configuration, count(*) AS runs, round(avg(mcc), 6) AS mcc_mean, round(stddev_samp(mcc), 6) AS mcc_std, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_std FROM runs GROUP BY configuration")
def a1_mean_std(spark, d):
    return runs(spark, d).groupBy("configuration").agg(F.count("*").alias("runs"), *(f(m).alias(f"{m}_{n}") for m in ("mcc", "accuracy") for n, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("std", lambda c: F.round(F.stddev_samp(c), 6)))))


@query(f"WITH {RUNS} SELECT configuration, median(width)::INT AS width, max(mcc) AS best, min(mcc) AS worst, count(DISTINCT fold) AS folds FROM runs GROUP BY configuration")
def a3_a6_a7_run_extent(spark, d):
    return runs(spark, d).groupBy("configuration").agg(F.median("width").cast("int").alias("width"), F.max("mcc").alias("best"), F.min("mcc").alias("worst"), F.countDistinct("fold").alias("folds"))


@query(f"""WITH {RUNS}, f AS (SELECT configuration, fold, avg(mcc) AS fm, stddev_samp(mcc) AS fs FROM runs GROUP BY ALL), s AS (SELECT configuration, seed, avg(mcc) AS sm FROM runs GROUP BY ALL)
    SELECT configuration, count(*) AS runs, round(avg(mcc), 6) AS mean, round(stddev_samp(mcc), 6) AS run_std, (SELECT round(stddev_samp(fm), 6) FROM f WHERE f.configuration = runs.configuration) AS fold_std, (SELECT round(avg(fs), 6) FROM f WHERE f.configuration = runs.configuration) AS within_fold_seed_std,
    (SELECT round(stddev_samp(sm), 6) FROM s WHERE s.configuration = runs.configuration) AS seed_std FROM runs GROUP BY configuration""")
def a8_variance_parts(spark, d):
    return inference.variance_parts(runs(spark, d), ["configuration"], "mcc")


_ENS = f"{PRED}, ens AS (SELECT configuration, row_index, label, round(avg(probability), 6) AS probability, (round(avg(probability), 6) >= 0.5)::INT AS prediction, (avg(prediction) >= 0.5)::INT AS vote FROM pred GROUP BY ALL)"


def _ensemble(spark, d):
    return inference.mean_ensemble(predictions(spark, d), ["configuration", "row_index", "label"])


@query(f"WITH {_ENS} SELECT * FROM ens")
def a14_a15_ensembles(spark, d):
    return _ensemble(spark, d)


@query(f"WITH {PRED} SELECT configuration, bin AS decile, count(*) AS n, round(quantile_cont(probability, 0.025) + 1e-9, 6) AS low, round(quantile_cont(probability, 0.975) + 1e-9, 6) AS high FROM (SELECT *, row_index % 10 AS bin FROM pred) GROUP BY ALL")
def a21_quantiles(spark, d):
    q = F.expr("percentile(probability, array(0.025, 0.975))")
    return predictions(spark, d).groupBy("configuration", F.pmod("row_index", F.lit(10)).alias("decile")).agg(F.count("*").alias("n"), F.round(q[0] + 1e-9, 6).alias("low"), F.round(q[1] + 1e-9, 6).alias("high"))


@query(f"WITH {RUNS} SELECT seed, fold::BIGINT AS fold, configuration, width, mcc FROM runs QUALIFY row_number() OVER (PARTITION BY seed, fold ORDER BY mcc DESC, width) = 1")
def w1_select_best(spark, d):
    return inference.select_best(runs(spark, d), ["seed", "fold"], "mcc", "width").select("seed", "fold", "configuration", "width", "mcc")


@query(f"WITH {RUNS}, b AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY seed, fold ORDER BY mcc DESC, width) = 1) SELECT configuration, count(*) AS times, round(avg(mcc), 6) AS mcc FROM b GROUP BY configuration UNION ALL SELECT 'config_selected', count(*), round(avg(mcc), 6) FROM b")
def r14_selection_frequency(spark, d):
    b = inference.select_best(runs(spark, d), ["seed", "fold"], "mcc", "width")
    both = b.unionByName(b.withColumn("configuration", F.lit("config_selected")))
    return both.groupBy("configuration").agg(F.count("*").alias("times"), F.round(F.avg("mcc"), 6).alias("mcc"))


@query(f"WITH {RUNS}, r AS (SELECT configuration, round(avg(mcc), 4) AS shown FROM runs GROUP BY 1), k AS (SELECT *, dense_rank() OVER (ORDER BY shown DESC) AS place FROM r) SELECT configuration, shown, place::INT AS place, CASE place WHEN 1 THEN 'best' WHEN 2 THEN 'second' ELSE '' END AS mark, CASE WHEN place = 1 THEN '\\textbf{{' || format('{{:.4f}}', shown) || '}}' WHEN place = 2 THEN '\\underline{{' || format('{{:.4f}}', shown) || '}}' ELSE format('{{:.4f}}', shown) END AS cell FROM k")
def w6_x1_marks(spark, d):
    r = runs(spark, d).groupBy("configuration").agg(F.round(F.avg("mcc"), 4).alias("shown"))
    return reporting.marks(r, "shown").withColumn("cell", reporting.latex_cell(F.format_string("%.4f", "shown"), F.col("mark"))).select("configuration", "shown", "place", "mark", "cell")


@query(f"WITH {RUNS} SELECT configuration, format('{{:.4f}}', round(avg(mcc), 4)) || ' ± ' || format('{{:.4f}}', round(stddev_samp(mcc), 4)) AS mcc, format('{{:,}}', count(*) * 1000) AS cost FROM runs GROUP BY configuration")
def x2_cost_table(spark, d):
    r = runs(spark, d).groupBy("configuration").agg(F.round(F.avg("mcc"), 4).alias("m"), F.round(F.stddev_samp("mcc"), 4).alias("s"), F.count("*").alias("n"))
    return r.select("configuration", reporting.mean_sd(F.col("m"), F.col("s")).alias("mcc"), F.format_number(F.col("n") * 1000, 0).alias("cost"))


@query(f"WITH {RUNS} SELECT DISTINCT configuration || suffix AS configuration, family, CASE WHEN width >= 512 THEN 'wide' WHEN width >= 128 THEN 'middle' ELSE 'narrow' END AS size FROM runs, (VALUES ('', 'plain'), ('_pca', 'pca'), ('_concat_gated', 'gated'), ('_RP64', 'random projection')) x(suffix, family)")
def proj_p10_name_rules(spark, d):
    size = F.when(F.col("width") >= 512, "wide").when(F.col("width") >= 128, "middle").otherwise("narrow")
    named = F.explode(F.array(*(F.concat("configuration", F.lit(x)) for x in ("", "_pca", "_concat_gated", "_RP64"))))
    r = runs(spark, d).select(named.alias("configuration"), size.alias("size"))
    return r.select("configuration", reporting.family(F.col("configuration")).alias("family"), "size").distinct()


@query(f"WITH {RUNS}, a AS (SELECT seed, configuration, round(avg(mcc), 6) AS m FROM runs GROUP BY ALL) SELECT seed, {', '.join(f'''max(m) FILTER (configuration = 'config_{c}') AS config_{c}''' for c in range(1, 5))} FROM a GROUP BY seed")
def proj_p2_pivot(spark, d):
    return runs(spark, d).groupBy("seed").pivot("configuration", [f"config_{c}" for c in range(1, 5)]).agg(F.round(F.avg("mcc"), 6))


_DIFF = "a AS (SELECT fold, seed, mcc FROM runs WHERE configuration = 'config_4' AND NOT (fold = 0 AND seed = 1)), b AS (SELECT fold, seed, mcc FROM runs WHERE configuration = 'config_1'), diff AS (SELECT fold, seed, round(a.mcc - b.mcc, 6) AS difference FROM a FULL JOIN b USING (fold, seed))"


def _differences(spark, d):
    r = runs(spark, d)
    return inference.paired_differences(r.where("configuration = 'config_4' and not (fold = 0 and seed = 1)"), r.where("configuration = 'config_1'"), ["fold", "seed"], "mcc")


@query(f"WITH {RUNS}, {_DIFF} SELECT fold::BIGINT AS fold, seed, difference FROM diff")
def j5_aligned_differences(spark, d):
    return _differences(spark, d)


@query(f"WITH {RUNS} SELECT configuration, fold::BIGINT AS fold, count(mcc) AS n, round(avg(mcc), 6) AS mean, round(avg(mcc) - 2.776445105 * stddev_samp(mcc) / sqrt(count(mcc)), 6) AS low, round(avg(mcc) + 2.776445105 * stddev_samp(mcc) / sqrt(count(mcc)), 6) AS high FROM runs GROUP BY ALL")
def r11_t_interval(spark, d):
    return inference.t_interval(runs(spark, d), ["configuration", "fold"], "mcc")


@query(f"WITH {RUNS}, {_DIFF}, f AS (SELECT fold, avg(difference) AS m FROM diff GROUP BY fold) SELECT 'config_4 - config_1' AS pair, count(m) AS n, round(avg(m), 6) AS mean, round(avg(m) - 2.776445105 * stddev_samp(m) / sqrt(count(m)), 6) AS low, round(avg(m) + 2.776445105 * stddev_samp(m) / sqrt(count(m)), 6) AS high FROM f")
def r12_r13_paired_interval(spark, d):
    f = _differences(spark, d).groupBy("fold").agg(F.avg("difference").alias("m")).withColumn("pair", F.lit("config_4 - config_1"))
    return inference.t_interval(f, ["pair"], "m")


@query(f"WITH {PRED} SELECT configuration, seed, count(*) AS n, count(DISTINCT row_index) AS rows, count(*) FILTER (probability IS NULL) AS missing, count(*) = (SELECT count(*) FROM embeddings) AND count(DISTINCT row_index) = (SELECT count(*) FROM embeddings) AS complete FROM pred GROUP BY ALL")
def r15_c6_completeness(spark, d):
    n = table(spark, d, "embeddings").count()
    return inference.completeness(predictions(spark, d), BY, n)


_FACT = "(SELECT coalesce(sum(ln(i)), 0) FROM range(1, {0} + 1) t(i))"


@query(f"""WITH {_ENS}, p AS (SELECT a.row_index, a.prediction = a.label AS ca, b.prediction = b.label AS cb FROM ens a JOIN ens b USING (row_index) WHERE a.configuration = 'config_4' AND b.configuration = 'config_1'),
    c AS (SELECT count(*) FILTER (ca AND NOT cb) AS only_a, count(*) FILTER (cb AND NOT ca) AS only_b FROM p), f AS (SELECT i, sum(CASE WHEN i > 0 THEN ln(i) ELSE 0 END) OVER (ORDER BY i) AS lf FROM range(0, 100000) t(i)),
    t AS (SELECT sum(exp((SELECT lf FROM f WHERE i = only_a + only_b) - f.lf - g.lf - (only_a + only_b) * ln(2))) AS tail FROM c, f, f g WHERE f.i <= least(only_a, only_b) AND g.i = only_a + only_b - f.i)
    SELECT 'config_4/config_1' AS pair, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6) AS p_value FROM c, t""")
def r10_mcnemar(spark, d):
    e = _ensemble(spark, d)
    side = lambda c, n: e.where(F.col("configuration") == c).select("row_index", (F.col("prediction") == F.col("label")).alias(n))
    return inference.mcnemar(side("config_4", "correct_a").join(side("config_1", "correct_b"), "row_index").withColumn("pair", F.lit("config_4/config_1")), ["pair"])


def _boot_sql(reps: int, seed: int) -> str:
    p = "2147483647"
    x = f"[(rep * 7919 + i * 104729 + {seed}) % {p}]"
    for s in (f"x * 48271 % {p}", f"x * x % {p}", f"((x + rep * 31 + i * 17) % {p}) * 69621 % {p}", f"(x * x % {p}) % n"):
        x = f"list_transform({x}, lambda x: {s})"
    cells = ", ".join(f"sum(CASE WHEN configuration = '{c}' AND label = {y} AND prediction = {q} THEN 1 ELSE 0 END) AS {a}_{n}" for c, a in (("config_4", "a"), ("config_1", "b")) for n, y, q in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))
    mcc = lambda m: f"round(coalesce(({m}_tp * {m}_tn - {m}_fp * {m}_fn) / nullif(sqrt(({m}_tp + {m}_fp) * ({m}_tp + {m}_fn) * ({m}_tn + {m}_fp) * ({m}_tn + {m}_fn)), 0), 0), 12)"
    return f"""WITH {_ENS}, g AS (SELECT row_index // 4 AS group_id, {cells} FROM ens GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS k FROM g), n AS (SELECT count(*) AS n FROM g),
    dr AS (SELECT rep, {x}[1] AS k FROM n, range({reps}) r(rep), range((SELECT count(*) FROM g)) t(i)), s AS (SELECT rep, {', '.join(f'sum({m}_{c})::DOUBLE AS {m}_{c}' for m in 'ab' for c in ('tn', 'fp', 'fn', 'tp'))} FROM dr JOIN k USING (k) GROUP BY rep),
    d AS (SELECT {mcc('a')} - {mcc('b')} AS d FROM s) SELECT count(*) AS reps, round(avg(d), 6) AS mean_difference, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(avg((d > 0)::INT), 6) AS p_positive FROM d"""


@query(_boot_sql(2000, 20260922))
def r5_r8_cluster_bootstrap(spark, d):
    e = _ensemble(spark, d).withColumn("group_id", F.floor(F.col("row_index") / 4))
    side = lambda c, m: metrics.confusion(e.where(F.col("configuration") == c), ["group_id"]).select("group_id", *(F.col(x).alias(f"{m}_{x}") for x in ("tn", "fp", "fn", "tp")))
    return inference.bootstrap_difference(side("config_4", "a").join(side("config_1", "b"), "group_id"), "a", "b", 2000, 20260922)


@query(f"""WITH {PRED}, k AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY row_index) - 1 AS k, count(*) OVER (PARTITION BY label) AS n, prediction FROM pred WHERE configuration = 'config_2' AND seed = 1),
    sizes AS (SELECT label, count(*) AS n FROM k GROUP BY label), dr AS (SELECT rep, label, list_transform(list_transform(list_transform(list_transform([(rep * 7919 + i * 104729 + (77 + label)) % 2147483647], lambda x: x * 48271 % 2147483647), lambda x: x * x % 2147483647), lambda x: ((x + rep * 31 + i * 17) % 2147483647) * 69621 % 2147483647), lambda x: (x * x % 2147483647) % n)[1] AS k FROM sizes, range(500) r(rep), unnest(range(n)) t(i)),
    c AS (SELECT rep, avg((prediction = label)::INT) AS accuracy FROM dr JOIN k USING (label, k) GROUP BY rep) SELECT count(*) AS reps, round(avg(accuracy), 6) AS mean, round(quantile_cont(accuracy, 0.025), 6) AS low, round(quantile_cont(accuracy, 0.975), 6) AS high FROM c""")
def r9_stratified_bootstrap(spark, d):
    p = predictions(spark, d).where("configuration = 'config_2' and seed = 1")
    k = p.withColumn("k", (F.row_number().over(Window.partitionBy("label").orderBy("row_index")) - 1).cast("bigint")).select("label", "k", "prediction")
    sizes = k.groupBy("label").agg(F.count("*").alias("n"))
    dr = spark.range(500).withColumnRenamed("id", "rep").crossJoin(F.broadcast(sizes)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    drawn = dr.select("rep", "label", inference.draw(F.col("rep"), F.col("i"), F.col("n"), F.col("label") + 77).alias("k"))
    c = drawn.join(k, ["label", "k"]).groupBy("rep").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
    q = F.expr("percentile(accuracy, array(0.025, 0.975))")
    return c.agg(F.count("*").alias("reps"), F.round(F.avg("accuracy"), 6).alias("mean"), F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("high"))


@query(f"WITH {PRED}, m AS (SELECT row_index, coalesce(language_column, 'none') AS language FROM long_messages), {_COUNTS.replace('SELECT configuration, seed,', 'SELECT configuration, language,').replace('FROM pred', 'FROM pred JOIN m USING (row_index)')} SELECT configuration, language, round({MCC}, 6) AS mcc, round({_F1}, 6) AS spam_f1 FROM counts")
def a20_scores_by_language(spark, d):
    m = table(spark, d, "long_messages").select("row_index", F.coalesce("language_column", F.lit("none")).alias("language"))
    s = metrics.scores()
    return metrics.confusion(predictions(spark, d).join(m, "row_index"), ["configuration", "language"]).select("configuration", "language", s["mcc"].alias("mcc"), s["spam_f1"].alias("spam_f1"))


@query(f"WITH {PRED}, m AS (SELECT configuration, row_index, label, avg(probability) AS p FROM pred GROUP BY ALL) SELECT a.configuration || ' + ' || b.configuration AS fusion, row_index, round((a.p + b.p) / 2, 6) AS fused FROM m a JOIN m b USING (row_index) WHERE a.configuration < b.configuration")
def v14_late_fusion(spark, d):
    """Seed means of every two configurations, averaged: the branches of a row meet in one array."""
    m = predictions(spark, d).groupBy("configuration", "row_index").agg(F.avg("probability").alias("p")).groupBy("row_index").agg(F.array_sort(F.collect_list(F.struct("configuration", "p"))).alias("c"))  # one entry a configuration
    two = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(F.concat(x["configuration"], F.lit(" + "), y["configuration"]).alias("fusion"), F.round((x["p"] + y["p"]) / 2, 6).alias("fused")))))
    return m.select("row_index", F.explode(two).alias("f")).select("f.fusion", "row_index", "f.fused")


@query()
def f16_half_precision(spark, d):
    @F.pandas_udf("double")
    def half(p: pd.Series) -> pd.Series:
        return p.astype(np.float16).astype(float)

    return predictions(spark, d).select(*BY, "row_index", half("probability").alias("probability"))


@query(f"WITH {PRED}, w AS (SELECT DISTINCT configuration, fold, seed FROM pred) SELECT configuration, fold::BIGINT AS fold, seed FROM w WHERE NOT (seed = 1 AND fold < 3)")
def c1_open_work(spark, d):
    work = predictions(spark, d).select("configuration", "fold", "seed").distinct()
    done = work.where("seed = 1 and fold < 3")
    return work.join(done, ["configuration", "fold", "seed"], "left_anti")


@query(f"WITH {RUNS}, t AS (SELECT configuration, seed, fold, mcc + CASE WHEN seed = 5 THEN 1e-4 ELSE 0 END AS again FROM runs) SELECT configuration, seed, fold::BIGINT AS fold, abs(mcc - again) <= 1e-7 AS reproduced FROM runs JOIN t USING (configuration, seed, fold)")
def c7_reproduction(spark, d):
    r = runs(spark, d)
    again = r.select("configuration", "seed", "fold", (F.col("mcc") + F.when(F.col("seed") == 5, 1e-4).otherwise(0.0)).alias("again"))
    return r.join(again, ["configuration", "seed", "fold"]).select("configuration", "seed", "fold", (F.abs(F.col("mcc") - F.col("again")) <= 1e-7).alias("reproduced"))
