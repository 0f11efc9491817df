"""Model selection, ensembles, resampling and exact tests over prediction and run relations."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import metrics
from corpusloom.operators.prefix import running_total

_P = 2147483647
#: 0.975 quantiles of Student's t by degrees of freedom.
T_975 = {1: 12.706204736, 2: 4.302652730, 3: 3.182446305, 4: 2.776445105, 5: 2.570581836, 9: 2.262157163, 24: 2.063898562}


def draw(rep: Column, i: Column, n: Column, seed: int) -> Column:
    """A portable draw from 0..n-1 for place i of a replicate; the squaring steps break the lattice of a linear one."""
    p = F.lit(_P)
    x = F.pmod(rep * 7919 + i * 104729 + seed, p)
    x = F.pmod(x * 48271, p)
    x = F.pmod(x * x, p)
    x = F.pmod(F.pmod(x + rep * 31 + i * 17, p) * 69621, p)
    return F.pmod(F.pmod(x * x, p), n)


def select_best(runs: DataFrame, by: list[str], score: str, width: str) -> DataFrame:
    """Per group the run of the highest score, then the smallest width."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), width)
    return runs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def mean_ensemble(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Mean probability over seeds, its prediction, and the majority vote (ties are positive)."""
    vote = (F.avg((F.col("probability") >= 0.5).cast("double")) >= 0.5).cast("int")
    mean = F.round(F.avg("probability"), 6)
    return predictions.groupBy(*by).agg(mean.alias("probability"), (mean >= 0.5).cast("int").alias("prediction"), vote.alias("vote"))


def bootstrap_difference(groups: DataFrame, a: str, b: str, reps: int, seed: int) -> DataFrame:
    """Interval of the difference of two correlation coefficients under resampling of groups. groups has one row per
    group with tn, fp, fn, tp of both models; a replicate draws groups, so its sufficient statistic is eight sums, and
    the replicates are spread over the cluster."""
    spark = groups.sparkSession
    ranked = groups.withColumn("one", F.lit(1)).withColumn("every", F.lit(0))
    numbered = running_total(ranked, ["every"], ["group_id"], F.floor(F.col("group_id") / 4096), "one", "k", "of").drop("one", "every", "of").withColumn("k", F.col("k").cast("bigint"))
    n = numbered.agg(F.count("*").alias("n"))
    draws = spark.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(n)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    picked = draws.select("rep", draw(F.col("rep"), F.col("i"), F.col("n"), seed).alias("k")).groupBy("rep", "k").agg(F.count("*").alias("times"))
    cells = [f"{m}_{c}" for m in (a, b) for c in ("tn", "fp", "fn", "tp")]
    sums = picked.join(numbered, "k").groupBy("rep").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in cells))
    mcc = lambda m: metrics.scores(*(f"{m}_{c}" for c in ("tn", "fp", "fn", "tp")), digits=12)["mcc"]
    d = sums.select((mcc(a) - mcc(b)).alias("d"))
    q = F.expr("percentile(d, array(0.025, 0.975))")
    return d.agg(F.count("*").alias("reps"), F.round(F.avg("d"), 6).alias("mean_difference"), F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("high"), F.round(F.avg((F.col("d") > 0).cast("double")), 6).alias("p_positive"))


def mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Exact two-sided test of the discordant pairs: correct_a, correct_b -> counts and p (1 if there are none)."""
    c = pairs.groupBy(*by).agg(F.sum(F.when(F.col("correct_a") & ~F.col("correct_b"), 1).otherwise(0)).alias("only_a"), F.sum(F.when(~F.col("correct_a") & F.col("correct_b"), 1).otherwise(0)).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    t = c.withColumn("n", n).withColumn("k", k)
    # ln C(n, i) and the logarithm of the sum so far go from i - 1 to i in one step, so the work is linear in k.
    first = F.struct((-F.col("n") * F.ln(F.lit(2.0))).alias("term"), (-F.col("n") * F.ln(F.lit(2.0))).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.ln((F.col("n") - i + 1) / i)
        high, low = F.greatest(term, s["total"]), F.least(term, s["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    tail = F.exp(F.aggregate(F.when(F.col("k") > 0, F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("k"), F.lit(1)).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), first, step)["total"])
    return t.select(*by, "only_a", "only_b", F.round(F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), 6).alias("p_value"))


def t_interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and Student interval over the rows of each group."""
    n = F.count(value)
    t = F.create_map(*(F.lit(x) for kv in T_975.items() for x in kv))
    a = df.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    half = t[(F.col("n") - 1).cast("int")] * F.col("s") / F.sqrt("n")
    return a.select(*by, "n", F.round("m", 6).alias("mean"), F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"))


def paired_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Aligned a - b: a missing side gives NULL."""
    x, y = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    return x.join(y, keys, "full").select(*keys, F.round(F.col("_a") - F.col("_b"), 6).alias("difference"))


def variance_parts(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Standard deviation of all runs, of fold means, and the mean of the seeds' deviations within folds."""
    fold = runs.groupBy(*by, "fold").agg(F.avg(value).alias("fm"), F.stddev_samp(value).alias("fs")).groupBy(*by).agg(F.round(F.stddev_samp("fm"), 6).alias("fold_std"), F.round(F.avg("fs"), 6).alias("within_fold_seed_std"))
    seed = runs.groupBy(*by, "seed").agg(F.avg(value).alias("sm")).groupBy(*by).agg(F.round(F.stddev_samp("sm"), 6).alias("seed_std"))
    whole = runs.groupBy(*by).agg(F.count("*").alias("runs"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("run_std"))
    return whole.join(fold, by).join(seed, by)


def completeness(predictions: DataFrame, by: list[str], expected: int) -> DataFrame:
    """Groups whose predictions are not exactly one for each of `expected` rows."""
    c = predictions.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("row_index").alias("rows"), F.count_if(F.col("probability").isNull()).alias("missing"))
    return c.withColumn("complete", (F.col("n") == expected) & (F.col("rows") == expected) & (F.col("missing") == 0))


#: Cumulative probabilities of a Poisson variable of mean 1, below which a weight is at most 0, 1, 2, ...
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975080)


def out_of_fold(predictions: DataFrame, by: list[str], expected: int) -> DataFrame:
    """by, row_index, label, probability, prediction: the mean of the seeds of each row, pooled over the folds that test
    it. Fails unless every group has the expected number of rows, each with a probability."""
    p = predictions.groupBy(*by, "row_index", "label").agg(F.avg("probability").alias("probability"), F.count_if(F.col("probability").isNull()).alias("_missing"))
    c = p.groupBy(*by).agg(F.count("*").alias("_n"), F.sum("_missing").alias("_m"), F.countDistinct("row_index").alias("_rows"))
    whole = (F.col("_n") == expected) & (F.col("_rows") == expected) & (F.col("_m") == 0)
    ok = F.when(whole, F.col("probability")).otherwise(F.raise_error(F.lit("incomplete out-of-fold probabilities")).cast("double"))
    j = p.join(F.broadcast(c), by)  # one row a group
    return j.select(*by, "row_index", "label", ok.alias("probability")).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def weighted_bootstrap(cells: DataFrame, pairs, reps: int, seed: int) -> DataFrame:
    """cells: configuration, group_id, tn, fp, fn, tp. Interval of the difference of each pair's coefficients and the share
    of replicates above 0. A group's weight in a replicate is a Poisson draw from (replicate, group), the same for all
    configurations, so nothing is numbered or joined: weighted sums are combined map-side, whatever the groups."""
    unit = draw(F.col("rep"), F.col("group_id").cast("bigint"), F.lit(_P), seed) / float(_P)
    spread = cells.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint")))).withColumn("u", unit)
    weight = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    sums = spread.withColumn("weight", weight).groupBy("rep", "configuration").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("tn", "fp", "fn", "tp")))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    m = sums.select("rep", "configuration", F.when(below > 0, (tp * tn - fp * fn) / below).otherwise(0.0).alias("mcc"))
    names = sorted({c for p in pairs for c in p})
    wide = m.groupBy("rep").pivot("configuration", names).agg(F.first("mcc"))
    d = wide.select(F.explode(F.array(*(F.struct(F.lit(f"{a} - {b}").alias("pair"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs))).alias("x")).select("x.*")
    q = F.expr("percentile(d, array(0.025, 0.975))")
    return d.groupBy("pair").agg(F.count("*").alias("reps"), F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("high"), F.round(F.avg((F.col("d") > 0).cast("double")), 6).alias("p_positive"))


def robustness(texts: DataFrame, weights: DataFrame, models: dict) -> DataFrame:
    """texts: row_index, label, clean_text. weights: w, weight. models: name -> which words count. Metrics of every model
    under every perturbation; the perturbed forms of a text travel as one array, and words meet their weights once."""
    c, row = F.col("clean_text"), F.col("row_index")
    forms = {"clean": c, "character_swap": text.swap_characters(c, row), "space_insertion": text.insert_spaces(c, row), "leetspeak": text.leetspeak(c, row), "url_variation": text.vary_urls(c)}
    made = texts.select("row_index", "label", F.explode(F.array(*(F.struct(F.lit(k).alias("perturbation"), f.alias("form")) for k, f in forms.items()))).alias("x"))
    w = made.select("row_index", "label", "x.perturbation", F.explode(text.words(F.col("x.form"))).alias("w")).join(weights, "w", "left")
    sums = w.groupBy("perturbation", "row_index", "label").agg(*(F.sum(F.when(f(F.col("w")), F.coalesce("weight", F.lit(0))).otherwise(0)).alias(f"_{k}") for k, (_, f) in enumerate(models.items())))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), (F.col(f"_{k}") > 0).cast("int").alias("prediction")) for k, n in enumerate(models))))
    p = sums.select("perturbation", "label", each.alias("y")).select("y.model", "perturbation", "label", "y.prediction")
    return metrics.with_scores(metrics.confusion(p, ["model", "perturbation"]), ["model", "perturbation"])


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails if a key occurs twice on either side. Keys are counted by map-side combined aggregates."""
    once = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c), F.first(F.struct(*(x for x in df.columns if x not in keys))).alias(f"{c}_row"))
    j = once(a, "_a").join(once(b, "_b"), keys)
    ok = F.when((F.col("_a") == 1) & (F.col("_b") == 1), F.col("_a_row")).otherwise(F.raise_error(F.concat(F.lit("key occurs twice: "), *(F.col(k).cast("string") for k in keys))))
    return j.select(*keys, ok.alias("_x"), "_b_row").select(*keys, "_x.*", "_b_row.*")


def cost(spark, configuration: str, run, n_messages: int, parameters: int, stored_bytes: int) -> DataFrame:
    """One row: what a run took and holds."""
    began = time.perf_counter()
    run()
    took = time.perf_counter() - began
    row = (configuration, took, took * 1000 / max(1, n_messages), parameters, stored_bytes / 1e6)
    return spark.createDataFrame([row], "configuration string, seconds double, ms_per_message double, parameters bigint, stored_mb double")
