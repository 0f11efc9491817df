"""Binary classification metrics as closed forms over confusion counts, and the threshold, calibration and rank metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import running_total


def confusion(df: DataFrame, by: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tn, fp, fn, tp per group: one map-side combined aggregate."""
    y, p = F.col(label), F.col(prediction)
    hit = lambda a, b: F.sum(F.when((y == a) & (p == b), 1).otherwise(0))
    return df.groupBy(*by).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def scores(tn: Column | str = "tn", fp: Column | str = "fp", fn: Column | str = "fn", tp: Column | str = "tp", digits: int = 6) -> dict[str, Column]:
    """Metric name -> expression over confusion counts; 0 where a denominator is 0."""
    tn, fp, fn, tp = ((F.col(x) if isinstance(x, str) else x).cast("double") for x in (tn, fp, fn, tp))
    n = tn + fp + fn + tp
    spam, ham = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    denominator = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    expected = _ratio((tn + fp) * (tn + fn) + (fn + tp) * (fp + tp), n * n)
    agreed = _ratio(tn + tp, n)
    m = {
        "accuracy": agreed,
        "spam_f1": spam,
        "macro_f1": (spam + ham) / 2,
        "weighted_f1": _ratio(ham * (tn + fp) + spam * (fn + tp), n),
        "mcc": _ratio(tp * tn - fp * fn, denominator),
        "cohen_kappa": F.when(expected < 1, (agreed - expected) / (1 - expected)).otherwise(F.lit(0.0)),
        "balanced_accuracy": (_ratio(tn, tn + fp) + _ratio(tp, tp + fn)) / 2,
    }
    return {k: F.round(v, digits) for k, v in m.items()}


def rates(tn: str = "tn", fp: str = "fp", fn: str = "fn", tp: str = "tp") -> dict[str, Column]:
    c = {k: F.col(k).cast("double") for k in (tn, fp, fn, tp)}
    return {
        "tn_percent": F.round(100 * _ratio(c[tn], c[tn] + c[fp]), 6),
        "false_positive_percent": F.round(100 * _ratio(c[fp], c[tn] + c[fp]), 6),
        "false_negative_percent": F.round(100 * _ratio(c[fn], c[fn] + c[tp]), 6),
        "tp_percent": F.round(100 * _ratio(c[tp], c[fn] + c[tp]), 6),
    }


def with_scores(counts: DataFrame, by: list[str]) -> DataFrame:
    s = scores()
    return counts.select(*by, *(v.alias(k) for k, v in s.items()))


def brier(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg(F.pow(F.col("probability") - F.col("label"), 2)), 6).alias("brier"))


def calibration_bins(df: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    """Count, mean probability and share of positives per probability bin."""
    b = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("probability").alias("confidence"), F.avg(F.col("label").cast("double")).alias("observed"))


def calibration_error(df: DataFrame, by: list[str], bins: int = 15) -> DataFrame:
    c = calibration_bins(df, by, bins)
    return c.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("observed"))) / F.sum("n"), 6).alias("ece"))


_RANGES = 1024


def _above(df: DataFrame, by: list[str]) -> DataFrame:
    """by, probability, n, pos of each distinct probability, with the rows and positives above it and in all. Running
    totals over ranges of probability, so no task orders all values."""
    v = df.groupBy(*by, "probability").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    bucket = F.floor((1 - F.col("probability")) * _RANGES)
    out = running_total(v, by, [F.desc("probability")], bucket, "n", "n_above", "all")
    return running_total(out, by, [F.desc("probability")], bucket, "pos", "pos_above", "all_pos")


def auc(df: DataFrame, by: list[str]) -> DataFrame:
    """Rank-sum area under the curve with average ties: each positive beats the negatives below it, and half of those that
    it ties with."""
    v = _above(df, by)
    below = F.col("all") - F.col("all_pos") - (F.col("n_above") - F.col("pos_above")) - (F.col("n") - F.col("pos"))
    won = F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2)
    a = v.groupBy(*by).agg(F.sum(won).alias("won"), F.max("all_pos").cast("double").alias("p"), F.max("all").cast("double").alias("n"))
    pairs = F.col("p") * (F.col("n") - F.col("p"))
    return a.select(*by, F.round(F.when(pairs > 0, F.col("won") / pairs), 6).alias("auc"))


def best_threshold(df: DataFrame, by: list[str]) -> DataFrame:
    """The threshold of the highest coefficient of correlation (-1 where it has no denominator). Of those within a relative
    tolerance of 1e-5 the closest to 0.5 wins, then the larger."""
    s = _above(df, by).withColumnRenamed("probability", "threshold")
    tp, p, n = (F.col("pos_above") + F.col("pos")).cast("double"), F.col("all_pos").cast("double"), F.col("all").cast("double")
    fp = F.col("n_above") + F.col("n") - tp
    fn, tn = p - tp, n - p - fp
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    s = s.select(*by, "threshold", F.when(below > 0, (tp * tn - fp * fn) / below).otherwise(-1.0).alias("mcc"))
    top = s.groupBy(*by).agg(F.max("mcc").alias("top"))
    same = F.lit(True)
    for c in by:
        same &= F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    near = s.alias("s").join(top.alias("t"), same).where(F.col("mcc") >= F.col("top") - 1e-12 - 1e-5 * F.abs("top"))
    best = near.groupBy(*(F.col(f"s.{c}") for c in by)).agg(F.min_by(F.struct("threshold", "mcc"), F.struct(F.abs(F.col("threshold") - 0.5), -F.col("threshold"))).alias("b"))
    return best.select(*by, "b.threshold", F.round("b.mcc", 6).alias("mcc"))
