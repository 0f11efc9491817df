"""Base relations of the queries, in Spark and as SQL: messages, splits, and deterministic predictions and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import metrics
from corpusloom.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def messages(spark, d) -> DataFrame:
    return table(spark, d, "long_messages").where("raw_text is not null")


def parted(spark, d) -> DataFrame:
    """Messages with their part."""
    return messages(spark, d).join(table(spark, d, "fold_split").where("part is not null").select("row_index", "part"), "row_index")


MSG = "msg AS (SELECT * FROM long_messages WHERE raw_text IS NOT NULL)"
PARTED = f"{MSG}, parted AS (SELECT msg.*, part FROM msg JOIN fold_split USING (row_index) WHERE part IS NOT NULL)"


def predictions(spark, d) -> DataFrame:
    """configuration, seed, fold, row_index, group_id, label, probability: a linear score of each embedding under
    pseudo-random weights, so folds, seeds and configurations come without training."""
    e = table(spark, d, "embeddings")
    c = spark.range(1, 5).select(F.col("id").alias("c"))
    s = spark.range(1, 6).select(F.col("id").alias("s"))
    weight = lambda j: (F.pmod((j + 1) * 7919 + F.col("c") * 104729 + F.col("s") * 1299709, F.lit(2003)) - 1001) / 1001.0
    y = (F.col("label") >= 5).cast("int")
    z = F.aggregate(F.transform("embedding", lambda x, j: x.cast("double") * weight(j.cast("bigint"))), F.lit(0.0), lambda a, x: a + x)
    z = z + F.when(y == 1, 0.3).otherwise(-0.3) * F.col("c")
    p = F.round(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))), 4)
    return e.crossJoin(F.broadcast(c.crossJoin(s))).select(F.concat(F.lit("config_"), F.col("c")).alias("configuration"), F.col("s").alias("seed"), F.pmod("vec_id", F.lit(5)).alias("fold"), F.col("vec_id").alias("row_index"), F.floor(F.col("vec_id") / 4).alias("group_id"), y.alias("label"), p.alias("probability"), (p >= 0.5).cast("int").alias("prediction"))


PRED = """pred AS (SELECT *, (probability >= 0.5)::INT AS prediction FROM (SELECT 'config_' || c AS configuration, s AS seed, vec_id % 5 AS fold, vec_id AS row_index, vec_id // 4 AS group_id, (label >= 5)::INT AS label,
    round(1 / (1 + exp(-greatest(-30, least(30, list_sum(list_transform(range(1, len(embedding) + 1), lambda j: embedding[j]::DOUBLE * (((j * 7919 + c * 104729 + s * 1299709) % 2003) - 1001) / 1001.0)) + CASE WHEN label >= 5 THEN 0.3 ELSE -0.3 END * c)))), 4) AS probability
    FROM embeddings, range(1, 5) a(c), range(1, 6) b(s)))"""

CONFUSION = "sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn, sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp"
MCC = "coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"


def runs(spark, d) -> DataFrame:
    """configuration, seed, fold, width, mcc, accuracy: one row a run."""
    c = metrics.confusion(predictions(spark, d), ["configuration", "seed", "fold"])
    s = metrics.scores()
    width = F.pow(F.lit(2), F.substring("configuration", 8, 9).cast("int") + 5).cast("int")
    return c.select("configuration", "seed", "fold", width.alias("width"), s["mcc"].alias("mcc"), s["accuracy"].alias("accuracy"))


RUNS = f"{PRED}, counts AS (SELECT configuration, seed, fold, {CONFUSION} FROM pred GROUP BY ALL), runs AS (SELECT configuration, seed, fold, (2 ** (substr(configuration, 8)::INT + 5))::INT AS width, round({MCC}, 6) AS mcc, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM counts)"
