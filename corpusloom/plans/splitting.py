"""Queries of ingestion, splits and their audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import ingest, splits
from corpusloom.plans.base import MSG, PARTED, messages, parted, query
from corpusloom.runtime import table

LANGS = ["text", "text_de", "text_fr", "text_es", "text_pt", "text_tr", "text_ru", "text_hi"]
_P = "2147483647"


def _shuffled(key: str, seed: int) -> str:
    x = f"[({key} * 48271 + {seed} * 7919) % {_P}]"
    for s in (f"x * x % {_P}", f"((x + {key} % {_P}) * 69621) % {_P}", f"x * x % {_P}"):
        x = f"list_transform({x}, lambda x: {s})"
    return f"{x}[1]"


_WIDE = f"""wide AS (SELECT group_id, arg_min(labels, row_index) AS labels, {', '.join(f"arg_min(raw_text, row_index) FILTER (language_column = '{c}') AS {c}" for c in LANGS)} FROM long_messages WHERE group_id IS NOT NULL AND language_column IN ({', '.join(f"'{c}'" for c in LANGS)}) AND labels IS NOT NULL AND raw_text IS NOT NULL GROUP BY group_id)"""
_LONG = f"""{_WIDE}, melted AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (raw_text FOR language_column IN ({', '.join(LANGS)}))), placed AS (SELECT *, (list_position({LANGS}, language_column) - 1)::BIGINT AS column_place FROM melted)"""


def _wide(spark, d):
    return ingest.widen(table(spark, d, "long_messages").where("labels is not null and raw_text is not null"), LANGS)


@query(f"WITH {_LONG} SELECT group_id, labels, language_column, raw_text, column_place FROM placed")
def proj_p1_unpivot(spark, d):
    return ingest.melt(_wide(spark, d)).select("group_id", "labels", "language_column", "raw_text", "column_place")


@query(f"""WITH {_LONG}, kept AS (SELECT *, row_number() OVER (PARTITION BY labels, raw_text ORDER BY column_place, group_id) AS k FROM placed WHERE raw_text IS NOT NULL)
    SELECT row_number() OVER (ORDER BY column_place, group_id) - 1 AS row_index, group_id, language_column, (labels <> 'ham')::TINYINT AS label, md5(c.clean_text) AS cleaned FROM kept JOIN (SELECT DISTINCT raw_text, clean_text FROM long_messages) c USING (raw_text) WHERE k = 1""")
def d2_load_long(spark, d):
    return ingest.load_long(_wide(spark, d)).select("row_index", "group_id", "language_column", "label", F.md5("clean_text").alias("cleaned"))


@query(f"WITH {MSG} SELECT min(row_index) AS row_index, labels, md5(raw_text) AS digest FROM msg GROUP BY labels, raw_text")
def w2_keep_first(spark, d):
    return ingest.keep_first(messages(spark, d), ["labels", "raw_text"], ["row_index"]).select("row_index", "labels", F.md5("raw_text").alias("digest"))


@query(f"WITH {MSG} SELECT max(row_index) AS row_index, labels, md5(raw_text) AS digest FROM msg GROUP BY labels, raw_text")
def w3_keep_last(spark, d):
    return ingest.keep_first(messages(spark, d), ["labels", "raw_text"], ["row_index"], last=True).select("row_index", "labels", F.md5("raw_text").alias("digest"))


@query(f"WITH {MSG}, c AS (SELECT labels, raw_text, count(*) AS n FROM msg GROUP BY ALL) SELECT sum(n - 1)::BIGINT AS duplicates, count(*) AS distinct_rows FROM c")
def w4_duplicate_count(spark, d):
    return ingest.duplicate_count(messages(spark, d), ["labels", "raw_text"])


_GROUPS = f"{MSG}, grp AS (SELECT group_id, arg_min(label, row_index) AS label FROM msg WHERE group_id IS NOT NULL AND label IS NOT NULL GROUP BY group_id)"


def _groups(spark, d):
    return splits.group_labels(messages(spark, d).where("label is not null"))


@query(f"""WITH {MSG}, k AS (SELECT row_index, row_number() OVER (PARTITION BY label ORDER BY {_shuffled('row_index', 42)}, row_index) AS k, count(*) OVER (PARTITION BY label) AS n FROM msg)
    SELECT row_index, CASE WHEN (k - 0.5) / n < 0.64 THEN 'train' WHEN (k - 0.5) / n < 0.8 THEN 'validation' ELSE 'test' END AS part FROM k""")
def r1_random_split(spark, d):
    return splits.three_way(messages(spark, d), "row_index")


_R2 = f"""{_GROUPS}, k AS (SELECT group_id, row_number() OVER (PARTITION BY label ORDER BY {_shuffled('group_id', 42)}, group_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM grp),
    gp AS (SELECT group_id, CASE WHEN (k - 0.5) / n < 0.64 THEN 'train' WHEN (k - 0.5) / n < 0.8 THEN 'validation' ELSE 'test' END AS part FROM k)"""


@query(f"WITH {_R2} SELECT row_index, part FROM msg JOIN gp USING (group_id)")
def r2_group_split(spark, d):
    return messages(spark, d).select("row_index", "group_id").join(splits.three_way(_groups(spark, d), "group_id"), "group_id").select("row_index", "part")


_FOLDS = f"""{_GROUPS}, b AS (SELECT group_id, label, (row_number() OVER (PARTITION BY label ORDER BY {_shuffled('group_id', 42)}, group_id) - 1) % 5 AS own FROM grp), e AS (SELECT b.*, fold FROM b, range(5) f(fold)),
    r AS (SELECT fold, group_id, label, {_shuffled('(group_id + fold * 1000003)', 42)} AS h FROM e WHERE own <> fold),
    folds AS (SELECT fold, group_id, 'test' AS part FROM e WHERE own = fold UNION ALL SELECT fold, group_id, CASE WHEN (row_number() OVER (PARTITION BY fold, label ORDER BY h, group_id) - 0.5) / count(*) OVER (PARTITION BY fold, label) < 0.2 THEN 'validation' ELSE 'train' END FROM r)"""


@query(f"WITH {_FOLDS} SELECT fold::INT AS fold, group_id, part FROM folds")
def r3_group_folds(spark, d):
    return splits.folds(_groups(spark, d))


_LEAK = "count(*) AS n_keys, count(*) FILTER (t AND v) AS train_validation, count(*) FILTER (t AND e) AS train_test, count(*) FILTER (v AND e) AS validation_test, count(*) FILTER (t AND v AND e) AS all_three"
_FLAGS = "bool_or(part = 'train') AS t, bool_or(part = 'validation') AS v, bool_or(part = 'test') AS e"


@query(f"""WITH {_R2}, k2 AS (SELECT row_index, group_id, row_number() OVER (PARTITION BY label ORDER BY {_shuffled('row_index', 42)}, row_index) AS k, count(*) OVER (PARTITION BY label) AS n FROM msg),
    both_ AS (SELECT 'row' AS split, group_id, CASE WHEN (k - 0.5) / n < 0.64 THEN 'train' WHEN (k - 0.5) / n < 0.8 THEN 'validation' ELSE 'test' END AS part FROM k2 UNION ALL SELECT 'group', group_id, part FROM msg JOIN gp USING (group_id)),
    x AS (SELECT split, group_id, {_FLAGS} FROM both_ WHERE group_id IS NOT NULL GROUP BY ALL) SELECT split, {_LEAK} FROM x GROUP BY split""")
def r4_leakage_audit(spark, d):
    m = messages(spark, d)
    rows = m.select("row_index", "group_id").join(splits.three_way(m, "row_index"), "row_index").select(F.lit("row").alias("split"), "group_id", "part")
    groups = m.select("group_id").join(splits.three_way(_groups(spark, d), "group_id"), "group_id").select(F.lit("group").alias("split"), "group_id", "part")
    return splits.leakage(rows.unionByName(groups), "group_id", ["split"])


@query(f"WITH {PARTED}, x AS (SELECT clean_text, {_FLAGS} FROM parted WHERE clean_text IS NOT NULL GROUP BY clean_text) SELECT {_LEAK} FROM x")
def u3_text_overlap(spark, d):
    return splits.leakage(parted(spark, d), "clean_text", [])


@query(f"""WITH {MSG}, c AS (SELECT label, count(*) AS n_c FROM msg WHERE label IS NOT NULL GROUP BY label)
    SELECT label, n_c, round(sum(n_c) OVER () / (2 * n_c), 6) AS sample_weight, round(sum(CASE WHEN label = 0 THEN n_c ELSE 0 END) OVER () / greatest(sum(CASE WHEN label = 1 THEN n_c ELSE 0 END) OVER (), 1), 6) AS pos_weight FROM c""")
def a18_class_weights(spark, d):
    return splits.class_weights(messages(spark, d))


@query(f"""WITH {PARTED} SELECT part, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups, count(DISTINCT language_column) AS n_languages, count(*) FILTER (clean_text = '') AS n_empty, round(avg(length(raw_text)), 4) AS mean_chars FROM parted GROUP BY part""")
def a22_dataset_summary(spark, d):
    return parted(spark, d).groupBy("part").agg(F.count("*").alias("n_rows"), F.countDistinct("group_id").alias("n_groups"), F.countDistinct("language_column").alias("n_languages"), F.count_if(F.col("clean_text") == "").alias("n_empty"), F.round(F.avg(F.length("raw_text")), 4).alias("mean_chars"))


@query(f"WITH {PARTED} SELECT group_id FROM parted WHERE part = 'train' AND group_id IS NOT NULL EXCEPT SELECT group_id FROM parted WHERE part = 'test'")
def u4_groups_only_in_train(spark, d):
    p = parted(spark, d)
    return p.where("part = 'train' and group_id is not null").select("group_id").subtract(p.where("part = 'test'").select("group_id"))


@query("""WITH s AS (SELECT DISTINCT row_index FROM fold_split), m AS (SELECT DISTINCT row_index FROM long_messages), x AS (SELECT (SELECT count(*) FROM (FROM s EXCEPT FROM m)) AS missing, (SELECT count(*) FROM (FROM m EXCEPT FROM s)) AS surplus) SELECT missing, surplus, missing + surplus = 0 AS equal FROM x""")
def u5_set_equality(spark, d):
    """Keys of the splits that no message has, keys of messages without a split row, and whether the two sets are equal."""
    key = lambda n, c: table(spark, d, n).select("row_index").distinct().withColumn(c, F.lit(1))
    both = key("fold_split", "s").join(key("long_messages", "m"), "row_index", "full")
    n = both.agg(F.count_if(F.col("m").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("surplus"))
    return n.withColumn("equal", F.col("missing") + F.col("surplus") == 0)
