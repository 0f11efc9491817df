"""Queries of the relational operators over the star schema, events and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators.ingest import text_columns
from corpusloom.plans.base import query
from corpusloom.runtime import scratch, table
from corpusloom.sources import files
from corpusloom.streaming import events


def t(spark, d, *names):
    return [table(spark, d, n) for n in names]


@query("SELECT count(*) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem")
def s1_parquet_scan(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


@query("SELECT s_suppkey, s_name, CASE s_suppkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'nan' ELSE 'a,\"b\"' END AS word FROM supplier")
def s2_s12_csv_round_trip(spark, d):
    path = scratch(spark, "csv")
    files.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", F.expr("""CASE s_suppkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'nan' ELSE 'a,"b"' END""").alias("word")), path)
    return files.read_csv(spark, path, "s_suppkey bigint, s_name string, word string")


@query("SELECT fold, row_index, part FROM fold_split WHERE part IS NOT NULL")
def s8_split_round_trip(spark, d):
    path = scratch(spark, "split")
    files.write_split(table(spark, d, "fold_split").where("part is not null"), path)
    return spark.read.parquet(path).select(F.col("fold").cast("int").alias("fold"), "row_index", "part")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s11_json_metadata(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT r_regionkey, r_name, sha256(r_name) AS digest FROM region")
def s13_cached_table(spark, d):
    make = lambda src: spark.read.parquet(src).select("r_regionkey", "r_name", F.sha2("r_name", 256).alias("digest"))
    cache = scratch(spark, "cache")
    files.cached(spark, f"{d}/region.parquet", cache, make)
    return files.cached(spark, f"{d}/region.parquet", cache, make)


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def s14_globbed_files(spark, d):
    path = scratch(spark, "parts")
    n = table(spark, d, "nation")
    n.repartition("n_regionkey").write.option("header", True).partitionBy("n_regionkey").csv(path)
    folders = n.select("n_regionkey").distinct().count()
    read = files.read_predictions(spark, f"{path}/n_regionkey=*/*.csv", folders)
    return read.select(F.regexp_extract("file", "n_regionkey=(\\d+)", 1).cast("int").alias("n_regionkey")).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT group_id, max(raw_text) FILTER (language_column = 'text') AS text, max(raw_text) FILTER (language_column = 'text_de') AS text_de, max(raw_text) FILTER (language_column = 'text_fr') AS text_fr FROM long_messages WHERE group_id IS NOT NULL GROUP BY group_id")
def proj_p3_columns_by_prefix(spark, d):
    """The text columns of a wide table, found by their names."""
    wide = table(spark, d, "long_messages").where("group_id is not null").groupBy("group_id").pivot("language_column", ["text", "text_de", "text_fr", "other"]).agg(F.max("raw_text"))
    return wide.select("group_id", *text_columns(wide))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND regexp_matches(o_orderpriority, '^[12]-')")
def proj_p4_p5_p6_filters(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderpriority").rlike("^[12]-")).select("o_orderkey")


@query("SELECT row_index, labels FROM long_messages JOIN fold_split USING (row_index) WHERE part = 'test'")
def proj_p7_positional_projection(spark, d):
    m, s = t(spark, d, "long_messages", "fold_split")
    return m.join(s.where("part = 'test'").select("row_index"), "row_index", "left_semi").select("row_index", "labels")


@query("SELECT 'tpch' AS origin, l_orderkey AS order_key, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def proj_p9_derived_columns(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount").withColumn("net", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).withColumnRenamed("l_orderkey", "order_key").select(F.lit("tpch").alias("origin"), "order_key", "l_linenumber", "net")


@query("SELECT record_id, coalesce(raw_text, '') AS raw_text, label IS NULL AS open FROM external_audited WHERE dataset IS NOT NULL")
def proj_p11_missing_values(spark, d):
    return table(spark, d, "external_audited").dropna(subset=["dataset"]).fillna({"raw_text": ""}).select("record_id", "raw_text", F.col("label").isNull().alias("open"))


@query("SELECT n_nationkey AS validation_n_nationkey, n_name AS validation_n_name, n_regionkey AS validation_n_regionkey FROM nation")
def proj_p12_prefixed_columns(spark, d):
    n = table(spark, d, "nation")
    return n.select(*(F.col(c).alias(f"validation_{c}") for c in n.columns))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def j1_j2_inner_join(spark, d):
    o, c = t(spark, d, "orders", "customer")
    return o.select("o_orderkey", "o_custkey", "o_totalprice").join(c.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT a.row_index AS row_index_a, b.row_index AS row_index_b FROM long_messages a JOIN long_messages b ON a.group_id = b.group_id AND a.label = b.label WHERE a.language_column = 'text_de' AND b.language_column = 'text_fr'")
def j3_composite_join(spark, d):
    m = table(spark, d, "long_messages").select("row_index", "group_id", "label", "language_column")
    side = lambda c, s: m.where(F.col("language_column") == c).select("group_id", "label", F.col("row_index").alias(f"row_index_{s}"))
    return side("text_de", "a").join(side("text_fr", "b"), ["group_id", "label"]).select("row_index_a", "row_index_b")


@query("SELECT record_id, row_index FROM external_audited e JOIN (SELECT clean_text, min(row_index) AS row_index FROM long_messages WHERE clean_text <> '' GROUP BY 1) m USING (clean_text)")
def j4_natural_key_to_id(spark, d):
    m, e = t(spark, d, "long_messages", "external_audited")
    return e.select("record_id", "clean_text").join(m.where("clean_text <> ''").groupBy("clean_text").agg(F.min("row_index").alias("row_index")), "clean_text").select("record_id", "row_index")


@query("SELECT n_nationkey, customers, suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON n_nationkey = c_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey")
def j6_left_join_of_aggregates(spark, d):
    n, c, s = t(spark, d, "nation", "customer", "supplier")
    cc = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    ss = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return n.select("n_nationkey").join(cc, "n_nationkey", "left").join(ss, "n_nationkey", "left")


@query("SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
def j10_semi_join(spark, d):
    c, o = t(spark, d, "customer", "orders")
    return c.join(o.where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
def j11_anti_join(spark, d):
    c, o = t(spark, d, "customer", "orders")
    return c.join(o.where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, n_name, s FROM region, nation, range(1, 4) x(s)")
def j13_small_cross_product(spark, d):
    r, n = t(spark, d, "region", "nation")
    return F.broadcast(r.select("r_name")).crossJoin(F.broadcast(n.select("n_name"))).crossJoin(spark.range(1, 4).withColumnRenamed("id", "s"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def a2_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def a4_value_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy("o_orderpriority")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order, count(*) AS n FROM orders GROUP BY 1")
def a5_named_aggregates(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_orderkey").alias("first_order"), F.count("*").alias("n"))


@query("SELECT group_id, sum((label = 1)::INT)::BIGINT AS spam, sum((label = 0)::INT)::BIGINT AS ham FROM long_messages WHERE group_id IS NOT NULL GROUP BY 1")
def a17_scatter_add(spark, d):
    return table(spark, d, "long_messages").where("group_id is not null").groupBy("group_id").agg(F.sum(F.when(F.col("label") == 1, 1).when(F.col("label").isNotNull(), 0)).alias("spam"), F.sum(F.when(F.col("label") == 0, 1).when(F.col("label").isNotNull(), 0)).alias("ham"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 25")
def o1_o2_o3_top_k(spark, d):
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))  # 25 rows


@query("SELECT term, total FROM (SELECT p_type AS term, count(*) AS total FROM part GROUP BY 1) QUALIFY row_number() OVER (ORDER BY total DESC, term) <= 20")
def o4_top_terms(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("term")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "term").limit(20)


@query("SELECT n_name, CASE WHEN n_name LIKE 'A%' THEN 0 WHEN n_regionkey = 3 THEN 1 ELSE 2 END AS section FROM nation")
def o6_custom_order(spark, d):
    section = F.when(F.col("n_name").like("A%"), 0).when(F.col("n_regionkey") == 3, 1).otherwise(2)
    return table(spark, d, "nation").select("n_name", section.alias("section")).orderBy("section", "n_name")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def u1_union_by_name(spark, d):
    c, s = t(spark, d, "customer", "supplier")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).unionByName(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t1_windowed_events(spark, d):
    return events.windowed(table(spark, d, "events"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t2_streamed_events(spark, d):
    src = scratch(spark, "stream-in")
    table(spark, d, "events").repartition(4).write.parquet(src)
    return events.run_once(spark, src, scratch(spark, "stream-out"), scratch(spark, "stream-state"))
