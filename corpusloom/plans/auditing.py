"""Queries of the external audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import audit
from corpusloom.plans.base import messages, query
from corpusloom.runtime import table

_EXT = f"""ext AS (SELECT record_id, dataset, label, raw_text, clean, regexp_replace(replace(lower(raw_text), 'ß', 'ss'), '\\s+', ' ', 'g') AS ekey FROM (SELECT record_id, dataset, label, coalesce(clean_text, '') AS clean, regexp_replace(coalesce(raw_text, ''), '^\\s+|\\s+$', '', 'g') AS raw_text FROM external_audited)),
    conf AS (SELECT dataset, ekey, count(*) AS rows FROM ext GROUP BY ALL HAVING count(DISTINCT label) > 1),
    kept AS (SELECT ext.* FROM ext ANTI JOIN conf USING (dataset, ekey) WHERE clean <> '' QUALIFY row_number() OVER (PARTITION BY dataset, ekey, label ORDER BY record_id) = 1)"""


@query(f"""WITH {_EXT}, a AS (SELECT dataset, count(*) AS raw_records, count(*) FILTER (clean = '') AS empty_after_cleaning FROM ext GROUP BY dataset), c AS (SELECT dataset, sum(rows) AS conflicting FROM conf GROUP BY dataset), u AS (SELECT dataset, count(*) AS unique_records FROM kept GROUP BY dataset)
    SELECT dataset, raw_records, empty_after_cleaning, coalesce(conflicting, 0)::BIGINT AS conflicting, coalesce(unique_records, 0) AS unique_records FROM a LEFT JOIN c USING (dataset) LEFT JOIN u USING (dataset)""")
def r17_audit_summary(spark, d):
    return audit.summary(table(spark, d, "external_audited"))


@query(f"""WITH {_EXT}, raws AS (SELECT DISTINCT regexp_replace(replace(lower(raw_text), 'ß', 'ss'), '\\s+', ' ', 'g') AS k FROM long_messages WHERE raw_text IS NOT NULL), cleans AS (SELECT DISTINCT clean_text AS k FROM long_messages WHERE clean_text <> '')
    SELECT record_id, ekey IN (SELECT k FROM raws) AS raw_overlap, clean IN (SELECT k FROM cleans) AS clean_overlap FROM kept""")
def j10_exact_overlap_flags(spark, d):
    base = audit.consistent(audit.prepared(table(spark, d, "external_audited")))
    return audit.exact_flags(base, table(spark, d, "long_messages").select("raw_text", "clean_text")).select("record_id", "raw_overlap", "clean_overlap")


@query(f"WITH {_EXT} SELECT record_id FROM kept")
def j11_conflicts_removed(spark, d):
    return audit.consistent(audit.prepared(table(spark, d, "external_audited"))).select("record_id")


@query()
def j12_similarity_join(spark, d):
    return audit.nearest(messages(spark, d).select("clean_text"), table(spark, d, "external_audited").where("clean_text is not null").select("record_id", "clean_text"))


@query()
def r17_audited_records(spark, d):
    return audit.audited(table(spark, d, "external_audited"), messages(spark, d).select("raw_text", "clean_text")).select("record_id", "raw_overlap", "clean_overlap", "near_overlap", "nearest_similarity", "eligible_primary", "eligible_strict")


@query()
def f18_simhash(spark, d):
    return messages(spark, d).where("clean_text is not null").select("row_index", audit.simhash("clean_text").alias("hash"))


@query()
def f19_hamming_distance(spark, d):
    """Bits by which the similarity hashes of each message and the first message of its group differ."""
    h = messages(spark, d).where("clean_text is not null and group_id is not null").select("row_index", "group_id", audit.simhash("clean_text").alias("hash"))
    first = h.groupBy("group_id").agg(F.min_by("hash", "row_index").alias("other"))
    return h.join(first, "group_id").select("row_index", F.bit_count(F.col("hash").bitwiseXOR(F.col("other"))).cast("int").alias("distance"))


@query()
def f20_sequence_ratio(spark, d):
    e = table(spark, d, "external_audited").where("clean_text is not null").select("record_id", "dataset", "clean_text")
    return e.join(e.groupBy("dataset").agg(F.min_by("clean_text", "record_id").alias("reference")), "dataset").select("record_id", audit.sequence_ratio("clean_text", "reference").alias("ratio"))
