"""Queries of the text functions and lexical operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import lexical
from corpusloom.plans.base import MSG, PARTED, messages, parted, query
from corpusloom.runtime import table

_W = r"[\p{L}\p{M}\p{N}\p{Pc}]"


def clean_sql(x: str) -> str:
    out = f"lower({x})"
    for p in ("<.*?>", r"http\S+|www\.\S+", rf"[@#]{_W}+", rf"{_W}*\p{{Nd}}{_W}*", r"[^\p{L}\s]"):
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return f"array_to_string(list_filter(string_split_regex({out}, '\\s+'), lambda w: length(w) > 1), ' ')"


WORDS = lambda x: f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
TEXT = "txt AS (SELECT row_index, label, language_column, clean_text, part FROM parted WHERE clean_text IS NOT NULL)"


@query(f"WITH {MSG} SELECT row_index, clean_text AS cleaned FROM msg")
def f1_clean_text(spark, d):
    return messages(spark, d).select("row_index", T.clean_text(F.col("raw_text")).alias("cleaned"))


@query(f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents WHERE text IS NOT NULL")
def f1_clean_documents(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.clean_text(F.col("text"), normalize=False).alias("cleaned"))


@query("SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g') AS exact_key FROM documents WHERE text IS NOT NULL")
def f2_exact_key(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.exact_key(F.col("text")).alias("exact_key"))


@query(f"WITH {MSG} SELECT row_index, regexp_replace(coalesce(labels, ''), '^\\s+|\\s+$', '', 'g') AS labels, len({WORDS('raw_text')})::BIGINT AS n_words, length(raw_text)::BIGINT AS n_chars FROM msg")
def f3_f4_word_statistics(spark, d):
    return messages(spark, d).select("row_index", T.strip(F.coalesce("labels", F.lit(""))).alias("labels"), F.size(T.words(F.col("raw_text"))).cast("bigint").alias("n_words"), F.length("raw_text").cast("bigint").alias("n_chars"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(c_name, '\\d+$') THEN regexp_extract(c_name, '(\\d+)$', 1)::INT END AS width FROM customer")
def f5_trailing_width(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.trailing_width(F.col("c_name")).alias("width"))


@query("""SELECT p_partkey, regexp_replace(lower(p_type), '[^\\p{L}\\p{N}]', '_', 'g') AS plain, regexp_replace(lower(p_type || '!'), '[^\\p{L}\\p{N}]+', '_', 'g') AS collapsed,
    regexp_replace(regexp_replace(lower('#' || p_type || '!'), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS joined FROM part""")
def f6_slugs(spark, d):
    n = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", T.slug(n, "plain").alias("plain"), T.slug(F.concat(n, F.lit("!"))).alias("collapsed"), T.slug(F.concat(F.lit("#"), n, F.lit("!")), "joined").alias("joined"))


def _chance_sql(row: str, place: str, seed: int = 42) -> str:
    """The same chain as functions.text.chance, nested through single-element list transforms."""
    p = "2147483647"
    steps = [f"({row} * 7919 + {place} * 104729 + {seed}) % {p}", f"x * 48271 % {p}", f"x * x % {p}", f"((x + {row} * 31 + {place} * 17) % {p}) * 69621 % {p}", f"x * x % {p}"]
    out = f"[{steps[0]}]"
    for s in steps[1:]:
        out = f"list_transform({out}, lambda x: {s})"
    return f"({out}[1] / 2147483647.0)"


def _perturbed(fits: str, change: str) -> str:
    w = "string_split_regex(clean_text, '\\s+')"
    return f"""WITH {PARTED}, w AS (SELECT row_index, generate_subscripts({w}, 1) - 1 AS i, unnest({w}) AS w FROM parted WHERE clean_text IS NOT NULL AND clean_text <> ''),
    c AS (SELECT row_index, i, w, {_chance_sql('row_index', 'i')} AS u, {_chance_sql('row_index', '(i + 1000003)')} AS v FROM w)
    SELECT row_index, string_agg(CASE WHEN {fits} AND u < 0.35 THEN {change} ELSE w END, ' ' ORDER BY i) AS changed FROM c GROUP BY row_index"""


def _changed(spark, d, f):
    return parted(spark, d).where("clean_text is not null and clean_text <> ''").select("row_index", f(F.col("clean_text"), F.col("row_index")).alias("changed"))


@query(_perturbed("length(w) >= 5 AND regexp_full_match(w, '\\p{L}+')", "substr(w, 1, floor(v * (length(w) - 3))::INT + 1) || substr(w, floor(v * (length(w) - 3))::INT + 3, 1) || substr(w, floor(v * (length(w) - 3))::INT + 2, 1) || substr(w, floor(v * (length(w) - 3))::INT + 4)"))
def f7_character_swap(spark, d):
    return _changed(spark, d, T.swap_characters)


@query(_perturbed("length(w) >= 6 AND regexp_full_match(w, '\\p{L}+')", "substr(w, 1, floor(v * (length(w) - 4))::INT + 2) || ' ' || substr(w, floor(v * (length(w) - 4))::INT + 3)"))
def f8_space_insertion(spark, d):
    return _changed(spark, d, T.insert_spaces)


@query(_perturbed("length(w) >= 1", "translate(w, 'aeios', '43105')"))
def f9_leetspeak(spark, d):
    return _changed(spark, d, T.leetspeak)


@query(f"WITH {MSG} SELECT row_index, array_to_string(list_transform({WORDS('raw_text')}, lambda w: CASE WHEN contains(w, 'http') OR contains(w, 'www') OR contains(w, '.com') THEN replace(replace(w, 'http', 'hxxp'), '.', ' dot ') ELSE w END), ' ') AS changed FROM msg")
def f10_url_variation(spark, d):
    return messages(spark, d).select("row_index", T.vary_urls(F.col("raw_text")).alias("changed"))


@query(f"""WITH {PARTED}, {TEXT}, w AS (SELECT unnest({WORDS('clean_text')}) AS w FROM txt), p AS (SELECT ' ' || w || ' ' AS p FROM w),
    g AS (SELECT unnest(list_concat(list_concat(list_transform(range(1, greatest(length(p) - 1, 1)), lambda i: substr(p, i, 3)), list_transform(range(1, greatest(length(p) - 2, 1)), lambda i: substr(p, i, 4))), list_transform(range(1, greatest(length(p) - 3, 1)), lambda i: substr(p, i, 5)))) AS gram FROM p)
    SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def f12_character_ngrams(spark, d):
    w = parted(spark, d).where("clean_text is not null").select(F.explode(T.words(F.col("clean_text"))).alias("w")).groupBy("w").agg(F.count("*").alias("times"))
    return w.select("times", F.explode(T.char_ngrams(F.col("w"), 3, 5)).alias("gram")).groupBy("gram").agg(F.sum("times").alias("n"))


@query(f"""WITH {PARTED}, {TEXT}, w AS (SELECT row_index, list_filter(string_split_regex(clean_text, '\\s+'), lambda w: length(w) >= 2) AS w FROM txt),
    g AS (SELECT unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def f12_word_ngrams(spark, d):
    return parted(spark, d).where("clean_text is not null").select(F.explode(T.word_ngrams(F.col("clean_text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"""WITH {PARTED}, {TEXT}, o AS (SELECT row_index, unnest({WORDS('clean_text')}) AS term FROM txt), tf AS (SELECT row_index, term, count(*) AS tf FROM o GROUP BY ALL),
    df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 75000), n AS (SELECT count(*) AS n FROM txt),
    x AS (SELECT row_index, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS v FROM tf JOIN df USING (term), n), nn AS (SELECT row_index, sqrt(sum(v * v)) AS norm FROM x GROUP BY row_index)
    SELECT row_index, term, round(v / norm, 6) AS w FROM x JOIN nn USING (row_index)""")
def f13_tfidf(spark, d):
    t = parted(spark, d).where("clean_text is not null")
    return lexical.tfidf(t, T.words(F.col("clean_text")), min_df=2, top=75_000).select("row_index", "term", F.round("w", 6).alias("w"))


@query(f"WITH {MSG} SELECT row_index, sha256(raw_text) AS digest FROM msg")
def f17_sha256(spark, d):
    return messages(spark, d).select("row_index", F.sha2("raw_text", 256).alias("digest"))


@query("SELECT n_nationkey, count(*) AS n, format('{:.2f}', max(c_acctbal)) AS mean, format('{:,}', count(*) * 12345) AS thousands FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def f21_number_formats(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    g = j.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("m"))
    return g.select("n_nationkey", "n", F.format_string("%.2f", "m").alias("mean"), F.format_number(F.col("n") * 12345, 0).alias("thousands"))


@query("SELECT line_id, try_cast(regexp_extract(raw_text, '^([0-9]+)(;|$)', 1) AS DOUBLE) AS grp FROM external_raw WHERE dataset = 'bosphor_sms' AND raw_text IS NOT NULL")
def f22_coerced_number(spark, d):
    r = table(spark, d, "external_raw").where(F.col("raw_text").isNotNull() & (F.col("dataset") == "bosphor_sms"))
    return r.select("line_id", F.regexp_extract("raw_text", "^([0-9]+)(;|$)", 1).try_cast("double").alias("grp"))


@query("SELECT line_id, regexp_extract(source_record, '^([^:]*):', 1) AS stem, contains(source_record, 'clip') AS is_clip FROM external_raw")
def f23_record_stem(spark, d):
    return table(spark, d, "external_raw").select("line_id", F.regexp_extract("source_record", "^([^:]*):", 1).alias("stem"), F.contains("source_record", F.lit("clip")).alias("is_clip"))


_VOCAB = f"""o AS (SELECT part, row_index, generate_subscripts({WORDS('clean_text')}, 1) AS place, unnest({WORDS('clean_text')}) AS word FROM txt),
    v AS (SELECT part, word, count(*) AS cnt, min(row_index * 100000 + place) AS first FROM o GROUP BY ALL), vocab AS (SELECT part, word, cnt, row_number() OVER (PARTITION BY part ORDER BY cnt DESC, first) AS idx FROM v)"""


@query(f"WITH {PARTED}, {TEXT}, {_VOCAB} SELECT part, word, cnt, idx FROM vocab")
def a12_vocabulary(spark, d):
    return lexical.vocabulary(parted(spark, d), by=["part"])


@query(f"""WITH {PARTED}, {TEXT}, {_VOCAB}, top AS (SELECT word, idx FROM vocab WHERE part = 'train' AND idx <= 500),
    k AS (SELECT row_index, list(idx ORDER BY place) AS s FROM o JOIN top USING (word) GROUP BY row_index)
    SELECT row_index, array_to_string(list_concat(list_transform(range(greatest(16 - coalesce(len(s), 0), 0)), lambda i: 0), coalesce(s[greatest(len(s) - 15, 1):], [])), ' ') AS tokens FROM txt LEFT JOIN k USING (row_index)""")
def w10_padded_tokens(spark, d):
    p = parted(spark, d).where("clean_text is not null")
    vocab = lexical.vocabulary(p.where("part = 'train'"), top=500)
    return lexical.token_rows(p, vocab, 16).select("row_index", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


@query(f"""WITH {PARTED}, {TEXT}, {_VOCAB}, train AS (SELECT word FROM vocab WHERE part = 'train'), r AS (SELECT row_index, count(*) AS total, count(t.word) AS known FROM o LEFT JOIN train t USING (word) GROUP BY row_index)
    SELECT part, language_column, count(*) AS samples, round(avg(coalesce(known, 0) / greatest(coalesce(total, 0), 1)), 6) AS token_coverage, count(*) FILTER (known > 0) AS samples_with_at_least_one_known_token, round(avg((coalesce(known, 0) > 0)::INT), 6) AS sample_coverage
    FROM txt LEFT JOIN r USING (row_index) GROUP BY part, language_column""")
def a19_vocabulary_coverage(spark, d):
    p = parted(spark, d).where("clean_text is not null")
    vocab = lexical.vocabulary(p.where("part = 'train'")).select("word", "idx")
    return lexical.coverage(p, vocab, ["part", "language_column"])


@query(f"WITH {PARTED}, {TEXT}, o AS (SELECT row_index, unnest({WORDS('clean_text')}) AS term FROM txt) SELECT term, count(DISTINCT row_index) AS df, count(*) AS total FROM o GROUP BY term")
def a13_document_frequency(spark, d):
    return lexical.occurrences(parted(spark, d)).groupBy("word").agg(F.countDistinct("row_index").alias("df"), F.count("*").alias("total")).withColumnRenamed("word", "term")
