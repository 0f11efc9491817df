"""Queries of whole studies: robustness, pooled assembly, shared resampling, guards, resumption, costs, archives."""

from __future__ import annotations

import bz2
import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import inference, lexical, metrics, tokens, vectors
from corpusloom.plans.base import CONFUSION, MCC, PARTED, PRED, parted, predictions, query
from corpusloom.plans.evaluation import _F1, _N, _SCORES
from corpusloom.plans.text import WORDS, _chance_sql
from corpusloom.plans.vectors import _LONG, _SLICE, _long, _tables
from corpusloom.runtime import cut, scratch, table
from corpusloom.sources import archives, files

_MODES = {
    "clean": "w",
    "character_swap": "CASE WHEN length(w) >= 5 AND regexp_full_match(w, '\\p{L}+') AND u < 0.35 THEN substr(w, 1, floor(v * (length(w) - 3))::INT + 1) || substr(w, floor(v * (length(w) - 3))::INT + 3, 1) || substr(w, floor(v * (length(w) - 3))::INT + 2, 1) || substr(w, floor(v * (length(w) - 3))::INT + 4) ELSE w END",
    "space_insertion": "CASE WHEN length(w) >= 6 AND regexp_full_match(w, '\\p{L}+') AND u < 0.35 THEN substr(w, 1, floor(v * (length(w) - 4))::INT + 2) || ' ' || substr(w, floor(v * (length(w) - 4))::INT + 3) ELSE w END",
    "leetspeak": "CASE WHEN u < 0.35 THEN translate(w, 'aeios', '43105') ELSE w END",
    "url_variation": "CASE WHEN contains(w, 'http') OR contains(w, 'www') OR contains(w, '.com') THEN replace(replace(w, 'http', 'hxxp'), '.', ' dot ') ELSE w END",
}


@query(f"""WITH {PARTED}, txt AS (SELECT row_index, part, label, clean_text FROM parted WHERE clean_text <> '' AND label IS NOT NULL), o AS (SELECT row_index, label, unnest({WORDS('clean_text')}) AS w FROM txt WHERE part = 'train'),
    wt AS (SELECT w, round(1000 * ln((count(*) FILTER (label = 1) + 1) / (count(*) FILTER (label = 0) + 1)::DOUBLE))::BIGINT AS weight FROM o GROUP BY w),
    p AS (SELECT row_index, label, generate_subscripts({WORDS('clean_text')}, 1) - 1 AS i, unnest({WORDS('clean_text')}) AS w FROM txt WHERE part = 'test'), c AS (SELECT *, {_chance_sql('row_index', 'i')} AS u, {_chance_sql('row_index', '(i + 1000003)')} AS v FROM p),
    m AS ({' UNION ALL '.join(f"SELECT '{k}' AS perturbation, row_index, label, i, {x} AS w FROM c" for k, x in _MODES.items())}), e AS (SELECT perturbation, row_index, label, unnest({WORDS('w')}) AS w FROM m),
    b AS (SELECT model, perturbation, row_index, label, (sum(CASE WHEN model = 'words' OR length(w) >= 5 THEN coalesce(weight, 0) ELSE 0 END) > 0)::INT AS prediction FROM e LEFT JOIN wt USING (w), (VALUES ('words'), ('long words')) x(model) GROUP BY ALL),
    counts AS (SELECT model, perturbation, {CONFUSION} FROM b GROUP BY ALL) SELECT model, perturbation, {_SCORES} FROM counts""")
def r16_robustness(spark, d):
    """Two lexical classifiers of the training part under each perturbation of the test part."""
    t = parted(spark, d).where("clean_text <> '' and label is not null").select("row_index", "part", "label", "clean_text")
    seen = t.where("part = 'train'").select("label", F.explode(T.words(F.col("clean_text"))).alias("w"))
    n = lambda y: F.count_if(F.col("label") == y) + 1
    weight = seen.groupBy("w").agg(F.round(1000 * F.ln(n(1) / n(0))).cast("bigint").alias("weight"))
    models = {"words": lambda w: F.lit(True), "long words": lambda w: F.length(w) >= 5}
    return inference.robustness(t.where("part = 'test'"), weight, models)


@query(f"WITH {PRED}, oof AS (SELECT configuration, row_index, label, (avg(probability) >= 0.5)::INT AS prediction FROM pred GROUP BY ALL), counts AS (SELECT configuration, {CONFUSION} FROM oof GROUP BY ALL) SELECT configuration, {_SCORES} FROM counts")
def r15_pooled_out_of_fold(spark, d):
    """Seed means of every row from the fold that tests it, pooled over folds; an incomplete pool fails."""
    n = table(spark, d, "embeddings").count()
    pooled = inference.out_of_fold(predictions(spark, d), ["configuration"], n)
    return metrics.with_scores(metrics.confusion(pooled, ["configuration"]), ["configuration"])


_CELLS = lambda m: ", ".join(f"sum(weight * CASE WHEN configuration = '{m}' AND label = {y} AND prediction = {p} THEN 1 ELSE 0 END)::DOUBLE AS {n}" for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))
_PAIRS = (("config_4", "config_1"), ("config_3", "config_2"))
_U = "list_transform(list_transform(list_transform(list_transform([(rep * 7919 + group_id * 104729 + 20260922) % 2147483647], lambda x: x * 48271 % 2147483647), lambda x: x * x % 2147483647), lambda x: ((x + rep * 31 + group_id * 17) % 2147483647) * 69621 % 2147483647), lambda x: x * x % 2147483647)[1] / 2147483647.0"


def _poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {c})::INT" for c in inference.POISSON) + ")"


@query(f"""WITH {PRED}, ens AS (SELECT configuration, row_index // 4 AS group_id, label, (avg(probability) >= 0.5)::INT AS prediction FROM pred GROUP BY configuration, row_index, label), g AS (SELECT DISTINCT group_id FROM ens),
    u AS (SELECT rep, group_id, {_U} AS u FROM g, range(500) r(rep)), wt AS (SELECT rep, group_id, {_poisson_sql('u')} AS weight FROM u), s AS (SELECT rep, configuration, {', '.join(f"sum(weight * (label = {y} AND prediction = {p})::INT)::DOUBLE AS {n}" for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))} FROM ens JOIN wt USING (group_id) GROUP BY ALL),
    m AS (SELECT rep, configuration, {MCC} AS mcc FROM s), d AS (SELECT a.configuration || ' - ' || b.configuration AS pair, a.mcc - b.mcc AS d FROM m a JOIN m b USING (rep) WHERE {' OR '.join(f"a.configuration = '{a}' AND b.configuration = '{b}'" for a, b in _PAIRS)})
    SELECT pair, count(*) AS reps, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(avg((d > 0)::INT), 6) AS p_positive FROM d GROUP BY pair""")
def r6_r7_shared_bootstrap(spark, d):
    """Weights of groups per replicate, shared by all pairs of configurations."""
    e = inference.out_of_fold(predictions(spark, d), ["configuration"], table(spark, d, "embeddings").count())
    cells = metrics.confusion(e.withColumn("group_id", F.floor(F.col("row_index") / 4)), ["configuration", "group_id"])
    return inference.weighted_bootstrap(cells, _PAIRS, 500, 20260922)


_VOCAB = f"""{PARTED}, o AS (SELECT row_index, generate_subscripts({WORDS('clean_text')}, 1) AS place, unnest({WORDS('clean_text')}) AS word FROM parted WHERE part = 'train' AND clean_text IS NOT NULL),
    vocab AS (SELECT word, count(*) AS cnt, (row_number() OVER (ORDER BY count(*) DESC, min(row_index * 100000 + place)))::INT AS idx FROM o GROUP BY word)"""


def _vocabulary(spark, d):
    return lexical.vocabulary(parted(spark, d).where("clean_text is not null and part = 'train'"))


@query(f"WITH {_VOCAB} SELECT word, idx FROM vocab")
def c4_vocabulary_guard(spark, d):
    """The vocabulary, checked word by word against the recorded one; any drift fails."""
    path = scratch(spark, "vocabulary")
    _vocabulary(spark, d).select("word", "idx").write.parquet(path)
    return lexical.guarded(_vocabulary(spark, d).select("word", "idx"), spark.read.parquet(path))


@query(f"WITH {_VOCAB} SELECT idx, length(word)::BIGINT AS size, md5(word) AS digest FROM vocab")
def c3_resumed_extraction(spark, d):
    """An extraction in batches that is cut off after two of them and goes on from its checkpoint."""
    words, path, origin = cut(_vocabulary(spark, d).select("idx", "word")), scratch(spark, "extraction"), {"representation": "digest"}
    run = lambda w: w.select("idx", F.length("word").cast("bigint").alias("size"), F.md5("word").alias("digest"))
    files.extract(words, path, 500, origin, run, stop_after=2)
    return files.extract(words, path, 500, origin, run)


@query(f"WITH t AS ({_SLICE(1, 32)}) {_LONG('vec', 't')}")
def s9_matrix_round_trip(spark, d):
    path = scratch(spark, "matrix")
    files.write_matrix(_tables(spark, d)[0], path)
    return _long(spark.read.parquet(path))


@query()
def m10_padded_ids(spark, d):
    """Token ids of a public vocabulary, cut and padded to one length, with their mask."""
    t = parted(spark, d).select("row_index", "raw_text")
    return tokens.padded(t, "raw_text", 128).select("row_index", "input_ids", "attention_mask", "n_tokens")


@query()
def v5_character_block(spark, d):
    """Word vectors with a block of scaled character n-gram weights of the training vocabulary beside them."""
    v = _vocabulary(spark, d).select("idx", "word")
    return vectors.character_block(v, 2, 5, 2, 2000).select("idx", "term", F.round("w", 5).alias("w"))


@query(f"""WITH {_VOCAB}, p AS (SELECT idx, ' ' || word || ' ' AS p FROM vocab), g AS (SELECT idx, unnest(list_concat({', '.join(f"list_transform(range(1, greatest(length(p) - {n - 2}, 1)), lambda i: substr(p, i, {n}))" for n in (2, 3, 4, 5))})) AS term FROM p), tf AS (SELECT idx, term, count(*) AS tf FROM g GROUP BY ALL),
    df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 2000) SELECT term, df FROM df""")
def v5_character_terms(spark, d):
    v = _vocabulary(spark, d).select("idx", "word")
    return vectors.character_block(v, 2, 5, 2, 2000).groupBy("term").agg(F.count("*").alias("df"))


@query()
def c8_costs(spark, d):
    """What a run costs: seconds, milliseconds a message, parameters, stored megabytes."""
    e = table(spark, d, "embeddings")
    return inference.cost(spark, "config_1", lambda: predictions(spark, d).where("configuration = 'config_1'").count(), e.count(), 64 * 3 * 64 + 64 + 64 * 32 + 32 + 33, e.count() * 64 * 8)


def _rows_of(spark, d, dataset: str, n: int = 400):
    """Valid small-table rows to pack into an archive: a few hundred records, as archives hold (the feature under test is
    the reader)."""
    return [(r["record_id"], r["raw_text"], r["label"]) for r in table(spark, d, "external_audited").where((F.col("dataset") == dataset) & F.col("raw_text").isNotNull() & F.col("label").isNotNull()).select("record_id", "raw_text", "label").orderBy("record_id").limit(n).collect()]




def _ascii(t: str) -> str:
    return " ".join("".join(c if " " < c <= "~" and c not in '";' else " " for c in t).split())


def _put(spark, name: str, body: bytes) -> str:
    path = f"{scratch(spark, 'archive')}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(body))
    out.close()
    return path


def _zipped(name: str, text: str) -> bytes:
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr(name, text.encode("latin-1"))
    return sink.getvalue()


def _archive_sql(dataset: str, record: str) -> str:
    clean = "trim(regexp_replace(regexp_replace(raw_text, '[^!-~]|[\";]', ' ', 'g'), ' +', ' ', 'g'))"
    return f"WITH r AS (SELECT *, row_number() OVER (ORDER BY record_id) AS k FROM external_audited WHERE dataset = '{dataset}' AND raw_text IS NOT NULL AND label IS NOT NULL QUALIFY k <= 400) SELECT {record} AS source_record, {clean} AS raw_text, label FROM r WHERE {clean} <> ''"


@query(_archive_sql("campus_sms", "'m:' || k"))
def s3_ragged_zip(spark, d):
    rows = _rows_of(spark, d, "campus_sms")
    body = "".join(f"u,1,t,in,n,1,{('ham', 'spam')[y]},{_ascii(t)},,\n" for _, t, y in rows)
    return archives.ragged_zip(spark, _put(spark, "a.zip", _zipped("in/m.csv", body))).where("raw_text <> ''").select("source_record", "raw_text", "label")


@query(_archive_sql("tube_comments", "'v.csv:' || record_id"))
def s5_headed_zip(spark, d):
    body = "COMMENT_ID,AUTHOR,DATE,CONTENT,CLASS\n" + "".join(f'{k},a,d,"{_ascii(t)}",{y}\n' for k, t, y in _rows_of(spark, d, "tube_comments"))
    return archives.headed_zip(spark, _put(spark, "b.zip", _zipped("v.csv", body))).where("raw_text <> ''").select("source_record", "raw_text", "label")


@query(_archive_sql("bosphor_sms", "'row:' || (k + 1)"))
def s4_coerced_csv(spark, d):
    body = "Group;Message\n" + "".join(f'{2 - y};"{_ascii(t) or "-"}"\n' for _, t, y in _rows_of(spark, d, "bosphor_sms"))
    return archives.coerced_csv(spark, _put(spark, "t.csv", body.encode())).where("raw_text <> '-'").select("source_record", "raw_text", "label")


@query(_archive_sql("mail_archive", "CASE label WHEN 1 THEN 'spam.tar.bz2' ELSE 'easy_ham.tar.bz2' END || ':x/' || record_id"))
def s6_s7_mail_tar(spark, d):
    rows, out = _rows_of(spark, d, "mail_archive"), None
    for name, label in (("spam.tar.bz2", 1), ("easy_ham.tar.bz2", 0)):
        sink = io.BytesIO()
        with tarfile.open(fileobj=sink, mode="w") as t:
            for k, text, _ in [r for r in rows if r[2] == label] + [("cmds", "mv", label)]:
                body = b"Content-Type: text/plain; charset=utf-8\n\n" + _ascii(text).encode()
                info = tarfile.TarInfo(f"x/{k}")
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        part = archives.mail_tar(spark, _put(spark, name, bz2.compress(sink.getvalue())))
        out = part if out is None else out.unionByName(part)
    return out.where("raw_text <> ''").select("source_record", "raw_text", "label")


@query("SELECT configuration, fold::BIGINT AS fold, seed FROM (SELECT 'config_' || c AS configuration, f AS fold, s AS seed FROM range(1, 5) a(c), range(5) b(f), range(1, 6) x(s))")
def c2_resumed_runs(spark, d):
    """Work that a first attempt did in part; the second runs and appends what is missing."""
    work, path = predictions(spark, d).select("configuration", F.col("fold").cast("bigint").alias("fold"), "seed").distinct(), scratch(spark, "results")
    files.append_missing(work.where("seed < 3"), path, ["configuration", "fold", "seed"], lambda w: w)
    return files.append_missing(work, path, ["configuration", "fold", "seed"], lambda w: w)


@query("SELECT row_index, label, part FROM long_messages JOIN fold_split USING (row_index) WHERE part IS NOT NULL AND label IS NOT NULL")
def c5_guarded_join(spark, d):
    """A join that fails if a key occurs twice on either side or a label is outside its values."""
    m, s = table(spark, d, "long_messages").where("label is not null").select("row_index", "label"), table(spark, d, "fold_split").where("part is not null").select("row_index", "part")
    return inference.one_to_one(m, s, ["row_index"]).select("row_index", F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(F.raise_error(F.lit("label outside 0 and 1")).cast("tinyint")).alias("label"), "part")
