"""File sources and sinks: typed CSV, split tables, prediction files, content-keyed Parquet caches, JSON metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import cut


def read_csv(spark: SparkSession, path: str, schema: str | None = None, keep_words: bool = True, sep: str = ",") -> DataFrame:
    """CSV with a header. keep_words: all strings, words such as null and nan survive."""
    r = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    if keep_words:
        r = r.option("nullValue", "\u0000").option("emptyValue", "").option("nanValue", "\u0000")
    return r.csv(path, schema=schema) if schema else r.csv(path)


def write_split(split: DataFrame, path: str) -> None:
    """fold, row_index, part as Parquet, one folder a fold."""
    split.repartition("fold").write.mode("overwrite").partitionBy("fold").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_predictions(spark: SparkSession, glob: str, expected: int) -> DataFrame:
    """The union of the prediction files of all folds; their number must be the expected one."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(glob).withColumn("file", F.col("_metadata.file_path"))
    n = df.select("file").distinct().count()
    if n != expected:
        raise ValueError(f"{n} prediction files, expected {expected}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; errors other than its absence are raised."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def content_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests of the files below a path, in name order."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("d"))
    return f.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "d"))), lambda x: x["d"]), "\n"), 256)).first()[0]


def cached(spark: SparkSession, source: str, cache: str, make) -> DataFrame:
    """The Parquet cache of make(source), made again when the digest of the source differs from the stored one."""
    digest = content_digest(spark, source)
    if exists(spark, f"{cache}/digest/_SUCCESS") and spark.read.json(f"{cache}/digest").first()["digest"] == digest:
        return spark.read.parquet(f"{cache}/data")
    make(source).write.mode("overwrite").parquet(f"{cache}/data")
    spark.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode("overwrite").json(f"{cache}/digest")
    return spark.read.parquet(f"{cache}/data")


def append_missing(work: DataFrame, done_path: str, keys: list[str], run) -> DataFrame:
    """Runs only the keys of the work list that the result table lacks and appends them: resumption after a loss."""
    spark = work.sparkSession
    if exists(spark, done_path):
        work = work.join(spark.read.parquet(done_path).select(*keys).distinct(), keys, "left_anti")
    run(work).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)


def write_matrix(table: DataFrame, path: str) -> None:
    """idx, vec as Parquet. Readers see the whole table or none: it is written beside its place and renamed."""
    spark, partial = table.sparkSession, f"{path}.partial"
    table.write.mode("overwrite").parquet(partial)
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (partial, path))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{partial} could not be renamed")


ROUNDS = 16


def extract(words: DataFrame, path: str, batch: int, origin: dict[str, str], run, stop_after: int | None = None) -> DataFrame:
    """run(words) for idx 1, 2, ... in batches, each written as it is done beside a checkpoint of the offset and of what
    it was made from. A second call goes on from the offset; one with other words or another origin fails. Many batches
    go in rounds of several, about `ROUNDS` for all words, so a loss costs one round; the words are made before the
    rounds, not in each."""
    spark = words.sparkSession
    words = cut(words.repartitionByRange("idx").sortWithinPartitions("idx"))  # a round reads its own part of the files
    digest = words.agg(F.sum(F.xxhash64("idx", "word").cast("decimal(38,0)")).cast("string"), F.max("idx")).first()
    about, n, offset = str(sorted(origin.items())), digest[1] or 0, 0
    if exists(spark, f"{path}/checkpoint"):
        kept = spark.read.json(f"{path}/checkpoint").orderBy(F.desc("offset")).first()
        if (kept["words"], kept["origin"]) != (digest[0], about):
            raise ValueError("the checkpoint was made from a different input")
        offset = kept["offset"]
    many, done = max(1, -(-n // (batch * ROUNDS))), 0
    while offset < n and (stop_after is None or done < stop_after):
        here = many if stop_after is None else min(many, stop_after - done)
        # The data of a round come first; a round that was cut off is written again.
        run(words.where((F.col("idx") > offset) & (F.col("idx") <= offset + batch * here))).write.mode("overwrite").parquet(f"{path}/data/batch={offset}")
        offset, done = min(n, offset + batch * here), done + here
        spark.createDataFrame([(offset, digest[0], about)], "offset bigint, words string, origin string").coalesce(1).write.mode("append").json(f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/data").drop("batch")
