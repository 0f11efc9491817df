"""Session helpers: table access, the shared folder, and cutting of lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of this name in a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session. Only where that is unset, as in
    tests on one machine, a local folder is made and set."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isDefined():
            return at.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Writes a frame as a table in the shared folder and reads it again, so that its lineage ends and lost executors
    cost nothing that was done before. (A checkpoint would carry the plan's constraints on, which double in each round
    of an iterative operator.)"""
    path = scratch(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: list[tuple] = []


def _clean() -> None:
    """Deletes what this process wrote to the shared folder; a JVM that is gone already leaves it to the folder's owner."""
    for jvm, conf, path in _made:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except (Py4JError, OSError):
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark._jvm, spark._jsc.hadoopConfiguration(), path))
    return path
