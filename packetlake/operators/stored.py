"""Intermediate tables in the folder that all executors share, and columns that are worked out once."""

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="packetlake-")


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir (or SparkContext.setCheckpointDir) names. Where that is unset, one of our own, but only in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or _own_folder()).rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, readable after an executor is lost.

    Results read these tables lazily, so they stay until the session's owner clears the folder, or calls `forget`.
    """
    path = f"{folder(df.sparkSession)}/packetlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are worked out once: a generator keeps what reads them from being written out in their terms."""
    return rows.withColumn("_h", F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))).select("*", "_h.*").drop("_h")
