"""Shared plumbing: tables, durable intermediate results, numbering and connected components."""

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes in an Arrow batch: texts are long, and a batch stands in memory on both sides of a Python worker.
BATCH, BATCH_BYTES = 1000, 4 << 20


def settings(spark: SparkSession) -> None:
    """Small Arrow batches; shuffle files go when the job that wrote them has ended, as each result is a table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settings(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="packetlake-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, one of our own, but only in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or _own_folder()


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, computed once and readable after an executor is lost."""
    spark = df.sparkSession
    settings(spark)
    path = f"{shared_folder(spark).rstrip('/')}/packetlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._saved_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], count: str, total: int) -> DataFrame:
    """left with `columns` of right, which has one row a key and in `count` how many rows of left have it (`total` in all, or fewer).

    Keys of more than a thousandth of the rows are fewer than a thousand, so these are broadcast; their rows are dealt by a
    hash to as many tasks as such a share of rows fits into.
    """
    most = max(1000, total // 1000)
    parts = F.ceil(F.col(count) / most).cast("int")
    hot = F.broadcast(right.where(F.col(count) > most).select(*keys, parts.alias("_parts")))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copies = right.select(*keys, *columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_salt"))
    return dealt.join(copies, [*keys, "_salt"], "left").select(*left.columns, *columns)


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def numbered(df: DataFrame, group: str, order: list[str], slot: str, rows_each: int = 50_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps; no group meets in one task.

    Rows of a group go to sub-groups by a hash of the order columns; a sub-group's first number is the sum of the sizes before it.
    """
    from pyspark.sql import Window as W

    n = df.count()
    parts = max(1, min(100_000, n // rows_each * 4))
    df = df.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = df.groupBy(group, "_sub").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_first", F.sum("_c").over(W.partitionBy(group).orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(group, "_sub", F.coalesce("_first", F.lit(0)).alias("_first"))
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(group, "_sub").orderBy(*order)) - 1)
    return ranked.join(before, [group, "_sub"]).withColumn(slot, (F.col("_first") + F.col("_r")).cast("long")).drop("_sub", "_first", "_r")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component): the smallest id that can be reached, for each node that has an edge.

    Alternating large-star and small-star rounds. All of a node's neighbours are never gathered: each round takes a
    minimum (combined before the shuffle) and joins it back, which Spark can split where a node is hot.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, before = saved(e), None
    n = e.count()
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = lookup(both, low, ["u"], ["m"], "c", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        last, e = e, saved(small.select("x.u", "x.v").where("u <> v").distinct())
        forget(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        n, before = now[0], now
    else:
        raise RuntimeError(f"components: no fixpoint after {rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
