"""Tables that outlive a run: alerts, incidents, learned state, feature history by day."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a packet table as other programs bring it.
PACKETS = (
    "pkt_id long, ts_ms long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flags string, dns_query string, dns_response string, payload_size long, length long, "
    "src_mac string, dst_mac string, is_encrypted boolean, process_name string, ttl int, payload string, date date"
)


def read_packets(spark: SparkSession, path: str, since: str | None = None, form: str = "parquet") -> DataFrame:
    """A packet table by days; days before `since` are not read."""
    rows = spark.read.schema(PACKETS).format(form).load(path)
    return rows.where(F.col("date") >= since) if since else rows


def append_alerts(found: DataFrame, path: str) -> None:
    found.withColumn("date", F.to_date(F.timestamp_millis("ts_ms"))).write.mode("append").partitionBy("date").parquet(path)


def newest_alerts(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("ts_ms"), F.desc("pkt_id"), "rule_id").limit(most)


def append_incidents(found: DataFrame, path: str) -> None:
    found.write.mode("append").parquet(path)


def newest_incidents(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("end_ms"), "key").limit(most)


def save_state(tables: dict[str, DataFrame], path: str) -> None:
    """Learned tables as a new version of a snapshot. The manifest names a version once all its tables are there, so a crash leaves the one before, and readers of that one go on."""
    version = f"v-{uuid.uuid4().hex}"
    for name, t in tables.items():
        t.write.parquet(f"{path}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    number = (_versions(spark, path)[-1][0] if _versions(spark, path) else 0) + 1
    spark.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return sorted(map(tuple, spark.read.schema("number long, version string").parquet(f"{path}/manifest").collect())) if there else []  # a row a version


def load_state(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables of the newest version."""
    version = _versions(spark, path)[-1][1]
    return {name: spark.read.parquet(f"{path}/{version}/{name}") for name in names}


def merged_counts(old: DataFrame, new: DataFrame, keys: list[str], times: int) -> DataFrame:
    """Two learned tables (n, and first_ms and last_ms where there are such) added up; `learned` follows from the sum."""
    has = set(old.columns) & set(new.columns)
    sums = [F.sum("n").alias("n")] + [f(x).alias(x) for x, f in (("first_ms", F.min), ("last_ms", F.max)) if x in has]
    names = [*keys, "n", *[x for x in ("first_ms", "last_ms") if x in has]]
    return old.select(*names).unionByName(new.select(*names)).groupBy(*keys).agg(*sums).withColumn("learned", F.col("n") >= times)


def drop_days(spark: SparkSession, path: str, before: str) -> list[str]:
    """Delete the day folders (date=...) of a table that lie before a day; returns them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(p.getName() for p in (s.getPath() for s in fs.listStatus(folder)) if p.getName().startswith("date=") and p.getName()[5:] < before)
    for name in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)
    return old


def export_results(found: DataFrame, path: str, form: str = "json") -> None:
    """Analysis results as JSON, or as CSV with the evidence as JSON text."""
    if form == "json":
        found.write.mode("overwrite").json(path)
    else:
        found.withColumn("evidence", F.to_json("evidence")).write.mode("overwrite").option("header", True).csv(path)
