"""Registered queries that run as streams over the packets, each with the SQL of the same question on the whole table."""

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.operators import detect
from packetlake.operators.stored import folder, stored
from packetlake.plans import q_detect, q_traffic
from packetlake.plans.packets import packets
from packetlake.streaming import alerts

QUERIES, SQL = {}, {}
#: Rows of a micro-batch: a key's rows wait in one task's memory, which must not grow with the table.
BATCH = 1_000_000
#: pkt_id of the row that moves the watermark past all others.
_LAST = 10**18
#: A packet that no rule skips and none tells of.
_PLAIN = {"src_ip": "8.8.8.8", "dst_ip": "10.1.1.1", "src_port": 40000, "dst_port": 81, "payload_size": 0, "protocol": "TCP", "flags": "PA"}


#: Files of a micro-batch.
FILES = 4


def run(spark: SparkSession, rows: DataFrame, build, batches: int = 2, most: int = BATCH, operators: int = 1) -> DataFrame:
    """What a stream over the rows gives: they come in order of time in `batches` micro-batches, or more of about `most` rows, then rows that move the watermark past them, twice.

    State is dealt over as many partitions as there are cores, fewer where the stream has several stateful `operators`: each
    partition of each one is a task that starts a Python worker and opens a store in every batch.
    """
    at = f"{folder(spark)}/packetlake-{uuid.uuid4().hex}"
    newest, n = rows.agg(F.max("ts_ms"), F.count("*")).first()
    batches = max(batches, -(-n // most))
    sorted_ = stored(rows.repartitionByRange(FILES * batches, "ts_ms"))
    files = sorted(sorted_.inputFiles())  # a file is a range of time, and their names are in its order
    for k in range(0, len(files), FILES):  # a stream takes files in the order in which they were written
        parts = [spark.read.schema(rows.schema).parquet(f) for f in files[k : k + FILES]]
        functools.reduce(DataFrame.unionByName, parts).write.parquet(f"{at}/in/{k // FILES}")
    for k in range(2):
        values = _PLAIN | {"ts_ms": (newest or 0) + 86_400_000}
        last = spark.range(0, FILES, 1, FILES).select(*[(F.col("id") + _LAST + k * FILES if n == "pkt_id" else F.lit(values.get(n, ""))).cast(t).alias(n) for n, t in rows.dtypes if n != "ts"])
        last.withColumn("ts", F.timestamp_millis("ts_ms")).select(*rows.columns).write.parquet(f"{at}/in/end{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).option("recursiveFileLookup", "true").parquet(f"{at}/in")
    done = build(stream)
    parts = "spark.sql.shuffle.partitions"
    before, cores = spark.conf.get(parts), spark.sparkContext.defaultParallelism
    spark.conf.set(parts, min(int(before), max(2, cores if operators == 1 else -(-4 * cores // operators))))
    try:  # a stream takes the settings at its start
        query = done.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(parts, before)
    query.awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{at}/out").where(F.col("pkt_id") < _LAST)


def _packets(s, d, *columns):
    return stored(packets(s, d).select(*(columns or detect.NEEDED), "ts"))


_WANTED = ("PORT-SCAN", "BRUTE-FORCE", "SYN-FLOOD", "ICMP-FLOOD", "DNS-FLOOD", "ARP-SPOOF", "DATA-EXFIL")
QUERIES["t6_stream_alerts"] = lambda s, d: run(s, _packets(s, d), alerts.alert_stream, operators=8).select("pkt_id", "ts_ms", "rule_id", "severity", "src_ip", "dst_ip")
SQL["t6_stream_alerts"] = f"with recursive {q_detect.ORACLE}, {q_detect.FOUND} select pkt_id, ts_ms, rule_id, severity, src_ip, dst_ip from found where rule_id in {_WANTED}"
QUERIES["j6_stream_domains"] = lambda s, d: run(s, _packets(s, d, "pkt_id", "ts_ms", "src_ip", "dst_ip", "protocol", "dns_query"), alerts.domain_stream).select("pkt_id", "dst_ip", "domain")
SQL["j6_stream_domains"] = q_traffic.SQL["j6_inferred_domains"]


def _resets(s, d):
    rows = stored(packets(s, d).where("flags = 'R'").select(F.lit("RST").alias("rule_id"), "ts_ms", "pkt_id", "src_ip", "dst_ip"))
    return rows.withColumn("ts", F.timestamp_millis("ts_ms"))


QUERIES["d15_stream_cooldown"] = lambda s, d: run(s, _resets(s, d), alerts.passed_stream).select("pkt_id", "ts_ms", "src_ip", "dst_ip")
SQL["d15_stream_cooldown"] = q_detect.SQL["d15_cooldown"]
