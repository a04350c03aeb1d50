"""The same operators on streams of packets."""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.operators import correlate, detect, enrich
from packetlake.streaming import stateful


def packet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Packets from a directory of Parquet files; the number of files a trigger takes is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rates(packets: DataFrame, late: str = "2 minutes", width: str = "10 seconds") -> DataFrame:
    """Packets and bytes for each tumbling window; rows later than the watermark are dropped."""
    return packets.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).select(F.unix_millis("w.start").alias("start_ms"), "packets", "bytes")


def flood_windows(packets: DataFrame, late: str = "2 minutes", cfg: c.Config = c.DEFAULT) -> DataFrame:
    """SYN packets for each pair and sliding window of ten seconds, by steps of one; pairs over the threshold."""
    syn = packets.where("protocol = 'TCP' and contains(flags, 'S') and not contains(flags, 'A')")
    by = syn.withWatermark("ts", late).groupBy("src_ip", "dst_ip", F.window("ts", "10 seconds", "1 second").alias("w")).agg(F.count("*").alias("n"))
    return by.where(F.col("n") > cfg.syn_flood).select("src_ip", "dst_ip", F.unix_millis("w.start").alias("start_ms"), "n")


#: Rules whose windows are kept from batch to batch, key by key.
KEYED_RULES = (detect.port_scan, detect.brute_force, detect.syn_flood, detect.icmp_flood, detect.dns_flood, detect.arp_spoof, detect.exfiltration)


def alert_stream(packets: DataFrame, late: str = "2 minutes", cfg: c.Config = c.DEFAULT, rules=KEYED_RULES) -> DataFrame:
    """Alerts of a packet stream, the same rows as the rules give on a table of these packets, however the stream is cut into batches.

    A rule's answer for a packet comes when the watermark has passed it. Packets later than `late` are dropped.
    """
    look = detect.candidates(packets.withWatermark("ts", late).select(*detect.NEEDED, "ts"), cfg)
    return functools.reduce(DataFrame.unionByName, [r(look, cfg, over=stateful) for r in rules])


def passed_stream(found: DataFrame, late: str = "2 minutes", ms: int = c.DEFAULT.cooldown_ms) -> DataFrame:
    """The alerts of a stream of alerts (such as the table that `alert_stream` is written to) that pass the cooldown."""
    timed = found.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return stateful.cooldown(timed, ms).drop("ts")


def domain_stream(packets: DataFrame, late: str = "2 minutes", cfg: c.Config = c.DEFAULT) -> DataFrame:
    """TCP and UDP packets with the name that their source asked for less than 30 s before."""
    columns = ("pkt_id", "ts_ms", "ts", "src_ip", "dst_ip", "protocol", "dns_query")
    return enrich.inferred_domains(packets.withWatermark("ts", late).select(*columns), cfg, over=stateful)


def flow_sessions(packets: DataFrame, late: str = "2 minutes", idle: str = c.DEFAULT.flow_idle) -> DataFrame:
    """Traffic sessions of address pairs, closed after `idle` without a packet."""
    a, b = F.least("src_ip", "dst_ip").alias("ip_a"), F.greatest("src_ip", "dst_ip").alias("ip_b")
    return packets.withWatermark("ts", late).groupBy(a, b, F.session_window("ts", idle).alias("s")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes")).select("ip_a", "ip_b", F.unix_millis("s.start").alias("start_ms"), "packets", "bytes")


def to_tables(packets: DataFrame, write: Callable[[DataFrame, str, int], None], cfg: c.Config = c.DEFAULT, rules=detect.RULES, state: str | None = None):
    """Run the rules over each micro-batch and hand alerts and incidents to `write(df, table, batch)`.

    state: a folder that all executors share. With it, each batch begins from what the one before left there: the packets of
    the widest window, so that floods and scans over a batch's edge are found, and the alerts of the last incident gap, so
    that the cooldown and the incidents go on (an incident comes again, longer, under the same key and start). Rows should
    reach the stream in about the order of time. Running totals of uploads start anew with each batch. Without it each batch
    stands for itself.
    """
    wide = max(cfg.scan_ms, cfg.failure_ms, cfg.flood_ms)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not state:
            alerts = detect.cooldown(detect.run_rules(batch, cfg, rules=rules), cfg.cooldown_ms)
            write(detect.with_id(alerts), "alerts", number)
            write(correlate.incidents(alerts, cfg), "incidents", number)
            return
        old = number - 1
        seen = _table(spark, f"{state}/packets/{old}", batch)
        found = detect.run_rules(seen.unionByName(batch), cfg, rules=rules).join(batch.select("pkt_id").distinct(), "pkt_id", "left_semi").select(*detect.ALERT)
        before = _table(spark, f"{state}/alerts/{old}", found)
        passed = detect.cooldown(before.unionByName(found), cfg.cooldown_ms).join(before.select("rule_id", "src_ip", "dst_ip", "pkt_id"), ["rule_id", "src_ip", "dst_ip", "pkt_id"], "left_anti").select(*detect.ALERT)
        passed.write.mode("overwrite").parquet(f"{state}/passed/{number}")
        passed = spark.read.schema(passed.schema).parquet(f"{state}/passed/{number}")
        write(detect.with_id(passed), "alerts", number)
        write(correlate.incidents(before.unionByName(passed), cfg), "incidents", number)
        newest = batch.agg(F.max("ts_ms")).first()[0] or 0
        seen.unionByName(batch).where(F.col("ts_ms") > newest - wide).write.mode("overwrite").parquet(f"{state}/packets/{number}")
        # alerts of incidents that may go on, and of the last cooldown
        before.unionByName(passed).where(F.col("ts_ms") >= newest - cfg.incident_ms).write.mode("overwrite").parquet(f"{state}/alerts/{number}")

    return packets.writeStream.foreachBatch(run)


def _table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table of the state, without rows where there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(like.schema).parquet(path) if there else spark.createDataFrame([], like.schema)
