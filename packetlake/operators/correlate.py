"""Alerts to incidents, alert statistics, batches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.functions import net


def incidents(found: DataFrame, cfg: c.Config = c.DEFAULT) -> DataFrame:
    """Alerts of one source at most five minutes apart are one incident; without a source, alerts of one category."""
    key = F.coalesce(F.expr("nullif(src_ip, '')"), F.concat(F.lit(":"), F.col("category")))
    rows = found.withColumns({"key": key, "ts": F.timestamp_millis("ts_ms"), "rank": net.severity_rank(F.col("severity"))})
    out = rows.groupBy("key", F.session_window("ts", f"{cfg.incident_ms} milliseconds").alias("s")).agg(
        F.count("*").alias("n_alerts"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.max("rank").alias("rank"),
        F.array_sort(F.collect_set("category")).alias("category_set"), F.array_sort(F.collect_set("rule_id")).alias("rule_set"), F.countDistinct("dst_ip").alias("n_targets"),
    )
    chain = F.lit(False)
    for first, then in c.ESCALATION:
        chain = chain | (F.arrays_overlap("category_set", F.array(*map(F.lit, first))) & F.arrays_overlap("category_set", F.array(*map(F.lit, then))))
    rank = F.when(chain, F.greatest(F.col("rank"), F.lit(2))).otherwise(F.col("rank"))
    severity = F.element_at(F.array(*map(F.lit, c.SEVERITIES)), rank + 1)
    return out.select("key", "start_ms", "end_ms", "n_alerts", "n_targets", F.array_join("category_set", "|").alias("categories"), F.array_join("rule_set", "|").alias("rules"), chain.alias("escalated"), severity.alias("severity"))


def alert_counts(found: DataFrame) -> DataFrame:
    """Counts by severity, by category and by rule, in one pass."""
    return found.groupingSets([["severity"], ["category"], ["rule_id"]], "severity", "category", "rule_id").agg(F.count("*").alias("n"))


def alert_rate(found: DataFrame, seconds: int = 10) -> DataFrame:
    return found.groupBy((F.floor(F.col("ts_ms") / (1000 * seconds)) * seconds).alias("second")).agg(F.count("*").alias("n"))


def notifications(found: DataFrame, seconds: int = 15) -> DataFrame:
    hot = found.where("severity in ('HIGH', 'CRITICAL')")
    return hot.groupBy((F.floor(F.col("ts_ms") / (1000 * seconds)) * seconds).alias("second")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"))


def select_alerts(found: DataFrame, least: str = "LOW", category: str | None = None, since_ms: int | None = None, limit: int | None = None) -> DataFrame:
    out = found.where(net.severity_rank(F.col("severity")) >= c.SEVERITIES.index(least))
    out = out.where(F.col("category") == category) if category else out
    out = out.where(F.col("ts_ms") >= since_ms) if since_ms is not None else out
    return out.orderBy(F.desc("ts_ms"), F.desc("pkt_id"), "rule_id").limit(limit) if limit else out


def acknowledged(found: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with a flag from an acknowledgement table (alert_id)."""
    return found.join(acks.select("alert_id").distinct().withColumn("acknowledged", F.lit(True)), "alert_id", "left").withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))
