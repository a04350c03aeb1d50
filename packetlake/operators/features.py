"""Windowed features, running baseline, beacon and DNS scores, combined anomaly score."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.functions import net
from packetlake.operators.stored import stored
from packetlake.operators.windows import previous

FEATURES = (
    "bytes_per_sec", "packets_per_sec", "avg_packet_size", "unique_dst_ports", "unique_dst_ips", "syn_ratio", "dns_rate", "failed_conn_ratio", "port_entropy",
    "iat_mean", "iat_std", "payload_ratio", "direction_asymmetry", "small_packet_ratio", "large_packet_ratio", "rst_ratio", "protocol_count", "encrypted_ratio",
)


USED = ("pkt_id", "ts_ms", "dst_ip", "dst_port", "protocol", "flags", "dns_query", "length", "payload_size", "is_encrypted")


def features(packets: DataFrame, seconds: int = 5) -> DataFrame:
    """One row of 18 features for each tumbling window."""
    slot = (F.floor(F.col("ts_ms") / (1000 * seconds))).alias("slot")
    rows = stored(packets.select(*USED)).withColumn("slot", slot)
    rows = previous(rows, "slot", "ts_ms", "_last", 100 * seconds).withColumn("iat", (F.col("ts_ms") - F.col("_last")) / 1000.0)
    ports = rows.groupBy("slot", "dst_port").agg(F.count("*").alias("k"))
    ports = ports.withColumn("p", F.col("k") / F.sum("k").over(W.partitionBy("slot"))).groupBy("slot").agg(F.sum(-F.col("p") * F.log2("p")).alias("port_entropy"))
    n = F.count("*")
    share = lambda test: F.count_if(test) / n
    out = rows.groupBy("slot").agg(
        (F.sum("length") / seconds).alias("bytes_per_sec"), (n / seconds).alias("packets_per_sec"), (F.sum("length") / n).alias("avg_packet_size"),
        F.countDistinct("dst_port").cast("double").alias("unique_dst_ports"), F.countDistinct("dst_ip").cast("double").alias("unique_dst_ips"), share(net.syn_only(F.col("flags"))).alias("syn_ratio"),
        (F.count_if(F.col("dns_query") != "") / seconds).alias("dns_rate"), share(F.col("flags").contains("R")).alias("failed_conn_ratio"), F.coalesce(F.avg("iat"), F.lit(0.0)).alias("iat_mean"),
        F.coalesce(F.stddev_pop("iat"), F.lit(0.0)).alias("iat_std"), (F.sum("payload_size") / F.sum("length")).alias("payload_ratio"), F.lit(0.0).alias("direction_asymmetry"),
        share(F.col("length") < 100).alias("small_packet_ratio"), share(F.col("length") > 1400).alias("large_packet_ratio"), share(F.col("flags").contains("R")).alias("rst_ratio"),
        F.countDistinct("protocol").cast("double").alias("protocol_count"), share(F.col("is_encrypted")).alias("encrypted_ratio"),
    )
    return out.join(ports, "slot").select("slot", *[F.round(F.col(f) + F.lit(0.0), 6).alias(f) for f in FEATURES])


def baseline(rows: DataFrame, by_hour: bool = False) -> DataFrame:
    """Mergeable (feature, n, total, squares) rows, for each hour of the day where asked: exact decimals, so that parts of a history add up to the same."""
    keys = ["hour", "feature"] if by_hour else ["feature"]
    long = rows.select(hour_of(F.col("slot")).alias("hour"), F.explode(F.map_from_arrays(F.array(*map(F.lit, FEATURES)), F.array(*[F.col(f).cast("decimal(18,6)") for f in FEATURES]))).alias("feature", "x"))
    return long.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").cast("decimal(38,6)").alias("total"), F.sum((F.col("x") * F.col("x")).cast("decimal(36,12)")).cast("decimal(38,12)").alias("squares"))


def hour_of(slot: Column, seconds: int = 5) -> Column:
    return (F.floor(slot * seconds / 3600) % 24).cast("int")


def merge_baselines(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [k for k in ("hour", "feature") if k in a.columns]
    return a.unionByName(b).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,6)").alias("total"), F.sum("squares").cast("decimal(38,12)").alias("squares"))


def statistics(base: DataFrame) -> DataFrame:
    """Mean and sample deviation of a baseline's features."""
    n, total, squares = F.col("n"), F.col("total").cast("double"), F.col("squares").cast("double")
    spread = F.when(n > 1, F.sqrt(F.greatest((squares - total * total / n) / F.greatest(n - 1, F.lit(1)), F.lit(0.0)))).otherwise(0.0)
    return base.select(*[k for k in ("hour", "feature") if k in base.columns], "n", (total / n).alias("mean"), spread.alias("sd"))


def standings(rows: DataFrame, least_hour: int = 5) -> DataFrame:
    """slot, n and z_<feature>: each window's features against all windows so far, this one included; against those of its hour where there are enough."""
    # windows are one row each 5 s, however many packets they hold: one ordered history, as the score is defined over all of it
    every = W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    hourly = W.partitionBy("_hour").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_hour", hour_of(F.col("slot")))
    mean = lambda f, w: F.avg(f).over(w)
    sd = lambda f, w: F.coalesce(F.stddev_samp(f).over(w), F.lit(0.0))
    own = F.count("*").over(hourly) >= least_hour
    z = [((F.col(f) - F.when(own, mean(f, hourly)).otherwise(mean(f, every))) / (F.when(own, sd(f, hourly)).otherwise(sd(f, every)) + 1e-8)).alias("z_" + f) for f in FEATURES]
    return rows.select("slot", F.count("*").over(every).alias("n"), *z)


def deviation(rows: DataFrame) -> DataFrame:
    """Score of the mean |z| over the features; 0 before ten windows."""
    z = [F.abs("z_" + f) for f in FEATURES]
    mean = F.least(F.lit(10.0), sum(z[1:], z[0]) / len(z))
    return standings(rows).select("slot", F.when(F.col("n") < 10, 0.0).otherwise(1 - 1 / (1 + mean / 3)).alias("deviation"))


def explanation(rows: DataFrame, most: int = 8, least: float = 2.0) -> DataFrame:
    """slot, place, feature, z: the features that stand out by more than two deviations, the largest first, eight at most."""
    long = standings(rows).select("slot", F.explode(F.map_from_arrays(F.array(*map(F.lit, FEATURES)), F.array(*["z_" + f for f in FEATURES]))).alias("feature", "z"))
    order = W.partitionBy("slot").orderBy(F.desc(F.abs("z")), "feature")  # 18 rows a slot
    return long.where(F.abs("z") > least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def reasons(deviation_: Column, forest: Column, beacon: Column, dns: Column) -> Column:
    """Why a window is anomalous, from its scores and features."""
    said = (
        (deviation_ > 0.5, "deviation"), (forest > 0.3, "forest"), (beacon > 0.5, "beacon"), (dns > 0.5, "dns"),
        (F.col("unique_dst_ports") > 200, "ports"), (F.col("syn_ratio") > 0.7, "syn"), (F.col("failed_conn_ratio") > 0.5, "failed"),
    )
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in said]), lambda x: x.isNotNull())


def anomaly_alerts(scored: DataFrame, cfg: c.Config = c.DEFAULT) -> DataFrame:
    """ML-ANOMALY: windows (slot, anomaly, reasons) over the threshold with two reasons or more, once a forest has been trained."""
    severity = F.when(F.col("anomaly") > 0.8, "CRITICAL").when(F.col("anomaly") > 0.5, "HIGH").otherwise("MEDIUM")
    rows = scored.where((F.col("anomaly") > cfg.anomaly) & (F.size("reasons") >= 2))
    return rows.select("slot", F.lit("ML-ANOMALY").alias("rule_id"), severity.alias("severity"), "anomaly", F.array_join("reasons", "|").alias("reasons"))


def daily_summary(scored: DataFrame, cfg: c.Config = c.DEFAULT, seconds: int = 5) -> DataFrame:
    """Score statistics of each day, from rows slot and anomaly."""
    day = F.floor(F.col("slot") * seconds / 86_400).alias("day")
    odd = F.count_if(F.col("anomaly") > cfg.anomaly)
    return scored.groupBy(day).agg(F.round(F.sum(F.col("anomaly").cast("decimal(12,4)")).cast("double") / F.count("*"), 4).alias("avg_score"), F.round(F.max("anomaly"), 4).alias("max_score"), F.round(F.min("anomaly"), 4).alias("min_score"), odd.alias("anomalies"), F.count("*").alias("samples"), F.round(100 * odd / F.count("*"), 2).alias("pct"))


def recent_scores(scored: DataFrame, minutes: int, seconds: int = 5) -> DataFrame:
    """Scores of the last minutes before the newest window."""
    newest = scored.agg(F.max("slot").alias("_newest"))
    return scored.crossJoin(F.broadcast(newest)).where(F.col("slot") > F.col("_newest") - minutes * 60 / seconds).drop("_newest")  # one row


def beacons(packets: DataFrame, cfg: c.Config = c.DEFAULT) -> DataFrame:
    """Destinations outside that are contacted at regular intervals of 5 to 300 s: score 1 - cv."""
    ip = F.col("dst_ip")
    rows = stored(packets.select("pkt_id", "ts_ms", "dst_ip").where(~net.is_private(ip) & ~net.is_loopback(ip) & ~net.is_link_local(ip) & ~net.is_multicast(ip)))
    rows = previous(rows, "dst_ip", "ts_ms", "_last").withColumn("gap", (F.col("ts_ms") - F.col("_last")) / 1000.0)
    by = rows.groupBy("dst_ip").agg(F.count("*").alias("packets"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    cv = F.col("sd") / F.col("mean")
    return by.where((F.col("packets") >= cfg.beacon_packets) & F.col("mean").between(5, 300) & (cv < cfg.beacon_cv)).select("dst_ip", "packets", F.round("mean", 6).alias("interval"), F.round(1 - cv, 6).alias("score"))


def dns_scores(packets: DataFrame, seconds: int = 60) -> DataFrame:
    """Per window: long names, random-looking labels and rate; the largest of the three scores."""
    q = F.col("dns_query")
    rows = packets.where((q != "") & ~q.endswith(".local")).withColumn("slot", F.floor(F.col("ts_ms") / (1000 * seconds))).withColumn("label", F.substring_index(q, ".", 1))
    odd = (F.length("label") > 25) & (net.entropy(F.col("label")) > 4.0)
    by = rows.groupBy("slot").agg(F.count("*").alias("n"), F.count_if(F.length(q) > 60).alias("long"), F.count_if(odd).alias("odd"))
    rate = F.col("n") / seconds
    long = F.when(F.col("long") >= 3, F.least(F.col("long") / F.col("n") * 2, F.lit(1.0))).otherwise(0.0)
    return by.select("slot", "n", "long", "odd", F.round(F.greatest(long, F.when(F.col("odd") >= 5, 0.7).otherwise(0.0), F.when(rate > 50, F.least(rate / 150, F.lit(1.0))).otherwise(0.0)), 6).alias("dns_score"))


def combined(deviation_: Column, forest: Column, beacon: Column, dns: Column) -> Column:
    """Weighted score of four columns, four decimals; the columns count with six, and their sum is exact."""
    parts = [(w, F.round(x, 6).cast("decimal(12,6)")) for w, x in (("0.30", deviation_), ("0.35", F.least(forest, F.lit(1.0))), ("0.15", beacon), ("0.20", dns))]
    total = sum((F.lit(w).cast("decimal(3,2)") * x for w, x in parts[1:]), F.lit(parts[0][0]).cast("decimal(3,2)") * parts[0][1])
    return F.round(total, 4).cast("double")
