"""Device profiles and classes from traffic."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake import config as c


def profiles(packets: DataFrame, low_ports_only: bool = True) -> DataFrame:
    """Per address: packets and bytes sent, ports served and contacted, ARP targets, share of TLS."""
    served = (F.col("src_port") < 1024) & (F.col("src_port") > 0) if low_ports_only else F.col("src_port") > 0
    sent = packets.select(F.col("src_ip").alias("ip"), F.lit(1).alias("sent"), "length", F.when(F.col("dst_port") > 0, F.col("dst_port")).alias("contacted"), F.when(served, F.col("src_port")).alias("served"), F.when(F.col("protocol") == "ARP", F.col("dst_ip")).alias("arp"))
    got = packets.select(F.col("dst_ip").alias("ip"), F.lit(0).alias("sent"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("int").alias("contacted"), F.when((F.col("dst_port") < 1024) & (F.col("dst_port") > 0), F.col("dst_port")).alias("served"), F.lit(None).cast("string").alias("arp"))
    return sent.unionByName(got).groupBy("ip").agg(
        F.sum("sent").alias("packets"), F.sum("length").alias("bytes"), F.countDistinct("contacted").alias("contacted_ports"), F.countDistinct("arp").alias("arp_targets"),
        F.array_sort(F.collect_set("served")).alias("served_ports"), F.count_if(F.col("contacted") == 443).alias("tls"),
    )


def classify(found: DataFrame, gateways: tuple = ()) -> DataFrame:
    """First class that fits: gateway, the port signatures in order, workstation, server, unknown."""
    kind, confidence = F.lit("unknown"), F.lit(0.0)
    rules = [("gateway", (F.col("arp_targets") > 10) | F.col("ip").isin(*(gateways or ("",))), F.when(F.col("ip").isin(*(gateways or ("",))), 0.95).otherwise(F.least(F.lit(1.0), 0.5 + F.col("arp_targets") / 100)))]
    for name, ports, least in c.DEVICE_PORTS:
        hits = F.size(F.array_intersect("served_ports", F.array(*map(F.lit, ports))))
        rules.append((name, hits >= least, F.least(F.lit(1.0), 0.7 + hits / 10)))
    rules.append(("workstation", (F.col("contacted_ports") > 20) & (F.col("tls") > 0.1 * F.col("packets")), F.lit(0.65)))
    rules.append(("server", (F.size("served_ports") > 0) & (F.col("packets") > 500), F.lit(0.6)))
    for name, test, sure in reversed(rules):
        kind, confidence = F.when(test, name).otherwise(kind), F.when(test, sure).otherwise(confidence)
    return found.withColumns({"device_type": kind, "confidence": F.round(confidence, 6)})
