"""Flows, traffic summaries and rates."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.functions import net


def flows(packets: DataFrame, idle: str = c.DEFAULT.flow_idle) -> DataFrame:
    """Bidirectional flows; a flow ends after `idle` without a packet."""
    keyed = packets.select("*", *[x.alias(n) for x, n in zip(net.flow_key(), ("ip_a", "ip_b", "port_a", "port_b", "proto"))])
    has = lambda letter: F.count_if(F.col("flags").contains(letter))
    out = keyed.groupBy("ip_a", "ip_b", "port_a", "port_b", "proto", F.session_window("ts", idle).alias("s")).agg(
        F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.sum("payload_size").alias("payload_bytes"),
        F.count_if(F.col("src_ip") == F.col("ip_a")).alias("packets_ab"), F.count_if(net.syn_only(F.col("flags"))).alias("syn"), has("R").alias("rst"), has("F").alias("fin"),
        F.bool_or(F.col("flags").contains("S") & F.col("flags").contains("A")).alias("established"),
        F.array_join(F.array_sort(F.collect_set(F.expr("nullif(flags, '')"))), "|").alias("flag_set"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"),
    ).drop("s")
    seconds = F.greatest((F.col("end_ms") - F.col("start_ms")) / 1000.0, F.lit(0.001))
    return out.withColumns({"seconds": F.round(seconds, 6), "bytes_per_sec": F.round(F.col("bytes") / seconds, 6), "avg_size": F.round(F.col("bytes") / F.col("packets"), 6), "direction_ratio": F.round(F.col("packets_ab") / F.col("packets"), 6)})


def classify(found: DataFrame, port: str = "dst_port", at_least: int = 3) -> DataFrame:
    """Behaviour class: port 3, protocol 2, size 2, direction 1, bytes 1; the first class with the best score wins."""
    p, proto, size, way, total = (F.col(x) for x in (port, "protocol", "avg_size", "direction_ratio", "bytes"))
    # The classes in order, with their ports and ranges.
    classes = {
        "web_browsing": (p.isin(80, 443, 8080, 8443), None, (200, 1500), (0.2, 0.8), None),
        "video_streaming": (p.isin(443, 80, 1935, 554), None, (1000, 1500), (0.05, 0.3), 1_000_000),
        "file_transfer": (p.isin(20, 21, 22, 990, 443, 80), None, (800, 1500), (0.0, 0.15), 100_000),
        "voip_video_call": (p.isin(3478, 3479, 5060, 5061, 16384, 32767), "UDP", (100, 300), None, None),
        "dns_lookup": (p.isin(53, 5353), "UDP", (40, 512), None, None),
        "email": (p.isin(25, 110, 143, 465, 587, 993, 995), None, None, None, None),
        "ssh_terminal": (p.isin(22), None, (40, 200), None, None),
        "database": (p.isin(1433, 3306, 5432, 6379, 27017, 9200), None, None, None, None),
        "gaming": (F.lit(False), "UDP", (40, 200), None, None),
    }
    points = lambda test, n: F.when(test, n).otherwise(0)
    scores = {}
    for name, (ports, protocol, sizes, ways, least) in classes.items():
        s = points(ports, 3)
        s = s + points(proto == protocol, 2) if protocol else s
        s = s + points(size.between(*sizes), 2) if sizes else s
        s = s + points(way.between(*ways), 1) if ways else s
        scores[name] = s + points(total >= least, 1) if least else s
    out = found.where(F.col("packets") >= at_least).withColumns({f"_s_{n}": s for n, s in scores.items()})
    best = F.greatest(*[F.col(f"_s_{n}") for n in scores])
    kind = F.lit("unknown")
    for name in reversed(scores):
        kind = F.when((F.col(f"_s_{name}") == best) & (best > 0), name).otherwise(kind)
    return out.withColumn("flow_class", kind).withColumn("class_score", best.cast("int")).drop(*[f"_s_{n}" for n in scores])


def protocol_mix(packets: DataFrame, top: int = 8) -> DataFrame:
    by = packets.groupBy("protocol").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("protocol", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")).orderBy(F.desc("n"), "protocol").limit(top)  # one row beside


def top_talkers(packets: DataFrame, top: int = 20, by: str = "src_ip") -> DataFrame:
    return packets.groupBy(F.col(by).alias("ip")).agg(F.sum("length").alias("bytes"), F.count("*").alias("packets")).orderBy(F.desc("bytes"), "ip").limit(top)


def rate(packets: DataFrame, seconds: int = 1) -> DataFrame:
    return packets.groupBy((F.floor(F.col("ts_ms") / (1000 * seconds)) * seconds).alias("second")).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


def summary(packets: DataFrame) -> DataFrame:
    distinct = {"src_ips": "src_ip", "dst_ips": "dst_ip", "src_ports": "src_port", "dst_ports": "dst_port", "dns_names": F.expr("nullif(dns_query, '')")}
    return packets.agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), *[F.countDistinct(x).alias(n) for n, x in distinct.items()])


def insecure_services(packets: DataFrame, least: int = 5) -> DataFrame:
    """Per server and clear-text port: traffic, clients, and whether it also speaks TLS; a few small packets beside TLS are a redirect."""
    tls = packets.where("dst_port = 443").select("dst_ip").distinct().withColumn("has_https", F.lit(True))
    # Clear-text ports.
    found = packets.where(F.col("dst_port").isin(21, 23, 25, 80, 110, 143, 161, 389, 445, 512, 513, 514, 554, 873, 1883, 3306, 5060, 5432, 5900, 6379, 8080, 9200, 11211, 27017) & (F.col("payload_size") > 0))
    by = found.groupBy("dst_ip", "dst_port").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.countDistinct("src_ip").alias("clients"), F.min("ts_ms").alias("first_ms")).where(F.col("packets") >= least)
    out = by.join(tls, "dst_ip", "left").withColumn("has_https", F.coalesce("has_https", F.lit(False)))
    return out.withColumn("redirect_only", F.col("dst_port").isin(80, 8080) & F.col("has_https") & (F.col("bytes") < 5000) & (F.col("packets") < 20))


def recent(packets: DataFrame, minutes: int) -> DataFrame:
    """Packets of the last minutes before the newest one."""
    last = packets.agg(F.max("ts_ms").alias("_last"))
    return packets.crossJoin(F.broadcast(last)).where(F.col("ts_ms") >= F.col("_last") - minutes * 60_000).drop("_last")  # one row beside


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def flow_list(packets: DataFrame, k: int = 100, idle: str = c.DEFAULT.flow_idle) -> DataFrame:
    """The k largest flows by bytes with their state: RST or FIN once such a packet was seen, else EST after a SYN-ACK, else NEW."""
    state = F.when(F.col("rst") > 0, "RST").when(F.col("fin") > 0, "FIN").when(F.col("established"), "EST").otherwise("NEW")
    order = (F.desc("bytes"), "ip_a", "ip_b", "port_a", "port_b", "proto", "start_ms")
    return flows(packets, idle).withColumn("state", state).orderBy(*order).limit(k)
