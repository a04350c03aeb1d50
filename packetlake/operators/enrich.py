"""Joins and look-ups: indicators, names, DNS answers and inference, learned state."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.functions import net
from packetlake.operators import windows


def sides(packets: DataFrame, *more: str) -> DataFrame:
    """One row for each address of a packet, with its direction and `more` of the packet's columns."""
    return packets.select("pkt_id", "ts_ms", *more, F.explode(F.array(F.struct(F.col("src_ip").alias("ip"), F.lit("src").alias("direction")), F.struct(F.col("dst_ip").alias("ip"), F.lit("dst").alias("direction")))).alias("x")).select("pkt_id", "ts_ms", *more, "x.*")


def indicator_hits(packets: DataFrame, indicators: DataFrame, *more: str) -> DataFrame:
    """Addresses that an indicator table (ip, category) lists; private, loopback and link-local ones are never looked up."""
    ip = F.col("ip")
    return sides(packets, *more).join(indicators, "ip").where(~net.is_private(ip) & ~net.is_loopback(ip) & ~net.is_link_local(ip))


def network_hits(packets: DataFrame, networks: DataFrame) -> DataFrame:
    """Addresses inside listed networks (lo, hi, name). The range join is made equal on the first byte, which a network may span."""
    spread = networks.withColumn("byte", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))))
    rows = sides(packets).withColumn("value", net.ip_long(F.col("ip"))).withColumn("byte", F.shiftright("value", 24))
    return rows.join(spread, "byte").where("value between lo and hi").select("pkt_id", "ip", "direction", "name")


def domain_hits(domains: DataFrame, listed: DataFrame, column: str = "domain") -> DataFrame:
    """Listed names (name, category): the name itself is HIGH, its nearest listed parent MEDIUM; a bare top level is never tested."""
    rows = domains.select(column).distinct().select(column, F.posexplode(net.suffixes(F.col(column))).alias("depth", "name")).where(F.col("name").contains("."))
    hits = rows.join(listed, "name").groupBy(column).agg(F.min_by(F.struct("name", "category", "depth"), "depth").alias("m"))
    return hits.select(column, F.col("m.name").alias("matched"), F.col("m.category").alias("category"), F.when(F.col("m.depth") == 0, "HIGH").otherwise("MEDIUM").alias("confidence"))


def dynamic_dns(domains: DataFrame, column: str = "domain", strict_suffix: bool = False) -> DataFrame:
    d = F.lower(F.col(column))
    ends = [d.endswith("." + x) | (d == x) if strict_suffix else d.endswith(x) for x in c.DYNAMIC_DNS]
    test = ends[0]
    for e in ends[1:]:
        test = test | e
    return domains.where(test)


def inferred_domains(packets: DataFrame, cfg: c.Config = c.DEFAULT, over=windows) -> DataFrame:
    """As-of: a TCP or UDP packet without a query takes the newest query of its source if that is less than 30 s old."""
    rows = over.newest_in_window(packets, ["src_ip"], cfg.dns_memory_ms, "dns_query", "domain")
    return rows.where("protocol in ('TCP', 'UDP') and dns_query = '' and domain is not null")


def answered_domains(packets: DataFrame) -> DataFrame:
    """Address to names, from DNS answers."""
    return packets.where("dns_response <> '' and dns_query <> ''").groupBy(F.col("dns_response").alias("ip")).agg(F.array_join(F.array_sort(F.collect_set("dns_query")), "|").alias("domains"))


def latest_owner(packets: DataFrame, owners: DataFrame, block_ms: int = 600_000) -> DataFrame:
    """As-of: the process that last owned the source port before the packet (owners: ip, port, owner_ms, process).

    A port's history goes by blocks of time: each begins with the last owner of the blocks before it.
    """
    both = owners.select("ip", "port", F.col("owner_ms").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pkt_id"), "process").unionByName(
        packets.select(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"), F.col("ts_ms").alias("t"), F.lit(1).alias("kind"), "pkt_id", F.lit(None).cast("string").alias("process"))
    )
    both = both.withColumn("_block", F.floor(F.col("t") / block_ms))
    keys = ["ip", "port", "_block"]
    last = both.groupBy(*keys).agg(F.max(F.when(F.col("process").isNotNull(), F.struct("t", "process"))).alias("_end"))
    before = W.partitionBy("ip", "port").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    carried = last.select(*keys, F.max("_end").over(before)["process"].alias("_carried"))
    inside = W.partitionBy(*keys).orderBy("t", "kind", "process", "pkt_id").rowsBetween(W.unboundedPreceding, 0)
    rows = both.withColumn("process", F.last("process", ignorenulls=True).over(inside)).where("kind = 1").join(carried, keys)
    return rows.select("pkt_id", F.coalesce("process", "_carried").alias("process"))


def learned(packets: DataFrame, domain_times: int = 3, address_times: int = 3, port_times: int = 5) -> dict[str, DataFrame]:
    """Baseline tables: base domains, destination addresses and ports seen often enough."""
    named = packets.where("dns_query <> ''").withColumn("domain", net.base_domain(F.col("dns_query")))
    domains = named.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("src_ip").alias("sources"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    confidence = F.least(F.lit(1.0), F.col("sources") / 3 * 0.5 + F.col("n") / 50 * 0.5)
    return {
        "domains": domains.withColumn("confidence", F.round(confidence, 6)).withColumn("learned", F.col("n") >= domain_times),
        "ips": packets.groupBy(F.col("dst_ip").alias("ip")).agg(F.count("*").alias("n"), F.countDistinct("dst_port").alias("ports")).withColumn("learned", F.col("n") >= address_times),
        "ports": packets.where("dst_port > 0").groupBy("dst_port").agg(F.count("*").alias("n")).withColumn("learned", F.col("n") >= port_times),
    }
