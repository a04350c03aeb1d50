"""Devices, endpoints, look-ups and the parts of a traffic report."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.functions import net
from packetlake.operators import flows


def last_seen(packets: DataFrame) -> DataFrame:
    """ip and last_ms of each address on either side."""
    return packets.select("ts_ms", F.explode(F.array("src_ip", "dst_ip")).alias("ip")).groupBy("ip").agg(F.max("ts_ms").alias("last_ms"))


def device_types(classes: DataFrame, seen: DataFrame, now_ms: int) -> DataFrame:
    """Devices of each type, and how many of them were active in the last hour."""
    active = F.count_if(F.col("last_ms") > now_ms - 3_600_000)
    return classes.join(seen, "ip").groupBy("device_type").agg(F.count("*").alias("devices"), active.alias("active"))


def newest_devices(classes: DataFrame, seen: DataFrame, most: int = 100) -> DataFrame:
    """The devices seen last."""
    return classes.join(seen, "ip").orderBy(F.desc("last_ms"), "ip").limit(most)


def expected_ports(packets: DataFrame, profiles: DataFrame, top: int = 30, least: int = 3) -> DataFrame:
    """Per address the ports that it usually contacts (the `top` most used, `least` times or more) and those that it serves."""
    used = packets.where("dst_port > 0").groupBy(F.col("src_ip").alias("ip"), "dst_port").agg(F.count("*").alias("n"))
    order = W.partitionBy("ip").orderBy(F.desc("n"), "dst_port")  # counts of ports, at most 65535 an address
    usual = used.withColumn("_r", F.row_number().over(order)).where((F.col("_r") <= top) & (F.col("n") >= least)).groupBy("ip").agg(F.collect_set("dst_port").alias("used"))
    none = F.array().cast("array<int>")
    return profiles.join(usual, "ip", "left").select("ip", F.array_sort(F.array_union(F.coalesce("used", none), F.coalesce("served_ports", none))).alias("ports"))


def named_devices(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """rows (ip, mac) with the name that a device table (name, ip, mac) gives to the address or else to the hardware address."""
    by_ip = devices.where("ip is not null").groupBy("ip").agg(F.first("name").alias("_by_ip"))
    by_mac = devices.where("mac is not null").groupBy(F.lower("mac").alias("_mac")).agg(F.first("name").alias("_by_mac"))
    out = rows.join(by_ip, "ip", "left").withColumn("_mac", F.lower("mac")).join(by_mac, "_mac", "left")
    return out.withColumn("device", F.coalesce("_by_ip", "_by_mac")).drop("_mac", "_by_ip", "_by_mac")


def dhcp_inventory(leases: DataFrame) -> DataFrame:
    """Per mac the newest address, host name and vendor that are not empty, and when it was seen first and last (leases: ts_ms, mac, ip, hostname, vendor)."""
    newest = lambda x: F.max_by(F.when(F.col(x) != "", F.col(x)), F.when(F.col(x) != "", F.col("ts_ms"))).alias(x)
    return leases.groupBy("mac").agg(newest("ip"), newest("hostname"), newest("vendor"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n"))


def with_dhcp(profiles: DataFrame, inventory: DataFrame) -> DataFrame:
    """Profiles with the mac, host name and vendor of the lease that gave out their address."""
    return profiles.join(inventory.select("ip", "mac", "hostname", "vendor"), "ip", "left")


def flow_totals(packets: DataFrame) -> DataFrame:
    """One row for each pair of addresses and ports, both ways together."""
    keyed = packets.select("length", "payload_size", "ts_ms", *[x.alias(n) for x, n in zip(net.flow_key(), ("ip_a", "ip_b", "port_a", "port_b", "proto"))])
    return keyed.groupBy("ip_a", "ip_b", "port_a", "port_b", "proto").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.sum("payload_size").alias("payload_bytes"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def breakdown(found: DataFrame, port: str = "dst_port") -> DataFrame:
    """Flows and bytes of each behaviour class, of flows of three packets or more."""
    return flows.classify(found, port).groupBy("flow_class").agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes"))


def totals(packets: DataFrame, secrets: DataFrame, exposures: DataFrame, insecure: DataFrame) -> DataFrame:
    """The counts of a report's head, one row each: packets, bytes, secrets by protocol, exposures by type, insecure services."""
    kind = lambda df, k, name, n=None: df.groupBy(F.lit(k).alias("section"), name.alias("item")).agg((F.count("*") if n is None else F.sum(n)).alias("n"))
    parts = [
        kind(packets, "packets", F.lit("all")), kind(packets, "bytes", F.lit("all"), "length"), kind(secrets, "secrets", F.col("protocol")),
        kind(exposures, "exposures", F.col("type")), kind(insecure, "insecure", F.col("dst_port").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reverse_names(rows: DataFrame, names: DataFrame, column: str = "ip") -> DataFrame:
    """rows with the reverse name of an address (names: ip, name), null where there is none."""
    return rows.join(names.select(F.col("ip").alias(column), F.col("name").alias("reverse_name")), column, "left")


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose url is one of a list of malicious ones."""
    return urls.join(listed.select("url").distinct(), "url", "left_semi")


def tool_processes(endpoints: DataFrame, tools: DataFrame, system: tuple[str, ...] = ()) -> DataFrame:
    """IOC-PROC-NAME: endpoint rows (process) whose name is that of a tool (name); names of the system are left alone."""
    rows = endpoints.withColumn("name", F.lower("process"))
    rows = rows.where(~F.col("name").isin(*system)) if system else rows
    return rows.join(tools.select(F.lower("name").alias("name")).distinct(), "name", "left_semi").withColumns({"rule_id": F.lit("IOC-PROC-NAME"), "severity": F.lit("CRITICAL")})


def missing_intelligence(spark: SparkSession, indicators: DataFrame | None) -> DataFrame:
    """IOC-NO-THREAT-INTEL: one row where there are no indicators."""
    none = indicators is None or indicators.isEmpty()
    return spark.createDataFrame([("IOC-NO-THREAT-INTEL", "MEDIUM")] if none else [], "rule_id string, severity string")


def incidents_of(found: DataFrame, least: str = "LOW", since_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """Incidents of a severity or more, those still active since a time, the newest first."""
    out = found.where(net.severity_rank(F.col("severity")) >= c.SEVERITIES.index(least))
    out = out.where(F.col("end_ms") >= since_ms) if since_ms is not None else out
    out = out.orderBy(F.desc("end_ms"), "key", "start_ms")
    return out.limit(limit) if limit else out


def incident_counts(found: DataFrame) -> DataFrame:
    """Incidents and alerts in them by severity."""
    return found.groupBy("severity").agg(F.count("*").alias("incidents"), F.sum("n_alerts").alias("alerts"), F.count_if("escalated").alias("escalated"))


def search(found: DataFrame, text: str = "", protocol: str | None = None, ip: str | None = None, port: int | None = None, most: int = 500) -> DataFrame:
    """Findings whose columns hold a text, of a protocol, address or port; the newest first. Values are masked already."""
    whole = F.lower(F.concat_ws(" ", "protocol", "masked", "src_ip", "dst_ip", F.col("dst_port").cast("string"), "note"))
    out = found.where(F.contains(whole, F.lit(text.lower()))) if text else found
    out = out.where(F.col("protocol") == protocol) if protocol else out
    out = out.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip)) if ip else out
    out = out.where(F.col("dst_port") == port) if port is not None else out
    return out.orderBy(F.desc("ts_ms"), F.desc("pkt_id"), "kind").limit(most)


def protocol_name(tcp: Column, udp: Column, number: Column, version: Column, is_arp: Column) -> Column:
    """The protocol of a packet from its header fields (ports where there are any, protocol number, IP version)."""
    inner = F.when(tcp.isNotNull(), "TCP").when(udp.isNotNull(), "UDP").when((version == 4) & (number == 1), "ICMP").when((version == 6) & (number == 58), "ICMPv6")
    return F.when(is_arp, "ARP").otherwise(inner.when(version == 4, "IP-Other").when(version == 6, "IPv6-Other").otherwise("Other"))
