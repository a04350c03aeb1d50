"""Threat intelligence alerts and what has been learned to be normal."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.functions import net
from packetlake.operators import enrich, windows
from packetlake.operators.detect import alerts

DAY_MS = 86_400_000


def under(domains: DataFrame, listed: DataFrame, column: str = "domain") -> DataFrame:
    """The different domains that are a listed name (column `name`) or lie under one, on label boundaries."""
    clean = F.lower(F.trim(F.col(column), F.lit(".")))
    names = domains.select(column).distinct().select(column, F.explode(net.suffixes(clean)).alias("name"))
    return names.join(listed.select("name"), "name", "left_semi").select(column).distinct()


def ip_domains(packets: DataFrame, cfg: c.Config = c.DEFAULT) -> DataFrame:
    """Different ip, domain pairs: from DNS answers, and from the query that a source made shortly before it connected."""
    answered = packets.where("dns_response <> '' and dns_query <> ''").select(F.col("dns_response").alias("ip"), F.col("dns_query").alias("domain"))
    inferred = enrich.inferred_domains(packets.select("pkt_id", "ts_ms", "src_ip", "dst_ip", "protocol", "dns_query"), cfg).select(F.col("dst_ip").alias("ip"), "domain")
    return answered.unionByName(inferred).distinct()


def standing(pairs: DataFrame, cloud: DataFrame) -> DataFrame:
    """ip, cloud_domains and other_domains (the first five of each, in order) and whether there are any."""
    marked = pairs.join(under(pairs, cloud).withColumn("_cloud", F.lit(True)), "domain", "left").withColumn("_cloud", F.coalesce("_cloud", F.lit(False)))
    numbered = marked.groupBy("ip", "_cloud").agg(F.slice(F.array_sort(F.collect_set("domain")), 1, 5).alias("names"))
    return numbered.groupBy("ip").agg(F.max(F.when(F.col("_cloud"), F.col("names"))).alias("cloud_domains"), F.max(F.when(~F.col("_cloud"), F.col("names"))).alias("other_domains"))


def threat_ips(packets: DataFrame, indicators: DataFrame, cloud: DataFrame, cfg: c.Config = c.DEFAULT) -> DataFrame:
    """THREAT-INTEL-IP: listed addresses (ip, category) on either side; LOW where only large services' names lead there, MEDIUM where others do too."""
    hits = enrich.indicator_hits(packets, indicators, "src_ip", "dst_ip", "dst_port")
    known = standing(ip_domains(packets, cfg).join(indicators.select("ip").distinct(), "ip", "left_semi"), cloud)
    rows = hits.join(known, "ip", "left")
    cloudy, other = F.col("cloud_domains").isNotNull(), F.col("other_domains").isNotNull()
    severity = F.when(cloudy & ~other, "LOW").when(cloudy, "MEDIUM").when(F.col("category").isin(*c.CRITICAL_CATEGORIES), "CRITICAL").otherwise("HIGH")
    said = {"matched_ip": F.col("ip"), "direction": F.when(F.col("direction") == "src", "inbound").otherwise("outbound"), "threat_category": F.col("category")}
    said |= {"cloud_domains": F.array_join("cloud_domains", ","), "unknown_domains": F.array_join("other_domains", ",")}
    return alerts(rows, "THREAT-INTEL-IP", severity, "Threat Intelligence", **said)


def threat_domains(packets: DataFrame, listed: DataFrame, cloud: DataFrame) -> DataFrame:
    """THREAT-INTEL-DOMAIN: queries of listed names (name, category) or names under them, but not of large services; HIGH where anyone can host."""
    asked = packets.where("dns_query <> ''").select("pkt_id", "ts_ms", "src_ip", "dst_ip", "dst_port", F.col("dns_query").alias("domain"))
    rows = asked.join(enrich.domain_hits(asked, listed), "domain").join(under(asked, cloud), "domain", "left_anti")
    hosted = net.in_suffixes(F.lower(F.col("domain")), c.HOSTING_SUFFIXES)
    severity = F.when(hosted, "HIGH").when(F.col("confidence") == "HIGH", "CRITICAL").otherwise("HIGH")
    said = {"queried_domain": F.col("domain"), "matched_domain": F.col("matched"), "threat_category": F.col("category"), "confidence": F.col("confidence"), "hosted_on_cloud": hosted}
    return alerts(rows, "THREAT-INTEL-DOMAIN", severity, "Threat Intelligence", **said)


def unlearned_domains(packets: DataFrame, domains: DataFrame, exact: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), column: str = "dns_query") -> DataFrame:
    """packets whose base domain is not among the learned ones (rows of `enrich.learned` with `learned`), nor in the user's own lists."""
    base = net.base_domain(F.lower(F.col(column)))
    rows = packets.withColumn("_base", base)
    if exact:
        rows = rows.where(~F.lower(F.col(column)).isin(*exact) & ~F.coalesce(F.col("_base").isin(*exact), F.lit(False)))
    for s in suffixes:
        rows = rows.where(~F.endswith(F.lower(F.col(column)), F.lit(s)))
    return rows.join(domains.where("learned").select(F.col("domain").alias("_base")), "_base", "left_anti").drop("_base")


def learned_since(packets: DataFrame, domain_times: int = 3, address_times: int = 3, port_times: int = 5) -> dict[str, DataFrame]:
    """When each base domain, destination and port had been seen often enough: the key and since_ms, since_pkt of that packet."""
    named = packets.where("dns_query <> ''").select(net.base_domain(F.lower("dns_query")).alias("domain"), "ts_ms", "pkt_id")
    at = {
        "domains": windows.nth_rows(named, "domain", domain_times),
        "ips": windows.nth_rows(packets.select(F.col("dst_ip").alias("ip"), "ts_ms", "pkt_id"), "ip", address_times),
        "ports": windows.nth_rows(packets.where("dst_port > 0"), "dst_port", port_times),
    }
    return {k: t.withColumnsRenamed({"ts_ms": "since_ms", "pkt_id": "since_pkt"}) for k, t in at.items()}


def as_of(rows: DataFrame, since: DataFrame, keys: dict) -> DataFrame:
    """rows with `known`: whether the key had been learned before the row's own packet, so that what comes later decides nothing.

    keys: column of `since` -> expression on rows. `since` has a row a key.
    """
    names = {f"_{k}": v for k, v in keys.items()}
    table = since.select(*[F.col(k).alias(f"_{k}") for k in keys], "since_ms", "since_pkt")
    before = (F.col("since_ms") < F.col("ts_ms")) | ((F.col("since_ms") == F.col("ts_ms")) & (F.col("since_pkt") < F.col("pkt_id")))
    joined = rows.withColumns(names).join(table, list(names), "left")
    return joined.withColumn("known", F.col("since_ms").isNotNull() & F.coalesce(before, F.lit(False))).select(*rows.columns, "known")


def unlearned_as_of(packets: DataFrame, domains: DataFrame, column: str = "dns_query") -> DataFrame:
    """packets whose base domain had not been learned (rows of `learned_since`) when they came."""
    return as_of(packets, domains, {"domain": net.base_domain(F.lower(F.col(column)))}).where("not known").drop("known")


def learned_beacons(packets: DataFrame, least: int = 10, cv: float = 0.3) -> DataFrame:
    """src_ip, dst_ip pairs that met at regular intervals during the baseline."""
    from packetlake.operators.windows import previous

    rows = packets.select("pkt_id", "ts_ms", "src_ip", "dst_ip", F.concat_ws(">", "src_ip", "dst_ip").alias("_pair"))
    gap = (F.col("ts_ms") - F.col("_last")) / 1000.0
    by = previous(rows, "_pair", "ts_ms", "_last").groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n"), F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("sd"))
    return by.where((F.col("n") >= least) & (F.col("mean") > 0) & (F.col("sd") / F.col("mean") < cv)).select("src_ip", "dst_ip")


def fresh(table: DataFrame, now_ms: int, days: int = 30, count: str | None = None, least: int = 100) -> DataFrame:
    """A learned table without rows last seen (last_ms) over `days` ago; with `count`, rows of `least` sights or more stay."""
    stale = F.col("last_ms") < now_ms - days * DAY_MS
    return table.where(~(stale & (F.col(count) < least)) if count else ~stale)


def known_devices(profiles: DataFrame, packets: int = 50) -> DataFrame:
    """Devices seen in more than `packets` packets, and whether each is a gateway (asked for more than ten addresses)."""
    return profiles.where(F.col("packets") > packets).withColumn("is_gateway", F.col("arp_targets") > 10)


def learned_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each learned table has, and how many of them are learned."""
    parts = [t.agg(F.lit(name).alias("kind"), F.count("*").alias("n"), F.count_if("learned").alias("learned")) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
