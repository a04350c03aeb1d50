"""Windowed detection rules: packets in, alerts out. All windows are on event time (ts_ms).

`over` holds the window functions: `operators.windows` for tables, `streaming.stateful` for streams.
"""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.functions import net
from packetlake.operators import windows
from packetlake.operators.stored import stored

ALERT = ("rule_id", "severity", "category", "ts_ms", "pkt_id", "src_ip", "dst_ip", "dst_port", "evidence")


def evidence(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def alerts(df: DataFrame, rule: str, severity, category: str, **values: Column) -> DataFrame:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return df.withColumns({"rule_id": F.lit(rule), "severity": severity, "category": F.lit(category), "evidence": evidence(**values)}).select(*ALERT)


def candidates(packets: DataFrame, cfg: c.Config = c.DEFAULT, allow: DataFrame | None = None) -> DataFrame:
    """Packets that the heuristic rules look at: no allow-listed address, no infrastructure, no noisy port."""
    dst, src = F.col("dst_ip"), F.col("src_ip")
    skip = net.is_multicast(dst) | net.is_link_local(src) | net.is_link_local(dst) | dst.isin(*c.SPECIAL_ADDRESSES) | src.isin(*c.SPECIAL_ADDRESSES) | F.col("dst_port").isin(*c.NOISY_PORTS)
    if cfg.infrastructure:
        known = dst.isin(*cfg.infrastructure) | src.isin(*cfg.infrastructure)
        skip = skip | (known & ~F.col("dst_port").isin(*c.BAD_PORT_NAMES))
    out = packets.where(~skip)
    if allow is not None:
        for side in ("src_ip", "dst_ip"):
            out = out.join(allow.select(F.col("ip").alias(side)), side, "left_anti")
    return out


def block_list(packets: DataFrame, listed: DataFrame) -> DataFrame:
    """BL-IP-SRC and BL-IP-DST."""
    sides = [alerts(packets.join(listed.select(F.col("ip").alias(s)), s, "left_semi"), rule, "HIGH", "Blacklist", ip=F.col(s)) for s, rule in (("src_ip", "BL-IP-SRC"), ("dst_ip", "BL-IP-DST"))]
    return sides[0].unionByName(sides[1])


def bad_port(packets: DataFrame, cfg: c.Config = c.DEFAULT) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in c.BAD_PORT_NAMES.items() for x in kv])
    return alerts(packets.where(F.col("dst_port").isin(*c.BAD_PORTS)), "BAD-PORT", "HIGH", "Suspicious Port", port=F.col("dst_port"), label=F.coalesce(names[F.col("dst_port")], F.lit("Unknown")))


def _scan_rows(packets: DataFrame) -> DataFrame:
    return packets.where(~F.col("src_port").isin(*c.SERVICE_PORTS) & (F.col("dst_port") > 0))


def port_scan(packets: DataFrame, cfg: c.Config = c.DEFAULT, over=windows) -> DataFrame:
    """The ports and targets themselves are added to the alerts that are let through, by `explained`."""
    rows = over.busy(_scan_rows(packets), ["src_ip"], cfg.scan_ms, cfg.scan_ports, "dst_port")
    rows = over.distinct_in_window(rows, ["src_ip"], "dst_port", cfg.scan_ms, _n=F.lit(True), _low=F.col("dst_port") < 1024)
    return alerts(rows.where((F.col("_n") >= cfg.scan_ports) & (F.col("_low") > 0)), "PORT-SCAN", "HIGH", "Reconnaissance", n_ports=F.col("_n"))


def _counted(rows, keys, width, least, threshold, over):
    """Rows whose window's count passes the threshold, which none under `least` does."""
    return over.count_in_window(over.busy(rows, keys, width, least), keys, width, "_n").where(threshold(F.col("_n")))


def brute_force(packets: DataFrame, cfg: c.Config = c.DEFAULT, over=windows) -> DataFrame:
    rows = _counted(packets.where(F.col("flags").contains("R")), ["src_ip", "dst_ip", "dst_port"], cfg.failure_ms, cfg.failures, lambda n: n >= cfg.failures, over)
    names = F.create_map(*[F.lit(x) for kv in c.SERVICE_NAMES.items() for x in kv])
    return alerts(rows, "BRUTE-FORCE", "HIGH", "Brute Force", attempts=F.col("_n"), service=F.coalesce(names[F.col("dst_port")], F.concat(F.lit("port "), F.col("dst_port"))))


def syn_flood(packets: DataFrame, cfg: c.Config = c.DEFAULT, over=windows) -> DataFrame:
    rows = packets.where((F.col("protocol") == "TCP") & net.syn_only(F.col("flags")) & ~F.col("dst_ip").isin(*(cfg.gateways or ("",))))
    most = F.when(net.is_lan_text(F.col("src_ip")) & F.col("dst_port").isin(*c.OUTBOUND_PORTS), cfg.syn_flood_local).otherwise(cfg.syn_flood)
    return alerts(_counted(rows, ["src_ip", "dst_ip"], cfg.flood_ms, min(cfg.syn_flood, cfg.syn_flood_local) + 1, lambda n: n > most, over), "SYN-FLOOD", "CRITICAL", "DoS", syn_count=F.col("_n"))


def icmp_flood(packets: DataFrame, cfg: c.Config = c.DEFAULT, over=windows) -> DataFrame:
    return alerts(_counted(packets.where("protocol = 'ICMP'"), ["src_ip"], cfg.flood_ms, cfg.icmp_flood + 1, lambda n: n > cfg.icmp_flood, over), "ICMP-FLOOD", "HIGH", "DoS", icmp_count=F.col("_n"))


def dns_tunnel(packets: DataFrame, cfg: c.Config = c.DEFAULT) -> DataFrame:
    q = F.col("dns_query")
    rows = packets.where((F.length(q) > cfg.tunnel_length) & ~net.in_suffixes(q, cfg.cloud_suffixes))
    return alerts(rows, "DNS-TUNNEL", "HIGH", "Data Exfiltration", query=q, length=F.length(q), levels=F.size(F.split(q, r"\.")), label_entropy=F.round(net.entropy(F.substring_index(q, ".", 1)), 2))


def bad_tld(packets: DataFrame, cfg: c.Config = c.DEFAULT, strict_suffix: bool = False) -> DataFrame:
    q = F.col("dns_query")
    ending = F.regexp_extract(q, (r"\." if strict_suffix else "") + "(" + "|".join(c.ABUSE_ENDINGS) + ")$", 1)
    rows = packets.where((q != "") & (ending != "") & ~net.in_suffixes(q, cfg.cloud_suffixes)).withColumn("_end", ending)
    return alerts(rows, "DNS-BAD-TLD", "MEDIUM", "Suspicious DNS", query=q, tld=F.col("_end"))


def dns_flood(packets: DataFrame, cfg: c.Config = c.DEFAULT, over=windows) -> DataFrame:
    rows = _counted(packets.where("dns_query <> ''"), ["src_ip"], cfg.flood_ms, cfg.dns_flood + 1, lambda n: F.lit(True), over)
    rows = over.distinct_in_window(rows, ["src_ip"], "dns_query", cfg.flood_ms, _names=F.lit(True)).where(F.col("_n") > cfg.dns_flood)
    return alerts(rows, "DNS-FLOOD", "MEDIUM", "Suspicious DNS", queries=F.col("_n"), distinct_domains=F.col("_names"))


def explained(found: DataFrame, packets: DataFrame, cfg: c.Config = c.DEFAULT) -> DataFrame:
    """Alerts with the lists that belong to their evidence: ports and targets of a scan, sample names of a flood.

    Meant for alerts that passed the cooldown: each asks only for its source's packets of its own window.
    """
    look = candidates(packets, cfg)
    parts = (
        ("PORT-SCAN", cfg.scan_ms, _scan_rows(look), {"ports": ("dst_port", 50), "targets": ("dst_ip", 10)}),
        ("DNS-FLOOD", cfg.flood_ms, look.where("dns_query <> ''"), {"sample": ("dns_query", 20)}),
    )
    keys = ["rule_id", "src_ip", "ts_ms", "pkt_id"]
    out = found
    for rule, width, rows, lists in parts:
        block = F.floor(F.col("ts_ms") / width)
        asks = found.where(F.col("rule_id") == rule).select(*keys, F.explode(F.array(block, block - 1)).alias("_block"))
        seen = rows.select(F.col("src_ip").alias("_src"), block.alias("_b"), F.col("ts_ms").alias("_t"), *{x for x, _ in lists.values()})
        met = asks.join(seen, (F.col("src_ip") == F.col("_src")) & (F.col("_block") == F.col("_b")) & F.col("_t").between(F.col("ts_ms") - (width - 1), F.col("ts_ms")))
        said = met.groupBy(*keys).agg(*[F.array_join(F.slice(F.array_sort(F.collect_set(x)), 1, n), ",").alias(name) for name, (x, n) in lists.items()])
        more = F.map_from_arrays(F.array(*map(F.lit, lists)), F.array(*lists))
        out = out.join(said.select(*keys, more.alias("_more")), keys, "left").withColumn("evidence", F.map_concat("evidence", F.coalesce("_more", F.create_map().cast("map<string,string>")))).drop("_more")
    return out.select(*found.columns)


def arp_spoof(packets: DataFrame, cfg: c.Config = c.DEFAULT, over=windows) -> DataFrame:
    rows = over.previous(packets.where("protocol = 'ARP' and src_mac <> ''"), "src_ip", "src_mac", "_old").where("_old <> src_mac")
    return alerts(rows, "ARP-SPOOF", "CRITICAL", "Network Attack", old_mac=F.col("_old"), new_mac=F.col("src_mac"))


def exfiltration(packets: DataFrame, cfg: c.Config = c.DEFAULT, learned_ips: DataFrame | None = None, over=windows, learned_since: DataFrame | None = None) -> DataFrame:
    """A destination's running upload passes upload_mb, then twice that, and so on. Crossings come from the running total's level.

    MEDIUM for learned destinations, else HIGH: those of `learned_ips` (ip), or those that `learned_since` (of
    `intel.learned_since`) has as learned before the packet.
    """
    level = lambda mb: F.when(mb > cfg.upload_mb, F.ceil(F.round(F.log2(mb / cfg.upload_mb), 12))).otherwise(0)
    crossed = lambda before, behind: level(behind / 1048576.0) > level(before / 1048576.0)
    rows = over.running_total(packets.where("payload_size > 0"), "dst_ip", "payload_size", "_total", changes=crossed).withColumn("_mb", F.col("_total") / 1048576.0)
    rows = rows.withColumn("_level", level(F.col("_mb"))).withColumn("_before", level(F.col("_mb") - F.col("payload_size") / 1048576.0)).where("_level > _before")
    severity = F.lit("HIGH")
    if learned_since is not None:
        from packetlake.operators import intel

        rows = intel.as_of(rows, learned_since, {"ip": F.col("dst_ip")})
        severity = F.when(F.col("known"), "MEDIUM").otherwise("HIGH")
    elif learned_ips is not None:
        rows = rows.join(learned_ips.select(F.col("ip").alias("dst_ip"), F.lit(True).alias("_known")), "dst_ip", "left")
        severity = F.when(F.col("_known"), "MEDIUM").otherwise("HIGH")
    return alerts(rows, "DATA-EXFIL", severity, "Exfiltration", total_mb=F.round("_mb", 2), threshold_mb=cfg.upload_mb * F.pow(F.lit(2.0), F.col("_level") - 1))


def odd_hours(packets: DataFrame, cfg: c.Config = c.DEFAULT) -> DataFrame:
    hour = F.floor(F.col("ts_ms") / 3_600_000) % 24
    rows = packets.where((F.col("payload_size") > cfg.odd_hour_bytes) & hour.between(*cfg.odd_hours)).withColumn("_slot", F.floor(F.col("ts_ms") / 3_600_000))
    first = rows.groupBy("src_ip", "_slot").agg(F.min_by(F.struct("ts_ms", "pkt_id", "dst_ip", "dst_port", "payload_size"), F.struct("ts_ms", "pkt_id")).alias("x"))
    return alerts(first.select("src_ip", "_slot", "x.*"), "ODD-HOURS", "LOW", "Anomaly", hour=F.col("_slot") % 24, payload=F.col("payload_size"))


def cooldown(found: DataFrame, ms: int = c.DEFAULT.cooldown_ms) -> DataFrame:
    """Greedy de-duplication by (rule, source, destination): an alert within `ms` of the last one let through is dropped.

    Which alert passes depends on the one before, so each key is walked in order, from one passing alert to the next by
    binary search; only the last passed time is held.
    """
    keys = ["rule_id", "src_ip", "dst_ip"]

    def walk(batches):
        at, last = None, 0
        for b in batches:
            if not len(b):
                continue
            cols, t = [pc.fill_null(b.column(k), "") for k in keys], b.column("ts_ms").to_numpy()
            new = np.zeros(len(b), bool)
            for x in cols:
                new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
            new[0] = at != tuple(x[0].as_py() for x in cols)
            first = np.flatnonzero(new)
            keep = np.zeros(len(b), bool)
            for s, e in zip([0, *first[first > 0]], [*first[first > 0], len(b)]):
                k = s if new[s] else s + int(np.searchsorted(t[s:e], last + ms))
                while k < e:
                    keep[k], last = True, int(t[k])
                    k += int(np.searchsorted(t[k:e], last + ms))
            at = tuple(x[-1].as_py() for x in cols)
            yield b.filter(pa.array(keep))

    return found.repartition(*keys).sortWithinPartitions(*keys, "ts_ms", "pkt_id").mapInArrow(walk, found.schema)


RULES = (bad_port, port_scan, brute_force, syn_flood, icmp_flood, dns_tunnel, bad_tld, dns_flood, arp_spoof, exfiltration, odd_hours)


NEEDED = ("pkt_id", "ts_ms", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flags", "dns_query", "payload_size", "src_mac")


def run_rules(packets: DataFrame, cfg: c.Config = c.DEFAULT, extra: tuple = (), rules=RULES) -> DataFrame:
    """Union of all rules before the cooldown. A custom rule is any function from packets to alerts.

    What the rules look at is read once and stored without the columns that none of them needs; each rule then reads its
    own columns and rows of that table.
    """
    look = stored(candidates(packets, cfg).select(*NEEDED))
    found = [r(look, cfg) for r in rules] + [r(packets) for r in extra]
    return functools.reduce(DataFrame.unionByName, found)


def with_id(found: DataFrame) -> DataFrame:
    """A deterministic alert id."""
    return found.withColumn("alert_id", F.xxhash64("rule_id", "src_ip", "dst_ip", "ts_ms", "pkt_id"))
