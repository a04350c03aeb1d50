"""Registered queries of the detection rules, each with the same question in SQL."""

from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.operators import detect
from packetlake.plans.packets import ORACLE, packets

QUERIES, SQL = {}, {}


def add(name, run, sql):
    QUERIES[name], SQL[name] = run, f"with recursive {ORACLE}, {sql}" if sql.lstrip()[:6] != "select" else f"with recursive {ORACLE} {sql}"


def _ev(name, kind="long"):
    return F.col("evidence")[name].cast(kind).alias(name)


def _rule(rule, *cols):
    return lambda s, d: rule(detect.candidates(packets(s, d))).select("pkt_id", "ts_ms", "rule_id", "severity", "src_ip", "dst_ip", *[_ev(*x) if isinstance(x, tuple) else _ev(x) for x in cols])


NOISY = ", ".join(map(str, c.NOISY_PORTS))
LOOK = f"look as (select * from packets where dst_port not in ({NOISY}))"
HEAD = "pkt_id, ts_ms, '{}' as rule_id, '{}' as severity, src_ip, dst_ip"


def _sliding(keys, ms, agg="count(*)"):
    return f"{agg} over (partition by {keys} order by ts_ms range between {ms - 1} preceding and current row)"


add("d3_block_list", lambda s, d: detect.block_list(packets(s, d), s.createDataFrame([("185.220.101.5",), ("203.0.113.7",)], "ip string")).select("pkt_id", "ts_ms", "rule_id", "severity", "src_ip", "dst_ip"),
    f"select {HEAD.format('BL-IP-SRC', 'HIGH')} from packets where src_ip in ('185.220.101.5', '203.0.113.7') union all select {HEAD.format('BL-IP-DST', 'HIGH')} from packets where dst_ip in ('185.220.101.5', '203.0.113.7')")
add("d4_bad_port", _rule(detect.bad_port, ("port", "int"), ("label", "string")), f"{LOOK} select {HEAD.format('BAD-PORT', 'HIGH')}, dst_port as port, 'Metasploit/Meterpreter' as label from look where dst_port in ({', '.join(map(str, c.BAD_PORTS))})")
_SERVICE = ", ".join(map(str, c.SERVICE_PORTS))
SCAN = f"scan as (select *, {_sliding('src_ip', 60000, 'count(distinct dst_port)')} as n, {_sliding('src_ip', 60000, 'min(dst_port)')} as low from look where src_port not in ({_SERVICE}) and dst_port > 0)"
add("d5_port_scan", _rule(detect.port_scan, ("n_ports", "long")), f"{LOOK}, {SCAN} select {HEAD.format('PORT-SCAN', 'HIGH')}, n as n_ports from scan where n >= 15 and low < 1024")
BRUTE = f"brute as (select *, {_sliding('src_ip, dst_ip, dst_port', 30000)} as n from look where contains(flags, 'R'))"
add("d6_brute_force", _rule(detect.brute_force, "attempts"), f"{LOOK}, {BRUTE} select {HEAD.format('BRUTE-FORCE', 'HIGH')}, n as attempts from brute where n >= 10")
SYN = f"syn as (select *, {_sliding('src_ip, dst_ip', 10000)} as n from look where protocol = 'TCP' and contains(flags, 'S') and not contains(flags, 'A'))"
SYN_OVER = f"n > case when (src_ip like '192.168.%' or src_ip like '10.%' or src_ip like '172.%') and dst_port in ({', '.join(map(str, c.OUTBOUND_PORTS))}) then 200 else 50 end"
add("d7_syn_flood", _rule(detect.syn_flood, "syn_count"), f"{LOOK}, {SYN} select {HEAD.format('SYN-FLOOD', 'CRITICAL')}, n as syn_count from syn where {SYN_OVER}")
ICMP = f"icmp as (select *, {_sliding('src_ip', 10000)} as n from look where protocol = 'ICMP')"
add("d8_icmp_flood", _rule(detect.icmp_flood, "icmp_count"), f"{LOOK}, {ICMP} select {HEAD.format('ICMP-FLOOD', 'HIGH')}, n as icmp_count from icmp where n > 30")
add("d9_dns_tunnel", _rule(detect.dns_tunnel, "length", "levels", ("label_entropy", "double")), f"""{LOOK}, hit as (select * from look where length(dns_query) > 60),
  ent as (select pkt_id, round(sum(-p * log2(p)), 2) + 0.0 as label_entropy from (select pkt_id, count(*) / sum(count(*)) over (partition by pkt_id) as p from (select pkt_id, unnest(string_split(split_part(dns_query, '.', 1), '')) as ch from hit) group by pkt_id, ch) group by pkt_id)
  select {HEAD.format('DNS-TUNNEL', 'HIGH')}, length(dns_query) as length, cast(len(string_split(dns_query, '.')) as bigint) as levels, label_entropy from hit join ent using (pkt_id)""")
TLD = "|".join(c.ABUSE_ENDINGS)
add("d10_dns_bad_tld", _rule(detect.bad_tld, ("tld", "string")), f"{LOOK} select {HEAD.format('DNS-BAD-TLD', 'MEDIUM')}, regexp_extract(dns_query, '({TLD})$', 1) as tld from look where regexp_matches(dns_query, '({TLD})$')")
FLOOD = f"flood as (select *, {_sliding('src_ip', 10000)} as n, {_sliding('src_ip', 10000, 'count(distinct dns_query)')} as nd from look where dns_query <> '')"
add("d11_dns_flood", _rule(detect.dns_flood, "queries", "distinct_domains"), f"{LOOK}, {FLOOD} select {HEAD.format('DNS-FLOOD', 'MEDIUM')}, n as queries, nd as distinct_domains from flood where n > 50")
ARP = "arp as (select *, lag(src_mac) over (partition by src_ip order by ts_ms, pkt_id) as old from look where protocol = 'ARP' and src_mac <> '')"
add("d12_arp_spoof", _rule(detect.arp_spoof, ("old_mac", "string"), ("new_mac", "string")), f"{LOOK}, {ARP} select {HEAD.format('ARP-SPOOF', 'CRITICAL')}, old as old_mac, src_mac as new_mac from arp where old <> src_mac")
EXFIL = """total as (select *, sum(payload_size) over (partition by dst_ip order by ts_ms, pkt_id rows unbounded preceding) as t from look where payload_size > 0),
  crossing as (select *, (select count(*) from (select unnest(range(30)) as q) where t > 104857600 * (1::bigint << q)) as level, (select count(*) from (select unnest(range(30)) as q) where t - payload_size > 104857600 * (1::bigint << q)) as prior from total)"""
add("d13_data_exfil", _rule(detect.exfiltration, ("threshold_mb", "double")), f"{LOOK}, {EXFIL} select {HEAD.format('DATA-EXFIL', 'HIGH')}, 100.0::double * (1::bigint << (level - 1)) as threshold_mb from crossing where level > prior")
ODD = "odd as (select *, row_number() over (partition by src_ip, ts_ms // 3600000 order by ts_ms, pkt_id) as r from look where payload_size > 50000 and (ts_ms // 3600000) % 24 between 2 and 5)"
add("d14_odd_hours", _rule(detect.odd_hours, "hour", "payload"), f"{LOOK}, {ODD} select {HEAD.format('ODD-HOURS', 'LOW')}, (ts_ms // 3600000) % 24 as hour, payload_size as payload from odd where r = 1")

_ALL = [("BAD-PORT", "HIGH", "Suspicious Port", f"look where dst_port in ({', '.join(map(str, c.BAD_PORTS))})"), ("PORT-SCAN", "HIGH", "Reconnaissance", "scan where n >= 15 and low < 1024"), ("BRUTE-FORCE", "HIGH", "Brute Force", "brute where n >= 10"), ("SYN-FLOOD", "CRITICAL", "DoS", f"syn where {SYN_OVER}"), ("ICMP-FLOOD", "HIGH", "DoS", "icmp where n > 30"),
        ("DNS-TUNNEL", "HIGH", "Data Exfiltration", "look where length(dns_query) > 60"), ("DNS-BAD-TLD", "MEDIUM", "Suspicious DNS", f"look where regexp_matches(dns_query, '({TLD})$')"), ("DNS-FLOOD", "MEDIUM", "Suspicious DNS", "flood where n > 50"), ("ARP-SPOOF", "CRITICAL", "Network Attack", "arp where old <> src_mac"), ("DATA-EXFIL", "HIGH", "Exfiltration", "crossing where level > prior"), ("ODD-HOURS", "LOW", "Anomaly", "odd where r = 1")]
FOUND = f"{LOOK}, {SCAN}, {BRUTE}, {SYN}, {ICMP}, {FLOOD}, {ARP}, {EXFIL}, {ODD}, found as (" + " union all ".join(f"select {HEAD.format(r, s)}, '{k}' as category, dst_port from {q}" for r, s, k, q in _ALL) + ")"
COOLED = """passed as (
    select rule_id, src_ip, dst_ip, min(ts_ms) as ts_ms from found group by rule_id, src_ip, dst_ip
    union all
    select f.rule_id, f.src_ip, f.dst_ip, min(f.ts_ms) from passed p join found f on f.rule_id = p.rule_id and f.src_ip = p.src_ip and f.dst_ip = p.dst_ip and f.ts_ms >= p.ts_ms + 30000 group by f.rule_id, f.src_ip, f.dst_ip),
  cooled as (select f.* from passed p join (select *, row_number() over (partition by rule_id, src_ip, dst_ip, ts_ms order by pkt_id) as first from found) f using (rule_id, src_ip, dst_ip, ts_ms) where f.first = 1)"""


def all_alerts(s, d):
    return detect.cooldown(detect.run_rules(packets(s, d)))


add("d15_cooldown", lambda s, d: detect.cooldown(packets(s, d).where("flags = 'R'").select(F.lit("RST").alias("rule_id"), F.lit("LOW").alias("severity"), F.lit("x").alias("category"), "ts_ms", "pkt_id", "src_ip", "dst_ip", "dst_port", F.create_map(F.lit("a"), F.lit("b")).alias("evidence"))).select("pkt_id", "ts_ms", "src_ip", "dst_ip"),
    f"found as (select 'RST' as rule_id, pkt_id, ts_ms, src_ip, dst_ip from packets where flags = 'R'), {COOLED} select pkt_id, ts_ms, src_ip, dst_ip from cooled")
add("d16_alerts", lambda s, d: all_alerts(s, d).select("pkt_id", "ts_ms", "rule_id", "severity", "src_ip", "dst_ip", "category", "dst_port"), f"{FOUND}, {COOLED} select pkt_id, ts_ms, rule_id, severity, src_ip, dst_ip, category, dst_port from cooled")
add("d16_alerts_by_rule", lambda s, d: all_alerts(s, d).groupBy("rule_id", "severity").agg(F.count("*").alias("n_alerts"), F.countDistinct("src_ip").alias("n_sources")), f"{FOUND}, {COOLED} select rule_id, severity, count(*) as n_alerts, count(distinct src_ip) as n_sources from cooled group by rule_id, severity")
