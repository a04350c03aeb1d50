"""Registered queries of devices, endpoints, look-ups and reports, each with the same question in SQL."""

from pyspark.sql import functions as F

from packetlake.operators import correlate, devices, payload, report
from packetlake.operators.flows import insecure_services
from packetlake.plans import q_payload, q_traffic
from packetlake.plans.packets import ORACLE, messages, packets
from packetlake.plans.q_detect import all_alerts

QUERIES, SQL = {}, {}


def add(name, run, sql):
    QUERIES[name], SQL[name] = run, f"with recursive {ORACLE}" + ("" if sql.lstrip().startswith("select") else ",") + f" {sql}"


NOW = 1704072600000 + 3_600_000 + 200_000
_CLASSES = q_payload.SQL["e1_device_classes"]
_CLASSES = _CLASSES[_CLASSES.index(q_payload._PROFILE) :]
_CLASSES = f"{q_payload._PROFILE}, cls as ({_CLASSES[len(q_payload._PROFILE) :]})"
_SEEN = "seen as (select ip, max(ts_ms) as last_ms from (select src_ip as ip, ts_ms from packets union all select dst_ip, ts_ms from packets) group by ip)"
_classes = lambda s, d: devices.classify(devices.profiles(packets(s, d))).select("ip", "device_type", "confidence")
add("a14_device_types", lambda s, d: report.device_types(_classes(s, d), report.last_seen(packets(s, d)), NOW), f"{_CLASSES}, {_SEEN} select device_type, count(*) as devices, count(*) filter (last_ms > {NOW - 3_600_000}) as active from cls join seen using (ip) group by 1")
add("a14_newest_devices", lambda s, d: report.newest_devices(_classes(s, d), report.last_seen(packets(s, d))), f"{_CLASSES}, {_SEEN} select ip, device_type, confidence, last_ms from cls join seen using (ip) order by last_ms desc, ip limit 100")
add("a15_expected_ports", lambda s, d: report.expected_ports(packets(s, d), devices.profiles(packets(s, d))).withColumn("ports", F.array_join("ports", "|")),
    f"{q_payload._PROFILE}, u as (select src_ip as ip, dst_port, count(*) as n from packets where dst_port > 0 group by 1, 2), r as (select *, row_number() over (partition by ip order by n desc, dst_port) as r from u), k as (select ip, list(dst_port) as used from r where r <= 30 and n >= 3 group by ip) select ip, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(used, []), served))), '|'), '') as ports from prof left join k using (ip)")
NAMES = (("router", "192.168.1.1", None), ("camera", None, "02:00:00:00:00:12"), ("desk", "192.168.1.12", "02:00:00:00:00:13"))
_DEV = "dv(name, ip, mac) as (values " + ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in r) + ")" for r in NAMES) + ")"
add("p18_device_names", lambda s, d: report.named_devices(packets(s, d).select("pkt_id", F.col("src_ip").alias("ip"), F.upper("src_mac").alias("mac")), s.createDataFrame(list(NAMES), "name string, ip string, mac string")).where("device is not null").select("pkt_id", "device"),
    f"{_DEV} select pkt_id, coalesce(a.name, b.name) as device from packets left join dv a on a.ip = src_ip left join dv b on b.mac = src_mac where coalesce(a.name, b.name) is not null")
_lease = lambda s, d: packets(s, d).where("h % 9 = 0").select("ts_ms", F.col("src_mac").alias("mac"), F.when(F.col("h") % 2 == 0, F.col("src_ip")).otherwise("").alias("ip"), F.when(F.col("h") % 4 == 1, F.concat(F.lit("host"), F.col("h") % 3)).otherwise("").alias("hostname"), F.when(F.col("h") % 5 == 2, "vendor").otherwise("").alias("vendor"))
_LEASE = "ls as (select ts_ms, src_mac as mac, case when h % 2 = 0 then src_ip else '' end as ip, case when h % 4 = 1 then concat('host', h % 3) else '' end as hostname, case when h % 5 = 2 then 'vendor' else '' end as vendor from packets where h % 9 = 0), inv as (select mac, arg_max(ip, ts_ms) filter (ip <> '') as ip, arg_max(hostname, ts_ms) filter (hostname <> '') as hostname, arg_max(vendor, ts_ms) filter (vendor <> '') as vendor, min(ts_ms) as first_ms, max(ts_ms) as last_ms, count(*) as n from ls group by mac)"
add("a25_dhcp_inventory", lambda s, d: report.dhcp_inventory(_lease(s, d)), f"{_LEASE} select * from inv")
add("e2_dhcp_devices", lambda s, d: report.with_dhcp(_classes(s, d), report.dhcp_inventory(_lease(s, d))).select("ip", "device_type", "mac", "hostname"), f"{_CLASSES}, {_LEASE} select cls.ip, device_type, mac, hostname from cls left join inv using (ip)")
_TOTAL = "k as (select *, least(src_ip, dst_ip) as ip_a, greatest(src_ip, dst_ip) as ip_b, least(src_port, dst_port) as port_a, greatest(src_port, dst_port) as port_b from packets)"
add("a11_flow_totals", lambda s, d: report.flow_totals(packets(s, d)).withColumnRenamed("proto", "protocol"), f"{_TOTAL} select ip_a, ip_b, port_a, port_b, protocol, count(*) as packets, sum(length)::bigint as bytes, sum(payload_size)::bigint as payload_bytes, min(ts_ms) as first_ms, max(ts_ms) as last_ms from k group by ip_a, ip_b, port_a, port_b, protocol")
_F1 = q_traffic.SQL["f1_flow_class"]
_F1 = _F1[_F1.index("b as (select dst_port, protocol") :].replace("select dst_port, protocol, case when m = 0", "select dst_port, protocol, bytes, case when m = 0")
add("a26_breakdown", lambda s, d: report.breakdown(q_traffic._pair(packets(s, d))), f"{_F1[: _F1.rindex('select dst_port')]}, w as ({_F1[_F1.rindex('select dst_port') :]}) select flow_class, count(*) as flows, sum(bytes)::bigint as bytes from w group by 1")


def _totals(s, d):
    m = messages(s, d)
    return report.totals(packets(s, d), payload.secrets(m), payload.exposures(m), insecure_services(packets(s, d)))


_A10 = q_traffic.SQL["a10_insecure_services"]
_A10 = _A10[_A10.index("t as (select distinct dst_ip") :]
add("a27_report_totals", _totals,
    f"{q_payload._FOUND}, o as ({q_payload._OPEN}), ins as (with {_A10}) select 'packets' as section, 'all' as item, count(*)::bigint as n from packets union all select 'bytes', 'all', sum(length)::bigint from packets union all select 'secrets', protocol, count(*) from f group by 2 union all select 'exposures', type, count(*) from o group by 2 union all select 'insecure', dst_port::varchar, count(*) from ins group by 2")
_RDNS = (("104.16.3.4", "a.cdn.example"), ("93.184.216.34", "big.example"))
add("j13_reverse_names", lambda s, d: report.reverse_names(packets(s, d).select("pkt_id", F.col("dst_ip").alias("ip")), s.createDataFrame(list(_RDNS), "ip string, name string")).where("pkt_id % 3 = 0"), f"nm(ip, name) as (values {', '.join(map(str, _RDNS))}) select pkt_id, dst_ip as ip, name as reverse_name from packets left join nm on ip = dst_ip where pkt_id % 3 = 0")
add("j5_listed_urls", lambda s, d: (lambda p: report.listed_urls(p, p.where("page_id % 5 = 0 or url like '%utm%'").select("url")))(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url")), "select page_id, url from pages where url in (select url from pages where page_id % 5 = 0 or url like '%utm%')")
_ends = lambda s, d: packets(s, d).select("pkt_id", F.col("process_name").alias("process"), F.when(F.col("h") % 3 == 0, "LISTEN").otherwise("ESTABLISHED").alias("state"), (F.col("h") % 7000).cast("int").alias("port"), F.col("dst_ip").alias("remote_ip"))
add("i7_tool_processes", lambda s, d: report.tool_processes(_ends(s, d), s.createDataFrame([("Mimikatz.exe",), ("svchost.exe",)], "name string"), ("svchost.exe",)).select("pkt_id", "rule_id", "severity"), "select pkt_id, 'IOC-PROC-NAME' as rule_id, 'CRITICAL' as severity from packets where process_name = 'mimikatz.exe'")


def _listening(s, d):
    from packetlake.operators import ioc

    return ioc.listening(_ends(s, d)).select("pkt_id", "port")


def _active(s, d):
    from packetlake.operators import ioc

    return ioc.active_threats(_ends(s, d), s.createDataFrame([("104.16.3.4", "Scanner"), ("10.0.0.22", "Private")], "ip string, category string")).select("pkt_id", "category")


from packetlake.config import LISTEN_PORTS  # noqa: E402

add("i5_listening", _listening, f"select pkt_id, (h % 7000)::int as port from packets where h % 3 = 0 and h % 7000 in ({', '.join(map(str, LISTEN_PORTS))})")
add("j14_active_threats", _active, "select pkt_id, 'Scanner' as category from packets where h % 3 <> 0 and dst_ip = '104.16.3.4'")
_C1 = q_traffic.SQL["c1_incidents"]
_C1 = _C1[_C1.index("look as (") :]
add("c4_incidents", lambda s, d: report.incidents_of(correlate.incidents(all_alerts(s, d)), "HIGH", 1704072600000 + 100_000, 20).select("key", "start_ms", "severity"), f"ic as (with recursive {_C1}) select key, start_ms, severity from ic where severity in ('HIGH', 'CRITICAL') and end_ms >= {1704072600000 + 100_000} order by end_ms desc, key, start_ms limit 20")
add("c4_incident_counts", lambda s, d: report.incident_counts(correlate.incidents(all_alerts(s, d))), f"ic as (with recursive {_C1}) select severity, count(*) as incidents, sum(n_alerts)::bigint as alerts, count(*) filter (escalated) as escalated from ic group by 1")
add("s14_search", lambda s, d: report.search(payload.secrets(messages(s, d)), "ANNA", "FTP", most=50).select("pkt_id", "kind", "masked"), f"{q_payload._FOUND} select pkt_id, kind, masked from f where protocol = 'FTP' and contains(lower(concat_ws(' ', protocol, masked, src_ip, dst_ip, dst_port, note)), 'anna') order by ts_ms desc, pkt_id desc, kind limit 50")
