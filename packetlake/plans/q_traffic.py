"""Registered queries of flows, summaries, joins and look-ups, features and indicators, each with the same question in SQL."""

from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.functions import net
from packetlake.operators import correlate, enrich, features, flows, ioc
from packetlake.plans.packets import ORACLE, packets
from packetlake.plans.q_detect import COOLED, FOUND, all_alerts

QUERIES, SQL = {}, {}


def add(name, run, sql):
    QUERIES[name], SQL[name] = run, f"with recursive {ORACLE}" + ("" if sql.lstrip().startswith("select") else ",") + f" {sql}"


PRIVATE_SQL = " or ".join(f"(v >= {net._value(b)} and v <= {net._value(b) + (1 << (32 - n)) - 1})" for b, n in net.PRIVATE)
VALUE = "(split_part(ip, '.', 1)::bigint << 24) + (split_part(ip, '.', 2)::bigint << 16) + (split_part(ip, '.', 3)::bigint << 8) + split_part(ip, '.', 4)::bigint"

# addresses, names and scalar expressions
add("p6_ip_class", lambda s, d: packets(s, d).select(F.col("dst_ip").alias("ip")).distinct().select("ip", net.ip_class(F.col("ip")).alias("kind")),
    f"a as (select distinct dst_ip as ip, {VALUE.replace('ip,', 'dst_ip,')} as v from packets) select ip, case when ip like '127.%' then 'loopback' when ip like '169.254.%' then 'link_local' when v between 3758096384 and 4026531839 then 'multicast' when {PRIVATE_SQL} then 'private' else 'global' end as kind from a")
add("p8_base_domain", lambda s, d: packets(s, d).where("dns_query <> ''").groupBy(net.base_domain(F.col("dns_query")).alias("domain")).agg(F.count("*").alias("n")),
    "select array_to_string(string_split(dns_query, '.')[-2:], '.') as domain, count(*) as n from packets where dns_query <> '' group by 1")
add("p8_page_hosts", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", net.base_domain(F.parse_url("url", F.lit("HOST"))).alias("domain")),
    "select page_id, array_to_string(string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.')[-2:], '.') as domain from pages")
add("p11_label_entropy", lambda s, d: packets(s, d).where("dns_query <> ''").select("dns_query").distinct().select("dns_query", F.round(net.entropy(F.substring_index("dns_query", ".", 1)), 6).alias("bits")),
    "q as (select distinct dns_query from packets where dns_query <> ''), ch as (select dns_query, unnest(string_split(split_part(dns_query, '.', 1), '')) as ch from q) select dns_query, round(sum(-p * log2(p)) + 0.0, 6) as bits from (select dns_query, count(*) / sum(count(*)) over (partition by dns_query) as p from ch group by dns_query, ch) group by dns_query")
add("p12_card_numbers", lambda s, d: packets(s, d).select("pkt_id", F.regexp_extract("payload", r"card=(\d{16})", 1).alias("card")).where("card <> ''").select("pkt_id", net.mask(F.col("card"), 4).alias("masked"), net.luhn(F.col("card")).alias("valid")),
    """k as (select pkt_id, regexp_extract(payload, 'card=([0-9]{16})', 1) as card from packets where payload like '%card=%'),
    dg as (select pkt_id, card, i, substr(card, i, 1)::int as g from k cross join (select unnest(range(1, 17))::int as i))
    select pkt_id, concat(substr(card, 1, 4), repeat('*', 12)) as masked, sum(case when i % 2 = 1 then case when g * 2 > 9 then g * 2 - 9 else g * 2 end else g end) % 10 = 0 as valid from dg group by pkt_id, card""")
add("p17_connection_text", lambda s, d: packets(s, d).where("scn = 'badport'").select("pkt_id", F.format_string("%s:%d -> %s:%d (%s)", "src_ip", "src_port", "dst_ip", "dst_port", "protocol").alias("connection")),
    "select pkt_id, concat(src_ip, ':', src_port, ' -> ', dst_ip, ':', dst_port, ' (', protocol, ')') as connection from packets where scn = 'badport'")

# joins
TI = [("185.220.101.5", "Botnet C2"), ("104.16.3.4", "Scanner"), ("10.0.0.22", "Private")]
TI_SQL = "ti(ip, category) as (values " + ", ".join(map(str, TI)) + ")"
SIDES = "sides as (select pkt_id, src_ip as ip, 'src' as direction from packets union all select pkt_id, dst_ip, 'dst' from packets)"
add("j1_indicator_ips", lambda s, d: enrich.indicator_hits(packets(s, d), F.broadcast(s.createDataFrame(TI, "ip string, category string"))).select("pkt_id", "ip", "direction", "category"),
    f"{TI_SQL}, {SIDES} select pkt_id, ip, direction, category from sides join ti using (ip) where ip not like '10.%'")
NETS = [(net._value("203.0.113.0"), net._value("203.0.113.255"), "net-a"), (net._value("9.0.0.0"), net._value("10.1.255.255"), "net-b")]
add("j2_indicator_networks", lambda s, d: enrich.network_hits(packets(s, d), F.broadcast(s.createDataFrame(NETS, "lo long, hi long, name string"))),
    f"nets(lo, hi, name) as (values {', '.join(map(str, NETS))}), {SIDES}, v as (select *, {VALUE} as v from sides) select pkt_id, ip, direction, name from v join nets on v between lo and hi")
NAMES = [("www.site7.com", "Malware"), ("site9.com", "Phishing"), ("example.org", "C2"), ("t.example.org", "Tunnel"), ("com", "Never")]
add("j3_indicator_domains", lambda s, d: enrich.domain_hits(packets(s, d).where("dns_query <> ''").select(F.col("dns_query").alias("domain")), F.broadcast(s.createDataFrame(NAMES, "name string, category string"))),
    f"listed(name, category) as (values {', '.join(map(str, NAMES))}), q as (select distinct dns_query as domain from packets where dns_query <> ''), l as (select domain, name, category, row_number() over (partition by domain order by length(name) desc) as r, domain = name as same from q join listed on (domain = name or ends_with(domain, '.' || name)) where name like '%.%') select domain, name as matched, category, case when same then 'HIGH' else 'MEDIUM' end as confidence from l where r = 1")
add("j4_dynamic_dns", lambda s, d: enrich.dynamic_dns(packets(s, d).where("dns_query <> ''").select(F.concat("dns_query", F.when(F.col("h") % 7 == 0, ".duckdns.org").otherwise("")).alias("domain"))).groupBy("domain").agg(F.count("*").alias("n")),
    "select dns_query || '.duckdns.org' as domain, count(*) as n from packets where dns_query <> '' and h % 7 = 0 group by 1")
add("j6_inferred_domains", lambda s, d: enrich.inferred_domains(packets(s, d)).select("pkt_id", "dst_ip", "domain"),
    "a as (select pkt_id, dst_ip, protocol, dns_query, max(case when dns_query <> '' then row(ts_ms, pkt_id, dns_query) end) over (partition by src_ip order by ts_ms range between 29999 preceding and current row) as m from packets) select pkt_id, dst_ip, struct_extract(m, 3) as domain from a where protocol in ('TCP', 'UDP') and dns_query = '' and m is not null")
add("j7_answered_domains", lambda s, d: enrich.answered_domains(packets(s, d)), "select dns_response as ip, string_agg(distinct dns_query, '|' order by dns_query) as domains from packets where dns_response <> '' and dns_query <> '' group by 1")
add("j8_allow_list", lambda s, d: __import__("packetlake.operators.detect", fromlist=["x"]).candidates(packets(s, d), allow=F.broadcast(s.createDataFrame([("192.168.1.10",), ("9.9.9.10",)], "ip string"))).groupBy("protocol").agg(F.count("*").alias("n")),
    f"select protocol, count(*) as n from packets where src_ip not in ('192.168.1.10', '9.9.9.10') and dst_ip not in ('192.168.1.10', '9.9.9.10') and dst_port not in ({', '.join(map(str, c.NOISY_PORTS))}) group by protocol")
add("j15_process_of_port", lambda s, d: enrich.latest_owner(packets(s, d), packets(s, d).where("process_name <> ''").select(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"), F.col("ts_ms").alias("owner_ms"), F.col("process_name").alias("process"))).where("process is not null").groupBy("process").agg(F.count("*").alias("n")),
    "o as (select src_ip as ip, src_port as port, ts_ms as owner_ms, process_name as process from packets where process_name <> ''), m as (select p.pkt_id, o.process from packets p asof join o on p.src_ip = o.ip and p.src_port = o.port and p.ts_ms >= o.owner_ms) select process, count(*) as n from m group by process")

# aggregations
add("a1_flows", lambda s, d: flows.flows(packets(s, d)).select("ip_a", "ip_b", "port_a", "port_b", F.col("proto").alias("protocol"), "packets", "bytes", "payload_bytes", "packets_ab", "syn", "rst", "fin", "established", "flag_set", "start_ms", "end_ms", "seconds", "bytes_per_sec", "avg_size"),
    """k as (select *, least(src_ip, dst_ip) as ip_a, greatest(src_ip, dst_ip) as ip_b, least(src_port, dst_port) as port_a, greatest(src_port, dst_port) as port_b from packets),
    g as (select *, case when ts_ms - lag(ts_ms) over w <= 120000 then 0 else 1 end as fresh from k window w as (partition by ip_a, ip_b, port_a, port_b, protocol order by ts_ms, pkt_id)),
    n as (select *, sum(fresh) over (partition by ip_a, ip_b, port_a, port_b, protocol order by ts_ms, pkt_id rows unbounded preceding) as s from g)
    select ip_a, ip_b, port_a, port_b, protocol, count(*) as packets, sum(length)::bigint as bytes, sum(payload_size)::bigint as payload_bytes, count(*) filter (src_ip = ip_a) as packets_ab, count(*) filter (contains(flags, 'S') and not contains(flags, 'A')) as syn, count(*) filter (contains(flags, 'R')) as rst, count(*) filter (contains(flags, 'F')) as fin,
      bool_or(contains(flags, 'S') and contains(flags, 'A')) as established, coalesce(string_agg(distinct nullif(flags, ''), '|' order by nullif(flags, '')), '') as flag_set, min(ts_ms) as start_ms, max(ts_ms) as end_ms,
      round(greatest((max(ts_ms) - min(ts_ms)) / 1000.0::double, 0.001::double), 6) as seconds, round(sum(length) / greatest((max(ts_ms) - min(ts_ms)) / 1000.0::double, 0.001::double), 6) as bytes_per_sec, round(sum(length) / count(*)::double, 6) as avg_size from n group by ip_a, ip_b, port_a, port_b, protocol, s""")
add("t1_flow_list", lambda s, d: flows.flow_list(packets(s, d)).select("ip_a", "ip_b", "port_a", "port_b", F.col("proto").alias("protocol"), "start_ms", "packets", "bytes", "state"),
    """k as (select *, least(src_ip, dst_ip) as ip_a, greatest(src_ip, dst_ip) as ip_b, least(src_port, dst_port) as port_a, greatest(src_port, dst_port) as port_b from packets),
    g as (select *, case when ts_ms - lag(ts_ms) over w <= 120000 then 0 else 1 end as fresh from k window w as (partition by ip_a, ip_b, port_a, port_b, protocol order by ts_ms, pkt_id)),
    n as (select *, sum(fresh) over (partition by ip_a, ip_b, port_a, port_b, protocol order by ts_ms, pkt_id rows unbounded preceding) as s from g)
    select ip_a, ip_b, port_a, port_b, protocol, min(ts_ms) as start_ms, count(*) as packets, sum(length)::bigint as bytes,
      case when bool_or(contains(flags, 'R')) then 'RST' when bool_or(contains(flags, 'F')) then 'FIN' when bool_or(contains(flags, 'S') and contains(flags, 'A')) then 'EST' else 'NEW' end as state
    from n group by ip_a, ip_b, port_a, port_b, protocol, s order by bytes desc, ip_a, ip_b, port_a, port_b, protocol, start_ms limit 100""")
add("a4_protocol_mix", lambda s, d: flows.protocol_mix(packets(s, d)), "select protocol, count(*) as n, round(count(*) / (select count(*) from packets)::double, 6) as share from packets group by protocol order by n desc, protocol limit 8")
add("a5_top_talkers", lambda s, d: flows.top_talkers(packets(s, d)), "select src_ip as ip, sum(length)::bigint as bytes, count(*) as packets from packets group by 1 order by bytes desc, ip limit 20")
add("a6_rate", lambda s, d: flows.rate(packets(s, d)), "select ts_ms // 1000 as second, count(*) as packets, sum(length)::bigint as bytes from packets group by 1")
add("a7_summary", lambda s, d: flows.summary(packets(s, d)), "select count(*) as packets, sum(length)::bigint as bytes, min(ts_ms) as first_ms, max(ts_ms) as last_ms, count(distinct src_ip) as src_ips, count(distinct dst_ip) as dst_ips, count(distinct src_port) as src_ports, count(distinct dst_port) as dst_ports, count(distinct nullif(dns_query, '')) as dns_names from packets")
add("a7_top_dns", lambda s, d: packets(s, d).where("dns_query <> ''").groupBy("dns_query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dns_query").limit(20), "select dns_query, count(*) as n from packets where dns_query <> '' group by 1 order by n desc, dns_query limit 20")
add("a10_insecure_services", lambda s, d: flows.insecure_services(packets(s, d)),
    "t as (select distinct dst_ip from packets where dst_port = 443), b as (select dst_ip, dst_port, count(*) as packets, sum(length)::bigint as bytes, count(distinct src_ip) as clients, min(ts_ms) as first_ms from packets where dst_port in (21, 23, 25, 80, 110, 143, 161, 389, 445, 512, 513, 514, 554, 873, 1883, 3306, 5060, 5432, 5900, 6379, 8080, 9200, 11211, 27017) and payload_size > 0 group by 1, 2 having count(*) >= 5) select *, dst_ip in (select dst_ip from t) as has_https, dst_port in (80, 8080) and dst_ip in (select dst_ip from t) and bytes < 5000 and packets < 20 as redirect_only from b")
add("a17_learned_domains", lambda s, d: enrich.learned(packets(s, d))["domains"],
    "b as (select array_to_string(string_split(dns_query, '.')[-2:], '.') as domain, count(*) as n, count(distinct src_ip) as sources, min(ts_ms) as first_ms, max(ts_ms) as last_ms from packets where dns_query <> '' group by 1) select *, round(least(1.0::double, sources / 3.0::double * 0.5 + n / 50.0::double * 0.5), 6) as confidence, n >= 3 as learned from b")
add("a18_learned_ips", lambda s, d: enrich.learned(packets(s, d))["ips"], "select dst_ip as ip, count(*) as n, count(distinct dst_port) as ports, count(*) >= 3 as learned from packets group by 1")
add("a18_learned_ports", lambda s, d: enrich.learned(packets(s, d))["ports"], "select dst_port, count(*) as n, count(*) >= 5 as learned from packets where dst_port > 0 group by 1")
_pair = lambda p: p.groupBy("dst_port", "protocol").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.round(F.sum("length") / F.count("*"), 6).alias("avg_size"), F.lit(1.0).alias("direction_ratio"))
add("f1_flow_class", lambda s, d: flows.classify(_pair(packets(s, d))).select("dst_port", "protocol", "flow_class"),
    """b as (select dst_port, protocol, count(*) as packets, sum(length) as bytes, sum(length) / count(*)::double as a from packets group by 1, 2 having count(*) >= 3),
    s as (select *, case when dst_port in (80, 443, 8080, 8443) then 3 else 0 end + case when a between 200 and 1500 then 2 else 0 end as s1, case when dst_port in (443, 80, 1935, 554) then 3 else 0 end + case when a between 1000 and 1500 then 2 else 0 end + case when bytes >= 1000000 then 1 else 0 end as s2,
      case when dst_port in (20, 21, 22, 990, 443, 80) then 3 else 0 end + case when a between 800 and 1500 then 2 else 0 end + case when bytes >= 100000 then 1 else 0 end as s3, case when dst_port in (3478, 3479, 5060, 5061, 16384, 32767) then 3 else 0 end + case when protocol = 'UDP' then 2 else 0 end + case when a between 100 and 300 then 2 else 0 end as s4,
      case when dst_port in (53, 5353) then 3 else 0 end + case when protocol = 'UDP' then 2 else 0 end + case when a between 40 and 512 then 2 else 0 end as s5, case when dst_port in (25, 110, 143, 465, 587, 993, 995) then 3 else 0 end as s6, case when dst_port = 22 then 3 else 0 end + case when a between 40 and 200 then 2 else 0 end as s7,
      case when dst_port in (1433, 3306, 5432, 6379, 27017, 9200) then 3 else 0 end as s8, case when protocol = 'UDP' then 2 else 0 end + case when a between 40 and 200 then 2 else 0 end as s9 from b), m as (select *, greatest(s1, s2, s3, s4, s5, s6, s7, s8, s9) as m from s)
    select dst_port, protocol, case when m = 0 then 'unknown' when s1 = m then 'web_browsing' when s2 = m then 'video_streaming' when s3 = m then 'file_transfer' when s4 = m then 'voip_video_call' when s5 = m then 'dns_lookup' when s6 = m then 'email' when s7 = m then 'ssh_terminal' when s8 = m then 'database' else 'gaming' end as flow_class from m""")
add("s16_recent", lambda s, d: flows.recent(packets(s, d), 5).groupBy("scn").agg(F.count("*").alias("n")), "select scn, count(*) as n from packets where ts_ms >= (select max(ts_ms) from packets) - 300000 group by 1")
add("t2_first_per_key", lambda s, d: flows.first_per_key(packets(s, d), ["src_ip", "dst_port"], ["ts_ms", "pkt_id"]).select("pkt_id", "src_ip", "dst_port"), "select pkt_id, src_ip, dst_port from (select *, row_number() over (partition by src_ip, dst_port order by ts_ms, pkt_id) as r from packets) where r = 1")

# alerts
ALERTS = f"{FOUND}, {COOLED}"
add("a8_alert_counts", lambda s, d: correlate.alert_counts(all_alerts(s, d)), f"{ALERTS} select severity, category, rule_id, count(*) as n from cooled group by grouping sets ((severity), (category), (rule_id))")
add("a9_alert_rate", lambda s, d: correlate.alert_rate(all_alerts(s, d)), f"{ALERTS} select (ts_ms // 10000) * 10 as second, count(*) as n from cooled group by 1")
add("c1_incidents", lambda s, d: correlate.incidents(all_alerts(s, d)),
    f"""{ALERTS}, r as (select *, case severity when 'LOW' then 0 when 'MEDIUM' then 1 when 'HIGH' then 2 else 3 end as rank, case when ts_ms - lag(ts_ms) over (partition by src_ip order by ts_ms, pkt_id) <= 300000 then 0 else 1 end as fresh from cooled),
    n as (select *, sum(fresh) over (partition by src_ip order by ts_ms, pkt_id rows unbounded preceding) as s from r),
    g as (select src_ip as key, min(ts_ms) as start_ms, max(ts_ms) as end_ms, count(*) as n_alerts, count(distinct dst_ip) as n_targets, string_agg(distinct category, '|' order by category) as categories, string_agg(distinct rule_id, '|' order by rule_id) as rules, max(rank) as rank, list(distinct category) as cs from n group by src_ip, s),
    e as (select *, (list_has_any(cs, ['Reconnaissance', 'Suspicious Port']) and list_has_any(cs, ['Brute Force', 'DoS'])) or (list_has_any(cs, ['Threat Intelligence']) and list_has_any(cs, ['Exfiltration', 'Data Exposure'])) or (list_has_any(cs, ['Credential Exposure']) and list_has_any(cs, ['Brute Force', 'Threat Intelligence'])) as escalated from g)
    select key, start_ms, end_ms, n_alerts, n_targets, categories, rules, escalated, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][(case when escalated then greatest(rank, 2) else rank end + 1)::int] as severity from e""")
add("c5_high_alerts", lambda s, d: correlate.select_alerts(all_alerts(s, d), "HIGH", limit=50).select("pkt_id", "rule_id", "severity"), f"{ALERTS} select pkt_id, rule_id, severity from cooled where severity in ('HIGH', 'CRITICAL') order by ts_ms desc, pkt_id desc, rule_id limit 50")
add("c7_notifications", lambda s, d: correlate.notifications(all_alerts(s, d)), f"{ALERTS} select (ts_ms // 15000) * 15 as second, count(*) as n, count(*) filter (severity = 'CRITICAL') as critical from cooled where severity in ('HIGH', 'CRITICAL') group by 1")

# indicators of compromise
add("i1_tor", lambda s, d: ioc.tor(packets(s, d)).select("pkt_id", "rule_id", "severity"), "select pkt_id, 'IOC-TOR' as rule_id, 'HIGH' as severity from packets where dst_port in (9001, 9030, 9050, 9051, 9150)")
add("i2_random_domains", lambda s, d: ioc.random_domains(packets(s, d)).select("domain", "queries", "first_ms", "first_pkt"),
    "q as (select dns_query as domain, count(*) as queries, min(ts_ms) as first_ms, min(pkt_id) as first_pkt from packets where dns_query <> '' group by 1), l as (select domain, unnest(string_split(domain, '.')[:-2]) as label from q), ch as (select domain, label, unnest(string_split(label, '')) as ch from l where length(label) >= 10), e as (select domain, label, round(sum(-p * log2(p)), 9) as bits from (select domain, label, count(*) / sum(count(*)) over (partition by domain, label) as p from ch group by domain, label, ch) group by domain, label) select * from q where domain in (select domain from e where bits >= 3.8)")
add("i3_doh", lambda s, d: ioc.doh(packets(s, d)).select("pkt_id", "rule_id", "severity"), f"select pkt_id, 'IOC-DOH-BYPASS' as rule_id, 'LOW' as severity from packets where dst_port = 443 and dst_ip in {c.DOH_ADDRESSES}")
add("i4_processes", lambda s, d: ioc.processes(packets(s, d), F.broadcast(s.createDataFrame([("mimikatz.exe",)], "name string"))).select("pkt_id", "rule_id", "severity"), "select pkt_id, 'IOC-SUSPICIOUS-PROC' as rule_id, 'CRITICAL' as severity from packets where process_name = 'mimikatz.exe'")

# features
_P = "f as (select *, ts_ms // 5000 as slot, (ts_ms - lag(ts_ms) over (partition by ts_ms // 5000 order by ts_ms, pkt_id)) / 1000.0::double as iat from packets), e as (select slot, sum(-p * log2(p)) as pe from (select slot, count(*) / sum(count(*)) over (partition by slot) as p from f group by slot, dst_port) group by slot)"
FEATURE_SQL = f"""{_P}, feat as (select slot, round(sum(length) / 5.0::double, 6) as bytes_per_sec, round(count(*) / 5.0::double, 6) as packets_per_sec, round(sum(length) / count(*)::double, 6) as avg_packet_size, count(distinct dst_port)::double as unique_dst_ports, count(distinct dst_ip)::double as unique_dst_ips,
  round(count(*) filter (contains(flags, 'S') and not contains(flags, 'A')) / count(*)::double, 6) as syn_ratio, round(count(*) filter (dns_query <> '') / 5.0::double, 6) as dns_rate, round(count(*) filter (contains(flags, 'R')) / count(*)::double, 6) as failed_conn_ratio, round(any_value(pe) + 0.0, 6) as port_entropy,
  round(coalesce(avg(iat), 0.0), 6) as iat_mean, round(coalesce(stddev_pop(iat), 0.0), 6) as iat_std, round(sum(payload_size) / sum(length)::double, 6) as payload_ratio, 0.0::double as direction_asymmetry, round(count(*) filter (length < 100) / count(*)::double, 6) as small_packet_ratio, round(count(*) filter (length > 1400) / count(*)::double, 6) as large_packet_ratio,
  round(count(*) filter (contains(flags, 'R')) / count(*)::double, 6) as rst_ratio, count(distinct protocol)::double as protocol_count, round(count(*) filter (is_encrypted) / count(*)::double, 6) as encrypted_ratio from f join e using (slot) group by slot)"""
add("a21_features", lambda s, d: features.features(packets(s, d)), f"{FEATURE_SQL} select * from feat")
LONG = "long as (unpivot feat on columns(* exclude slot) into name feature value x), xs as (select slot, feature, x::decimal(18,6) as x from long)"
_SUMS = "count(*) as n, sum(x)::decimal(38,6) as total, sum(x::decimal(38,6) * x::decimal(38,6))::decimal(38,12) as squares"
_STATS = "n, round(total::double / n, 6) as mean, round(case when n > 1 then sqrt(greatest((squares::double - total::double * total::double / n) / greatest(n - 1, 1), 0.0)) else 0.0 end, 3) as sd"
_base = lambda s, d, by: features.statistics(features.baseline(features.features(packets(s, d)), by)).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 3)})
add("a22_baseline", lambda s, d: _base(s, d, False), f"{FEATURE_SQL}, {LONG}, b as (select feature, {_SUMS} from xs group by feature) select feature, {_STATS} from b")
add("a22_hourly_baseline", lambda s, d: _base(s, d, True), f"{FEATURE_SQL}, {LONG}, b as (select ((slot * 5 // 3600) % 24)::int as hour, feature, {_SUMS} from xs group by 1, 2) select hour, feature, {_STATS} from b")
_Z = "abs(x - avg(x) over {w}) / (coalesce(stddev_samp(x) over {w}, 0.0) + 1e-8::double)"
_HIST = "(partition by feature order by slot rows unbounded preceding)"
_HOUR = "(partition by feature, slot * 5 // 3600 % 24 order by slot rows unbounded preceding)"
_DEV = f"zs as (select slot, feature, count(*) over {_HIST} as n, case when count(*) over {_HOUR} >= 5 then {_Z.format(w=_HOUR)} else {_Z.format(w=_HIST)} end as z from long)"
add("l2_deviation", lambda s, d: features.deviation(features.features(packets(s, d))).select("slot", F.round("deviation", 4).alias("deviation")), f"{FEATURE_SQL}, {LONG}, {_DEV} select slot, round(case when any_value(n) < 10 then 0.0::double else 1 - 1 / (1 + least(10.0::double, avg(z)) / 3) end, 4) as deviation from zs group by slot")
add("l10_explanation", lambda s, d: features.explanation(features.features(packets(s, d)).where("slot % 7 < 100"), most=18, least=2.5).groupBy("feature").agg(F.count("*").alias("windows")), f"{FEATURE_SQL}, {LONG}, {_DEV} select feature, count(*) as windows from zs where z > 2.5 group by feature")


add("l5_beacons", lambda s, d: features.beacons(packets(s, d)),
    f"g as (select *, {VALUE.replace('(ip,', '(dst_ip,')} as v, (ts_ms - lag(ts_ms) over (partition by dst_ip order by ts_ms, pkt_id)) / 1000.0::double as gap from packets), b as (select dst_ip, count(*) as packets, avg(gap) as m, stddev_pop(gap) as sd from g where not ({PRIVATE_SQL}) and not v between 3758096384 and 4026531839 group by dst_ip) select dst_ip, packets, round(m, 6) as interval, round(1 - sd / m, 6) as score from b where packets >= 15 and m between 5 and 300 and sd / m < 0.05")
add("l6_dns_scores", lambda s, d: features.dns_scores(packets(s, d)),
    "q as (select ts_ms // 60000 as slot, pkt_id, dns_query, split_part(dns_query, '.', 1) as label from packets where dns_query <> '' and not ends_with(dns_query, '.local')), e as (select pkt_id, sum(-p * log2(p)) as h from (select pkt_id, count(*) / sum(count(*)) over (partition by pkt_id) as p from (select pkt_id, unnest(string_split(label, '')) as ch from q) group by pkt_id, ch) group by pkt_id), b as (select slot, count(*) as n, count(*) filter (length(dns_query) > 60) as long, count(*) filter (length(label) > 25 and h > 4.0) as odd from q join e using (pkt_id) group by slot) select slot, n, long, odd, round(greatest(case when long >= 3 then least(long / n::double * 2, 1.0::double) else 0.0 end, case when odd >= 5 then 0.7 else 0.0 end, case when n / 60.0 > 50 then least(n / 60.0::double / 150, 1.0::double) else 0.0 end)::double, 6) as dns_score from b")
