"""Registered queries of threat intelligence and learned state, each with the same question in SQL."""

from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.operators import detect, devices, enrich, intel, ioc, trailing
from packetlake.plans.packets import ORACLE, packets
from packetlake.plans.q_payload import _PROFILE

QUERIES, SQL = {}, {}


def add(name, run, sql):
    QUERIES[name], SQL[name] = run, f"with {ORACLE}" + ("" if sql.lstrip().startswith("select") else ",") + f" {sql}"


CLOUD = ("site3.com", "site4.com", "site12.com", "example.com")
IPS = (("185.220.101.5", "Botnet C2"), ("104.16.3.4", "Scanner"), ("104.16.0.1", "Malicious SSL"), ("104.16.9.9", "Scanner"), ("93.184.216.34", "Spam"), ("1.1.1.1", "Scanner"))
NAMES = (("www.site7.com", "Malware"), ("site9.com", "Phishing"), ("site3.com", "Malware"), ("t.example.org", "Tunnel"), ("xyz", "Never"), ("promo7.xyz", "Spam"))


def _names(s, names):
    return s.createDataFrame([(x,) for x in names], "name string")


_UNDER = lambda x: "(" + " or ".join(f"{x} = '{n}' or ends_with({x}, '.{n}')" for n in CLOUD) + ")"
_PAIRS = f"""a as (select pkt_id, dst_ip, protocol, dns_query, max(case when dns_query <> '' then row(ts_ms, pkt_id, dns_query) end) over (partition by src_ip order by ts_ms range between 29999 preceding and current row) as m from packets),
  pairs as (select dst_ip as ip, struct_extract(m, 3) as domain from a where protocol in ('TCP', 'UDP') and dns_query = '' and m is not null union select dns_response, dns_query from packets where dns_response <> '' and dns_query <> ''),
  st as (select ip, bool_or({_UNDER('domain')}) as cloudy, bool_or(not {_UNDER('domain')}) as other from pairs group by ip)"""
_TI = "ti(ip, category) as (values " + ", ".join(map(str, IPS)) + ")"
add("d1_threat_ips", lambda s, d: intel.threat_ips(packets(s, d), F.broadcast(s.createDataFrame(list(IPS), "ip string, category string")), _names(s, CLOUD)).select("pkt_id", "rule_id", "severity", F.col("evidence")["matched_ip"].alias("ip"), F.col("evidence")["direction"].alias("direction")),
    f"{_TI}, {_PAIRS}, sides as (select pkt_id, src_ip as ip, 'inbound' as direction from packets union all select pkt_id, dst_ip, 'outbound' from packets) select pkt_id, 'THREAT-INTEL-IP' as rule_id, case when cloudy and not other then 'LOW' when cloudy then 'MEDIUM' when category in ('Botnet C2', 'Malicious SSL') then 'CRITICAL' else 'HIGH' end as severity, ip, direction from sides join ti using (ip) left join st using (ip)")
add("d2_threat_domains", lambda s, d: intel.threat_domains(packets(s, d), F.broadcast(s.createDataFrame(list(NAMES), "name string, category string")), _names(s, CLOUD)).select("pkt_id", "rule_id", "severity", F.col("evidence")["matched_domain"].alias("matched")),
    f"listed(name, category) as (values {', '.join(map(str, NAMES))}), l as (select pkt_id, name, row_number() over (partition by pkt_id order by length(name) desc) as r, dns_query = name as same from packets join listed on dns_query = name or ends_with(dns_query, '.' || name) where contains(name, '.') and not {_UNDER('dns_query')}) select pkt_id, 'THREAT-INTEL-DOMAIN' as rule_id, case when same then 'CRITICAL' else 'HIGH' end as severity, name as matched from l where r = 1")
add("j11_ip_standing", lambda s, d: intel.standing(intel.ip_domains(packets(s, d)), _names(s, CLOUD)).select("ip", F.col("cloud_domains").isNotNull().alias("cloudy"), F.col("other_domains").isNotNull().alias("other")), f"{_PAIRS} select ip, cloudy, other from st")
add("p10_cloud_names", lambda s, d: intel.under(packets(s, d).where("dns_query <> ''").select(F.col("dns_query").alias("domain")), _names(s, CLOUD)), f"select distinct dns_query as domain from packets where dns_query <> '' and {_UNDER('dns_query')}")


def _early(s, d):
    return packets(s, d).where("ts_ms < 1704072600000 + 100000")


_LEARNED = "b as (select array_to_string(string_split(dns_query, '.')[-2:], '.') as domain, count(*) as n from packets where dns_query <> '' and ts_ms < 1704072600000 + 100000 group by 1 having count(*) >= 3)"
add("j10_unlearned_tunnels", lambda s, d: detect.dns_tunnel(intel.unlearned_domains(packets(s, d), enrich.learned(_early(s, d), domain_times=3)["domains"])).select("pkt_id", "rule_id"),
    f"{_LEARNED} select pkt_id, 'DNS-TUNNEL' as rule_id from packets where length(dns_query) > 60 and array_to_string(string_split(dns_query, '.')[-2:], '.') not in (select domain from b)")
add("j10_unlearned_tlds", lambda s, d: detect.bad_tld(intel.unlearned_domains(packets(s, d), enrich.learned(_early(s, d))["domains"], exact=("promo3.xyz",), suffixes=("9.xyz",))).select("pkt_id", "rule_id"),
    f"{_LEARNED} select pkt_id, 'DNS-BAD-TLD' as rule_id from packets where regexp_matches(dns_query, '({'|'.join(c.ABUSE_ENDINGS)})$') and dns_query <> 'promo3.xyz' and not ends_with(dns_query, '9.xyz') and array_to_string(string_split(dns_query, '.')[-2:], '.') not in (select domain from b)")
add("d13_learned_exfil", lambda s, d: detect.exfiltration(detect.candidates(packets(s, d)), learned_ips=enrich.learned(packets(s, d).where("dst_ip like '93.%' or src_port % 2 = 0"))["ips"].where("learned")).select("dst_ip", "severity"),
    f"k as (select dst_ip from packets where dst_ip like '93.%' or src_port % 2 = 0 group by 1 having count(*) >= 3), t as (select *, sum(payload_size) over (partition by dst_ip order by ts_ms, pkt_id rows unbounded preceding) as t from packets where payload_size > 0 and dst_port not in ({', '.join(map(str, c.NOISY_PORTS))})), l as (select *, (select count(*) from (select unnest(range(30)) as q) where t > 104857600 * (1::bigint << q)) as level, (select count(*) from (select unnest(range(30)) as q) where t - payload_size > 104857600 * (1::bigint << q)) as prior from t) select dst_ip, case when dst_ip in (select dst_ip from k) then 'MEDIUM' else 'HIGH' end as severity from l where level > prior")
add("a16_known_devices", lambda s, d: intel.known_devices(devices.profiles(packets(s, d))).select("ip", "packets", "is_gateway"), f"{_PROFILE} select ip, packets, arp_targets > 10 as is_gateway from prof where packets > 50")
_NOW = 1704072600000 + 30 * intel.DAY_MS + 1_000_000
add("a20_fresh_domains", lambda s, d: intel.fresh(enrich.learned(packets(s, d))["domains"], _NOW).select("domain", "n"), f"select array_to_string(string_split(dns_query, '.')[-2:], '.') as domain, count(*) as n from packets where dns_query <> '' group by 1 having max(ts_ms) >= {_NOW - 30 * intel.DAY_MS}")
add("a29_learned_counts", lambda s, d: intel.learned_counts(enrich.learned(packets(s, d))), "d as (select array_to_string(string_split(dns_query, '.')[-2:], '.') as k, count(*) as n from packets where dns_query <> '' group by 1), i as (select dst_ip as k, count(*) as n from packets group by 1), p as (select dst_port as k, count(*) as n from packets where dst_port > 0 group by 1) select 'domains' as kind, count(*) as n, count(*) filter (n >= 3) as learned from d union all select 'ips', count(*), count(*) filter (n >= 3) from i union all select 'ports', count(*), count(*) filter (n >= 5) from p")


# what had been learned before each packet, by a running count
_BASE = "array_to_string(string_split(dns_query, '.')[-2:], '.')"
_SEEN = f"""seen as (
    select *, count(*) over (partition by {_BASE} order by ts_ms, pkt_id rows between unbounded preceding and 1 preceding) as before from packets where dns_query <> '')"""


def _since(s, d):
    return intel.learned_since(packets(s, d))


add("j10_tunnels_as_of", lambda s, d: detect.dns_tunnel(intel.unlearned_as_of(packets(s, d), _since(s, d)["domains"])).select("pkt_id", "rule_id"),
    f"{_SEEN} select pkt_id, 'DNS-TUNNEL' as rule_id from seen where length(dns_query) > 60 and before < 3")
add("j10_tlds_as_of", lambda s, d: detect.bad_tld(intel.unlearned_as_of(packets(s, d), _since(s, d)["domains"])).select("pkt_id", "rule_id"),
    f"{_SEEN} select pkt_id, 'DNS-BAD-TLD' as rule_id from seen where regexp_matches(dns_query, '({'|'.join(c.ABUSE_ENDINGS)})$') and before < 3")
add("j10_ports_as_of", lambda s, d: intel.as_of(packets(s, d).where("dst_port > 0"), _since(s, d)["ports"], {"dst_port": F.col("dst_port")}).where("not known").select("pkt_id", "dst_port"),
    "seen as (select pkt_id, dst_port, count(*) over (partition by dst_port order by ts_ms, pkt_id rows between unbounded preceding and 1 preceding) as before from packets where dst_port > 0) select pkt_id, dst_port from seen where before < 5")
#: Uploads grow by 100 MB steps; here by 10 MB, and a destination is learned after 40 packets, so that both severities are met.
_SMALL = c.Config(upload_mb=10.0)
add("d13_exfil_as_of", lambda s, d: detect.exfiltration(detect.candidates(packets(s, d)), _SMALL, learned_since=intel.learned_since(packets(s, d), address_times=40)["ips"]).select("pkt_id", "dst_ip", "severity"),
    f"""k as (select pkt_id, count(*) over (partition by dst_ip order by ts_ms, pkt_id rows between unbounded preceding and 1 preceding) as before from packets),
    t as (select *, sum(payload_size) over (partition by dst_ip order by ts_ms, pkt_id rows unbounded preceding) as t from packets where payload_size > 0 and dst_port not in ({', '.join(map(str, c.NOISY_PORTS))})),
    l as (select *, (select count(*) from (select unnest(range(40)) as q) where t > 10485760 * (1::bigint << q)) as level, (select count(*) from (select unnest(range(40)) as q) where t - payload_size > 10485760 * (1::bigint << q)) as prior from t)
    select pkt_id, dst_ip, case when before >= 40 then 'MEDIUM' else 'HIGH' end as severity from l join k using (pkt_id) where level > prior""")

# random names: an alert from the fifth different one on
_NAMES = """q as (select distinct dns_query as domain from packets where dns_query <> ''), lab as (select domain, unnest(string_split(domain, '.')[:-2]) as label from q),
  ch as (select domain, label, unnest(string_split(label, '')) as ch from lab where length(label) >= 10),
  bits as (select domain, label, round(sum(-p * log2(p)), 9) as bits from (select domain, label, count(*) / sum(count(*)) over (partition by domain, label) as p from ch group by domain, label, ch) group by domain, label),
  odd as (select p.*, row_number() over (partition by dns_query order by ts_ms, pkt_id) as nth, row_number() over (partition by src_ip, dns_query order by ts_ms, pkt_id) as own from packets p where dns_query in (select domain from bits where bits >= 3.8))"""
add("i2_random_name_alerts", lambda s, d: ioc.random_name_alerts(packets(s, d)).select("pkt_id", "rule_id", "severity", F.col("evidence")["total_dga_domains"].cast("long").alias("total"), F.col("evidence")["sample_domains"].alias("sample")),
    f"""{_NAMES}, so_far as (select *, count(*) filter (nth = 1) over (order by ts_ms, pkt_id) as total from odd), f as (select dns_query, row_number() over (order by ts_ms, pkt_id) as r from odd where nth = 1)
    select pkt_id, 'IOC-DGA' as rule_id, 'HIGH' as severity, total, (select string_agg(dns_query, ',' order by r) from f where r <= least(total, 15)) as sample from so_far where total >= 5""")
add("i2_random_name_alerts_by_source", lambda s, d: ioc.random_name_alerts(packets(s, d), per_source=True).select("pkt_id", "src_ip", F.col("evidence")["total_dga_domains"].cast("long").alias("total")),
    f"{_NAMES}, so_far as (select *, count(*) filter (own = 1) over (partition by src_ip order by ts_ms, pkt_id) as total from odd) select pkt_id, src_ip, total from so_far where total >= 5")

# the last 5000 packets at every 5 s
add("l1_last_packets", lambda s, d: trailing.features(packets(s, d)),
    """n as (select *, ts_ms // 5000 as slot, row_number() over (order by ts_ms, pkt_id) as number, ts_ms - lag(ts_ms) over (order by ts_ms, pkt_id) as gap from packets),
  ticks as (select slot as tick, max(number) as e from n group by slot), w as (select t.tick, n.*, case when number > greatest(1, e - 4999) then gap / 1000.0::double end as iat from ticks t join n on number > e - 5000 and number <= e),
  pe as (select tick, sum(-p * log2(p)) as bits from (select tick, count(*) / sum(count(*)) over (partition by tick) as p from w group by tick, dst_port) group by tick)
  select tick as slot, count(*) as packets, round(sum(length) / 5.0::double, 6) as bytes_per_sec, round(count(*) / 5.0::double, 6) as packets_per_sec, round(sum(length) / count(*)::double, 6) as avg_packet_size,
    count(distinct dst_port)::double as unique_dst_ports, count(distinct dst_ip)::double as unique_dst_ips, round(count(*) filter (contains(flags, 'S') and not contains(flags, 'A')) / count(*)::double, 6) as syn_ratio,
    round(count(*) filter (dns_query <> '') / 5.0::double, 6) as dns_rate, round(count(*) filter (contains(flags, 'R')) / count(*)::double, 6) as failed_conn_ratio, round(any_value(bits) + 0.0, 6) as port_entropy,
    round(coalesce(avg(iat), 0.0), 6) as iat_mean, round(coalesce(stddev_pop(iat), 0.0), 6) as iat_std, round(sum(payload_size) / sum(length)::double, 6) as payload_ratio, 0.0::double as direction_asymmetry,
    round(count(*) filter (length < 100) / count(*)::double, 6) as small_packet_ratio, round(count(*) filter (length > 1400) / count(*)::double, 6) as large_packet_ratio, round(count(*) filter (contains(flags, 'R')) / count(*)::double, 6) as rst_ratio,
    count(distinct protocol)::double as protocol_count, round(count(*) filter (is_encrypted) / count(*)::double, 6) as encrypted_ratio from w join pe using (tick) group by tick""")
