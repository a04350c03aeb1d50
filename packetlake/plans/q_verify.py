"""Registered queries of alert verification and anomaly scores, with the same question in SQL where SQL can say it."""

import dataclasses

from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.operators import verify
from packetlake.plans.packets import ORACLE, packets
from packetlake.plans.q_traffic import PRIVATE_SQL, VALUE

QUERIES, SQL = {}, {}

RULES = (
    "THREAT-INTEL-IP", "THREAT-INTEL-DOMAIN", "PORT-SCAN", "BRUTE-FORCE", "DATA-EXFIL", "DNS-TUNNEL", "DNS-BAD-TLD", "DNS-FLOOD", "ML-ANOMALY", "ARP-SPOOF", "SYN-FLOOD", "ICMP-FLOOD", "BAD-PORT",
    "FORENSICS-INSECURE-SVC", "FORENSICS-CREDENTIAL", "FORENSICS-SENSITIVE-DATA", "IOC-TOR", "IOC-DGA", "IOC-DOH-BYPASS", "ODD-HOURS", "IOC-SUSPICIOUS-PROC", "BL-IP-SRC", "OTHER",
)
EVIDENCE = (
    "process", "threat_category", "cloud_domains", "unknown_domains", "direction", "queried_domain", "confidence", "hosted_on_cloud", "ports", "n_ports", "attempts", "service", "destination_domains", "total_mb",
    "query", "label_entropy", "length", "queries", "distinct_domains", "what_is_unusual", "anomaly_score", "syn_count", "icmp_count", "port", "packets_observed", "bytes_transferred", "has_https", "total_dga_domains",
    "data_type", "process_verdict",
)
#: An alert of some rule for each packet, with evidence that follows from the packet's number; one text for both engines.
_ALERTS = (
    "select pkt_id, ts_ms, case when h % 3 = 0 then dst_ip else src_ip end as src_ip, dst_ip, dst_port, case h % 3 when 0 then 'LOW' when 1 then 'MEDIUM' else 'HIGH' end as severity, case pkt_id % 23 "
    + " ".join(f"when {k} then '{r}'" for k, r in enumerate(RULES))
    + """ end as rule_id,
  case h % 5 when 0 then 'chrome.exe' when 1 then 'OneDrive.exe' when 2 then 'tor.exe' when 3 then 'Unknown' end as process, case h % 2 when 0 then 'Botnet C2' else 'Scanner' end as threat_category,
  case h % 3 when 0 then 'docs.site3.com' else '' end as cloud_domains, case h % 4 when 0 then 'x.bad.xyz' else '' end as unknown_domains, case h % 2 when 0 then 'inbound' else 'outbound' end as direction,
  case h % 4 when 0 then 'www.site3.com' when 1 then 'a.b.c.d.evil.xyz' when 2 then 'aaaaaaaaaaaaaaaaaaaaaaaaa.top' else 'AAAAAAAAAAAAAAAAAAAAAAAAA.com' end as queried_domain,
  case h % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as confidence, case h % 7 when 0 then 'true' else 'false' end as hosted_on_cloud,
  case h % 3 when 0 then '1,2,3,4,5' when 1 then '22,80,443,8080' else '5,9,13' end as ports, cast(h % 150 as {text}) as n_ports, cast(h % 70 as {text}) as attempts,
  case h % 3 when 0 then 'SSH' when 1 then 'HTTP' else 'FTP' end as service, case h % 4 when 0 then 'cdn.site3.com' when 1 then 'dl.dropbox.com,x.y' when 2 then 'a.example' else '' end as destination_domains,
  cast(h % 900 as {text}) as total_mb, case h % 5 when 0 then 'cdn1.site3.com' when 1 then 'q9w8e7r6t5y4u3i2.t.example.org' when 2 then 'ABCDEFABCDEFABCDEFABCDEF.t.example.org' when 3 then 'z.example.org' else 'www.site3.com' end as query,
  concat(cast(h % 6 as {text}), '.', cast(h % 10 as {text})) as label_entropy, cast(h % 130 as {text}) as length, cast(h % 15 as {text}) as queries, cast(h % 12 as {text}) as distinct_domains,
  case h % 6 when 0 then 'Bandwidth is above normal|SYN ratio above normal' when 1 then 'Encrypted ratio|failed connection ratio' when 2 then 'Still learning' when 3 then 'Unique dest ports' when 4 then 'failed connection ratio|SYN ratio above' end as what_is_unusual,
  concat('0.', cast(10 + h % 89 as {text})) as anomaly_score, cast(h % 400 as {text}) as syn_count, cast(h % 400 as {text}) as icmp_count,
  case h % 7 when 0 then '80' when 1 then '21' when 2 then '3306' when 3 then '502' when 4 then '5060' when 5 then '6379' end as port, cast(h % 40 as {text}) as packets_observed, cast(h % 20000 as {text}) as bytes_transferred,
  case h % 2 when 0 then 'true' else 'false' end as has_https, cast(h % 20 as {text}) as total_dga_domains, case h % 3 when 0 then 'SSN' else 'Session Cookie' end as data_type,
  case h % 5 when 0 then 'VERIFIED_SAFE' when 1 then 'LIKELY_SAFE' when 2 then 'MALICIOUS' when 3 then 'SUSPICIOUS' end as process_verdict
from {packets}"""
)
RDNS = (("104.16.3.4", "scan.shodan.io"), ("104.16.0.1", "edge.site3.com"), ("192.168.1.12", "host.site3.com"), ("93.184.216.34", "big.site3.com"))
LISTED = ("104.16.0.1", "104.16.5.5", "93.184.216.34")


def _verdicts(s, d):
    rows = s.sql(_ALERTS.format(packets="{packets}", text="string"), packets=packets(s, d))
    said = F.map_filter(F.create_map(*[x for name in EVIDENCE for x in (F.lit(name), F.col(name))]), lambda k, v: v.isNotNull())
    found = rows.select("pkt_id", "ts_ms", "src_ip", "dst_ip", "dst_port", "severity", "rule_id", said.alias("evidence"))
    cfg = dataclasses.replace(c.DEFAULT, cloud_suffixes=("site3.com",), gateways=("192.168.1.1",))
    names, listed = s.createDataFrame(list(RDNS), "ip string, name string"), s.createDataFrame([(x,) for x in LISTED], "ip string")
    out = verify.verify(found, cfg, F.broadcast(names), F.broadcast(listed))
    return out.select("pkt_id", "rule_id", "score", "verdict", "confidence", "adjusted_severity", "title_prefix")


def _sql_list(names):
    return ", ".join(f"'{x}'" for x in names)


_SCORES = {
    "THREAT-INTEL-IP": ("case when threat_category = 'Botnet C2' then 3 else 1 end + case when cloud_domains <> '' and unknown_domains = '' then -3 when cloud_domains = '' and unknown_domains = '' then 2 else 0 end + case when mname is null then 1 when ends_with(mname, '.site3.com') then -2 else 0 end", 5, "address"),
    "THREAT-INTEL-DOMAIN": ("case confidence when 'HIGH' then 3 when 'MEDIUM' then 1 else 0 end - (hosted_on_cloud = 'true')::int + (len(string_split(queried_domain, '.')) > 4)::int + (queried_domain like 'aaaaaaaaaaaaaaaaaaaaaaaaa.%')::int + (queried_domain like '%.xyz' or queried_domain like '%.top')::int", 4, "usual"),
    "PORT-SCAN": ("case when local then 1 else 2 end - case when ends_with(sname, 'shodan.io') then 2 else 0 end + case ports when '5,9,13' then 0 else 1 end + case when n_ports::int > 100 then 2 when n_ports::int > 30 then 1 else 0 end", 4, "usual"),
    "BRUTE-FORCE": (f"case when local then 1 else 2 end + case when src_ip in ({_sql_list(LISTED)}) then 2 else 0 end + case when attempts::int > 50 then 2 when attempts::int > 20 then 1 else 0 end + (service = 'SSH')::int", 5, "brute"),
    "DATA-EXFIL": (f"case when destination_domains = '' then 2 else 0 end - case when destination_domains like '%site3.com' then 2 else 0 end - case when destination_domains like '%dropbox.com%' then 3 else 0 end - case when lower(process) in ('chrome.exe', 'onedrive.exe') then 2 else 0 end + case when total_mb::int > 500 then 2 when total_mb::int > 200 then 1 else 0 end + case when dst_ip in ({_sql_list(LISTED)}) then 3 else 0 end", 5, "upload"),
    "DNS-TUNNEL": ("case when label_entropy::double > 4.5 then 2 when label_entropy::double > 3.8 then 1 else 0 end + case when length::int > 100 then 2 when length::int > 70 then 1 else 0 end - case when query like 'cdn%' or query like 'ABC%' then 2 else 0 end - case when query like '%.site3.com' then 2 else 0 end", 4, "usual"),
    "DNS-BAD-TLD": ("1 + (length(split_part(query, '.', 1)) > 15)::int + case when queries::int > 10 then 1 when queries::int = 1 then -1 else 0 end", 3, "port"),
    "DNS-FLOOD": ("case when queries::int = 0 then 0 when distinct_domains::double / queries::double > 0.8 then 2 else -1 end - case when process = 'chrome.exe' then 2 else 0 end", 3, "flood"),
    "ML-ANOMALY": ("case h6 when 2 then -2 when 3 then -1 when 4 then 2 else 0 end - (anomaly_score::double < 0.375)::int + case when anomaly_score::double > 0.7 then 2 when anomaly_score::double > 0.4 then 1 else 0 end", 4, "flood"),
    "ARP-SPOOF": ("2 + case when src_ip = '192.168.1.1' then 2 else 0 end", 4, "likely"),
    "SYN-FLOOD": ("2 + (not local)::int + (syn_count::int > 200)::int", 4, "likely"),
    "ICMP-FLOOD": ("2 + (not local)::int + (icmp_count::int > 200)::int", 4, "likely"),
    "BAD-PORT": ("1 + case when process is null or process = 'Unknown' then 0 when process = 'chrome.exe' then -1 else 1 end", 3, "port"),
    "FORENSICS-INSECURE-SVC": ("""case when service = 'HTTP' or coalesce(port::int, dst_port) = 80 then case when bytes_transferred::int < 2000 and packets_observed::int < 10 then -3 when bytes_transferred::int < 10000 and has_https = 'true' then -2 else 1 end - case when has_https = 'true' then 3 else 0 end - case when ends_with(dname, '.site3.com') then 2 else 0 end
      when coalesce(port::int, dst_port) in (21, 23, 5900, 6379, 27017, 9200) then 3 + (packets_observed::int > 20)::int when coalesce(port::int, dst_port) in (1433, 3306, 5432, 1521) then 2 when coalesce(port::int, dst_port) in (502, 47808) then 3 else 1 end""", 4, "usual"),
}
_CUT = {k: "case " + " ".join(f"when score >= {n} then '{v}'" for n, v in cuts[:-1]) + f" else '{cuts[-1][1]}' end" if len(cuts) > 1 else f"'{cuts[0][1]}'" for k, cuts in verify.CUTS.items()}
_FLAT = """when 'BL-IP-SRC' then row('LIKELY_THREAT', 0.8) when 'FORENSICS-CREDENTIAL' then row('VERIFIED_THREAT', 0.95) when 'FORENSICS-SENSITIVE-DATA' then case when data_type = 'SSN' then row('VERIFIED_THREAT', 0.9) else row('LIKELY_THREAT', 0.7) end
  when 'IOC-TOR' then case when process = 'tor.exe' then row('INCONCLUSIVE', 0.5) else row('LIKELY_THREAT', 0.7) end when 'IOC-DGA' then case when total_dga_domains::int >= 10 then row('VERIFIED_THREAT', 0.9) else row('LIKELY_THREAT', 0.6) end
  when 'IOC-DOH-BYPASS' then case when process = 'chrome.exe' then row('FALSE_POSITIVE', 0.8) else row('LIKELY_THREAT', 0.6) end when 'ODD-HOURS' then case when process in ('chrome.exe', 'OneDrive.exe') then row('LIKELY_FALSE_POSITIVE', 0.7) else row('INCONCLUSIVE', 0.4) end
  when 'IOC-SUSPICIOUS-PROC' then case process_verdict when 'VERIFIED_SAFE' then row('FALSE_POSITIVE', 0.9) when 'LIKELY_SAFE' then row('LIKELY_FALSE_POSITIVE', 0.7) when 'MALICIOUS' then row('VERIFIED_THREAT', 0.9) when 'SUSPICIOUS' then row('LIKELY_THREAT', 0.6) else row('INCONCLUSIVE', 0.3) end"""
QUERIES["v_verdicts"] = _verdicts
SQL["v_verdicts"] = f"""with {ORACLE}, raw as ({_ALERTS.format(packets="packets", text="varchar")}), names(ip, name) as (values {", ".join(map(str, RDNS))}),
  al as (select raw.*, sn.name as sname, dn.name as dname, case direction when 'inbound' then sn.name else dn.name end as mname, case what_is_unusual when 'Still learning' then 2 when 'Unique dest ports' then 3 when 'failed connection ratio|SYN ratio above' then 4 else 0 end as h6, {VALUE.replace("(ip,", "(raw.src_ip,")} as v
    from raw left join names sn on sn.ip = raw.src_ip left join names dn on dn.ip = raw.dst_ip), pr as (select *, ({PRIVATE_SQL}) as local from al),
  sc as (select *, (case rule_id {" ".join(f"when '{r}' then {s}" for r, (s, _, _) in _SCORES.items())} else 0 end)::int as score, case rule_id {" ".join(f"when '{r}' then {k}" for r, (_, k, _) in _SCORES.items())} end as k from pr),
  vd as (select *, case rule_id {_FLAT} end as flat, case rule_id {" ".join(f"when '{r}' then {_CUT[cut]}" for r, (_, _, cut) in _SCORES.items())} end as scored from sc),
  fin as (select pkt_id, rule_id, severity, score, case when rule_id = 'THREAT-INTEL-DOMAIN' and queried_domain like '%.site3.com' then 'FALSE_POSITIVE' else coalesce(scored, flat[1], 'INCONCLUSIVE') end as verdict,
    round(case when rule_id = 'THREAT-INTEL-DOMAIN' and queried_domain like '%.site3.com' then 0.95::double when k is not null then least(abs(score) / k::double, 1.0::double) else coalesce(flat[2]::double, 0.3::double) end, 6) as confidence from vd)
  select pkt_id, rule_id, score, verdict, confidence, case when ends_with(verdict, 'FALSE_POSITIVE') then 'LOW' when verdict = 'VERIFIED_THREAT' and confidence > 0.5 and severity in ('LOW', 'MEDIUM') then 'HIGH' else severity end as adjusted_severity, case when verdict = 'FALSE_POSITIVE' then '[FALSE POSITIVE] ' when verdict = 'LIKELY_FALSE_POSITIVE' then '[LIKELY SAFE] ' when verdict = 'VERIFIED_THREAT' and confidence > 0.5 then '[CONFIRMED] ' when verdict = 'LIKELY_THREAT' and confidence > 0.5 then '[LIKELY THREAT] ' else '' end as title_prefix from fin"""


def _forest(s, d):
    from pyspark.sql import functions as F

    from packetlake.operators import features, forest
    from packetlake.operators.stored import stored
    from packetlake.plans.packets import packets

    rows = stored(features.features(packets(s, d)))  # read for the count, the draws and the scores
    return forest.score(rows, forest.train(rows)).select("slot", F.round("anomaly", 6).alias("anomaly"))


#: A random forest is not SQL: tests/test_forest.py holds its invariants.
QUERIES["l3_isolation_forest"] = _forest
