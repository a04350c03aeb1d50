"""Registered queries of payload findings and devices, each with the same question in SQL."""

from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.operators import devices, payload
from packetlake.plans.packets import MESSAGES, ORACLE, messages, packets

QUERIES, SQL = {}, {}


def add(name, run, sql):
    QUERIES[name], SQL[name] = run, f"with {ORACLE}" + ("" if sql.lstrip().startswith("select") else ",") + f" {sql}"


def _mask(value, show=3):
    return f"concat(substr({value}, 1, {show}), repeat('*', greatest(0, least(length({value}) - {show}, 20))::int))"


def _ports(ports, only_dst=False):
    if ports is None:
        return "true"
    few = ", ".join(map(str, ports))
    return f"(dst_port in ({few}))" if only_dst else f"(dst_port in ({few}) or src_port in ({few}))"


def _said(pattern):
    return "'" + pattern.replace("'", "''") + "'"


_HOST = "regexp_extract(payload, '(?i)Host:\\s*(\\S+)', 1)"
_ROW = "select pkt_id, ts_ms, src_ip, dst_ip, dst_port, '{kind}' as kind, {protocol} as protocol, {field} as field, {risk} as severity, {shown} as masked, {value} as value, {note} as note from messages where length(payload) >= 4 and {test}"
_PARTS = []
for _kind, _protocol, _field, _on, _dst, _re, _show in payload.SECRETS:
    _value = f"regexp_extract(payload, {_said(_re)}, 1)"
    _note = f"concat_ws(' ', {_HOST}, substr(regexp_extract(payload, {_said(payload.REQUEST)}, 2), 1, 100))" if _kind == "HTTP_FORM" else "''"
    _PARTS.append(_ROW.format(kind=_kind, protocol=f"'{_protocol}'", field=f"'{_field}'", risk="'CRITICAL'", shown=_mask(_value, _show) if _show else _value, value=_value, note=_note, test=f"{_ports(_on, _dst)} and {_value} <> ''"))
_PAIR = f"from_base64(nullif(regexp_extract(payload, {_said(payload.BASIC)}, 1), ''))::varchar"
_BOTH = f"concat(split_part({_PAIR}, ':', 1), ':', {_mask(f'split_part({_PAIR}, {chr(39)}:{chr(39)}, 2)')})"
for _kind, _protocol, _on, _note in (("HTTP_BASIC", "HTTP Basic Auth", payload.HTTP_PORTS, _HOST), ("RTSP_BASIC", "RTSP/Camera", (554,), "''")):
    _PARTS.append(_ROW.format(kind=_kind, protocol=f"'{_protocol}'", field="'credentials'", risk="'CRITICAL'", shown=_BOTH, value=_PAIR, note=_note, test=f"{_ports(_on)} and contains({_PAIR}, ':')"))
_part = lambda name, none: f"""coalesce(nullif(regexp_extract(payload, '(?i){name}="([^"]+)"', 1), ''), '{none}')"""
_UPDATE = "regexp_matches(lower(" + _HOST + "), 'update\\.eset\\.com|eset\\.com|update\\.nod32\\.com')"
_PARTS.append(_ROW.format(kind="HTTP_DIGEST", protocol=f"case when {_UPDATE} then 'HTTP Digest Auth (Update Service)' else 'HTTP Digest Auth' end", field=f"case when {_UPDATE} then 'digest_hash' else 'digest_credentials' end", risk=f"case when {_UPDATE} then 'LOW' else 'CRITICAL' end",
    shown=f"case when {_UPDATE} then concat({_part('username', '?')}, '@', {_part('realm', '?')}, ' via ', {_HOST}, ' (hashed, not plaintext)') else concat({_part('username', '?')}, '@', {_part('realm', '?')}, ' (uri: ', {_part('uri', '?')}, ')') end",
    value=f"concat('username=', {_part('username', '?')}, ', realm=', {_part('realm', '?')}, ', uri=', {_part('uri', '?')}, ', nonce=', {_part('nonce', '')}, ', response=', {_part('response', '')})", note=_HOST, test=f"{_ports(payload.HTTP_PORTS)} and regexp_matches(payload, '(?i)Authorization:\\s*Digest\\s+.+?\\r?\\n')"))
_TOKEN = "regexp_extract(payload, '(?i)Authorization:\\s*(\\S+\\s+\\S+)', 1)"
_UPDATE = "contains(lower(" + _HOST + "), 'eset.com')"
_PARTS.append(_ROW.format(kind="HTTP_TOKEN", protocol=f"case when {_UPDATE} then 'HTTP Auth Token (Update Service)' else 'HTTP Auth Token' end", field="'token'", risk=f"case when {_UPDATE} then 'LOW' else 'CRITICAL' end", shown=f"concat({_mask(_TOKEN, 8)}, case when {_UPDATE} then concat(' via ', lower({_HOST})) else '' end)", value=_TOKEN, note=_HOST,
    test=f"{_ports(payload.HTTP_PORTS)} and {_TOKEN} <> '' and not contains({_TOKEN}, 'Basic') and not contains({_TOKEN}, 'Digest')"))
_LOGIN = [f"split_part(payload, '\"', {k})" for k in (2, 4)]
_PARTS.append(_ROW.format(kind="IMAP_LOGIN", protocol="'IMAP'", field="'login'", risk="'CRITICAL'", shown=f"concat({_LOGIN[0]}, ':', {_mask(_LOGIN[1])})", value=f"concat({_LOGIN[0]}, ':', {_LOGIN[1]})", note="''", test="dst_port = 143 and contains(payload, 'LOGIN')"))
_WORD = "case when payload ilike '%public%' then 'public' when payload ilike '%private%' then 'private' end"
_PARTS.append(_ROW.format(kind="SNMP", protocol="'SNMP'", field="'community_string'", risk="'CRITICAL'", shown=_WORD, value=_WORD, note="''", test=f"dst_port in (161, 162) and ({_WORD}) is not null"))
_FOUND = f"{MESSAGES}, f as ({' union all '.join(_PARTS)})"
add("x1_secrets", lambda s, d: payload.secrets(messages(s, d)).select("pkt_id", "kind", "protocol", "field", "severity", "masked", "note", "fingerprint"), f"{_FOUND} select pkt_id, kind, protocol, field, severity, masked, note, sha256(value) as fingerprint from f")
add("s13_secret_store", lambda s, d: payload.distinct_secrets(payload.secrets(messages(s, d))), f"{_FOUND} select kind, src_ip, dst_ip, dst_port, sha256(value) as fingerprint, masked, min(ts_ms) as first_ms, max(ts_ms) as last_ms, count(*) as n from f group by kind, src_ip, dst_ip, dst_port, value, masked")
_OPEN = " union all ".join(f"select pkt_id, ts_ms, src_ip, dst_ip, dst_port, '{k}' as type, '{risk}' as risk, '' as value from messages where regexp_matches(payload, {_said(re)}) and " + ("true" if p is None else f"(dst_port in ({', '.join(map(str, p))})" + (f" or src_port in ({', '.join(map(str, b))})" if b else "") + ")") for k, p, b, re, risk in payload.EXPOSURES)
_OPEN += " union all select pkt_id, ts_ms, src_ip, dst_ip, dst_port, 'Network Printer', 'MEDIUM', payload_size::varchar from messages where dst_port in (515, 631, 9100) and payload_size > 100"
_OPEN += " union all select pkt_id, ts_ms, src_ip, dst_ip, dst_port, 'Redis No Auth', 'CRITICAL', '' from messages where 6379 in (dst_port, src_port) and payload ~ '.*(SET|GET).*' and not regexp_matches(payload, '(?i)AUTH\\s+(\\S+)')"
_OPEN += f" union all select pkt_id, ts_ms, src_ip, dst_ip, dst_port, 'Session Cookie', 'HIGH', substr(trim(regexp_extract(payload, '(?i)Cookie:\\s*(.+?)\\r?\\n', 1)), 1, 80) from messages, (values (1), (2)) as twice(k) where {_ports(payload.HTTP_PORTS)} and not (dst_ip like '192.168.%' or dst_ip like '10.%' or dst_ip like '172.%' or dst_ip = '127.0.0.1') and contains(payload, 'SessionId') and (k = 1 or contains(payload, 'Set-Cookie'))"
add("x12_exposures", lambda s, d: payload.exposures(messages(s, d)).select("pkt_id", "type", "risk", "value"), f"{MESSAGES}, f as ({_OPEN}) select pkt_id, type, risk, value from f")
_BEAT = "b as (select *, substr(payload, 1, 12) as mac, split_part(payload, ' ', 5) as token from messages where contains(payload, 'GETEIP')), r as (select *, row_number() over (partition by mac, token order by ts_ms, pkt_id) as a, row_number() over (partition by mac order by ts_ms, pkt_id) as b, count(*) over (partition by mac, token) as n from b)"
add("x16_heartbeats", lambda s, d: payload.heartbeats(messages(s, d)).select("mac", "device", "wan_ip", "token", "n", "pkt_id", "alert"), f"{MESSAGES}, {_BEAT} select mac, 'K12' as device, '203.0.113.9' as wan_ip, concat(substr(token, 1, 12), '...') as token, n, pkt_id, b = 1 as alert from r where a = 1")
_AGENT = "u as (select src_ip, pkt_id, payload, trim(regexp_extract(payload, '(?i)User-Agent:[ \\t]*([^\\r\\n]+)', 1)) as agent from messages where dst_port in (" + ", ".join(map(str, payload.HTTP_PORTS)) + ")), k as (select *, case when lower(agent) like '%sqlmap%' then 'sqlmap' when lower(agent) like '%scrapy%' then 'scrapy' when lower(agent) like '%spider%' then 'spider' when agent <> '' and length(agent) < 5 then 'short_ua' when agent = '' and regexp_matches(payload, '^(GET|POST|PUT|DELETE|PATCH) \\S+ HTTP') and not contains(lower(payload), 'windowsupdate.com') and not contains(lower(payload), 'eset.com') then 'no_ua' end as signature from u)"
add("x21_agents", lambda s, d: payload.agents(messages(s, d)), f"{MESSAGES}, {_AGENT} select src_ip, signature, case signature when 'sqlmap' then 'CRITICAL' when 'scrapy' then 'HIGH' when 'spider' then 'HIGH' else 'MEDIUM' end as risk, count(*) as n, min(pkt_id) as first_pkt from k where signature is not null group by src_ip, signature")
_METHOD = f"q as (select *, upper(regexp_extract(payload, {_said(payload.REQUEST)}, 1)) as method from messages where {_ports(payload.HTTP_PORTS)} and regexp_matches(payload, {_said(payload.REQUEST)}))"
add("a30_form_context", lambda s, d: payload.form_context(payload.connections(messages(s, d)))[0].withColumn("methods", F.array_join("methods", "|")), f"{MESSAGES}, {_METHOD} select src_ip, dst_ip, dst_port, string_agg(distinct method, '|' order by method) as methods from q group by src_ip, dst_ip, dst_port")
_CARD = "regexp_extract(payload, '(4[0-9]{15})', 1)"
_LUHN = f"list_sum(list_transform(range(1, 17), lambda i: case when i % 2 = 1 then case when substr({_CARD}, i::int, 1)::int > 4 then 2 * substr({_CARD}, i::int, 1)::int - 9 else 2 * substr({_CARD}, i::int, 1)::int end else substr({_CARD}, i::int, 1)::int end)) % 10 = 0"
_SENSITIVE = f"v as (select *, 'CARD' as kind, concat('****', substr({_CARD}, 13)) as masked from messages where src_port not in ({', '.join(map(str, payload.SERVER_PORTS))}) and {_CARD} <> '' and case when {_CARD} <> '' then {_LUHN} end union all select *, 'SSN', '***-**-6789' from messages where src_port not in ({', '.join(map(str, payload.SERVER_PORTS))}) and contains(payload, ' 123-45-6789 '))"
add("x18_sensitive", lambda s, d: payload.sensitive(messages(s, d)).select("pkt_id", "kind", "masked"), f"{MESSAGES}, {_SENSITIVE} select pkt_id, kind, masked from v")
SERVICES = ("site1.com", "site7.com")


def _context(s, d):
    m, p = messages(s, d), packets(s, d)
    domains = p.where("dns_response <> ''").select(F.col("dns_response").alias("ip"), F.col("dns_query").alias("domain")).distinct()
    return payload.in_context(payload.sensitive(m), m, domains, s.createDataFrame([(x,) for x in SERVICES], "name string")).select("pkt_id", "kind", "score", "risk")


add("x20_context", _context, f"""{MESSAGES}, {_SENSITIVE}, {_METHOD}, tls as (select distinct unnest([src_ip, dst_ip]) as ip from messages where is_encrypted), two as (select dst_ip as ip from messages where dst_port in (80, 443) group by 1 having count(distinct dst_port) = 2),
  dom as (select dns_response as ip, count(distinct dns_query) as n from packets where dns_response <> '' and ({' or '.join(f"dns_query = '{x}' or ends_with(dns_query, '.{x}')" for x in SERVICES)}) group by 1), mt as (select src_ip, dst_ip, dst_port, list(distinct method) as ms from q group by all),
  cf as (select src_ip, dst_ip, bool_or(method = 'POST' and regexp_matches(lower(payload), 'card|cc_num|credit|payment|pan=|cardnumber')) as form from q group by all),
  sc as (select v.pkt_id, v.kind, 5 - case when tls.ip is not null then 3 else 0 end - case when two.ip is not null then 2 else 0 end - case when dom.n is not null then 3 + 2 * dom.n else 0 end
    + case when kind <> 'CARD' then 0 when list_contains(ms, 'POST') and form then 3 when list_contains(ms, 'GET') and not list_contains(ms, 'POST') then -2 else 0 end
    - case when v.dst_ip like '192.168.%' or v.dst_ip like '10.%' or v.dst_ip like '172.%' then 2 else 0 end - case when regexp_matches(lower(payload), 'order_id|transaction_id|ref=|tracking|confirmation|"id":|product_id') then 1 else 0 end
    + case when regexp_matches(lower(payload), 'card_number|cc_num|cardnumber|pan=|credit_card|payment_method|cvv') then 2 else 0 end as score
    from v left join tls on tls.ip = v.dst_ip left join two on two.ip = v.dst_ip left join dom on dom.ip = v.dst_ip left join mt on mt.src_ip = v.src_ip and mt.dst_ip = v.dst_ip and mt.dst_port = v.dst_port left join cf on cf.src_ip = v.src_ip and cf.dst_ip = v.dst_ip)
  select pkt_id, kind, score::int as score, case when score >= 5 then 'CRITICAL' when score >= 3 then 'HIGH' else 'MEDIUM' end as risk from sc where score >= 1""")
add("x29_finding_alerts", lambda s, d: (lambda m: payload.finding_alerts(payload.secrets(m), payload.exposures(m)))(messages(s, d)).select("rule_id", "what", "src_ip", "dst_ip", "dst_port", "pkt_id", "category"),
    f"{_FOUND}, o as ({_OPEN}), w as (select 'CREDENTIAL' as rule_id, protocol as what, src_ip, dst_ip, dst_port, ts_ms, pkt_id, 'Credential Exposure' as category from f union all select 'SENSITIVE-DATA', type, src_ip, dst_ip, dst_port, ts_ms, pkt_id, 'Data Exposure' from o) select rule_id, what, src_ip, dst_ip, dst_port, arg_min(pkt_id, ts_ms) as pkt_id, any_value(category) as category from w group by rule_id, what, src_ip, dst_ip, dst_port")
add("x27_insecure_traffic", lambda s, d: payload.insecure_traffic(packets(s, d), (21, 23, 25, 80, 110, 143, 8080)).select("pkt_id", "event"), "select pkt_id, 'unencrypted' as event from packets where dst_port in (21, 23, 25, 80, 110, 143, 8080) and payload_size > 5 and payload = ''")
add("x2_basic_users", lambda s, d: packets(s, d).select(payload.basic_user(F.expr("nullif(regexp_extract(payload, 'Basic ([A-Za-z0-9+/=]+)', 1), '')")).alias("user")).where("user is not null").groupBy("user").agg(F.count("*").alias("n")), "select 'user' as user, count(*) as n from packets where payload like '%Basic dXNlcjpwYXNzd29yZA==%'")
add("x22_attacks", lambda s, d: payload.attacks(packets(s, d)), "select src_ip, dst_ip, 'SQL Injection attempt' as attack, count(*) as n, arg_min(pkt_id, ts_ms) as pkt_id from packets where payload like '%union+select%' group by src_ip, dst_ip")
add("x21_attack_agents", lambda s, d: payload.attack_agents(packets(s, d)), "select src_ip, 'sqlmap' as signature, count(*) as n, min(pkt_id) as first_pkt from packets where payload like '%User-Agent: sqlmap%' group by src_ip")
add("x26_disclosures", lambda s, d: payload.disclosures(packets(s, d)),
    "h as (select dst_ip, dst_port, pkt_id, 'Server' as header, regexp_extract(payload, 'Server: (\\S+)', 1) as value from packets where payload like 'HTTP/%' union all select dst_ip, dst_port, pkt_id, 'X-Powered-By', regexp_extract(payload, 'X-Powered-By: (\\S+)', 1) from packets where payload like 'HTTP/%') select dst_ip, dst_port, header, value, min(pkt_id) as first_pkt, case when value like 'PHP/5.%' or value in ('Apache/2.0', 'Apache/2.1', 'Apache/2.2') then 'HIGH' else 'MEDIUM' end as risk from h group by dst_ip, dst_port, header, value")
_PROFILE = """both_ways as (select src_ip as ip, 1 as sent, length, case when dst_port > 0 then dst_port end as contacted, case when src_port < 1024 and src_port > 0 then src_port end as served, case when protocol = 'ARP' then dst_ip end as arp from packets
  union all select dst_ip, 0, 0, null, case when dst_port < 1024 and dst_port > 0 then dst_port end, null from packets),
  prof as (select ip, sum(sent)::bigint as packets, sum(length)::bigint as bytes, count(distinct contacted) as contacted_ports, count(distinct arp) as arp_targets, count(*) filter (contacted = 443) as tls, coalesce(list(distinct served order by served) filter (served is not null), []) as served from both_ways group by ip)"""
add("a12_device_profiles", lambda s, d: devices.profiles(packets(s, d)).withColumn("served_ports", F.array_join("served_ports", "|")), f"{_PROFILE} select ip, packets, bytes, contacted_ports, arp_targets, tls, array_to_string(served, '|') as served_ports from prof")


def _hits(ports):
    return f"len(list_intersect(served, [{', '.join(map(str, ports))}]))"


_CASES = " ".join(f"when {_hits(p)} >= {n} then '{name}'" for name, p, n in c.DEVICE_PORTS)
_SURE = " ".join(f"when {_hits(p)} >= {n} then least(1.0::double, 0.7::double + {_hits(p)} / 10.0::double)" for _, p, n in c.DEVICE_PORTS)
add("e1_device_classes", lambda s, d: devices.classify(devices.profiles(packets(s, d))).select("ip", "device_type", "confidence"),
    f"{_PROFILE} select ip, case when arp_targets > 10 then 'gateway' {_CASES} when contacted_ports > 20 and tls > 0.1 * packets then 'workstation' when len(served) > 0 and packets > 500 then 'server' else 'unknown' end as device_type, round(case when arp_targets > 10 then least(1.0::double, 0.5::double + arp_targets / 100.0::double) {_SURE} when contacted_ports > 20 and tls > 0.1 * packets then 0.65::double when len(served) > 0 and packets > 500 then 0.6::double else 0.0::double end, 6) as confidence from prof")
