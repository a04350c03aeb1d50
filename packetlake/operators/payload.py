"""Findings in payload text: credentials, attack patterns, disclosures, sensitive numbers. Only masked values and hashes leave."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.functions import net
from packetlake.operators.intel import under
from packetlake.operators.stored import held, stored

# Ports of web servers, update services whose hashed log-ins are of low risk, services that send no agent.
HTTP_PORTS = (80, 3000, 4200, 5000, 8000, 8008, 8080, 8081, 8888, 9090)
SERVER_PORTS = (80, 443, 3000, 4200, 5000, 8000, 8008, 8080, 8081, 8443, 8888, 9090)
DIGEST_SERVICES = ("update.eset.com", "eset.com", "update.nod32.com")
TOKEN_SERVICES = ("update.eset.com", "eset.com")
SILENT_SERVICES = ("update.eset.com", "eset.com", "windowsupdate.com", "update.microsoft.com", "ctldl.windowsupdate.com", "download.windowsupdate.com")
BASIC = r"(?i)Authorization:\s*Basic\s+([A-Za-z0-9+/=]+)"
# Clear-text secrets by protocol. (kind, protocol, field, ports (None: any), only as destination, pattern, letters shown (None: all))
SECRETS = (
    ("FTP_USER", "FTP", "username", (21,), False, r"(?i)USER\s+(\S+)", None),
    ("FTP_PASS", "FTP", "password", (21,), False, r"(?i)PASS\s+(\S+)", 3),
    ("HTTP_API_KEY", "API Key", "key", HTTP_PORTS, False, r"(?i)(?:x-api-key|api-key|apikey|x-auth-token|x-access-token):\s*(\S+)", 6),
    ("HTTP_FORM", "HTTP Form", "password_field", HTTP_PORTS, False, r"(?i)(?:password|passwd|pass|pwd|secret|token|api_key|apikey|auth)\s*[=:]\s*([^\s&\r\n]{1,200})", 3),
    ("TELNET_LOGIN", "Telnet", "username", (23,), False, r"(?i)(?:login|username)[\s:]+(\S+)", None),
    ("TELNET_PASS", "Telnet", "password", (23,), False, r"(?i)(?:password|passwd)[\s:]+(\S+)", 3),
    ("SMTP_AUTH", "SMTP", "auth_attempt", (25, 587), True, r"(?i)AUTH\s+(LOGIN|PLAIN)\s*.*", None),
    ("POP3_USER", "POP3", "username", (110,), False, r"(?i)USER\s+(\S+)", None),
    ("POP3_PASS", "POP3", "password", (110,), False, r"(?i)PASS\s+(\S+)", 3),
    ("REDIS_AUTH", "Redis", "auth_password", (6379,), False, r"(?i)AUTH\s+(\S+)", 3),
    ("MONGO_AUTH", "MongoDB", "auth_data", (27017,), False, r"""(?i)(?:authenticate|createUser|pwd)\s*[=:]\s*["']?(\S+)""", 3),
    ("SIP_DIGEST", "SIP/VoIP", "digest_auth", (5060,), False, r"(?i)(?:Authorization|Proxy-Authorization):\s*Digest\s+(.+?)(?:\r?\n)", 20),
    ("IRC_PASS", "IRC", "password", (6667, 6668, 6669), False, r"(?i)PASS\s+(\S+)", 3),
)
# What payloads show besides secrets. (type, ports (None: any), source ports, pattern, risk)
EXPOSURES = (
    ("VNC Session", (5900, 5901, 5800), (5900, 5901), r"RFB\s+\d+\.\d+", "CRITICAL"),
    ("MQTT/IoT", (1883,), (), r"^\x10", "HIGH"),
    ("rsync", (873,), (873,), r"(?i)@RSYNCD:", "HIGH"),
    ("Elasticsearch", (9200,), (9200,), r"/_search|/_cat|/_cluster", "CRITICAL"),
    ("Private Key", None, (), r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "CRITICAL"),
)
PRINTER_PORTS, PRINT_BYTES = (515, 631, 9100), 100
# Parts of user agents of automation tools, in order, after those of attack tools.
AUTOMATION_AGENTS = ("scrapy", "mechanize", "phantom", "headless", "selenium", "puppeteer", "playwright", "httpclient", "aiohttp", "httpx", "zgrab", "censys", "shodan", "crawler", "spider", "bot/")
# Names near a number that speak against and for a card.
BENIGN_CLUES = ("order_id", "transaction_id", "ref=", "tracking", "confirmation", '"id":', "product_id")
CARD_CLUES = ("card_number", "cc_num", "cardnumber", "pan=", "credit_card", "payment_method", "cvv")
CARD_FIELDS = ("card", "cc_num", "credit", "payment", "pan=", "cardnumber")
# Request patterns in order; the first that fits names the attack.
ATTACKS = (
    ("SQL Injection attempt", r"(?i)(?:union\+select|union%20select|select\+.*\+from|insert\+into|drop\+table|'%20or%20'1'='1|%27%20or)"),
    ("Path traversal attempt", r"(?i)(?:\.\./\.\./|\.\.\\\.\.\\|%2e%2e%2f|%252e%252e)"),
    ("Command injection attempt", r"(?i)(?:;(?:ls|cat|id|whoami|uname|wget|curl|nc|bash|sh)\b|\|(?:ls|cat|id|whoami)\b)"),
    ("Log4Shell (CVE-2021-44228) exploit attempt", r"(?i)\$\{jndi:"),
    ("Shellshock (CVE-2014-6271) exploit attempt", r"\(\)\s*\{\s*:"),
    ("Webshell access attempt", r"(?i)(?:/(?:cmd|shell|c99|r57|b374k|wso)\.(php|asp|jsp))"),
    ("WordPress exploit probe", r"(?i)(?:/wp-(?:admin|login|content/uploads)/.*\.php\?)"),
    ("Admin panel probe", r"(?i)^(?:GET|POST|PUT)\s+/(?:phpmyadmin|adminer|manager/html|jenkins|solr)(?:/|\s)"),
)
# Parts of user agents of attack tools, in order; the first that fits is the signature.
ATTACK_AGENTS = (
    "nikto", "sqlmap", "nmap", "masscan", "zmap", "dirbuster", "gobuster", "feroxbuster", "ffuf", "wfuzz", "burpsuite", "burp suite", "owasp", "metasploit", "cobalt strike", "empire",
    "blacksun", "black sun", "zmeu", "morfeus", "openvas", "nessus", "havij", "acunetix", "netsparker", "appscan", "w3af", "arachni", "skipfish", "vega/",
    "botnet", "mirai", "muhstik", "tsunami", "gafgyt", "hajime", "satori",
    "python-requests", "python-urllib", "go-http-client", "libwww-perl", "lwp-", "wget/", "curl/", "java/", "okhttp", "httpclient", "winhttp", "httpie",
    "${jndi", "() { :",
)


FOUND_IN = ("pkt_id", "ts_ms", "src_ip", "dst_ip", "dst_port")


def _on(ports, only_dst: bool) -> Column:
    if ports is None:
        return F.lit(True)
    here = F.col("dst_port").isin(*ports)
    return here if only_dst else here | F.col("src_port").isin(*ports)


def _per_rule(packets: DataFrame, rules, text: str) -> DataFrame:
    """Packets of four letters or more, once for each rule whose ports (None: any) they have: the text as `_t`, the rule's number as `_rule`.

    rules: (ports of the destination, ports of the source) of each rule. The ports are looked up, so that a rule's
    patterns run over the packets of its ports alone, and once each; the text is worked out once.
    """
    none = F.array().cast("array<int>")

    def of(side: int) -> Column:
        by: dict[int, list] = {}
        for k, ports in enumerate(rules):
            for port in ports[side] or ():
                by.setdefault(port, []).append(k)
        found = F.create_map(*[x for port, ks in by.items() for x in (F.lit(port), F.array(*map(F.lit, ks)))])
        return F.coalesce(found[F.col(("dst_port", "src_port")[side])], none)

    always = [F.lit(k) for k, ports in enumerate(rules) if ports[0] is None]
    numbers = F.array_union(of(0), of(1))
    numbers = F.concat(numbers, F.array(*always)) if always else numbers
    return held(packets, _t=F.col(text)).where(F.length("_t") >= 4).withColumn("_rule", F.explode(numbers))


def _by_rule(values: dict) -> Column:
    """The value of a row's rule (of its number, or of one among a tuple of numbers); null for other rules."""
    out = F
    for k, value in values.items():
        out = out.when(F.col("_rule").isin(*k) if isinstance(k, tuple) else F.col("_rule") == k, value)
    return out


def _any(text: Column, parts) -> Column:
    return functools.reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in parts])


def secrets(packets: DataFrame, text: str = "payload") -> DataFrame:
    """One row a finding: kind, protocol, field, severity, masked value, note (host and the like) and the value's hash; the value itself is not kept."""
    t, v, host = F.col("_t"), F.col("_v"), F.col("_host")
    names, rules, first = [], [], {}  # (kind, protocol, field) and ports of each rule, and what its pattern finds

    def rule(kind, protocol, field, ports, only_dst, value) -> int:
        names.append((kind, protocol, field))
        rules.append((ports, () if only_dst else ports))
        first[len(names) - 1] = value
        return len(names) - 1

    for kind, protocol, field, ports, only_dst, pattern, _ in SECRETS:
        rule(kind, protocol, field, ports, only_dst, F.regexp_extract(t, pattern, 1))
    form = [kind for kind, *_ in names].index("HTTP_FORM")
    # a user and password in base64, of web servers and of cameras
    pair = F.try_to_binary(F.nullif(F.regexp_extract(t, BASIC, 1), F.lit("")), F.lit("base64")).cast("string")
    basic, camera = (rule(kind, protocol, "credentials", ports, False, pair) for kind, protocol, ports in (("HTTP_BASIC", "HTTP Basic Auth", HTTP_PORTS), ("RTSP_BASIC", "RTSP/Camera", (554,))))
    # hashed log-ins of web servers, and other tokens of the same header: of low risk where an update service asks for them
    digest = rule("HTTP_DIGEST", "HTTP Digest Auth", "digest_credentials", HTTP_PORTS, False, F.regexp_extract(t, r"(?i)Authorization:\s*Digest\s+(.+?)(?:\r?\n)", 1))
    token = rule("HTTP_TOKEN", "HTTP Auth Token", "token", HTTP_PORTS, False, F.regexp_extract(t, r"(?i)Authorization:\s*(\S+\s+\S+)", 1))
    login = r'(?i)LOGIN\s+"?(\S+?)"?\s+"?(\S+?)"?(?:\s|$)'
    imap = rule("IMAP_LOGIN", "IMAP", "login", (143,), True, F.regexp_extract(t, login, 1))
    low = F.lower(t)
    snmp = rule("SNMP", "SNMP", "community_string", (161, 162), True, F.when(F.contains(low, F.lit("public")), "public").when(F.contains(low, F.lit("private")), "private"))

    # each step is held, so that no pattern runs again for the next one
    rows = held(_per_rule(packets, rules, text), _v=_by_rule(first)).where(v != "")
    is_pair = F.col("_rule").isin(basic, camera)
    rows = rows.where(~is_pair | F.contains(v, F.lit(":"))).where((F.col("_rule") != token) | ~F.contains(v, F.lit("Basic")) & ~F.contains(v, F.lit("Digest")))
    part = lambda name, none: F.coalesce(F.nullif(F.regexp_extract(t, f'(?i){name}="([^"]+)"', 1), F.lit("")), F.lit(none))
    rows = held(rows, _host=F.when(F.col("_rule").isin(form, basic, digest, token), F.regexp_extract(t, r"(?i)Host:\s*(\S+)", 1)).otherwise(""),
                _second=_by_rule({imap: F.regexp_extract(t, login, 2), form: F.substring(F.regexp_extract(t, REQUEST, 2), 1, 100)}),
                _p=F.when(F.col("_rule") == digest, F.struct(*[part(n, none).alias(n) for n, none in (("username", "?"), ("realm", "?"), ("uri", "?"), ("nonce", ""), ("response", ""))])))
    p = F.col("_p")
    rows = held(rows, _update=F.coalesce(_by_rule({digest: _any(F.lower(host), DIGEST_SERVICES), token: _any(F.lower(host), TOKEN_SERVICES)}), F.lit(False)),
                _value=F.coalesce(_by_rule({digest: F.concat(F.lit("username="), p.username, F.lit(", realm="), p.realm, F.lit(", uri="), p.uri, F.lit(", nonce="), p.nonce, F.lit(", response="), p.response), imap: F.concat_ws(":", v, F.col("_second"))}), v))
    update, shown = F.col("_update"), F.array(*[F.lit(show).cast("int") for *_, show in SECRETS])
    who = F.concat(p.username, F.lit("@"), p.realm)
    masked = _by_rule({
        tuple(k for k, x in enumerate(SECRETS) if x[-1] is None) + (snmp,): v, tuple(k for k, x in enumerate(SECRETS) if x[-1] is not None): net.mask(v, F.get(shown, F.col("_rule"))),
        (basic, camera): F.concat(F.substring_index(v, ":", 1), F.lit(":"), net.mask(F.substring(v, F.locate(":", v) + 1, F.length(v)))),
        digest: F.when(update, F.concat(who, F.lit(" via "), host, F.lit(" (hashed, not plaintext)"))).otherwise(F.concat(who, F.lit(" (uri: "), p.uri, F.lit(")"))),
        token: F.concat(net.mask(v, 8), F.when(update, F.concat(F.lit(" via "), F.lower(host))).otherwise("")), imap: F.concat(v, F.lit(":"), net.mask(F.col("_second"))),
    })
    said = lambda k: F.get(F.array(*[F.lit(n[k]) for n in names]), F.col("_rule"))
    return rows.select(
        *FOUND_IN, said(0).alias("kind"), F.when(update, F.concat(said(1), F.lit(" (Update Service)"))).otherwise(said(1)).alias("protocol"), F.when(update & (F.col("_rule") == digest), "digest_hash").otherwise(said(2)).alias("field"),
        F.when(update, "LOW").otherwise("CRITICAL").alias("severity"), masked.alias("masked"), F.when(F.col("_rule") == form, F.concat_ws(" ", host, F.col("_second"))).otherwise(host).alias("note"), F.sha2("_value", 256).alias("fingerprint"),
    )


REQUEST = r"(?i)^(GET|POST|PUT|DELETE|PATCH)\s+(\S+)\s+HTTP"


def exposures(packets: DataFrame, text: str = "payload") -> DataFrame:
    """One row for each thing that a payload lays open besides secrets: type, risk and text."""
    t, v = F.col("_t"), F.col("_v")
    names = [(kind, risk) for kind, _, _, _, risk in EXPOSURES] + [("Network Printer", "MEDIUM"), ("Redis No Auth", "CRITICAL"), ("Session Cookie", "HIGH"), ("Session Cookie", "HIGH")]
    rules = [(ports, back) for _, ports, back, _, _ in EXPOSURES] + [(PRINTER_PORTS, ()), ((6379,), (6379,)), (HTTP_PORTS, HTTP_PORTS), (HTTP_PORTS, HTTP_PORTS)]
    first = {k: F.when(t.rlike(pattern), "") for k, (_, _, _, pattern, _) in enumerate(EXPOSURES)}
    printer, redis, *cookies = range(len(EXPOSURES), len(names))
    first[printer] = F.when(F.col("payload_size") > PRINT_BYTES, F.col("payload_size").cast("string"))
    commands = (t.startswith("*") & F.contains(t, F.lit("SET"))) | F.contains(t, F.lit("GET"))
    first[redis] = F.when(commands & ~t.rlike(r"(?i)AUTH\s+(\S+)"), "")
    outside = ~(F.col("dst_ip").startswith("192.168.") | F.col("dst_ip").startswith("10.") | F.col("dst_ip").startswith("172.") | (F.col("dst_ip") == "127.0.0.1"))
    for k, header in zip(cookies, ("Cookie", "Set-Cookie")):
        first[k] = F.when(outside, F.regexp_extract(t, rf"(?i){header}:\s*(.+?)(?:\r?\n)", 1))
    rows = held(_per_rule(packets, rules, text), _v=_by_rule(first)).where("_v is not null")
    rows = rows.where(~F.col("_rule").isin(*cookies) | _any(F.lower(v), ("session", "auth", "token", "sid")))
    said = lambda k: F.get(F.array(*[F.lit(n[k]) for n in names]), F.col("_rule"))
    return rows.select(*FOUND_IN, said(0).alias("type"), said(1).alias("risk"), F.when(F.col("_rule").isin(*cookies), F.substring(v, 1, 80)).otherwise(v).alias("value"))


def heartbeats(packets: DataFrame, text: str = "payload") -> DataFrame:
    """Devices that send their address and a token in clear: one row for each (mac, token), the first; `alert` for the first of each mac."""
    pattern = r"(?i)([0-9a-f]{12})\s+(K\d+)\s+GETEIP\s+(\d+\.\d+\.\d+\.\d+)\s+([0-9a-f]{40})"
    names = ("mac", "device", "wan_ip", "token")
    rows = packets.where(F.col(text).rlike(pattern)).select(*FOUND_IN, *[F.regexp_extract(text, pattern, k + 1).alias(n) for k, n in enumerate(names)])
    first = rows.groupBy("mac", "token").agg(F.min_by(F.struct(*FOUND_IN, "device", "wan_ip"), F.struct("ts_ms", "pkt_id")).alias("x"), F.count("*").alias("n"))
    macs = rows.groupBy("mac").agg(F.min_by("pkt_id", F.struct("ts_ms", "pkt_id")).alias("_first"))
    out = first.select("mac", F.concat(F.substring("token", 1, 12), F.lit("...")).alias("token"), F.sha2("token", 256).alias("fingerprint"), "n", "x.*").join(macs, "mac")
    return out.withColumn("alert", F.col("pkt_id") == F.col("_first")).drop("_first")


def connections(packets: DataFrame, text: str = "payload") -> DataFrame:
    """What in_context asks of all packets, a row for each (source, destination, port): tls, the methods used (METHODS, one flag each) and whether fields like a card's were posted. Stored."""
    rows = held(packets, _t=F.when(_on(HTTP_PORTS, False), F.col(text)))
    rows = held(rows, _method=F.upper(F.regexp_extract("_t", REQUEST, 1)))
    rows = rows.withColumn("_card", F.when(F.col("_method") != "", (F.col("_method") == "POST") & _any(F.lower("_t"), CARD_FIELDS)))
    used = [F.coalesce(F.bool_or(F.col("_method") == m), F.lit(False)).alias(m) for m in METHODS]
    return stored(rows.groupBy("src_ip", "dst_ip", "dst_port").agg(F.coalesce(F.bool_or("is_encrypted"), F.lit(False)).alias("tls"), F.bool_or("_card").alias("card_form"), *used))


#: Request methods, in order of their names.
METHODS = ("DELETE", "GET", "PATCH", "POST", "PUT")


def form_context(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of `connections`: the methods that each (source, destination, port) used, and whether each (source, destination) posted fields that look like a card's."""
    rows = links.where(functools.reduce(Column.__or__, [F.col(m) for m in METHODS]))
    methods = rows.select("src_ip", "dst_ip", "dst_port", F.array_compact(F.array(*[F.when(F.col(m), m) for m in METHODS])).alias("methods"))
    return methods, rows.groupBy("src_ip", "dst_ip").agg(F.bool_or("card_form").alias("card_form"))


def in_context(found: DataFrame, packets: DataFrame, domains: DataFrame, known: DataFrame, text: str = "payload") -> DataFrame:
    """Sensitive numbers (rows of `sensitive` with their packet's columns and payload) with a context score and its risk; those that score 0 or less are dropped.

    domains: ip, domain pairs; known: names of large services. A number starts with 5 points; encrypted traffic to the same
    address, web ports 80 and 443 side by side, known services behind it, an address inside and names of other numbers
    speak against it, a posted form with a card's fields and a card's names for it.
    """
    links = connections(packets, text)
    tls = links.where("tls").select(F.explode(F.array("src_ip", "dst_ip")).alias("dst_ip")).distinct().withColumn("_tls", F.lit(True))
    two = links.where("dst_port in (80, 443)").groupBy("dst_ip").agg((F.countDistinct("dst_port") == 2).alias("_two"))
    services = domains.join(under(domains, known), "domain", "left_semi").groupBy(F.col("ip").alias("dst_ip")).agg(F.countDistinct("domain").alias("_services"))
    methods, fields = form_context(links)
    rows = found.join(tls, "dst_ip", "left").join(two, "dst_ip", "left").join(services, "dst_ip", "left").join(methods, ["src_ip", "dst_ip", "dst_port"], "left").join(fields, ["src_ip", "dst_ip"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    used = F.coalesce("methods", F.array().cast("array<string>"))
    get_only = F.array_contains(used, "GET") & ~F.array_contains(used, "POST")
    card = F.when(F.col("kind") != "CARD", 0).when(F.array_contains(used, "POST") & yes(F.col("card_form")), 3).when(get_only, -2).otherwise(0)
    inside = F.col("dst_ip").startswith("192.168.") | F.col("dst_ip").startswith("10.") | F.col("dst_ip").startswith("172.") | (F.col("dst_ip") == "127.0.0.1")
    low, n = F.lower(F.col(text)), F.coalesce("_services", F.lit(0))
    score = 5 - F.when(yes(F.col("_tls")), 3).otherwise(0) - F.when(yes(F.col("_two")), 2).otherwise(0) - F.when(n > 0, 3 + 2 * n).otherwise(0) + card
    score = score - F.when(inside, 2).otherwise(0) - F.when(_any(low, BENIGN_CLUES), 1).otherwise(0) + F.when(_any(low, CARD_CLUES), 2).otherwise(0)
    risk = F.when(F.col("score") >= 5, "CRITICAL").when(F.col("score") >= 3, "HIGH").when(F.col("score") >= 1, "MEDIUM")
    return rows.withColumn("score", score.cast("int")).withColumn("risk", risk).where("risk is not null").select(*found.columns, "score", "risk")


def distinct_secrets(found: DataFrame) -> DataFrame:
    """The findings store: one row for each secret and connection, with first and last sight and a count."""
    return found.groupBy("kind", "src_ip", "dst_ip", "dst_port", "fingerprint", "masked").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n"))


def basic_user(header: Column) -> Column:
    return F.substring_index(F.decode(F.unbase64(header), "UTF-8"), ":", 1)


def attacks(packets: DataFrame, text: str = "payload") -> DataFrame:
    """First attack pattern of a request's header region, once for each (source, destination, attack)."""
    head = F.col("head")
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(ATTACKS):
        kind = F.when(head.rlike(pattern), name).otherwise(kind)
    # a generator, so that the text is read off once and not once a pattern
    rows = packets.where(F.length(text) > 0).select("src_ip", "dst_ip", "ts_ms", "pkt_id", F.substring(text, 1, 2048).alias("head"))
    rows = rows.select("*", F.explode(F.filter(F.array(kind), lambda x: x.isNotNull())).alias("attack"))
    return rows.groupBy("src_ip", "dst_ip", "attack").agg(F.min(F.struct("ts_ms", "pkt_id")).alias("x"), F.count("*").alias("n")).select("src_ip", "dst_ip", "attack", "n", F.col("x.pkt_id").alias("pkt_id"))


def agents(packets: DataFrame, text: str = "payload") -> DataFrame:
    """Requests with an attack tool's, an automation tool's, a very short or no user agent, once for each (source, signature)."""
    t = F.col(text)
    agent = F.trim(F.regexp_extract(t, r"(?i)User-Agent:[ \t]*([^\r\n]+)", 1))
    first = lambda parts: F.get(F.filter(F.array(*map(F.lit, parts)), lambda x: F.contains(F.lower(agent), x)), F.lit(0))
    has = t.rlike(r"(?i)User-Agent:[ \t]*[^\r\n]+")
    silent = ~has & t.rlike(REQUEST) & ~_any(F.lower(F.regexp_extract(t, r"(?i)Host:\s*(\S+)", 1)), SILENT_SERVICES)
    rows = packets.where(F.col("dst_port").isin(*HTTP_PORTS) & (F.length(t) >= 4)).withColumns({"_bad": F.when(has, first(ATTACK_AGENTS)), "_tool": F.when(has, first(AUTOMATION_AGENTS))})
    short = has & (F.length(agent) < 5) & (agent != "")
    kind = F.when(F.col("_bad").isNotNull(), F.struct(F.col("_bad").alias("signature"), F.lit("CRITICAL").alias("risk")))
    kind = kind.when(F.col("_tool").isNotNull(), F.struct(F.col("_tool").alias("signature"), F.lit("HIGH").alias("risk")))
    kind = kind.when(short, F.struct(F.lit("short_ua").alias("signature"), F.lit("MEDIUM").alias("risk"))).when(silent, F.struct(F.lit("no_ua").alias("signature"), F.lit("MEDIUM").alias("risk")))
    rows = rows.withColumn("k", kind).where("k is not null").select("src_ip", "pkt_id", "k.*")
    return rows.groupBy("src_ip", "signature", "risk").agg(F.count("*").alias("n"), F.min("pkt_id").alias("first_pkt"))


def attack_agents(packets: DataFrame, text: str = "payload") -> DataFrame:
    return agents(packets, text).where("risk = 'CRITICAL'").select("src_ip", "signature", "n", "first_pkt")


def disclosures(packets: DataFrame, text: str = "payload") -> DataFrame:
    """Response headers that name software, once for each server and header; a version makes them MEDIUM, an old one HIGH."""
    names = F.array(*[F.struct(F.lit(h).alias("header"), F.regexp_extract(text, rf"(?i)\b{h}:\s*(\S+)", 1).alias("value")) for h in ("Server", "X-Powered-By", "X-AspNet-Version", "X-PHP-Version", "X-Generator")])
    rows = packets.where(F.col(text).startswith("HTTP/")).select("src_ip", "dst_ip", "dst_port", "pkt_id", F.explode(F.filter(names, lambda x: x["value"] != "")).alias("f"))
    risk = F.when(F.col("value").rlike(r"^(PHP/[45]\.|Apache/2\.[012]$)|Apache/2\.[0-2]\.|PHP/[45]\.|IIS/[5-7]\.|nginx/1\.[0-9]\.|OpenSSL/0\.|ASP\.NET.*[1-3]\."), "HIGH").when(F.col("value").rlike(r"\d+\.\d+"), "MEDIUM").otherwise("LOW")
    return rows.groupBy("dst_ip", "dst_port", F.col("f.header").alias("header"), F.col("f.value").alias("value")).agg(F.min("pkt_id").alias("first_pkt")).withColumn("risk", risk)


def sensitive(packets: DataFrame, text: str = "payload") -> DataFrame:
    """Card numbers that pass the check digit, and social security numbers, masked; answers of web servers are not looked at."""
    t = F.col("_t")
    rows = held(packets.where(~F.col("src_port").isin(*SERVER_PORTS)), _t=F.col(text)).where(F.length(t) >= 4)
    rows = held(rows, _card=F.regexp_extract(t, r"(4\d{15}|5[1-5]\d{14}|3[47]\d{13}|6(?:011|5\d{2})\d{12})", 1), _ssn=F.regexp_extract(t, r"\b(\d{3}-\d{2}-\d{4})\b", 1))
    card, ssn = F.col("_card"), F.col("_ssn")
    found = F.array(
        F.when((card != "") & net.luhn(F.when(card != "", card).otherwise("0")), F.struct(F.lit("CARD").alias("kind"), F.concat(F.lit("****"), F.right(card, F.lit(4))).alias("masked"))),
        F.when(ssn != "", F.struct(F.lit("SSN").alias("kind"), F.concat(F.lit("***-**-"), F.right(ssn, F.lit(4))).alias("masked"))),
    )
    rows = rows.where((card != "") | (ssn != "")).select(*FOUND_IN, t.alias(text), F.explode(found).alias("f")).where("f is not null")
    return rows.select(*FOUND_IN, text, "f.kind", "f.masked")


def finding_alerts(found: DataFrame, exposed: DataFrame) -> DataFrame:
    """Alerts of findings: a secret once for each (protocol, source, destination, port), an exposure once for each (type, source, destination, port)."""
    secret = found.select(*FOUND_IN, F.lit("CREDENTIAL").alias("rule_id"), "severity", F.lit("Credential Exposure").alias("category"), F.col("protocol").alias("what"))
    open_ = exposed.select(*FOUND_IN, F.lit("SENSITIVE-DATA").alias("rule_id"), F.col("risk").alias("severity"), F.lit("Data Exposure").alias("category"), F.col("type").alias("what"))
    keys = ["rule_id", "what", "src_ip", "dst_ip", "dst_port"]
    first = secret.unionByName(open_).groupBy(*keys).agg(F.min_by(F.struct("ts_ms", "pkt_id", "severity", "category"), F.struct("ts_ms", "pkt_id")).alias("x"))
    return first.select(*keys, "x.*")


def insecure_traffic(packets: DataFrame, ports: tuple[int, ...], text: str = "payload") -> DataFrame:
    """Timeline events of plain-text traffic: payload sizes over 5 on insecure ports of which no bytes were kept."""
    return packets.where(F.col("dst_port").isin(*ports) & (F.col("payload_size") > 5) & (F.col(text) == "")).select(*FOUND_IN, F.lit("unencrypted").alias("event"))


def timeline(*events: DataFrame) -> DataFrame:
    """All events (ts_ms, event and the packet's columns) in order of time."""
    return functools.reduce(DataFrame.unionByName, [e.select(*FOUND_IN, "event") for e in events]).orderBy("ts_ms", "pkt_id", "event")
