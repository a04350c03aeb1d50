"""Alert verification: additive scores over an alert's evidence and context, a verdict and a confidence."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.functions import net
from packetlake.operators.stored import held

# Cut-offs of the verdicts (least score, verdict), the last one for all that is lower.
CUTS = {
    "usual": ((3, "VERIFIED_THREAT"), (1, "LIKELY_THREAT"), (0, "INCONCLUSIVE"), (None, "LIKELY_FALSE_POSITIVE")),
    "address": ((3, "VERIFIED_THREAT"), (1, "LIKELY_THREAT"), (-1, "INCONCLUSIVE"), (None, "LIKELY_FALSE_POSITIVE")),
    "brute": ((4, "VERIFIED_THREAT"), (2, "LIKELY_THREAT"), (None, "INCONCLUSIVE")),
    "upload": ((4, "VERIFIED_THREAT"), (2, "LIKELY_THREAT"), (0, "INCONCLUSIVE"), (-2, "LIKELY_FALSE_POSITIVE"), (None, "FALSE_POSITIVE")),
    "port": ((2, "LIKELY_THREAT"), (1, "INCONCLUSIVE"), (None, "LIKELY_FALSE_POSITIVE")),
    "flood": ((2, "LIKELY_THREAT"), (0, "INCONCLUSIVE"), (None, "LIKELY_FALSE_POSITIVE")),
    "likely": ((None, "LIKELY_THREAT"),),
}
# Services, names, ports and programs that speak for or against an alert.
HIGH_VALUE = ("SSH", "RDP", "SMB", "MSSQL", "MySQL", "PostgreSQL")
SCANNERS = ("shodan.io", "censys.io", "shadowserver.org", "binaryedge.io", "zoomeye.org", "onyphe.io", "recyber.net", "stretchoid.com", "internet-measurement.com", "internet-census.org")
COMMON_PORTS = (21, 22, 23, 25, 53, 80, 110, 143, 443, 445, 993, 995, 3306, 3389, 5432, 8080, 8443)
TRANSFER_SERVICES = (
    "windowsupdate.com", "download.microsoft.com", "delivery.mp.microsoft.com", "officecdn.microsoft.com", "update.microsoft.com", "dl.google.com", "redirector.googlevideo.com", "cache.google.com",
    "swcdn.apple.com", "updates.cdn-apple.com", "appldnld.apple.com", "steampowered.com", "steamcontent.com", "content.steampowered.com", "epicgames-download1.akamaized.net", "download.epicgames.com",
    "dropbox.com", "dl.dropboxusercontent.com", "onedrive.live.com", "skyapi.onedrive.live.com", "icloud-content.com", "drive.google.com", "docs.google.com", "github.com",
    "objects.githubusercontent.com", "releases.ubuntu.com", "archive.ubuntu.com", "cdn.discordapp.com", "media.discordapp.net", "akamai.net", "akamaized.net", "cloudfront.net", "fbcdn.net",
)
CDN_LABEL = r"(?i)^[a-f0-9]{24,}$|^[a-z0-9]{20,}-[a-z0-9]+$|^v\d+\.|^[a-z]{2}\d*\.|cdn|cache|static|assets|media|edge|origin|lb|pool"
ABUSED_TLDS = ("xyz", "top", "buzz", "tk", "ml", "ga", "cf", "gq", "icu")
TRANSFER_PROGRAMS = ("onedrive.exe", "dropbox.exe", "googledrivesync.exe", "icloudservices.exe", "steam.exe", "steamwebhelper.exe", "chrome.exe", "firefox.exe", "msedge.exe", "windowsupdate", "svchost.exe", "bits")
BROWSERS = ("chrome.exe", "firefox.exe", "msedge.exe", "brave.exe")
SAFE_PROGRAMS = ("chrome.exe", "firefox.exe", "msedge.exe", "svchost.exe", "system", "steam.exe")
NIGHT_PROGRAMS = ("svchost.exe", "windowsupdate", "onedrive.exe", "dropbox.exe", "steam.exe", "msedge.exe", "chrome.exe", "backblaze.exe", "crashpad_handler.exe", "system", "bits")
CRITICAL_TYPES = ("Private Key", "Credit Card", "SSN", "Modbus WRITE", "BACnet WRITE", "BACnet RESET", "SMBv1", "VNC Session")
PROCESS_RULES = ("IOC-SUSPICIOUS-PROC", "IOC-PROC-NAME")


def points(test: Column, n: int) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)


def _first(value: Column, *steps: tuple[float, int]) -> Column:
    """Points of the first step that the value is over."""
    return functools.reduce(lambda out, s: F.when(value > s[0], s[1]).otherwise(out), reversed(steps), F.lit(0))


def _verdict(score: Column, cuts) -> Column:
    out = F.lit(cuts[-1][1])
    for least, name in reversed(cuts[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def _scan(ports: Column, n: Column) -> Column:
    """Points of a scan's ports: one after the other, and those of common services."""
    next_to = F.size(F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.size(ports), F.lit(2))), lambda i: F.coalesce(F.get(ports, i - 1) - F.get(ports, i - 2), F.lit(0))), lambda d: d == 1))
    common = F.size(F.array_intersect(ports, F.array(*map(F.lit, COMMON_PORTS))))
    return points(next_to > 0.5 * F.size(ports), 1) + points(common > 0.7 * F.size(F.array_distinct(ports)), 1) + _first(n, (100, 2), (30, 1))


def _under(name: Column, names) -> Column:
    return functools.reduce(Column.__or__, [F.endswith(name, F.lit(x)) for x in names])


def with_context(found: DataFrame, rdns: DataFrame | None = None, indicators: DataFrame | None = None) -> DataFrame:
    """Add src_name and dst_name (reverse names: ip, name) and src_listed and dst_listed (indicators: ip) to alerts; without a table they are null and false."""
    for side in ("src", "dst"):
        ip = f"{side}_ip"
        found = found.join(rdns.select(F.col("ip").alias(ip), F.col("name").alias(f"{side}_name")), ip, "left") if rdns is not None else found.withColumn(f"{side}_name", F.lit(None).cast("string"))
        if indicators is not None:
            found = found.join(indicators.select(F.col("ip").alias(ip)).distinct().withColumn(f"{side}_listed", F.lit(True)), ip, "left")
            found = found.withColumn(f"{side}_listed", F.coalesce(f"{side}_listed", F.lit(False)))
        else:
            found = found.withColumn(f"{side}_listed", F.lit(False))
    return found


def verify(found: DataFrame, cfg: c.Config = c.DEFAULT, rdns: DataFrame | None = None, indicators: DataFrame | None = None) -> DataFrame:
    """Add score, verdict, confidence, title prefix and the adjusted severity to alerts with an evidence map.

    cfg.cloud_suffixes: names of large services; cfg.gateways: addresses of gateways. Evidence that is absent counts for
    nothing, but an alert without a known domain counts as one to an address alone.
    """
    is_rule = lambda name: F.col("rule_id") == name
    ports = F.array_sort(F.filter(F.transform(F.split(F.coalesce(F.col("evidence")["ports"], F.lit("")), ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull()))
    rows = held(with_context(found, rdns, indicators), _ports=F.when(is_rule("PORT-SCAN"), ports))
    said = lambda name: F.coalesce(F.col("evidence")[name], F.lit(""))
    ev = lambda name: F.col("evidence")[name].try_cast("double")
    cloud = lambda name: F.coalesce(net.in_suffixes(F.lower(name), cfg.cloud_suffixes), F.lit(False))
    local, process, query = net.is_private(F.col("src_ip")), F.lower(said("process")), said("query")
    label = F.substring_index(query, ".", 1)
    asked = F.coalesce(F.col("evidence")["queried_domain"], F.lit(""))
    asked_label = F.substring_index(asked, ".", 1)
    matched_name = F.when(said("direction") == "inbound", F.col("src_name")).otherwise(F.col("dst_name"))
    clouds, others = said("cloud_domains") != "", said("unknown_domains") != ""
    domains = F.filter(F.split(said("destination_domains"), ","), lambda x: x != "")
    unusual = F.split(F.lower(said("what_is_unusual")), r"\|")
    moved = F.aggregate(unusual, F.lit(0), lambda acc, x: acc + F.when(F.contains(x, F.lit("bandwidth")) & F.contains(x, F.lit("above")), -1).when(F.contains(x, F.lit("encrypted")), -1).when(F.contains(x, F.lit("unique dest ports")), -1).when(F.contains(x, F.lit("syn ratio")) & F.contains(x, F.lit("above")), 1).when(F.contains(x, F.lit("failed connection")), 1).otherwise(0))
    port, packets, size = F.coalesce(ev("port").cast("int"), F.col("dst_port")), F.coalesce(ev("packets_observed"), F.lit(0)), F.coalesce(ev("bytes_transferred"), F.lit(0))
    https = said("has_https") == "true"
    web = F.when((size < 2000) & (packets < 10), -3).when((size < 10000) & https, -2).otherwise(1) - F.when(https, 3).otherwise(0) - points(cloud(F.col("dst_name")), 2)
    service = F.when((said("service") == "HTTP") | (port == 80), web).when(port.isin(21, 23, 5900, 6379, 27017, 9200), 3 + points(packets > 20, 1)).when(port.isin(1433, 3306, 5432, 1521), 2).when(port.isin(502, 47808), 3).otherwise(1)
    rules = {
        "THREAT-INTEL-IP": (F.when(said("threat_category").isin(*c.CRITICAL_CATEGORIES), 3).otherwise(1) + F.when(clouds & ~others, -3).when(~clouds & ~others, 2).otherwise(0) + F.when(matched_name.isNull(), 1).when(cloud(matched_name), -2).otherwise(0), "address", 5),
        "THREAT-INTEL-DOMAIN": (F.when(said("confidence") == "HIGH", 3).when(said("confidence") == "MEDIUM", 1).otherwise(0) - points(said("hosted_on_cloud") == "true", 1) + points(F.size(F.split(asked, r"\.")) > 4, 1) + points((F.length(asked_label) > 20) & (F.lower(asked_label) == asked_label), 1) + points(F.substring_index(asked, ".", -1).isin(*ABUSED_TLDS), 1), "usual", 4),
        "PORT-SCAN": (F.when(local, 1).otherwise(2) - points(_under(F.col("src_name"), SCANNERS), 2) + _scan(F.col("_ports"), ev("n_ports")), "usual", 4),
        "BRUTE-FORCE": (F.when(local, 1).otherwise(2) + points(F.col("src_listed"), 2) + _first(ev("attempts"), (50, 2), (20, 1)) + points(said("service").isin(*HIGH_VALUE), 1), "brute", 5),
        "DATA-EXFIL": (F.when(F.size(domains) == 0, 2).otherwise(0) - points(F.exists(domains, cloud), 2) - points(F.exists(domains, lambda x: _under(x, TRANSFER_SERVICES)), 3) - points(process.isin(*TRANSFER_PROGRAMS), 2) + _first(ev("total_mb"), (500, 2), (200, 1)) + points(F.col("dst_listed"), 3), "upload", 5),
        "DNS-TUNNEL": (_first(ev("label_entropy"), (4.5, 2), (3.8, 1)) + _first(ev("length"), (100, 2), (70, 1)) - points(label.rlike(CDN_LABEL), 2) - points(cloud(F.substring_index(query, ".", -2)), 2), "usual", 4),
        "DNS-BAD-TLD": (1 + points(F.length(label) > 15, 1) + F.when(ev("queries") > 10, 1).when(ev("queries") == 1, -1).otherwise(0), "port", 3),
        "DNS-FLOOD": (F.when(~(F.coalesce(ev("queries"), F.lit(0)) > 0), 0).when(ev("distinct_domains") > 0.8 * ev("queries"), 2).otherwise(-1) - points(process.isin(*BROWSERS, "opera.exe"), 2), "flood", 3),
        "ML-ANOMALY": (moved - points(F.contains(F.lower(said("what_is_unusual")), F.lit("still learning")), 2) - points(ev("anomaly_score") < 0.375, 1) + _first(ev("anomaly_score"), (0.7, 2), (0.4, 1)), "flood", 4),
        "ARP-SPOOF": (2 + points(F.col("src_ip").isin(*(cfg.gateways or ("",))), 2), "likely", 4),
        "SYN-FLOOD": (2 + points(~local, 1) + points(ev("syn_count") > 200, 1), "likely", 4),
        "ICMP-FLOOD": (2 + points(~local, 1) + points(ev("icmp_count") > 200, 1), "likely", 4),
        "BAD-PORT": (1 + F.when(process.isin("", "unknown"), 0).when(process.isin(*SAFE_PROGRAMS), -1).otherwise(1), "port", 3),
        "FORENSICS-INSECURE-SVC": (service, "usual", 4),
    }
    tor = F.contains(process, F.lit("firefox")) | F.contains(process, F.lit("tor"))
    facts = said("process_verdict")
    plain = {
        "BL-IP-SRC": ("LIKELY_THREAT", 0.8), "BL-IP-DST": ("LIKELY_THREAT", 0.8), "FORENSICS-CREDENTIAL": ("VERIFIED_THREAT", 0.95),
        "FORENSICS-SENSITIVE-DATA": _pair(said("data_type").isin(*CRITICAL_TYPES), ("VERIFIED_THREAT", 0.9), ("LIKELY_THREAT", 0.7)),
        "IOC-TOR": _pair(tor, ("INCONCLUSIVE", 0.5), ("LIKELY_THREAT", 0.7)), "IOC-DGA": _pair(ev("total_dga_domains") >= 10, ("VERIFIED_THREAT", 0.9), ("LIKELY_THREAT", 0.6)),
        "IOC-DOH-BYPASS": _pair(process.isin(*BROWSERS), ("FALSE_POSITIVE", 0.8), ("LIKELY_THREAT", 0.6)),
        "ODD-HOURS": _pair(process.isin(*NIGHT_PROGRAMS), ("LIKELY_FALSE_POSITIVE", 0.7), ("INCONCLUSIVE", 0.4)),
    }
    for rule in PROCESS_RULES:
        verdict, sure = F.lit("INCONCLUSIVE"), F.lit(0.3)
        for name, v, p in (("VERIFIED_SAFE", "FALSE_POSITIVE", 0.9), ("LIKELY_SAFE", "LIKELY_FALSE_POSITIVE", 0.7), ("MALICIOUS", "VERIFIED_THREAT", 0.9), ("SUSPICIOUS", "LIKELY_THREAT", 0.6)):
            verdict, sure = F.when(facts == name, v).otherwise(verdict), F.when(facts == name, p).otherwise(sure)
        plain[rule] = (verdict, sure)
    result = lambda score, verdict, sure: F.struct(score.cast("int").alias("score"), verdict.alias("verdict"), sure.cast("double").alias("confidence"))
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = result(F.lit(0), F.lit("INCONCLUSIVE"), F.lit(0.3))
    for rule, (v, p) in plain.items():
        out = F.when(F.col("rule_id") == rule, result(F.lit(0), as_col(v), as_col(p))).otherwise(out)
    points_of = F.lit(0)
    for rule, (s, _, _) in rules.items():
        points_of = F.when(is_rule(rule), F.coalesce(s, F.lit(0))).otherwise(points_of)
    rows, s = held(rows, _s=points_of), F.col("_s")  # the verdict and its confidence read the points several times
    for rule, (_, cuts, k) in rules.items():
        sure, verdict = F.least(F.abs(s) / k, F.lit(1.0)), _verdict(s, CUTS[cuts])
        if rule == "THREAT-INTEL-DOMAIN":
            own = cloud(asked)
            sure, verdict = F.when(own, 0.95).otherwise(sure), F.when(own, "FALSE_POSITIVE").otherwise(verdict)
        out = F.when(F.col("rule_id") == rule, result(s, verdict, sure)).otherwise(out)
    # a generator, so that the long case is worked out once a row
    rows = rows.withColumn("_v", F.explode(F.array(out))).withColumns({"score": F.col("_v.score"), "verdict": F.col("_v.verdict"), "confidence": F.round("_v.confidence", 6)})
    adjusted = F.when(F.col("verdict").endswith("FALSE_POSITIVE"), "LOW").when((F.col("verdict") == "VERIFIED_THREAT") & (F.col("confidence") > 0.5) & F.col("severity").isin("LOW", "MEDIUM"), "HIGH").otherwise(F.col("severity"))
    sure = F.col("confidence") > 0.5
    prefix = F.when(F.col("verdict") == "FALSE_POSITIVE", "[FALSE POSITIVE] ").when(F.col("verdict") == "LIKELY_FALSE_POSITIVE", "[LIKELY SAFE] ").when((F.col("verdict") == "VERIFIED_THREAT") & sure, "[CONFIRMED] ").when((F.col("verdict") == "LIKELY_THREAT") & sure, "[LIKELY THREAT] ").otherwise("")
    return rows.withColumn("adjusted_severity", adjusted).withColumn("title_prefix", prefix).drop("_v", "_s", "_ports", "src_name", "dst_name", "src_listed", "dst_listed")


def _pair(test: Column, yes: tuple, no: tuple) -> tuple[Column, Column]:
    test = F.coalesce(test, F.lit(False))
    return F.when(test, yes[0]).otherwise(no[0]), F.when(test, yes[1]).otherwise(no[1])
