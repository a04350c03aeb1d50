"""Indicators of compromise in packets and endpoint tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake import config as c
from packetlake.functions import net
from packetlake.operators import windows
from packetlake.operators.detect import alerts

# Names and patterns of domains that look random by design.
SAFE_ENDINGS = (
    ".local", "._tcp.local", "._udp.local", ".nabu.casa", ".ui.nabu.casa", ".ecaserver.eset.com", ".eset.com",
    "._googlecast._tcp.local", "._googlezone._tcp.local", "._googlerpc._tcp.local", "._airplay._tcp.local", "._raop._tcp.local", "._homekit._tcp.local", "._hap._tcp.local",
    "._companion-link._tcp.local", "._spotify-connect._tcp.local", ".amazonaws.com", ".amazon-dss.com", ".arcus-uswest.amazon.com", ".cloudfront.net", ".akamaized.net", ".fastly.net",
    ".azureedge.net", ".edgekey.net", ".edgesuite.net", ".datadoghq.com", ".browser-intake-datadoghq.com", ".gvt2.com", ".gvt1.com", ".1e100.net", ".steamserver.net", ".steamcontent.com",
    ".samsungcloudsolution.com", ".samsungelectronics.com", ".events.data.microsoft.com", ".microsoft.com", ".letsencrypt.org", ".ubnt.com", ".ui.com",
)
SAFE_PARTS = ("_tcp.local", "_udp.local", ".in-addr.arpa", ".ip6.arpa", "_services._dns-sd.")
SAFE_WORDS = (
    "datadoghq", "cloudflare", "akamai", "fastly", "amazonaws", "googleusercontent", "googlevideo", "gstatic", "googleapis", "azurewebsites", "cloudfront", "samsungcloudsolution",
    "steamserver", "steamcontent", "steampowered",
)


def tor(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("dst_port").isin(*c.TOR_PORTS)).withColumns({"rule_id": F.lit("IOC-TOR"), "severity": F.lit("HIGH")})


def doh(packets: DataFrame) -> DataFrame:
    return packets.where((F.col("dst_port") == 443) & F.col("dst_ip").isin(*c.DOH_ADDRESSES)).withColumns({"rule_id": F.lit("IOC-DOH-BYPASS"), "severity": F.lit("LOW")})


def processes(packets: DataFrame, tools: DataFrame) -> DataFrame:
    """Process names of a tool table (name), by exact lower-case name."""
    return packets.withColumn("name", F.lower("process_name")).where("name <> ''").join(tools, "name", "left_semi").withColumns({"rule_id": F.lit("IOC-SUSPICIOUS-PROC"), "severity": F.lit("CRITICAL")})


def _safe(d):
    out = F.coalesce(F.element_at(F.split(d, r"\."), F.greatest(-F.size(F.split(d, r"\.")), F.lit(-2))).rlike("|".join(SAFE_WORDS)), F.lit(False))
    for x in SAFE_ENDINGS:
        out = out | d.endswith(x)
    for x in SAFE_PARTS:
        out = out | d.contains(x)
    return out


def random_domains(packets: DataFrame, cfg: c.Config = c.DEFAULT) -> DataFrame:
    """Different names with a long, random-looking label, with their first packet. Names are made distinct before they are scored."""
    names = packets.where("dns_query <> ''").groupBy(F.lower("dns_query").alias("domain")).agg(F.min(F.struct("ts_ms", "pkt_id")).alias("first"), F.count("*").alias("queries"))
    d = F.col("domain")
    labels = F.split(d, r"\.")
    labels = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    top = F.array_max(F.transform(F.filter(labels, lambda x: F.length(x) >= cfg.dga_label), lambda x: F.round(net.entropy(x), 9)))
    return names.where(~_safe(d)).withColumn("entropy", top).where(F.col("entropy") >= cfg.dga_entropy).select("domain", "entropy", "queries", F.col("first.ts_ms").alias("first_ms"), F.col("first.pkt_id").alias("first_pkt"))


def random_name_alerts(packets: DataFrame, cfg: c.Config = c.DEFAULT, per_source: bool = False, sample: int = 15) -> DataFrame:
    """IOC-DGA: each query of a random-looking name once `cfg.dga_domains` different ones have been asked for, by anyone or, where asked, by its source.

    A name counts from its first packet on. Counts over the whole table are sums of blocks of time, then running sums in each.
    """
    names = random_domains(packets, cfg).select("domain", "entropy")
    rows = packets.where("dns_query <> ''").withColumn("domain", F.lower("dns_query")).join(names, "domain")
    keys = ["src_ip", "domain"] if per_source else ["domain"]
    first = rows.groupBy(*keys).agg(F.min(F.struct("ts_ms", "pkt_id")).alias("_first"))
    rows = rows.join(first, keys).withColumn("_new", (F.struct("ts_ms", "pkt_id") == F.col("_first")).cast("long"))
    if per_source:
        rows = windows.running_total(rows, "src_ip", "_new", "total")
        shown = F.lit(None).cast("string")
    else:
        rows = windows.running_over_all(rows, F.col("_new"), "total")
        earliest = rows.where("_new = 1").orderBy("ts_ms", "pkt_id").limit(sample).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "pkt_id", "domain"))), lambda x: x["domain"]).alias("_names"))  # one row
        rows = rows.crossJoin(F.broadcast(earliest))
        shown = F.array_join(F.slice("_names", F.lit(1), F.least(F.col("total"), F.lit(sample)).cast("int")), ",")
    rows = rows.where(F.col("total") >= cfg.dga_domains)
    return alerts(rows, "IOC-DGA", "HIGH", "Indicator of Compromise", latest_domain=F.col("domain"), domain_entropy=F.round("entropy", 2), total_dga_domains=F.col("total"), sample_domains=shown)


def listening(endpoints: DataFrame) -> DataFrame:
    """Endpoint rows that listen on a port of the list (columns state, port)."""
    return endpoints.where((F.col("state") == "LISTEN") & F.col("port").isin(*c.LISTEN_PORTS))


def active_threats(endpoints: DataFrame, indicators: DataFrame) -> DataFrame:
    """Established endpoint rows whose remote address an indicator lists."""
    return endpoints.where("state = 'ESTABLISHED'").join(indicators, endpoints.remote_ip == indicators.ip).where(~net.is_private(F.col("remote_ip")))
