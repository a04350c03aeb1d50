"""Readers and writers: field dumps, indicator feeds, feature history, alert export."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake.functions import net
from packetlake.operators import report

# The fields of a delimited packet dump, in order.
DUMP = ("time", "ip_src", "ip_dst", "ip6_src", "ip6_dst", "tcp_sport", "tcp_dport", "udp_sport", "udp_dport", "proto", "length", "tcp_flags", "dns_query", "dns_answer", "eth_src", "eth_dst", "ttl")


def packet_dump(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Rows of a 17-field text dump as packets; short rows are padded, flags come in hex, the payload size is estimated; a frame with hardware addresses but no IP is ARP."""
    part = F.split("value", "\\" + sep)
    raw = spark.read.text(path).select(*[F.coalesce(F.get(part, F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(DUMP)])
    first = lambda a, b: F.coalesce(F.expr(f"nullif({a}, '')"), F.expr(f"nullif({b}, '')"), F.lit(""))
    port = lambda a, b: F.coalesce(F.col(a).try_cast("int"), F.col(b).try_cast("int"), F.lit(0))
    length = F.coalesce(F.col("length").try_cast("long"), F.lit(0))
    some = lambda name: F.expr(f"nullif({name}, '')")
    version = F.when(F.col("ip_src") != "", 4).when(F.col("ip6_src") != "", 6)
    bare = (F.col("ip_src") == "") & (F.col("ip6_src") == "") & (F.col("eth_src") != "") & (F.col("proto") == "")
    protocol = report.protocol_name(some("tcp_dport"), some("udp_dport"), F.col("proto").try_cast("int"), version, bare)
    return raw.select(
        (F.col("time").try_cast("double") * 1000).cast("long").alias("ts_ms"), first("ip_src", "ip6_src").alias("src_ip"), first("ip_dst", "ip6_dst").alias("dst_ip"),
        port("tcp_sport", "udp_sport").alias("src_port"), port("tcp_dport", "udp_dport").alias("dst_port"), protocol.alias("protocol"),
        F.when(F.col("tcp_flags") != "", net.flag_letters(F.col("tcp_flags"))).otherwise("").alias("flags"), F.rtrim(F.col("dns_query"), F.lit(".")).alias("dns_query"), F.rtrim(F.col("dns_answer"), F.lit(".")).alias("dns_response"),
        length.alias("length"), F.greatest(F.lit(0), length - 54).cast("long").alias("payload_size"), F.col("eth_src").alias("src_mac"),
    )


def feed(spark: SparkSession, path: str, layout: str, category: str, order: int = 0) -> DataFrame:
    """Indicators (value, category, feed_order) of a text feed: comment_lines, plain_ips, url_lines or tab_first."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.rlike("^[#;]"))
    value = {"comment_lines": line, "plain_ips": F.get(F.split(line, r"[\s;#]+"), F.lit(0)), "url_lines": F.parse_url(line, F.lit("HOST")), "tab_first": F.get(F.split(line, "\t"), F.lit(0))}[layout]
    return rows.select(value.alias("value"), F.lit(category).alias("category"), F.lit(order).alias("feed_order")).where("value is not null").distinct()


def merge_feeds(*feeds: DataFrame) -> DataFrame:
    """One row a value; the last feed wins."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out.groupBy("value").agg(F.max_by("category", "feed_order").alias("category"))


def append_history(features: DataFrame, path: str) -> None:
    """Feature rows by day of their slot (five-second slots)."""
    features.withColumn("date", F.to_date(F.timestamp_millis(F.col("slot") * 5000))).write.mode("append").partitionBy("date").parquet(path)


def load_history(spark: SparkSession, path: str, since: str, most: int = 15_000) -> DataFrame:
    """The newest rows from the day `since` on; older days are not read."""
    return spark.read.parquet(path).where(F.col("date") >= since).orderBy(F.desc("slot")).limit(most)


def export_alerts(found: DataFrame, path: str, keys: list[str], form: str = "json") -> None:
    """Alerts as JSON, or as CSV with one column for each evidence key."""
    if form == "json":
        found.write.mode("overwrite").json(path)
    else:
        flat = found.select(*[c for c in found.columns if c != "evidence"], *[F.col("evidence")[k].alias(f"evidence_{k}") for k in keys])
        flat.write.mode("overwrite").option("header", True).csv(path)


def newest(found: DataFrame, keys: list[str], order: str = "ts_ms") -> DataFrame:
    """The newest row of each key."""
    return found.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
