"""Column expressions on packet fields: addresses, flags, names, masks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlake.config import SEVERITIES, TWO_PART_ENDINGS

#: IPv4 ranges that count as private, loopback, link-local and multicast.
PRIVATE = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4), ("255.255.255.255", 32))


def _value(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


def ip_long(ip: Column) -> Column:
    """IPv4 text as a number; null for anything else. The text is split once."""
    number = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.try_cast("long"))
    return F.when(ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), number)


def _within(number: Column, ranges) -> Column:
    """Whether a number is in one of the ranges. It is the element of an array, so that a filter computes it once and not for each bound."""

    def test(x):
        out = F.lit(False)
        for base, bits in ranges:
            low = _value(base)
            out = out | x.between(low, low + (1 << (32 - bits)) - 1)
        return out

    return F.get(F.transform(F.array(number), test), F.lit(0))


def is_private(ip: Column) -> Column:
    """IPv4 by the fixed ranges; IPv6 unique-local, link-local and loopback by prefix."""
    return F.coalesce(_within(ip_long(ip), PRIVATE), F.lower(ip).rlike(r"^(::1?$|f[cd]|fe[89ab])"), F.lit(False))


def is_loopback(ip: Column) -> Column:
    return ip.startswith("127.") | (ip == "::1")


def is_link_local(ip: Column) -> Column:
    return ip.startswith("169.254.") | F.lower(ip).rlike("^fe[89ab]")


def is_multicast(ip: Column) -> Column:
    return F.coalesce(_within(ip_long(ip), (("224.0.0.0", 4),)), F.lower(ip).startswith("ff"), F.lit(False))


def ip_class(ip: Column) -> Column:
    return F.when(is_loopback(ip), "loopback").when(is_link_local(ip), "link_local").when(is_multicast(ip), "multicast").when(is_private(ip), "private").when(ip_long(ip).isNotNull() | ip.contains(":"), "global").otherwise("invalid")


def is_lan_text(ip: Column) -> Column:
    """The broad test by text that some rules use."""
    return ip.startswith("192.168.") | ip.startswith("10.") | ip.startswith("172.")


def flow_key() -> tuple[Column, ...]:
    """Bidirectional key: addresses and ports are ordered independently, then the protocol."""
    return F.least("src_ip", "dst_ip").alias("ip_a"), F.greatest("src_ip", "dst_ip").alias("ip_b"), F.least("src_port", "dst_port").alias("port_a"), F.greatest("src_port", "dst_port").alias("port_b"), F.col("protocol")


def flag_letters(hexed: Column) -> Column:
    """TCP flag bits written in hex (0x012) as letters."""
    bits = F.conv(F.regexp_replace(F.lower(hexed), "^0x", ""), 16, 10).cast("int")
    return F.concat(*[F.when(bits.bitwiseAND(1 << k) != 0, c).otherwise("") for k, c in enumerate("FSRPAUEC")])


def syn_only(flags: Column) -> Column:
    return flags.contains("S") & ~flags.contains("A")


def base_domain(domain: Column) -> Column:
    d = F.lower(F.regexp_replace(domain, r"^\.+|\.+$", ""))
    two = F.substring_index(d, ".", -2)
    return F.when(F.size(F.split(d, r"\.")) <= 2, d).when(two.isin(*TWO_PART_ENDINGS), F.substring_index(d, ".", -3)).otherwise(two)


def suffixes(domain: Column) -> Column:
    """All suffixes on label boundaries, the whole name first."""
    labels = F.split(F.lower(domain), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def in_suffixes(domain: Column, names) -> Column:
    return F.arrays_overlap(suffixes(domain), F.array(*[F.lit(x) for x in names])) if names else F.lit(False)


def entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of a text's characters."""
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    n = F.size(chars)
    share = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def luhn(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def mask(value: Column, show: int = 3) -> Column:
    hidden = F.greatest(F.lit(0), F.least(F.length(value) - show, F.lit(20)))
    return F.concat(F.substring(value, 1, show), F.repeat(F.lit("*"), hidden))


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for k, s in enumerate(SEVERITIES):
        out = F.when(severity == s, k).otherwise(out)
    return out


def threat_level(score: Column) -> Column:
    return F.when(score > 0.7, "CRITICAL").when(score > 0.4, "ELEVATED").when(score > 0.2, "GUARDED").otherwise("SAFE")
