"""Capture files (classic .pcap) as packet rows: a Spark data source that cuts the files of a folder into splits at record boundaries.

    spark.dataSource.register(captures.PcapSource)
    spark.read.format("pcap").option("splitBytes", 64 << 20).load(folder)

A split is a range of bytes of one file. Records do not say where the next one begins before they are read, so a task looks for
the first place in its range from which CHAIN records (or those to the file's end) follow one another with plausible headers; it
reads the records that begin in its range. A large file is thus many tasks.

Files are opened by path on the executors, so the folder must be one that they share. Both byte orders, micro- and
nanosecond stamps, Ethernet (with VLAN tags) and raw IP links; IPv4, IPv6, TCP, UDP, ICMP, ARP and the first question and
answer of DNS. A cut last record ends its file; what is no capture file is an error.
"""

import glob
import os
import socket
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "file string, place long, ts_ms long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flags string, dns_query string, dns_response string, "
    "length long, payload_size long, src_mac string, is_encrypted boolean, payload_raw binary"
)
#: Marks of the file format (byte order, units of a second), and the names of protocols and flags.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000)}
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6"}
FLAGS = ((1, "F"), (2, "S"), (4, "R"), (8, "P"), (16, "A"), (32, "U"))
ETHERNET, RAW, HEAD, RECORD, CHAIN, LONGEST, DAY = 1, 101, 24, 16, 4, 262_144, 86_400


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _head(f) -> tuple[str, int, int]:
    head = f.read(HEAD)
    if head[:4] not in MAGIC or len(head) < HEAD:
        raise ValueError(f"{f.name} is no capture file")
    order, unit = MAGIC[head[:4]]
    return order, unit, struct.unpack(order + "I", head[20:24])[0] & 0xFFFF


def first_record(f, order: str, unit: int, start: int, size: int) -> int:
    """The first place from `start` on where records follow one another."""
    if start <= HEAD:
        return HEAD
    window, at = b"", start
    while at < size:
        f.seek(at)
        window = f.read(1 << 20)
        for k in range(max(0, len(window) - RECORD + 1)):
            if _chained(f, order, unit, at + k, size, window[k : k + RECORD]):
                return at + k
        at += max(1, len(window) - RECORD + 1)
    return size


def _chained(f, order: str, unit: int, at: int, size: int, head: bytes) -> bool:
    before = None
    for _ in range(CHAIN):
        if at == size:
            return before is not None
        if len(head) < RECORD:
            return False
        second, part, kept, whole = struct.unpack(order + "IIII", head)
        if part >= unit * 1000 or not 0 < kept <= LONGEST or whole < kept or whole > LONGEST or (before is not None and abs(second - before) > DAY):
            return False
        before, at = second, at + RECORD + kept
        if at > size:
            return False
        f.seek(at)
        head = f.read(RECORD)
    return True


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A DNS name and the place behind it; pointers are followed sixteen times at most."""
    labels, end, jumps = [], None, 0
    while at < len(data) and data[at]:
        n = data[at]
        if n >= 192:
            if at + 1 >= len(data) or jumps == 16:
                break
            end = at + 2 if end is None else end
            at, jumps = (n & 63) << 8 | data[at + 1], jumps + 1
        else:
            labels.append(data[at + 1 : at + 1 + n].decode("utf-8", "replace"))
            at += 1 + n
    return ".".join(labels), at + 1 if end is None else end


def _dns(data: bytes) -> tuple[str, str]:
    """The name asked for and the first address answered."""
    if len(data) < 12:
        return "", ""
    questions, answers = struct.unpack(">HH", data[4:8])
    query, at = _name(data, 12) if questions else ("", 12)
    at += 4 if questions else 0
    for _ in range(min(answers, 32)):
        _, at = _name(data, at)
        if at + 10 > len(data):
            break
        kind, n = struct.unpack(">H", data[at : at + 2])[0], struct.unpack(">H", data[at + 8 : at + 10])[0]
        value = data[at + 10 : at + 10 + n]
        if (kind, len(value)) in ((1, 4), (28, 16)):
            return query, socket.inet_ntop(socket.AF_INET if kind == 1 else socket.AF_INET6, value)
        at += 10 + n
    return query, ""


def parsed(data: bytes, link: int) -> dict:
    """The fields of a record's bytes."""
    out = dict.fromkeys(("src_ip", "dst_ip", "flags", "dns_query", "dns_response", "src_mac"), "") | {"src_port": 0, "dst_port": 0, "protocol": "Other", "payload_raw": b""}
    kind, at = (data[0] >> 4 if data else 0), 0
    if link == ETHERNET:
        if len(data) < 14:
            return out
        out["src_mac"], kind, at = data[6:12].hex(":"), struct.unpack(">H", data[12:14])[0], 14
        while kind in (0x8100, 0x88A8) and len(data) >= at + 4:
            kind, at = struct.unpack(">H", data[at + 2 : at + 4])[0], at + 4
    body = data[at:]
    if kind == 0x0806 and len(body) >= 28:
        return out | {"protocol": "ARP", "src_mac": body[8:14].hex(":"), "src_ip": socket.inet_ntoa(body[14:18]), "dst_ip": socket.inet_ntoa(body[24:28])}
    if kind in (0x0800, 4) and len(body) >= 20:
        number, at, end = body[9], (body[0] & 15) * 4, struct.unpack(">H", body[2:4])[0] or len(body)
        out |= {"src_ip": socket.inet_ntoa(body[12:16]), "dst_ip": socket.inet_ntoa(body[16:20])}
    elif kind in (0x86DD, 6) and len(body) >= 40:
        number, at, end = body[6], 40, 40 + struct.unpack(">H", body[4:6])[0]
        out |= {"src_ip": socket.inet_ntop(socket.AF_INET6, body[8:24]), "dst_ip": socket.inet_ntop(socket.AF_INET6, body[24:40])}
    else:
        return out
    out["protocol"], rest = PROTOCOLS.get(number, f"IP-{number}"), body[at:end]
    size = 8
    if number == 6 and len(rest) >= 20:
        size = (rest[12] >> 4) * 4
        out["flags"] = "".join(letter for bit, letter in FLAGS if rest[13] & bit)
    if number in (6, 17) and len(rest) >= 8:
        out["src_port"], out["dst_port"] = struct.unpack(">HH", rest[:4])
        out["payload_raw"] = rest[size:]
        if number == 17 and 53 in (out["src_port"], out["dst_port"]):
            out["dns_query"], out["dns_response"] = _dns(out["payload_raw"])
    return out


class PcapReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self):
        path = self.path.removeprefix("file://")
        files = sorted(p for p in (glob.glob(f"{path}/**/*", recursive=True) if os.path.isdir(path) else [path]) if os.path.splitext(p)[1].lower() in (".pcap", ".cap", ".dmp"))
        return [Split(p, s, min(s + self.size, os.path.getsize(p))) for p in files for s in range(0, os.path.getsize(p), self.size)] or [Split("", 0, 0)]

    def read(self, split):
        if not split.path:
            return
        size = os.path.getsize(split.path)
        with open(split.path, "rb") as f:
            order, unit, link = _head(f)
            at = first_record(f, order, unit, split.start, size)
            f.seek(at)
            while at < split.end:
                head = f.read(RECORD)
                if len(head) < RECORD:
                    return
                second, part, kept, whole = struct.unpack(order + "IIII", head)
                data = f.read(kept)
                if len(data) < kept:
                    return
                x = parsed(data, link)
                encrypted = x["protocol"] == "TCP" and 443 in (x["src_port"], x["dst_port"])
                yield (
                    os.path.basename(split.path), at, second * 1000 + part // unit, x["src_ip"], x["dst_ip"], x["src_port"], x["dst_port"], x["protocol"], x["flags"], x["dns_query"], x["dns_response"],
                    whole, len(x["payload_raw"]), x["src_mac"], encrypted, x["payload_raw"],
                )
                at += RECORD + kept


class PcapSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PcapReader(self.options)
