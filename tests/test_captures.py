"""Capture files written here are read with the same rows by one task and by many."""

import random
import socket
import struct

import pytest

from packetlake.sources import captures


def tcp(src, dst, sport, dport, flags, payload=b""):
    body = struct.pack(">HHIIBBHHH", sport, dport, 1, 2, 5 << 4, flags, 1000, 0, 0) + payload
    return ip(src, dst, 6, body)


def ip(src, dst, number, body):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 1, 0, 64, number, 0, socket.inet_aton(src), socket.inet_aton(dst)) + body


def udp(src, dst, sport, dport, payload):
    return ip(src, dst, 17, struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload)


def answer(name, address):
    q = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0" + struct.pack(">HH", 1, 1)
    return struct.pack(">HHHHHH", 7, 0x8180, 1, 1, 0, 0) + q + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + socket.inet_aton(address)


def ether(body, kind=0x0800, vlan=False):
    return b"\x02\0\0\0\0\x01" + b"\x02\0\0\0\0\x02" + (struct.pack(">HH", 0x8100, 5) if vlan else b"") + struct.pack(">H", kind) + body


def write(path, records, order="<", nano=False, link=1):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link))
        for ms, data in records:
            f.write(struct.pack(order + "IIII", ms // 1000, ms % 1000 * (1_000_000 if nano else 1000), len(data), len(data) + 3) + data)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, r = tmp_path_factory.mktemp("captures"), random.Random(6)
    records = []
    for k in range(3000):
        payload = bytes(r.randrange(256) if r.random() < 0.7 else 0 for _ in range(r.randint(0, 300)))
        body = tcp("10.0.0.1", f"10.0.1.{k % 200}", 40000 + k % 9, 443 if k % 5 == 0 else 80, (2, 18, 24, 4)[k % 4], payload)
        records.append((1_700_000_000_000 + k * 7, ether(body, vlan=k % 11 == 0)))
    records[10] = (1_700_000_000_070, ether(udp("10.0.0.9", "10.0.0.1", 53, 5000, answer("www.site.com", "93.184.216.34"))))
    records[11] = (1_700_000_000_077, ether(bytes(8) + b"\x02\0\0\0\0\x09" + socket.inet_aton("10.0.0.7") + bytes(6) + socket.inet_aton("10.0.0.8"), 0x0806))
    records[12] = (1_700_000_000_084, b"short")
    write(at / "a.pcap", records)
    write(at / "b.cap", [(1_700_000_100_000 + k, udp("10.2.0.1", "10.2.0.2", 9, 10, b"x" * k)) for k in range(1, 200)], ">", True, 101)
    write(at / "empty.pcap", [])
    with open(at / "b.cap", "ab") as f:
        f.write(b"\0" * 9)  # a cut last record
    (at / "notes.txt").write_text("no capture")
    return str(at)


def test_the_same_rows_by_two_and_by_many_tasks(spark, folder):
    spark.dataSource.register(captures.PcapSource)
    read = lambda size: spark.read.format("pcap").option("splitBytes", size).load(folder)
    few, many = read(1 << 30), read(20_000)
    assert few.rdd.getNumPartitions() == 3 and many.rdd.getNumPartitions() > 20
    a, b = (sorted(map(tuple, df.collect())) for df in (few, many))
    assert a == b and len(a) == 3000 + 199
    rows = {(r[0], k): r for k, r in enumerate(sorted(x for x in a if x[0] == "a.pcap"))}
    r = few.where("file = 'a.pcap' and dns_query <> ''").first()
    assert (r.dns_query, r.dns_response, r.protocol, r.src_port, r.ts_ms) == ("www.site.com", "93.184.216.34", "UDP", 53, 1_700_000_000_070)
    r = few.where("protocol = 'ARP'").first()
    assert (r.src_ip, r.dst_ip, r.src_mac) == ("10.0.0.7", "10.0.0.8", "02:00:00:00:00:09")
    assert few.where("protocol = 'Other' and length = 8").count() == 1
    assert {x.flags for x in few.where("protocol = 'TCP'").select("flags").distinct().collect()} == {"S", "SA", "PA", "R"}
    assert few.where("file = 'b.cap' and payload_size = 199 and ts_ms = 1700000100199").count() == 1 and len(rows) == 3000


def test_what_is_no_capture_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"0123456789" * 9)
    spark.dataSource.register(captures.PcapSource)
    with pytest.raises(Exception, match="is no capture file"):
        spark.read.format("pcap").load(str(tmp_path)).collect()
