"""Boundary cases of the detection rules on hand-made packets."""

import pytest
from pyspark.sql import functions as F

from packetlake.operators import correlate, detect, enrich, features, flows, ioc

COLUMNS = "pkt_id long, ts_ms long, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, flags string, dns_query string, dns_response string, payload_size long, length long, src_mac string, is_encrypted boolean, process_name string"
BASE = dict(src_ip="192.168.1.10", dst_ip="10.0.0.1", src_port=12345, dst_port=80, protocol="TCP", flags="", dns_query="", dns_response="", payload_size=0, length=100, src_mac="", is_encrypted=False, process_name="")


def make(spark, rows):
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    full = [dict(BASE, pkt_id=k) | r for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], COLUMNS).withColumn("ts", F.timestamp_millis("ts_ms"))


@pytest.mark.parametrize("n, gap, hits", [(10, 3333, 1), (9, 1, 0), (10, 3334, 0)])
def test_brute_force_needs_ten_in_under_thirty_seconds(spark, n, gap, hits):
    got = detect.brute_force(make(spark, [dict(ts_ms=1000 + k * gap, flags="R", dst_port=22) for k in range(n)]))
    assert got.count() == hits


@pytest.mark.parametrize("n, hits", [(50, 0), (51, 1), (52, 2)])
def test_syn_flood_threshold(spark, n, hits):
    rows = [dict(ts_ms=k, flags="S", src_ip="203.0.113.9", dst_port=8081) for k in range(n)]
    assert detect.syn_flood(make(spark, rows)).count() == hits


@pytest.mark.parametrize("n, hits", [(30, 0), (31, 1)])
def test_icmp_flood_threshold(spark, n, hits):
    assert detect.icmp_flood(make(spark, [dict(ts_ms=k, protocol="ICMP") for k in range(n)])).count() == hits


@pytest.mark.parametrize("ports, hits", [(range(1000, 1015), 1), (range(1000, 1014), 0), (range(1024, 1050), 0)])
def test_port_scan_needs_fifteen_ports_and_a_low_one(spark, ports, hits):
    assert detect.port_scan(make(spark, [dict(ts_ms=k, dst_port=p) for k, p in enumerate(ports)])).count() == hits


@pytest.mark.parametrize("length, hits", [(60, 0), (61, 1)])
def test_dns_tunnel_length(spark, length, hits):
    name = "a" * (length - 4) + ".com"
    assert detect.dns_tunnel(make(spark, [dict(ts_ms=1, dns_query=name)])).count() == hits


def test_arp_change(spark):
    rows = [dict(ts_ms=k, protocol="ARP", src_mac=f"aa:0{m}") for k, m in enumerate((1, 1, 2, 2, 1))]
    assert [r.pkt_id for r in detect.arp_spoof(make(spark, rows)).orderBy("pkt_id").collect()] == [2, 4]


def test_exfiltration_doubles_its_threshold(spark):
    rows = [dict(ts_ms=k, payload_size=105_000) for k in range(1010)]
    assert detect.exfiltration(make(spark, rows)).count() == 1
    exact = [dict(ts_ms=k, payload_size=100 * 1048576) for k in range(4)]
    assert [r.pkt_id for r in detect.exfiltration(make(spark, exact)).orderBy("pkt_id").collect()] == [1, 2]


def test_odd_hours_once_an_hour(spark):
    rows = [dict(ts_ms=h * 3_600_000 + k, payload_size=60_000) for h in (1, 2, 5, 6) for k in range(3)]
    assert sorted(r.ts_ms // 3_600_000 for r in detect.odd_hours(make(spark, rows)).collect()) == [2, 5]


def test_cooldown_is_greedy_on_what_passed(spark):
    times = [0, 29_999, 30_000, 59_999, 60_000, 60_000, 100_000]
    found = detect.bad_port(make(spark, [dict(ts_ms=t, dst_port=4444) for t in times]))
    assert sorted(r.ts_ms for r in detect.cooldown(found).collect()) == [0, 30_000, 60_000, 100_000]


def test_incidents_join_within_five_minutes(spark):
    rows = [dict(ts_ms=t, dst_port=4444, src_ip=s) for s, t in (("1.1.1.1", 0), ("1.1.1.1", 300_000), ("1.1.1.1", 600_001), ("2.2.2.2", 0))]
    got = correlate.incidents(detect.bad_port(make(spark, rows))).orderBy("key", "start_ms").collect()
    assert [(r.key, r.n_alerts) for r in got] == [("1.1.1.1", 2), ("1.1.1.1", 1), ("2.2.2.2", 1)]


def test_beacon_inside_and_outside(spark):
    rows = [dict(ts_ms=k * 10_000, dst_ip=ip) for ip in ("192.168.1.1", "45.33.32.156") for k in range(30)]
    got = features.beacons(make(spark, rows)).collect()
    assert [r.dst_ip for r in got] == ["45.33.32.156"] and got[0].score > 0.99


def test_inferred_domain_is_newest_and_fresh(spark):
    rows = [dict(ts_ms=0, protocol="UDP", dns_query="old.com"), dict(ts_ms=10, protocol="UDP", dns_query="google.com"), dict(ts_ms=29_999 + 10), dict(ts_ms=30_010)]
    got = enrich.inferred_domains(make(spark, rows)).collect()
    assert [(r.pkt_id, r.domain) for r in got] == [(2, "google.com")]


def test_flow_splits_after_idle(spark):
    rows = [dict(ts_ms=0), dict(ts_ms=119_999, src_ip="10.0.0.1", dst_ip="192.168.1.10", src_port=80, dst_port=12345), dict(ts_ms=119_999 + 120_001)]
    assert sorted(r.packets for r in flows.flows(make(spark, rows)).collect()) == [1, 2]


def test_random_domains_spare_known_names(spark):
    names = ["x7f9q2k8w3z5v1.com", "x7f9q2k8w3z5v1.cloudfront.net", "q8w7e6r5t4y3u2._tcp.local", "aaaaaaaaaaaaaaaa.com"]
    assert [r.domain for r in ioc.random_domains(make(spark, [dict(ts_ms=k, dns_query=n) for k, n in enumerate(names)])).collect()] == names[:1]


def test_empty_input(spark):
    none = make(spark, []).where("false")
    assert detect.cooldown(detect.run_rules(none)).count() == 0
    assert correlate.incidents(detect.run_rules(none)).count() == 0
