"""Stores against what was put in, windows against brute force, and evidence that is added after the cooldown."""

import random

from pyspark.sql import functions as F

from packetlake.operators import detect, report, windows
from packetlake.plans.packets import packets
from packetlake.sources import stores

SF = "/root/testdata/sf0.001"


def test_alerts_and_state_come_back(spark, tmp_path):
    found = detect.cooldown(detect.run_rules(packets(spark, SF), rules=(detect.bad_port, detect.bad_tld)))
    path = str(tmp_path / "alerts")
    stores.append_alerts(found, path)
    stores.append_alerts(found.limit(0), path)
    back = stores.newest_alerts(spark, path, 5)
    assert back.count() == 5 and back.first().ts_ms == found.agg(F.max("ts_ms")).first()[0]
    assert stores.drop_days(spark, path, "2024-01-01") == [] and stores.drop_days(spark, path, "2025-01-01") == ["date=2024-01-01"]
    old = spark.createDataFrame([("a", 2, 1, 5), ("b", 1, 2, 2)], "domain string, n long, first_ms long, last_ms long")
    stores.save_state({"domains": old}, str(tmp_path / "state"))
    both = stores.merged_counts(stores.load_state(spark, str(tmp_path / "state"), ("domains",))["domains"], old, ["domain"], 3)
    assert {(r.domain, r.n, r.learned, r.first_ms, r.last_ms) for r in both.collect()} == {("a", 4, True, 1, 5), ("b", 2, False, 2, 2)}


def test_windows_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(k, r.randrange(0, 4000), r.choice("ab"), r.randrange(6), r.randrange(50)) for k in range(400)]
    df = spark.createDataFrame(rows, "pkt_id long, ts_ms long, who string, port int, size long")
    got = {x.pkt_id: (x.n, x.low) for x in windows.distinct_in_window(df, ["who"], "port", 300, n=F.lit(True), low=F.col("port") < 3).collect()}
    sums = {x.pkt_id: x.total for x in windows.running_total(df, "who", "size", "total", 500).collect()}
    last = {x.pkt_id: x.last for x in windows.previous(df, "who", "size", "last", 500).collect()}
    for k, t, who, _, size in rows:
        seen = {p for _, u, w, p, _ in rows if w == who and t - 299 <= u <= t}
        assert got[k] == (len(seen), len([p for p in seen if p < 3]))
        before = sorted((u, q, s) for q, u, w, _, s in rows if w == who and (u, q) < (t, k))
        assert sums[k] == sum(s for *_, s in before) + size and last[k] == (before[-1][2] if before else None)


def test_lists_are_added_to_alerts_that_passed(spark):
    p = packets(spark, SF)
    found = detect.cooldown(detect.run_rules(p, rules=(detect.port_scan, detect.dns_flood)))
    full = detect.explained(found, p).collect()
    assert len(full) == found.count() > 0
    for a in full:
        e = a.evidence
        if a.rule_id == "PORT-SCAN":
            assert len(e["ports"].split(",")) == min(50, int(e["n_ports"])) and e["targets"]
        else:
            assert len(e["sample"].split(",")) == min(20, int(e["distinct_domains"]))


def test_protocol_names(spark):
    rows = spark.createDataFrame([(1, None, 6, 4, False), (None, 5, 17, 4, False), (None, None, 1, 4, False), (None, None, 58, 6, False), (None, None, 2, 4, False), (None, None, 2, 6, False), (None, None, None, None, True), (None, None, None, None, False)], "t int, u int, n int, v int, a boolean")
    got = [r[0] for r in rows.select(report.protocol_name(*(F.col(x) for x in "tunva"))).collect()]
    assert got == ["TCP", "UDP", "ICMP", "ICMPv6", "IP-Other", "IPv6-Other", "ARP", "Other"]
