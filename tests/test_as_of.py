"""What was known when a packet came: learned keys, running counts, count-bounded windows; small fixtures."""

from pyspark.sql import functions as F

from packetlake.operators import intel, ioc, trailing, windows


def rows(spark, data):
    return spark.createDataFrame(data, "pkt_id long, ts_ms long, key string")


def test_a_key_is_known_only_after_its_nth_row(spark):
    df = rows(spark, [(k, 1000 * (k // 2), "a" if k % 3 else "b") for k in range(12)])
    since = windows.nth_rows(df, "key", 3).withColumnsRenamed({"ts_ms": "since_ms", "pkt_id": "since_pkt"})
    got = {r.pkt_id for r in intel.as_of(df, since, {"key": F.col("key")}).where("known").collect()}
    seen, want = {}, set()
    for k in range(12):
        key = "a" if k % 3 else "b"
        if seen.get(key, 0) >= 3:
            want.add(k)
        seen[key] = seen.get(key, 0) + 1
    assert got == want and want


def test_running_sum_over_all_rows(spark):
    data = [(k, (k * 7919 % 500) * 1000, "x") for k in range(300)]
    got = {r.pkt_id: r.n for r in windows.running_over_all(rows(spark, data), F.col("pkt_id") % 3, "n", 2000).collect()}
    total = 0
    for k, _, _ in sorted(data, key=lambda r: (r[1], r[0])):
        total += k % 3
        assert got[k] == total


def test_sums_before_blocks_over_several_groups(spark):
    df = spark.range(200).select((F.col("id") * 3).alias("b"), F.col("id").alias("v"))
    got = {r.b: r.s for r in windows.sums_before(df, "b", 16, s=F.sum("v")).collect()}
    assert got == {3 * k: k * (k - 1) // 2 for k in range(200)}
    assert windows.sums_before(df.where("false"), "b", s=F.sum("v")).count() == 0


def test_random_names_alert_from_the_fifth_different_one_on(spark):
    names = [f"q{c}zx8k1w{c}7pv3m5t9j.info" for c in "abcdefgh"]
    asked = [names[i] for i in (0, 0, 1, 2, 1, 3, 0, 4, 4, 5)] + ["x4k9q2z8w7m3vj6t1y5p.amazon-dss.com", "www.plain.com"]
    df = spark.createDataFrame([(k, 1000 * k, "10.0.0.1", "9.9.9.9", 53, n) for k, n in enumerate(asked)], "pkt_id long, ts_ms long, src_ip string, dst_ip string, dst_port int, dns_query string")
    got = sorted((r.pkt_id, int(r.evidence["total_dga_domains"]), r.evidence["sample_domains"]) for r in ioc.random_name_alerts(df).collect())
    assert [(k, n) for k, n, _ in got] == [(7, 5), (8, 5), (9, 6)]
    assert got[0][2] == ",".join(names[:5]) and got[2][2] == ",".join(names[:6])


def test_last_packets_against_plain_counting(spark):
    import math
    import random
    import statistics

    r = random.Random(4)
    t, data = 0, []
    for k in range(400):
        t += r.choice([0, 10, 300, 2500, 30_000])
        data.append((k, t, f"10.0.0.{r.randint(1, 9)}", r.choice([80, 443, 22]), r.choice(["TCP", "UDP"]), r.choice(["S", "SA", "R", ""]), r.choice(["", "a.b"]), r.randint(50, 1500), r.randint(0, 40), r.random() < 0.5))
    df = spark.createDataFrame(data, "pkt_id long, ts_ms long, dst_ip string, dst_port int, protocol string, flags string, dns_query string, length int, payload_size int, is_encrypted boolean")
    got = {x.slot: x for x in trailing.features(df, most=37).collect()}
    ends = {}
    for k, d in enumerate(data):
        ends[d[1] // 5000] = k + 1
    assert got.keys() == ends.keys()
    for slot, e in ends.items():
        w, x = data[max(0, e - 37) : e], got[slot]
        gaps = [(b[1] - a[1]) / 1000 for a, b in zip(w, w[1:])]
        ports = [d[3] for d in w]
        bits = -sum(ports.count(p) / len(w) * math.log2(ports.count(p) / len(w)) for p in set(ports))
        want = {
            "bytes_per_sec": sum(d[7] for d in w) / 5, "unique_dst_ports": len(set(ports)), "unique_dst_ips": len({d[2] for d in w}), "protocol_count": len({d[4] for d in w}), "port_entropy": bits,
            "syn_ratio": sum(d[5] == "S" for d in w) / len(w), "rst_ratio": sum(d[5] == "R" for d in w) / len(w), "dns_rate": sum(d[6] != "" for d in w) / 5, "iat_mean": statistics.fmean(gaps) if gaps else 0,
            "iat_std": statistics.pstdev(gaps) if gaps else 0, "payload_ratio": sum(d[8] for d in w) / sum(d[7] for d in w), "encrypted_ratio": sum(d[9] for d in w) / len(w),
        }
        assert x.packets == len(w) and all(abs(x[f] - v) < 2e-5 for f, v in want.items()), slot
