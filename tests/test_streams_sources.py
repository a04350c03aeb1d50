"""Streams equal batches on the same rows; readers and writers round-trip."""

from pyspark.sql import functions as F

from packetlake.operators import detect, verify
from packetlake.plans.packets import packets
from packetlake.sources import tables
from packetlake.streaming import alerts

SF = "/root/testdata/sf0.001"


def test_stream_rates_equal_batch(spark, tmp_path):
    p = packets(spark, SF).select("pkt_id", "ts_ms", "ts", "src_ip", "dst_ip", "protocol", "flags", "length")
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = alerts.rates(alerts.packet_stream(spark, str(tmp_path / "in"), p.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.w.start, r.n) for r in p.groupBy(F.window("ts", "10 seconds").alias("w")).agg(F.count("*").alias("n")).collect()}
    got = spark.table("rates").collect()
    assert len(got) == len(want) and sum(r.packets for r in got) == p.count()


def test_micro_batches_write_alerts(spark, tmp_path):
    p = packets(spark, SF).limit(3000)
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = alerts.to_tables(alerts.packet_stream(spark, str(tmp_path / "in"), p.schema), lambda df, name, n: seen.append((name, df.count())), rules=(detect.bad_port, detect.brute_force)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert dict(seen)["alerts"] == detect.cooldown(detect.run_rules(spark.read.parquet(str(tmp_path / "in")), rules=(detect.bad_port, detect.brute_force))).count() > 0


def test_batches_with_a_state_equal_one_run(spark, tmp_path):
    p = packets(spark, SF).where("pkt_id between 1100 and 2700").select("pkt_id", "ts_ms", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flags", "dns_query", "payload_size", "src_mac")
    for k in range(4):  # batches end inside a flood
        p.where(f"pkt_id between {1100 + 400 * k} and {1499 + 400 * k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rules = (detect.bad_port, detect.brute_force, detect.syn_flood)
    got = []
    stream = alerts.packet_stream(spark, str(tmp_path / "in"), p.schema, 1)
    q = alerts.to_tables(stream, lambda df, name, n: got.extend((r.rule_id, r.src_ip, r.dst_ip, r.pkt_id) for r in df.collect()) if name == "alerts" else None, rules=rules, state=str(tmp_path / "state")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(240)
    want = [(r.rule_id, r.src_ip, r.dst_ip, r.pkt_id) for r in detect.cooldown(detect.run_rules(p, rules=rules)).collect()]
    assert sorted(got) == sorted(want) and {r for r, *_ in want} == {"BAD-PORT", "BRUTE-FORCE", "SYN-FLOOD"}


def test_dump_and_feeds(spark, tmp_path):
    (tmp_path / "dump").write_text("1.5|10.0.0.1|10.0.0.2|||1234|80||||100|0x012|||aa:bb||64\n2|||fe80::1|fe80::2\n")
    rows = tables.packet_dump(spark, str(tmp_path / "dump")).orderBy("ts_ms").collect()
    assert (rows[0].src_port, rows[0].dst_port, rows[0].protocol, rows[0].flags, rows[0].payload_size) == (1234, 80, "TCP", "SA", 46)
    assert rows[1].src_ip == "fe80::1" and rows[1].length == 0
    (tmp_path / "feed").write_text("# c\n1.2.3.4 ; x\n\n5.6.7.8\n")
    a, b = tables.feed(spark, str(tmp_path / "feed"), "plain_ips", "A", 1), tables.feed(spark, str(tmp_path / "feed"), "plain_ips", "B", 2)
    assert {(r.value, r.category) for r in tables.merge_feeds(a, b).collect()} == {("1.2.3.4", "B"), ("5.6.7.8", "B")}


def test_verdicts(spark):
    found = verify.verify(detect.run_rules(packets(spark, SF), rules=(detect.brute_force, detect.bad_tld)))
    got = {(r.rule_id, r.verdict) for r in found.select("rule_id", "verdict").distinct().collect()}
    assert ("DNS-BAD-TLD", "INCONCLUSIVE") in got and any(k == "BRUTE-FORCE" and v in ("INCONCLUSIVE", "LIKELY_THREAT", "VERIFIED_THREAT") for k, v in got)
