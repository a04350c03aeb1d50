"""Plans whose cost must not grow faster than the input; small fixtures."""

from pyspark.sql import functions as F

from packetlake.functions import net
import __spark_entry__ as entry
from packetlake.operators import binary, detect, enrich, intel, models, payload, trailing, windows
from packetlake.operators.stored import stored
from packetlake.plans import packets as plan
from packetlake.plans import q_stream


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_address_is_read_once_in_a_filter(spark):
    df = spark.range(3).select(F.concat(F.lit("192.0.0."), F.col("id").cast("string")).alias("ip"))
    assert planned(df.where(~net.is_private(F.col("ip")) & ~net.is_multicast(F.col("ip")))).count("split(") <= 2
    texts = ["10.0.0.1", "010.0.0.1", "09.1.1.1", "192.0.0.7", "192.0.0.8", "192.0.0.171", "198.19.255.255", "198.20.0.0", "240.0.0.1", "224.0.0.1", "1.2.3", "1.2.3.4.5", "256.1.1.1", "::1", "fd00::1", "ff02::1", "x", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "ip string").select("ip", net.is_private(F.col("ip")).alias("p"), net.is_multicast(F.col("ip")).alias("m"), net.ip_long(F.col("ip")).alias("n")).collect()
    assert {r.ip for r in rows if r.p} == {"10.0.0.1", "192.0.0.7", "192.0.0.171", "198.19.255.255", "240.0.0.1", "::1", "fd00::1"}
    assert {r.ip for r in rows if r.m} == {"224.0.0.1", "ff02::1"}
    assert {r.ip: r.n for r in rows if r.n} == {"10.0.0.1": 10 << 24 | 1, "09.1.1.1": 9 << 24 | 0x010101, "192.0.0.7": 192 << 24 | 7, "192.0.0.8": 192 << 24 | 8, "192.0.0.171": 192 << 24 | 171, "198.19.255.255": 198 << 24 | 19 << 16 | 0xFFFF, "198.20.0.0": 198 << 24 | 20 << 16, "240.0.0.1": 240 << 24 | 1, "224.0.0.1": 224 << 24 | 1}


def test_digests_are_made_for_their_names_only(spark):
    df = plan.packets(spark, "/root/testdata/sf0.001")
    assert planned(df).replace(" ", "").count("md5(") == planned(df).replace(" ", "").count(")THENmd5(") + planned(df).replace(" ", "").count(")THENtranslate(md5(") > 0


def test_threat_alerts_carry_their_packet(spark):
    df = plan.packets(spark, "/root/testdata/sf0.001")
    listed = F.broadcast(spark.createDataFrame([("185.220.101.5", "Botnet C2")], "ip string, category string"))
    found = intel.threat_ips(df, listed, spark.createDataFrame([("example.com",)], "name string"))
    assert "(pkt_id#" not in "".join(x for x in planned(found).splitlines() if "Join" in x)
    assert found.count() == enrich.indicator_hits(df, listed).count() > 0


def test_draws_and_windows_of_models_are_not_broadcast(spark):
    rows = stored(spark.range(600).select((F.col("id") + 10).alias("slot"), F.col("id").alias("number"), F.array(F.col("id") % 7.0, F.col("id") * 1.0).alias("x")))
    found = stored(models.schedule(rows, 200, 100, 300))
    nodes = stored(models.train(rows, found, 3, 16))
    for df in (models.train(rows, found, 3, 16), models.scores(rows, found, nodes, 100, 16)):
        joins = [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x and "cell#" not in x]
        assert joins and all("SortMergeJoin" in x for x in joins)


def test_batches_of_a_stream_do_not_grow_with_the_table(spark):
    rows = plan.packets(spark, "/root/testdata/sf0.001").select(*detect.NEEDED, "ts")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = q_stream.run(spark, rows, lambda s: s.withColumn("file", F.input_file_name()), most=1000)
    sizes = {r[0]: r[1] for r in got.groupBy("file").count().collect()}
    n = rows.count()
    assert sum(sizes.values()) == n and got.select("pkt_id").distinct().count() == n
    assert len(sizes) >= n // 1000 and max(sizes.values()) <= 1200
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_rules_window_only_blocks_that_can_reach_their_threshold(spark):
    rows = [("quiet", k * 900, k, k % 3) for k in range(50)] + [("loud", k, 100 + k, k) for k in range(6)] + [("edge", 990 + k * 5, 200 + k, k) for k in range(5)] + [(None, k, 300 + k, k) for k in range(5)]
    df = spark.createDataFrame(rows, "src_ip string, ts_ms long, pkt_id long, port long").withColumn("size", F.lit(10))
    for value in (None, "port"):
        kept = windows.busy(df, ["src_ip"], 1000, 5, value)
        assert {r.src_ip for r in kept.select("src_ip").distinct().collect()} == {"loud", "edge", None}
    full, few = (windows.count_in_window(x, ["src_ip"], 1000, "n").where("n >= 5").select("pkt_id", "n").collect() for x in (df, windows.busy(df, ["src_ip"], 1000, 5)))
    assert sorted(full) == sorted(few) and len(full) == 2 + 1 + 1
    every = {r.pkt_id: r.t for r in windows.running_total(df, "src_ip", "size", "t", 1000).collect()}
    some = {r.pkt_id: r.t for r in windows.running_total(df, "src_ip", "size", "t", 1000, changes=lambda a, b: (a < 300) & (b >= 300)).collect()}
    assert 0 < len(some) < 3 and some.items() <= every.items()


def test_names_end_their_fold_early_and_long_ones_are_read_whole(spark):
    labels = [f"label{k}" for k in range(20)]
    whole = b"".join(bytes([len(x)]) + x.encode() for x in labels) + b"\0"
    far = b"\xc0\x10" + b"\0\0" + whole  # a pointer to a name of twenty labels, and one that points to itself
    rows = spark.createDataFrame([(1, bytes(12) + whole), (2, bytes(12) + far), (3, bytes(12) + b"\xc0\x0c"), (4, bytes(12) + b"\x03abc")], "id long, raw binary").withColumn("x", F.hex("raw"))
    got = rows.select("id", binary.dns_name(F.col("x")).alias("name"))
    assert {r.id: r.name for r in got.collect()} == {1: ".".join(labels), 2: ".".join(labels), 3: "", 4: "abc"}
    assert f"sequence({binary.FIRST + 1}, {binary.LABELS + binary.JUMPS}" in got._jdf.queryExecution().analyzed().toString()


def test_verdicts_are_joined_without_a_shuffle_and_points_are_worked_out_once(spark):
    plan_ = entry.queries()["v_verdicts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "SortMergeJoin" not in plan_.sparkPlan().toString()
    assert plan_.optimizedPlan().toString().count("array_intersect") == 1


def test_the_forest_reads_its_windows_from_a_table(spark):
    got = entry.queries()["l3_isolation_forest"](spark, "/root/testdata/sf0.001")
    assert "Window" not in planned(got) and "Aggregate" not in planned(got) and got.count() > 0


def test_each_pattern_of_findings_runs_once(spark):
    rows = [(1, "10.1.1.1", 5000, 80, "POST /a HTTP/1.1\r\nHost: h.example\r\nX-API-Key: abcdefghij\r\n\r\npassword=secret1&x=1"), (2, "10.1.1.1", 5000, 21, "USER anna\r\nPASS word12\r\n"), (3, "10.1.1.1", 21, 21, "USER bob\r\n"),
            (4, "8.8.8.8", 5000, 80, "GET / HTTP/1.1\r\nSet-Cookie: SessionId=1\r\n"), (5, "10.1.1.1", 40000, 80, "card=4111111111111111 "), (6, "10.1.1.1", None, None, "PASS word12"), (7, "10.1.1.1", 5000, 21, None)]
    df = spark.createDataFrame(rows, "pkt_id long, dst_ip string, src_port int, dst_port int, payload string").selectExpr("*", "pkt_id as ts_ms", "'10.9.9.9' as src_ip", "false as is_encrypted", "50 as payload_size")
    found, shown = payload.secrets(df), payload.exposures(df)
    assert [planned(found).count(x) for x in ("x-api-key", "passwd|pass|pwd", "createUser", "Proxy-Authorization")] == [1, 1, 1, 1] and "lambda" not in planned(found)
    assert planned(shown).count("Set-Cookie:") == planned(shown).count("_cluster") == 1 and planned(payload.sensitive(df)).count("4\\d{15}") == 1
    assert {(r.pkt_id, r.kind, r.masked, r.note) for r in found.collect()} == {
        (1, "HTTP_API_KEY", "abcdef****", ""), (1, "HTTP_FORM", "sec****", "h.example /a"), (2, "FTP_USER", "anna", ""), (2, "FTP_PASS", "wor***", ""), (3, "FTP_USER", "bob", ""),
    }
    assert sorted((r.pkt_id, r.type, r.value) for r in shown.collect()) == [(4, "Session Cookie", "SessionId=1")] * 2
    assert [(r.pkt_id, r.kind, r.masked) for r in payload.sensitive(df).collect()] == [(5, "CARD", "****1111")]


def test_what_numbers_stand_in_is_asked_of_all_packets_once(spark):
    plan_ = entry.queries()["x20_context"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan_.count("RFB 003.008") == 1


def test_tasks_of_the_view_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(plan, "TASK_BYTES", 1000)
    assert plan.packets(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 10


def test_packets_find_where_they_leave_in_one_pass(spark):
    rows = stored(spark.range(1000).select(F.col("id").alias("number"), F.floor(F.pow("id", F.lit(0.8)) / 3).alias("slot")))
    slots = [r.slot for r in rows.orderBy("number").collect()]
    for most, size in ((1, 1), (7, 50), (100, 64), (2000, 10)):
        df = trailing.leaving(rows, most, size)
        assert "Join" not in planned(df)
        got = df.orderBy("number").collect()
        assert [r.slot for r in got] == slots and [r.leave for r in got] == [slots[k + most] if k + most < 1000 else None for k in range(1000)]
        ends = {s: k for k, s in enumerate(slots)}  # the last packet of each slot
        assert {r.opens: r.number for r in got if r.opens is not None} == {s: k - most + 1 for s, k in ends.items() if k >= most - 1}

    got = entry.queries()["l1_last_packets"](spark, "/root/testdata/sf0.001")
    assert "number#" not in "".join(x for x in planned(got).splitlines() if "Join" in x)
