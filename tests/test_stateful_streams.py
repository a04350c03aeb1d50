"""Streams with keyed state give the rows of the batch rules in any split into batches; late rows and expiry."""

import functools
import json

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.operators import detect, enrich
from packetlake.plans.packets import packets
from packetlake.streaming import alerts, stateful

SF = "/root/testdata/sf0.001"
COLUMNS = ("pkt_id", "ts_ms", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flags", "dns_query", "payload_size", "src_mac")
END = 10**15


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("packets") / "all")
    packets(spark, SF).where("pkt_id between 300 and 6700").select(*COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


def written(df, folder, split, end=True):
    """One file a batch, then a file that moves the watermark past all of them."""
    split = F.expr(split)
    names = sorted(r[0] for r in df.select(split.alias("x")).distinct().collect())
    for k, x in enumerate(names):
        df.where(split == x).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    if end:
        last = df.limit(1).withColumns({"pkt_id": F.lit(END).cast("long"), "ts_ms": F.lit(1704072600000 + 86_400_000).cast("long"), "src_ip": F.lit("8.8.8.8")})
        last = last.withColumn("ts", F.timestamp_millis("ts_ms"))
        for k in range(2):  # timers fire in the batch after the one that moved the watermark
            last.withColumn("pkt_id", F.col("pkt_id") + k).coalesce(1).write.parquet(f"{folder}/{900 + k}")
    return folder


def streamed(spark, build, schema, folder, out):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    q = build(stream).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(600)
    return spark.read.parquet(f"{out}/rows").where(F.col("pkt_id") < END), q


def same(got, want):
    key = lambda r: json.dumps({k: r[k] for k in sorted(r)}, sort_keys=True, default=str)
    a, b = (sorted(key(r.asDict()) for r in df.collect()) for df in (got, want))
    assert a == b and a


SPLITS = {
    "one batch": "0",
    "inside floods": "pkt_id div 1500",
    "out of order": "(pkt_id div 1000) + (pkt_id % 2) + (pkt_id * 7919 % 3)",
}


@pytest.mark.parametrize("split", SPLITS)
def test_rules_equal_batch(spark, rows, tmp_path, split):
    look = detect.candidates(rows)
    want = functools.reduce(DataFrame.unionByName, [r(look) for r in alerts.KEYED_RULES])
    assert {r.rule_id for r in want.select("rule_id").distinct().collect()} == {"PORT-SCAN", "BRUTE-FORCE", "SYN-FLOOD", "ICMP-FLOOD", "DNS-FLOOD", "ARP-SPOOF", "DATA-EXFIL"}
    got, _ = streamed(spark, alerts.alert_stream, rows.schema, written(rows, str(tmp_path / "in"), SPLITS[split]), str(tmp_path / "out"))
    same(got, want)


@pytest.mark.parametrize("split", SPLITS)
def test_names_and_cooldown_equal_batch(spark, rows, tmp_path, split):
    folder = written(rows, str(tmp_path / "in"), SPLITS[split])
    got, _ = streamed(spark, alerts.domain_stream, rows.schema, folder, str(tmp_path / "out"))
    same(got.select("pkt_id", "dst_ip", "domain"), enrich.inferred_domains(rows).select("pkt_id", "dst_ip", "domain"))
    found = detect.brute_force(detect.candidates(rows)).unionByName(detect.bad_tld(detect.candidates(rows)))
    schema = found.schema
    timed = found.withColumn("ts", F.timestamp_millis("ts_ms"))
    folder = written(timed, str(tmp_path / "alerts"), SPLITS[split])
    got, q = streamed(spark, alerts.passed_stream, schema, folder, str(tmp_path / "passed"))
    same(got, detect.cooldown(found))
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= 4 < found.select("rule_id", "src_ip", "dst_ip").distinct().count()  # what is left belongs to the last rows, which moved the watermark


def test_late_rows_are_dropped_and_idle_keys_expire(spark, rows, tmp_path):
    at = 1704072600000
    make = lambda name, data: spark.createDataFrame(data, "pkt_id long, ts_ms long, src_ip string").withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    make("0", [(k, at + k * 1000, "a") for k in range(5)])
    make("1", [(5, at + 400_000, "b")])
    make("2", [(6, at + 500_000, "b"), (8, at + 450_000, "a")])
    make("3", [(9, at + 900_000, "b"), (7, at + 4500, "a")])  # 7 is later than the watermark
    make("4", [(10, at + 9_000_000, "b")])
    make("5", [(11, at + 9_000_001, "b")])
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    build = lambda s: stateful.count_in_window(s.withWatermark("ts", "2 minutes"), ["src_ip"], 300_000, "n")
    got, q = streamed(spark, build, schema, f"{tmp_path}/in", str(tmp_path / "out"))
    assert sorted((r.pkt_id, r.n) for r in got.collect()) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (6, 2), (8, 1), (9, 1)]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"])
    assert dropped == 1
