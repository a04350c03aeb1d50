"""Features of the last packets at every step of time: windows bounded by a count.

Packets are numbered in order of (ts_ms, pkt_id) by sums over slots of time, so no task sees them all. Each slot with packets is
a tick, and its window the last `most` packets up to its end: an interval of numbers. Sums over an interval are
differences of running sums at its ends. How often a value stands in the windows changes only at the tick that its packet
enters and at the one it leaves (that of the packet `most` numbers later), so different values and entropy are running
sums of those changes over the ticks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake.functions import net
from packetlake.operators.features import FEATURES, USED
from packetlake.operators.stored import stored
from packetlake.operators.windows import previous, running_total, sums_before

#: Decimals of a value's part of the entropy: exact sums, so that running sums don't drift.
_PART = "decimal(28,9)"


def _values() -> dict:
    """What a packet adds to a window's sums, as whole numbers."""
    flags, count = F.col("flags"), lambda test: F.coalesce(test, F.lit(False)).cast("long")
    return {
        "length": F.col("length").cast("long"), "payload": F.col("payload_size").cast("long"), "syn": count(net.syn_only(flags)), "dns": count(F.col("dns_query") != ""), "rst": count(flags.contains("R")),
        "small": count(F.col("length") < 100), "large": count(F.col("length") > 1400), "enc": count(F.col("is_encrypted")), "gap": F.coalesce("_gap", F.lit(0)), "gap2": F.coalesce(F.col("_gap") * F.col("_gap"), F.lit(0)),
    }


def numbered(packets: DataFrame, seconds: int = 5) -> DataFrame:
    """slot, number (from 0), the values, their sums up to each packet (s_), and the columns of which values are counted."""
    rows = packets.select(*USED).withColumns({"slot": F.floor(F.col("ts_ms") / (1000 * seconds)), "_all": F.lit("")})
    rows = previous(rows, "_all", "ts_ms", "_last").withColumn("_gap", F.col("ts_ms") - F.col("_last"))
    values = _values()
    rows = rows.withColumns({f"v_{n}": x for n, x in values.items()}).withColumn("v_one", F.lit(1).cast("long")).select("slot", "ts_ms", "pkt_id", "dst_port", "dst_ip", "protocol", *[f"v_{n}" for n in (*values, "one")])
    rows = stored(rows)
    names = (*values, "one")
    before = sums_before(rows, "slot", **{f"b_{n}": F.sum(f"v_{n}") for n in names})
    inside = W.partitionBy("slot").orderBy("ts_ms", "pkt_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"s_{n}": F.sum(f"v_{n}").over(inside) for n in names}).join(before, "slot")
    rows = rows.withColumns({f"s_{n}": F.col(f"s_{n}") + F.col(f"b_{n}") for n in names}).withColumn("number", F.col("s_one") - 1)
    return stored(rows.drop(*[f"b_{n}" for n in names]))


def _changes(rows: DataFrame, column: str) -> DataFrame:
    """slot and what its tick changes: kinds (different values) and parts (sum of k log2 k over their counts)."""
    moves = rows.select(F.col(column).cast("string").alias("x"), "slot", F.lit(1).alias("d")).unionByName(rows.where("leave is not null").select(F.col(column).cast("string").alias("x"), F.col("leave").alias("slot"), F.lit(-1).alias("d")))
    moves = moves.groupBy("x", "slot").agg(F.sum("d").alias("d")).withColumns({"ts_ms": F.col("slot"), "pkt_id": F.col("slot")})
    counted = running_total(moves, "x", "d", "k", 4096)
    before = F.col("k") - F.col("d")
    part = lambda k: F.when(k > 0, k * F.log2(k)).otherwise(0.0).cast(_PART)
    return counted.groupBy("slot").agg(F.sum((F.col("k") > 0).cast("long") - (before > 0).cast("long")).alias("kinds"), F.sum(part(F.col("k")) - part(before)).cast(_PART).alias("parts"))


def _standing(changes: DataFrame, name: str) -> DataFrame:
    """slot, name (kinds after its tick) and name_parts."""
    changes = stored(changes)  # a row a slot, read twice
    before = sums_before(changes, "slot", _kinds=F.sum("kinds"), _parts=F.sum("parts"))
    return changes.join(before, "slot").select("slot", (F.col("kinds") + F.col("_kinds")).alias(name), (F.col("parts") + F.col("_parts")).cast("double").alias(name + "_parts"))


def leaving(rows: DataFrame, most: int, size: int = 65536) -> DataFrame:
    """rows with `leave`, the slot in whose window they are no longer, and `opens`, the slot whose window of `most` packets they begin (null: none).

    Numbers are cut into blocks, and each block also gets the first `most` packets of the next one, so one pass over
    the packets tells which one stands `most` places later.
    """
    size = max(size, most)
    block, own = F.floor(F.col("number") / size), F.col("_own")
    rows = rows.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).where(own | (F.col("number") % size < most)).withColumn("_block", F.when(own, block).otherwise(block - 1))
    later = W.partitionBy("_block").orderBy("number")
    rows = rows.withColumns({"leave": F.lead("slot", most).over(later), "_last": F.lead("slot", most - 1).over(later)}).where(own)
    return rows.withColumn("opens", F.when(~F.col("_last").eqNullSafe(F.col("leave")), F.col("_last"))).drop("_own", "_block", "_last")


def features(packets: DataFrame, most: int = 5000, seconds: int = 5) -> DataFrame:
    """A row of 18 features for each slot of time that has packets, over the last `most` packets up to its end."""
    rows = numbered(packets, seconds)
    sums = [n.removeprefix("s_") for n in rows.columns if n.startswith("s_")]
    last = rows.groupBy("slot").agg(F.max_by(F.struct(*[f"s_{n}" for n in sums]), "number").alias("end"))
    begin = rows.select("number", "slot", "dst_port", "dst_ip", "protocol", *[(F.col(f"s_{n}") - F.col(f"v_{n}")).alias(f"f_{n}") for n in sums], F.col("s_gap").alias("f_gap_in"), F.col("s_gap2").alias("f_gap2_in"))
    values = [n for n in begin.columns if n.startswith("f_")]
    moves = stored(leaving(begin, most).select("slot", "leave", "dst_port", "dst_ip", "protocol", "opens", *[F.when(F.col("opens").isNotNull(), F.col(n)).alias(n) for n in values]))
    first = moves.where("opens is not null").select(F.col("opens").alias("slot"), *values)
    at = last.join(first, "slot", "left").fillna(0, values)  # shorter windows begin with the first packet, before which nothing is
    for column in ("dst_port", "dst_ip", "protocol"):
        at = at.join(_standing(_changes(moves, column), column), "slot")
    total = {n: F.col(f"end.s_{n}") - F.col(f"f_{n}") for n in sums}
    n = total["one"]
    gaps, gap, gap2 = n - 1, (F.col("end.s_gap") - F.col("f_gap_in")) / 1000.0, (F.col("end.s_gap2") - F.col("f_gap2_in")) / 1e6
    mean = F.when(gaps > 0, gap / gaps).otherwise(0.0)
    spread = F.when(gaps > 0, F.sqrt(F.greatest(gap2 / gaps - mean * mean, F.lit(0.0)))).otherwise(0.0)
    out = {
        "bytes_per_sec": total["length"] / seconds, "packets_per_sec": n / seconds, "avg_packet_size": total["length"] / n, "unique_dst_ports": F.col("dst_port").cast("double"), "unique_dst_ips": F.col("dst_ip").cast("double"),
        "syn_ratio": total["syn"] / n, "dns_rate": total["dns"] / seconds, "failed_conn_ratio": total["rst"] / n, "port_entropy": F.log2(n) - F.col("dst_port_parts") / n, "iat_mean": mean, "iat_std": spread,
        "payload_ratio": total["payload"] / total["length"], "direction_asymmetry": F.lit(0.0), "small_packet_ratio": total["small"] / n, "large_packet_ratio": total["large"] / n, "rst_ratio": total["rst"] / n,
        "protocol_count": F.col("protocol").cast("double"), "encrypted_ratio": total["enc"] / n,
    }
    return at.select("slot", n.alias("packets"), *[F.round(out[f] + F.lit(0.0), 6).alias(f) for f in FEATURES])
