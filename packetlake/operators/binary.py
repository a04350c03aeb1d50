"""Findings in binary payloads (column payload_raw binary): DHCP, mDNS and LLMNR, Modbus, BACnet. Column expressions alone.

Bytes are read from the payload's hexadecimal text; a byte behind the end is null. Lists of options and names, which say
themselves where the next part begins, are folds over at most as many steps as there are bytes (or labels).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake.operators.stored import held as _held

# Message and function names of the protocols.
DHCP_TYPES = {1: "Discover", 2: "Offer", 3: "Request", 4: "Decline", 5: "ACK", 6: "NAK", 7: "Release", 8: "Inform"}
MODBUS_WRITES = (5, 6, 15, 16, 22, 23)
MODBUS_NAMES = {
    1: "Read Coils", 2: "Read Discrete Inputs", 3: "Read Holding Registers", 4: "Read Input Registers", 5: "Write Single Coil", 6: "Write Single Register", 15: "Write Multiple Coils",
    16: "Write Multiple Registers", 22: "Mask Write Register", 23: "Read/Write Multiple Registers", 43: "Read Device Identification",
}
BACNET_PORT, NOT_BACNET = 47808, (10001, 8443)
#: Labels of a name and jumps to other places that are followed.
LABELS, JUMPS = 128, 16
#: Steps that every name takes.
FIRST = 6


def _byte(text: Column, at) -> Column:
    """The byte at a place of the hexadecimal text, null behind its end."""
    at = at if isinstance(at, Column) else F.lit(at)
    two = F.substr(text, (at * 2 + 1).cast("int"), F.lit(2))
    return F.when(F.length(two) == 2, F.conv(two, 16, 10).cast("int"))


def _part(text: Column, at: Column, size: Column) -> Column:
    return F.substr(text, (at * 2 + 1).cast("int"), (size * 2).cast("int"))


def _two(text: Column, at) -> Column:
    return _byte(text, at) * 256 + _byte(text, at + 1)


def _text(hexadecimal: Column) -> Column:
    return F.make_valid_utf8(F.unhex(hexadecimal).cast("string"))


def _address(text: Column, at: int) -> Column:
    return F.concat_ws(".", *[_byte(text, at + k).cast("string") for k in range(4)])


def _name(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def _on(packets: DataFrame, *ports: int) -> DataFrame:
    rows = packets.where(F.col("dst_port").isin(*ports) | F.col("src_port").isin(*ports))
    return _held(rows, _x=F.hex("payload_raw"), _n=F.coalesce(F.length("payload_raw"), F.lit(0)))


def dhcp(packets: DataFrame) -> DataFrame:
    """pkt_id, ts_ms, mac, ip, hostname, vendor, type of DHCP messages: fixed fields, then the options 53, 12, 60 and 50 in any order.

    The address is the one given, else the client's own, else the one asked for. A length that goes past the end takes
    what is there. Messages under 240 bytes and such without a hardware address are left out.
    """
    rows = _on(packets, 67, 68).where("_n >= 240")
    x = F.col("_x")
    own = F.lower(F.concat_ws(":", *[F.substr(x, F.lit(2 * (28 + k) + 1), F.lit(2)) for k in range(6)]))
    mac = F.when((_byte(x, 2) == 6) & (F.col("_n") > 34), own).otherwise(F.coalesce("src_mac", F.lit("")))
    start = F.struct(F.lit(240).alias("at"), F.lit(0).alias("type"), F.lit("").alias("host"), F.lit("").alias("vendor"), F.lit("").alias("asked"))

    def step(s, _):
        option, size = _byte(x, s["at"]), _byte(x, s["at"] + 1)
        data = _part(x, s["at"] + 2, size)
        ended = (s["at"] < 0) | option.isNull() | (option == 255) | (s["at"] >= F.col("_n") - 1)
        given = lambda code, test=F.lit(True): ~ended & (option == code) & test
        at = F.when(ended, -1).when(option == 0, s["at"] + 1).otherwise(s["at"] + 2 + size)
        return F.struct(
            at.alias("at"), F.when(given(53, size == 1), _byte(x, s["at"] + 2)).otherwise(s["type"]).alias("type"), F.when(given(12), data).otherwise(s["host"]).alias("host"),
            F.when(given(60), data).otherwise(s["vendor"]).alias("vendor"), F.when(given(50, size == 4), data).otherwise(s["asked"]).alias("asked"),
        )

    cookie = F.substr(x, F.lit(2 * 236 + 1), F.lit(8)) == "63825363"
    steps = F.when(cookie & (F.col("_n") > 240), F.sequence(F.lit(1), F.col("_n") - 240)).otherwise(F.array().cast("array<int>"))
    rows = _held(rows, _mac=mac, _o=F.aggregate(steps, start, step))
    asked = F.concat_ws(".", *[_byte(F.col("_o.asked"), k).cast("string") for k in range(4)])
    ip = F.coalesce(*[F.when(~a.isin("", "0.0.0.0"), a) for a in (_address(x, 16), _address(x, 12), asked)], F.lit(""))
    kind = F.coalesce(_name(DHCP_TYPES, F.col("_o.type")), F.concat(F.lit("Type "), F.col("_o.type").cast("string")))
    rows = rows.where(~F.col("_mac").isin("", "00:00:00:00:00:00"))
    return rows.select("pkt_id", "ts_ms", F.col("_mac").alias("mac"), ip.alias("ip"), _text(F.col("_o.host")).alias("hostname"), _text(F.col("_o.vendor")).alias("vendor"), kind.alias("type"))


def dns_name(text: Column, at: int = 12) -> Column:
    """The name at a place of a DNS message in hexadecimal: labels, and pointers to other places of the message. At most LABELS steps and JUMPS pointers are followed.

    The first FIRST steps are a fold, and the others one that only names which have not ended by then go through.
    """
    start = F.struct(F.lit(at).alias("at"), F.lit("").alias("name"), F.lit(0).alias("jumps"))

    def step(s, _):
        size = F.when(s["at"] >= 0, _byte(text, s["at"]))
        jump = (size >= 192) & (s["jumps"] < JUMPS) & _byte(text, s["at"] + 1).isNotNull()
        label = (size > 0) & (size < 64)
        to = F.when(jump, (size - 192) * 256 + _byte(text, s["at"] + 1)).when(label, s["at"] + 1 + size).otherwise(-1)
        said = F.concat(s["name"], F.when(s["name"] == "", "").otherwise("2E"), _part(text, s["at"] + 1, size))
        on = F.struct(to.alias("at"), F.when(label, said).otherwise(s["name"]).alias("name"), (s["jumps"] + F.coalesce(jump, F.lit(False)).cast("int")).alias("jumps"))
        return F.when(s["at"] < 0, s).otherwise(on)

    some = F.aggregate(F.sequence(F.lit(1), F.lit(FIRST)), start, step)
    rest = lambda s: F.when(s["at"] < 0, s).otherwise(F.aggregate(F.sequence(F.lit(FIRST + 1), F.lit(LABELS + JUMPS)), s, step))
    return _text(F.transform(F.array(some), rest)[0]["name"])


def answered_names(packets: DataFrame) -> DataFrame:
    """pkt_id, ts_ms, src_ip, dst_ip, protocol, name of mDNS and LLMNR responses that have an answer."""
    rows = _on(packets, 5353, 5355).where("_n >= 12").where((_byte(F.col("_x"), 2) >= 128) & (_two(F.col("_x"), 6) > 0))
    protocol = F.when((F.col("dst_port") == 5353) | (F.col("src_port") == 5353), "mDNS").otherwise("LLMNR")
    return _held(rows, protocol=protocol, name=dns_name(F.col("_x"))).select("pkt_id", "ts_ms", "src_ip", "dst_ip", "protocol", "name").where("name <> ''")


def poisoned_names(packets: DataFrame) -> DataFrame:
    """A finding for each name that a second responder answers for, at that responder's first answer; HIGH for mDNS, CRITICAL for LLMNR."""
    first = answered_names(packets).groupBy("protocol", "name", "src_ip").agg(F.min(F.struct("ts_ms", "pkt_id")).alias("at"))
    place = F.row_number().over(W.partitionBy("protocol", "name").orderBy("at"))  # tasks pass on two responders a name
    two = first.withColumn("_place", place).where("_place <= 2").groupBy("protocol", "name").agg(F.count("*").alias("n"), F.max("at").alias("at"), F.max_by("src_ip", "at").alias("src_ip"), F.array_join(F.array_sort(F.collect_set("src_ip")), ", ").alias("responders"))
    return two.where("n > 1").select("at.pkt_id", "at.ts_ms", "src_ip", "protocol", "name", F.when(F.col("protocol") == "mDNS", "HIGH").otherwise("CRITICAL").alias("severity"), "responders")


FINDING = ("pkt_id", "ts_ms", "src_ip", "dst_ip", "kind", "severity", "detail")


def modbus(packets: DataFrame) -> DataFrame:
    """Modbus: writes are CRITICAL findings with unit, register and value, other functions are told of, and a short frame is a finding."""
    x, n = F.col("_x"), F.col("_n")
    rows = _held(_on(packets, 502), _f=_byte(x, 7))
    write, name = F.col("_f").isin(*MODBUS_WRITES), F.coalesce(_name(MODBUS_NAMES, F.col("_f")), F.concat(F.lit("Function "), F.col("_f").cast("string")))
    where = F.when(n >= 12, F.concat(F.lit(", Register "), _two(x, 8).cast("string"), F.lit(" = "), _two(x, 10).cast("string"))).otherwise("")
    detail = F.when(n < 8, "no authentication").when(write, F.concat(F.lit("Unit "), _byte(x, 6).cast("string"), F.lit(", "), name, where)).otherwise(name)
    kind = F.when(n < 8, "Modbus/SCADA").when(write, "Modbus WRITE").otherwise("Modbus READ")
    return rows.select("pkt_id", "ts_ms", "src_ip", "dst_ip", kind.alias("kind"), F.when((n < 8) | write, "CRITICAL").otherwise("INFO").alias("severity"), detail.alias("detail"))


def bacnet(packets: DataFrame) -> DataFrame:
    """BACnet/IP requests by service: discovery, answers to it, writes, resets and reads.

    The request begins behind the network header, whose parts are as long as they say: destination network (with an
    address of DLEN bytes and a hop count), and source network (with SLEN bytes).
    """
    x = F.col("_x")
    rows = _on(packets, BACNET_PORT).where(~F.col("dst_port").isin(*NOT_BACNET) & ~F.col("src_port").isin(*NOT_BACNET)).where(_byte(x, 0) == 0x81)
    control = _byte(x, 5)
    rows = _held(rows, _to=control.bitwiseAND(0x20) > 0, _of=control.bitwiseAND(0x08) > 0, _d=_byte(x, 8))
    to, of = F.col("_to"), F.col("_of")
    rows = _held(rows, _s=F.when(to, 9 + F.col("_d")).otherwise(6))  # where the source network begins
    rows = _held(rows, _a=F.when(of, F.col("_s") + 3 + _byte(x, F.col("_s") + 2)).otherwise(F.col("_s")) + F.when(to, 1).otherwise(0))
    rows = _held(rows, _t=F.floor(_byte(x, F.col("_a")) / 16), _one=_byte(x, F.col("_a") + 1), _two=_byte(x, F.col("_a") + 2))
    rows = _held(rows.where(F.col("_n") > F.col("_a") + 2), _v=F.when(F.col("_t") == 1, F.col("_one")).when(F.col("_t") == 0, F.col("_two")))
    v = F.col("_v")
    kinds = ((v == 8, "BACnet Discovery", "MEDIUM"), (v == 0, "BACnet Device", "INFO"), (v.isin(15, 16), "BACnet WRITE", "CRITICAL"), (v == 20, "BACnet RESET", "CRITICAL"), (v.isin(12, 14), "BACnet READ", "INFO"))
    kind = severity = F.lit(None).cast("string")
    for test, k, s in kinds:
        kind, severity = F.when(test, k).otherwise(kind), F.when(test, s).otherwise(severity)
    return rows.select("pkt_id", "ts_ms", "src_ip", "dst_ip", kind.alias("kind"), severity.alias("severity"), F.concat(F.lit("Service "), v.cast("string")).alias("detail")).where("kind is not null")
