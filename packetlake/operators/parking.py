"""Parking messages in clear XML: card numbers' ends, transponder tags, cards used as tickets, commands."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The port, and the elements that are read. Elements may stand anywhere in the payload, in any case.
PORT = 31769
ELEMENTS = {
    "command": r"<(?:Command|CommandType)>\s*(\w+)\s*</", "last4": r"<LastFour>\s*(\d{4})\s*</LastFour>", "card_type": r"<CardType>\s*(\w+)\s*</CardType>", "ticket": r"<TicketNumber>\s*(\d+)\s*</TicketNumber>",
    "tag": r"<EntryCredential>\s*:?(\d{1,3}:\d+)\s*</EntryCredential>", "as_ticket": r"<EntryCredential>\s*:(\d{4})\s*</EntryCredential>", "account": r"<AccountId>\s*([^<]+)\s*</AccountId>", "sender": r"<SenderId>\s*([^<]+)\s*</SenderId>",
}
FINDING = ("pkt_id", "ts_ms", "kind", "severity", "masked", "ticket", "gate", "n")


def messages(packets: DataFrame, text: str = "payload") -> DataFrame:
    """The elements of each message on the parking port, empty where absent."""
    rows = packets.where((F.col("dst_port") == PORT) | (F.col("src_port") == PORT))
    parts = F.array(F.struct(*[F.regexp_extract(text, "(?i)" + p, 1).alias(n) for n, p in ELEMENTS.items()]))
    rows = rows.select("pkt_id", "ts_ms", "src_ip", F.explode(parts).alias("m")).select("pkt_id", "ts_ms", "src_ip", "m.*")
    return rows.withColumn("gate", F.when(F.col("sender") == "", F.col("src_ip")).otherwise(F.trim("sender")))


def _first(rows: DataFrame, key: str, kind: Column, severity: Column, masked: Column) -> DataFrame:
    """The first message of each key, and how many there are."""
    made = rows.select(F.col(key).alias("_key"), F.struct("ts_ms", "pkt_id").alias("_at"), kind.alias("kind"), severity.alias("severity"), masked.alias("masked"), "ticket", "gate")
    first = made.groupBy("_key").agg(F.min_by(F.struct("_at", "kind", "severity", "masked", "ticket", "gate"), "_at").alias("x"), F.count("*").alias("n"))
    return first.select("x._at.pkt_id", "x._at.ts_ms", "x.kind", "x.severity", "x.masked", "x.ticket", "x.gate", "n")


def findings(packets: DataFrame, agencies: DataFrame, text: str = "payload") -> DataFrame:
    """A row for each card (its last four digits and kind) and each tag at its first message, and for each card used as a ticket.

    agencies: code int, state, name, a row a code. Tags of agency 68, and short ones of agencies over 60, are contactless
    cards (HIGH), others transponders (CRITICAL) with the state that their agency belongs to.
    """
    rows = messages(packets, text)
    cards = rows.where("last4 <> ''").withColumn("_card", F.concat("last4", F.lit(":"), F.when(F.col("card_type") == "", "Unknown").otherwise(F.col("card_type"))))
    card = _first(cards, "_card", F.lit("CARD"), F.lit("CRITICAL"), F.concat(F.substring_index("_card", ":", -1), F.lit(" ****"), F.col("last4")))
    tags = rows.where("tag <> ''").withColumns({"_agency": F.substring_index("tag", ":", 1), "_id": F.substring_index("tag", ":", -1)})
    tags = tags.join(F.broadcast(agencies.select(F.col("code").alias("_code"), "state")), F.col("_agency").cast("int") == F.col("_code"), "left")  # three digits: a thousand codes at most
    contactless = (F.col("_agency") == "68") | ((F.col("_agency").cast("int") > 60) & (F.length("_id") <= 5))
    shown = F.concat(F.col("_agency"), F.lit(":"), F.regexp_replace(F.substring("_id", 1, 64), r".(?=.{3})", "*"), F.when(~contactless & F.col("state").isNotNull(), F.concat(F.lit(" "), F.col("state"))).otherwise(""))
    tag = _first(tags, "tag", F.when(contactless, "CONTACTLESS").otherwise("TRANSPONDER"), F.when(contactless, "HIGH").otherwise("CRITICAL"), shown)
    ticket = rows.where("as_ticket <> '' and tag = '' and last4 = ''").select("pkt_id", "ts_ms", F.lit("CARD_AS_TICKET").alias("kind"), F.lit("HIGH").alias("severity"), F.concat(F.lit("****"), F.col("as_ticket")).alias("masked"), "ticket", "gate", F.lit(1).cast("long").alias("n"))
    return card.unionByName(tag).unionByName(ticket).select(*FINDING)


def commands(packets: DataFrame, text: str = "payload") -> DataFrame:
    """Messages with a command and neither card nor tag, for the timeline."""
    return messages(packets, text).where("command <> '' and last4 = '' and tag = ''").select("pkt_id", "ts_ms", "command", "ticket", "gate", F.trim("account").alias("account"))
