"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

Dimensions are the language, the source, the length in bytes and the number of words. A node is split along the one that
is widest in it, as a share of the table's width. Rows that are equal there are told apart by the other dimensions, widest
first, and only then by a hash of the text. Rows with equal texts stand for one point (the smallest language and source
that one of them has), so they stay together unless a cut must fall inside their group, which is then cut by doc_id.

Edge cases: a null text has no bytes, so size 1, and counts as the empty text; a null language or source stands before all
others; rows without doc_id count as rows of one id, and repeated rows
get a slot each; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lookup, numbered, saved

#: Bins of one histogram pass for all nodes of a level together: what the driver receives is at most this many rows.
BINS = 1 << 16


DIMENSIONS = ("lang", "source", "length", "words")


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions as whole numbers below 2**32, and the hashes that break ties."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    place = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(F.col(c).cast("string")), 32))
    return docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place("lang").alias("lang"),
        place("source").alias("source"),
        (F.log2(size) * (1 << 26)).cast("long").alias("length"),
        (F.length(text) - F.length(F.translate(text, " \n\t", ""))).cast("long").alias("words"),
        F.xxhash64(text).alias("text_hash"),
        F.shiftrightunsigned(F.xxhash64(text), 32).alias("text_place"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 32).alias("doc_place"),
    )


def one_point_a_text(rows: DataFrame) -> DataFrame:
    """Rows of one text with different languages or sources take the smallest of each."""
    groups = rows.groupBy("text_hash").agg(F.count("*").alias("c"), *[f(x).alias(f"{k}_{x}") for x in ("lang", "source") for k, f in (("lo", F.min), ("hi", F.max))])
    groups = saved(groups.where("lo_lang <> hi_lang or lo_source <> hi_source").select("text_hash", "c", "lo_lang", "lo_source"))
    out = lookup(rows, groups, ["text_hash"], ["lo_lang", "lo_source"], "c", groups.agg(F.sum("c")).first()[0] or 0)
    out = saved(out.withColumns({x: F.coalesce("lo_" + x, x) for x in ("lang", "source")}).drop("lo_lang", "lo_source"))
    forget(groups)
    return out


def _cut(level: DataFrame, share: dict[int, float], key: dict[int, str], carry: dict[int, tuple]) -> dict[int, tuple[int, bool]]:
    """For each open node, the value of its key column at which the weight reaches its share, found by narrowing histograms.

    Each pass bins the rows still in question; after a few passes the bin is one value. Returns value and weight below it.
    """
    lo_hi = {n: (0, (1 << 32) - 1) for n in share}
    below = {n: carry[n][1] for n in share}
    while True:
        step = {n: max(1, -(-(hi - lo + 1) // max(2, BINS // max(1, len(share))))) for n, (lo, hi) in lo_hi.items()}
        value = F.lit(None).cast("long")
        inside = F.lit(False)
        bin_ = F.lit(None).cast("long")
        for n, (lo, hi) in lo_hi.items():
            here = (F.col("node") == n) & carry[n][0]
            value = F.col(key[n])
            ok = here & value.between(lo, hi)
            inside = inside | ok
            bin_ = F.when(ok, F.expr(f"({key[n]} - {lo}) div {step[n]}")).otherwise(bin_)
        got = level.where(inside).groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("w")).collect()
        done = True
        for n, (lo, hi) in list(lo_hi.items()):
            bins = sorted((r["bin"], r["w"]) for r in got if r["node"] == n)
            at = None
            for b, w in bins:
                at = b
                if below[n] + w >= share[n]:
                    break
                below[n] += w
            if at is None:
                lo_hi[n] = (lo, lo)
                continue
            if bins and at == bins[-1][0] and below[n] < share[n] and below[n] == carry[n][1] + sum(w for _, w in bins):
                below[n] -= bins[-1][1]
            lo_hi[n] = (lo + at * step[n], min(hi, lo + at * step[n] + step[n] - 1))
            done &= step[n] == 1
        if done:
            return {n: (lo, below[n]) for n, (lo, _) in lo_hi.items()}


def _weights(level: DataFrame, cond: dict[int, tuple]) -> dict[int, int]:
    """Bytes of the rows of each node that its condition holds for, in one pass."""
    if not cond:
        return {}
    got = level.agg(*[F.coalesce(F.sum(F.when((F.col("node") == n) & c[0], F.col("size"))), F.lit(0)).alias(str(n)) for n, c in cond.items()]).first()
    return {n: got[str(n)] for n in cond}


def kd_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of near equal bytes.

    A node that must hold k shards is split into ceil(k/2) and floor(k/2) of them by weight, until each holds one.
    tolerance: a group of equal texts is cut only where keeping it whole would miss the wanted weight by more than this
    share of a shard.
    """
    raw = saved(points(docs))
    level = one_point_a_text(raw)
    forget(raw)
    level = level.withColumn("node", F.lit(1))
    total = level.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    want, least = {1: shards}, tolerance * total / shards
    dims = DIMENSIONS
    whole = level.agg(*[F.coalesce(F.max(d) - F.min(d), F.lit(1)).alias(d) for d in dims]).first()
    while total and any(k > 1 for k in want.values()):
        open_ = [n for n, k in want.items() if k > 1]
        stats = level.where(F.col("node").isin(open_)).groupBy("node").agg(
            F.sum("size").alias("w"), *[f(d).alias(f"{k}{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]
        ).collect()
        share, key, first, ties = {}, {}, {}, {}
        for r in stats:
            n = r["node"]
            share[n] = r["w"] * -(-want[n] // 2) / want[n]
            # each dimension's range in the node as a part of its range in the table
            span = {d: (r[f"hi{d}"] - r[f"lo{d}"]) / max(1, whole[d]) for d in dims}
            key[n], *rest = sorted(dims, key=lambda d: -span[d])
            first[n], ties[n] = (F.lit(True), 0), [*rest, "text_place", "doc_place"]
        open_ = list(share)
        at = _cut(level, share, key, first)
        side = {n: F.col(key[n]) < at[n][0] for n in open_}
        # rows at the very value: by the other dimensions, then by text hash, then by doc_id, as far as needed
        cond = {n: (F.col(key[n]) == at[n][0], at[n][1]) for n in open_}
        for k in range(len(dims) + 1):
            ask = {n: c for n, c in cond.items() if share[n] - c[1] > 0}
            if not ask:
                break
            weights = _weights(level, ask)
            for n, w in list(weights.items()):
                over, under = ask[n][1] + w - share[n], share[n] - ask[n][1]
                if min(over, under) <= least or w == 0:
                    if over < under:
                        side[n] = side[n] | ask[n][0]
                    ask.pop(n), cond.pop(n)
            if not ask:
                break
            deeper = _cut(level, {n: share[n] for n in ask}, {n: ties[n][k] for n in ask}, ask)
            for n in ask:
                column = F.col(ties[n][k])
                side[n] = side[n] | (ask[n][0] & (column < deeper[n][0]))
                cond[n] = (ask[n][0] & (column == deeper[n][0]), deeper[n][1])
        left = _weights(level, cond)
        for n, c in cond.items():  # one row left: to the side that it unbalances less
            w = left[n]
            if c[1] + w - share[n] < share[n] - c[1]:
                side[n] = side[n] | c[0]
        node = F.col("node")
        for n in open_:
            node = F.when(F.col("node") == n, F.when(side[n], 2 * n).otherwise(2 * n + 1)).otherwise(node)
        level = level.withColumn("node", node)
        want = {m: k for n, k in want.items() for m, k in (((2 * n, -(-k // 2)), (2 * n + 1, k // 2)) if n in open_ else ((n, k),))}
    leaf = {n: i for i, n in enumerate(sorted(want, key=lambda n: bin(n)[2:]))}
    shard = F.lit(0)
    for n, i in leaf.items():
        shard = F.when(F.col("node") == n, i).otherwise(shard)
    out = level.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))
    return numbered(out, "shard", ["doc_id", "text_crc32"], "slot")


def op10_kd_shards(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
