"""Best-fit packing by linear grouping: token sequences of at most `capacity` from whole documents.

Large lengths are rounded up within groups of equal cardinality, so that few sizes are left; configurations of those
sizes are chosen on the histogram; the actual documents then take the rounded places, and small documents are put best-fit
into what room is left. Only the histogram of lengths (at most `capacity` numbers) reaches the driver.

Edge cases: a null or empty text is the end token alone; a longer document is cut into full pieces, its first piece may be
shorter; repeated doc_ids are packed as separate rows; an empty table gives an empty result; extra columns are ignored.
"""

import functools
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import saved, table

CAPACITY, GROUPS, LARGE = 2048, 256, 1 / 8
VOCABULARY = "byte_bpe_50k.json"


@functools.cache
def _cache(vocabulary: str) -> tokens.Cache:
    """Units are encoded from the rank file of the same vocabulary, which is faster; a text with a special token's string needs the tokenizer."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(public_tokenizers.path(vocabulary))

    def whole(units):
        code = fast.encode_ordinary
        return [array("I", code(u)).tobytes() for u in units]

    cache = tokens.Cache(lambda pieces: dict(zip(pieces, whole(pieces))), b"".join, whole)
    cache.text = lambda text: np.array(full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return cache


def token_bytes(texts: list[str], vocabulary: str = VOCABULARY) -> list[bytes]:
    """Each text's ids as little-endian 32-bit bytes. A text that holds a special token's string is left to the tokenizer itself."""
    cache = _cache(vocabulary)
    odd = [k for k, t in enumerate(texts) if "<|" in t]
    if odd:
        out = token_bytes([t if "<|" not in t else "" for t in texts], vocabulary)
        for k in odd:
            out[k] = cache.text(texts[k])
        return out
    return [b"".join(v) for v in cache.values(texts)]


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = 0) -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32 for each piece of each document."""

    def cut(batches):
        from zlib import crc32

        last = np.uint32(end).astype("<u4").tobytes()
        for b in batches:
            for lo in range(0, len(b), 256):
                part, out = b.slice(lo, 256), defaultdict(list)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, raw in zip(part.column(0).to_pylist(), token_bytes(texts, vocabulary)):
                    ids = memoryview(raw + last)
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    at = [0, *range(first, n + 1, capacity)]
                    for k, (i, j) in enumerate(zip(at, at[1:])):
                        for name, v in (("doc_id", doc), ("piece", k), ("start", i), ("length", j - i), ("ids_crc32", crc32(ids[4 * i : 4 * j]))):
                            out[name].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32"))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Counts of items by length, handed out in order of rank within a length."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: v for k, v in counts.items() if v}
        self.next = defaultdict(int)

    def take(self, length: int, n: int) -> int:
        rank = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
        return rank


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): runs of items of a length; each goes to its own sequence.

    Works on counts alone, so its cost depends on the number of different lengths, not of documents.
    """
    out, sequence = [], 0
    stock = _Stock(counts)
    big = sorted((length for length in stock.left if length >= large * capacity), reverse=True)
    number = sum(stock.left[x] for x in big)
    # 1. linear grouping: equally many items a group, from the largest down; a group's size is its largest length
    each, room, sizes, members = max(1, -(-number // groups)), 0, [], []
    for length in big:
        n = stock.left[length]
        while n:
            if not room:
                sizes.append(length)
                members.append([])
                room = each
            k = min(n, room)
            members[-1].append([length, k])
            n, room = n - k, room - k
    merged: dict[int, list] = {}
    for s, m in zip(sizes, members):
        merged.setdefault(s, []).extend(m)
    sizes, left = sorted(merged, reverse=True), {s: sum(k for _, k in m) for s, m in merged.items()}

    # 2. configurations of the few sizes: the fullest that holds the largest size left, as often as the counts allow
    runs = []  # (multiplicity, [sizes])
    while left:
        top = max(left)
        conf = _fullest(top, left, capacity, min(capacity * large, 1e9))
        need = defaultdict(int)
        for s in conf:
            need[s] += 1
        times = min(left[s] // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
        runs.append((times, conf))

    # 3. the actual documents take the places: a run splits where the actual length changes
    rooms = defaultdict(list)  # room left -> [(first sequence, number, offset)]
    for times, conf in runs:
        parts = [(sequence, times, 0)]
        sequence += times
        for size in conf:
            after = []
            for first, n, offset in parts:
                while n:
                    m = merged[size]
                    length, k = m[0]
                    k = min(k, n)
                    out.append((length, stock.take(length, k), k, first, offset))
                    m[0][1] -= k
                    if not m[0][1]:
                        m.pop(0)
                    after.append((first, k, offset + length))
                    first, n = first + k, n - k
            parts = after
        for first, n, offset in parts:
            rooms[capacity - offset].append((first, n, offset))

    # 4. the small ones, largest first, into the tightest room that holds them
    for length in sorted(stock.left, reverse=True):
        n = stock.left[length]
        while n:
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is None:
                per = capacity // length
                k = -(-n // per)
                rooms[capacity].append((sequence, k, 0))
                sequence += k
                continue
            first, k, offset = rooms[fit].pop()
            use = min(k, n)
            if use < k:
                rooms[fit].append((first + use, k - use, offset))
            if not rooms[fit]:
                del rooms[fit]
            out.append((length, stock.take(length, use), use, first, offset))
            rooms[fit - length].append((first, use, offset + length))
            n -= use
    return out


def _fullest(top: int, left: dict[int, int], capacity: int, small: float) -> list[int]:
    """The set of sizes that holds `top` and fills the capacity best, by a subset-sum over the sizes left.

    Of equally full ones, that with the larger sizes. A size is used at most as often as it is there.
    """
    room = capacity - top
    reach: dict[int, tuple] = {0: ()}
    for s in sorted((x for x in left if x <= room), reverse=True):
        most = min(left[s] - (s == top), room // s)
        if most <= 0:
            continue
        for total, used in list(reach.items()):
            for k in range(1, most + 1):
                t = total + k * s
                if t > room:
                    break
                if t not in reach:
                    reach[t] = used + (s,) * k
        if room in reach:
            break
    return [top, *reach[max(reach)]]


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_each: int = 100_000) -> DataFrame:
    """Add sequence_id and offset. Items of a length get ranks by sub-groups of a hash, so a common length does not meet in one task."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_k", F.xxhash64("doc_id", "piece", "ids_crc32"))
    n = pieces.count()
    subs = max(1, n // rows_each)
    pieces = pieces.withColumn("_sub", F.pmod("_k", F.lit(subs)).cast("int"))
    by = pieces.groupBy("length", "_sub").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = counts.pop(capacity, 0)
    rows = [(capacity, 0, full, 0, 0)] * bool(full) + [(a, b, c, d + full, e) for a, b, c, d, e in plan(counts, capacity)]
    # within a length, runs are in order of rank; the run of a rank is found by its position among the run starts
    starts = defaultdict(list)
    for row in sorted(rows):
        starts[row[0]].append(row[1:])
    schema = "length long, runs array<struct<rank:long,n:long,sequence:long,offset:long>>"
    runs = spark.createDataFrame([(k, v) for k, v in starts.items()], schema)
    before = by.withColumn("_first", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = pieces.withColumn("_r", F.row_number().over(W.partitionBy("length", "_sub").orderBy("_k", "start")) - 1)
    ranked = ranked.join(before, ["length", "_sub"]).withColumn("_rank", F.col("_first") + F.col("_r"))
    flat = runs.select("length", F.explode("runs").alias("_run"))
    # at most about capacity x groups runs in all, whatever the number of documents: safe to broadcast
    out = ranked.join(F.broadcast(flat.withColumnRenamed("length", "_l")), (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_run.rank")) & (F.col("_rank") < F.col("_run.rank") + F.col("_run.n")))
    return out.withColumn("sequence_id", F.col("_run.sequence") + F.col("_rank") - F.col("_run.rank")).withColumn("offset", F.col("_run.offset")).drop("_k", "_sub", "_first", "_r", "_rank", "_l", "_run")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(saved(cut_pieces(docs, capacity)), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
