"""Which keys of many documents' key lists have more than one owner, and their first and last one.

Lists are long, so they are combined before the shuffle: each task keeps, for each key, its smallest and largest owner
and a count, and sends them as compressed column blocks by a hash of the key. A key that a third of all rows hold costs
at most a row for each task.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH = 250_000


def _runs(key: np.ndarray):
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(key)) - 1


def extremes(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """key, n, lo_owner, hi_owner and lo_ of the extra columns, of the keys with two owners or more.

    rows: owner long, key array<int or long>, and for each extra column an array<int> of the same length.
    """
    import zstandard

    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = 1 + len(extra)  # owner and extras

    def block(key, n, lo, hi):
        two = hi[0] > lo[0]
        small = all(abs(x).max(initial=0) < 2**31 for x in (lo[0], hi[0]))
        kind = np.int32 if small else np.int64
        raw = [np.array([len(key), int(two.sum()), small], np.int64), key.astype(np.int64), n.astype(np.int32), two.astype(np.uint8)]
        raw += [lo[0].astype(kind), hi[0][two].astype(kind)]
        raw += [lo[k].astype(np.int32) for k in range(1, width)]
        return zstandard.compress(b"".join(x.tobytes() for x in raw), 1)

    def unblock(blob):
        raw, at = zstandard.decompress(blob), 24
        m, t, small = np.frombuffer(raw, np.int64, 3)

        def take(kind, count):
            nonlocal at
            x = np.frombuffer(raw, kind, int(count), at)
            at += x.nbytes
            return x

        key, n, two = take(np.int64, m), take(np.int32, m), take(np.uint8, m).astype(bool)
        kind = np.int32 if small else np.int64
        cols = [np.concatenate([take(kind, m), take(kind, t)]).astype(np.int64)]
        for _ in range(1, width):  # of the last owner only the id is held
            cols.append(np.concatenate([take(np.int32, m), np.zeros(t, np.int32)]))
        return np.concatenate([key, key[two]]), np.concatenate([n, np.zeros(t, np.int32)]), cols

    def combine(key, n, cols):
        order = np.lexsort((cols[0], key))
        key, n = key[order], n[order]
        first, last = _runs(key)
        return key[first], np.add.reduceat(n, first) if len(first) else n, [c[order][first] for c in cols], [cols[0][order][last]]

    def pack(batches):
        held, size = [], 0

        def flush():
            key = np.concatenate([h[0] for h in held])
            cols = [np.concatenate([h[1][k] for h in held]) for k in range(width)]
            key, n, lo, hi = combine(key, np.ones(len(key), np.int64), cols)
            p = ((key * 0x9E3779B1) >> 16) % parts
            order = np.argsort(p, kind="stable")
            first, last = _runs(p[order])
            out = [order[s : e + 1] for s, e in zip(first, last)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(p[order][first].astype(np.int32)), pa.array([block(key[o], n[o], [c[o] for c in lo], [hi[0][o]]) for o in out], pa.binary())], names=["p", "block"])

        for b in batches:
            count = b.column(1).value_lengths().fill_null(0).to_numpy()
            owner = np.repeat(b.column(0).to_numpy(), count)
            if len(owner):
                held.append((b.column(1).flatten().to_numpy().astype(np.int64), [owner, *(b.column(2 + k).flatten().to_numpy() for k in range(len(extra)))]))
                size += len(owner)
            if size > FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    def join(batches):
        held = [unblock(x.as_py()) for b in batches for x in b.column(1)]
        if not held:
            return
        key, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        cols = [np.concatenate([h[2][k] for h in held]) for k in range(width)]
        held.clear()
        key, n, lo, hi = combine(key, n, cols)
        del cols
        two = np.flatnonzero(hi[0] > lo[0])
        for s in range(0, len(two), 100_000):
            t = two[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[t]), pa.array(n[t].astype(np.int64)), *(pa.array(c[t].astype(np.int64)) for c in (*lo, hi[0]))], names=["key", "n", *names])

    names = [*(f"lo_{c}" for c in ("owner", *extra)), "hi_owner"]
    packed = rows.select("owner", "key", *extra).mapInArrow(pack, "p int, block binary")
    return packed.repartition(parts // 2, "p").mapInArrow(join, "key long, n long, " + ", ".join(f"{c} long" for c in names))


def bit_map(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit map of `bits` bits (a power of two) of the column's low bits. It may hold more than the ids, never less."""
    rows = ids.select(F.col(column).bitwiseAND(bits - 1).alias("x")).groupBy(F.shiftright("x", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 31 as int))")).alias("bits"))
    t = rows.toArrow()  # bits / 32 rows at most
    out = np.zeros(bits // 32, np.uint32)
    out[t.column("word").to_numpy()] = t.column("bits").to_numpy().astype(np.uint32)
    return out


def held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    x = values.astype(np.int64) & (32 * len(bits) - 1)
    return ((bits[x >> 5] >> (x & 31).astype(np.uint32)) & 1).astype(bool)


def spread(rows: DataFrame, bits, columns: list[str], arrays: list[str], schema: str) -> DataFrame:
    """One row for each key of the bit map: the plain columns of its document, its place in the list, then the key and the other array columns."""

    def run(batches):
        for b in batches:
            key = b.column(len(columns)).flatten().to_numpy().astype(np.int64)
            size = b.column(len(columns)).value_lengths().fill_null(0).to_numpy()
            own = np.repeat(np.arange(len(b)), size)
            place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            at = np.flatnonzero(held(bits.value, key))
            for s in range(0, len(at), 50_000):
                t = at[s : s + 50_000]
                doc = pa.array(own[t])
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(doc) for k in range(len(columns))), pa.array(place[t]), pa.array(key[t]), *(pa.array(b.column(len(columns) + k).flatten().to_numpy()[t]) for k in range(1, len(arrays)))], names=[*columns, "place", *arrays])

    return rows.select(*columns, *arrays).mapInArrow(run, schema)
