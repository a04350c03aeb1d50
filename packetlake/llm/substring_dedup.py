"""Substring dedup by compact windows.

A text is its sequence of 5-word shingle hashes. For each of HASHES hash functions the Cartesian tree over the hashed
sequence groups all subsequences of at least 46 shingles (50 words) by their minimum: a compact window (l, c, r) stands for
all of them that lie in [l, r] and contain c, where the minimum is. Two texts that share a passage have windows with
the same minimum whose intervals meet. The windows of a pair are joined as intervals, those that enough hashes support
are verified on the words, and passages of at least 50 words with a similarity of 0.75 or more come out.

Windows of one minimum are linked to hubs, not with each other, so a passage in many documents costs as many rows as it
has windows. A window's hubs are the smallest doc_id that has the minimum and, where that holds it in another context, the
smallest doc_id that has the minimum together with the same smallest shingle of another hash function among the SIDE ones
on its left, or on its right. Besides, each run of 46 shingles around a shared minimum is a
key too (in the first hash function, as every run has a minimum there), and is linked to the smallest doc_id that has this
run: every 50 words that stand in two documents are found. So that documents with a part of a passage don't come
between those that have it whole, or nearly so, a minimum is also a key together with the least values of two bands, one
on each side of it and 34 shingles apart or more, and linked to the smallest doc_id that has all three; such links
are followed where no passage has been found by the others.

Only the parts of two texts that a passage around the seeds can reach are sent to be verified. Of the passages of one
document that stand inside one another the outermost comes out, once, with the smallest doc_id that has it. Intermediate tables are
deleted when they are no longer read.

Edge cases: null and empty texts and texts under 50 words have no passage; equal texts are one class, and each copy is a
repeat of the class's smallest doc_id, whole; a doc_id on several rows counts once: of different texts, that of the
smallest hash is searched and cut, and the rows of the others are left alone; rows without doc_id are left alone; an empty
table gives an empty result; extra columns are kept by `remove_repeats`, whatever their names.
"""

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings
from . import textvec as tv
from .common import forget, lookup, saved, table
from .ngram_join import IDBITS, id_map

WIDTH, WORDS, HASHES, SUPPORT, PERCENT = 5, 50, 4, 2, 75
LEAST = WORDS - WIDTH + 1
#: Bits of the map of minima that more than one document has.
KEYBITS = 1 << 25
#: Hash function of a seed that is an equal run of LEAST shingles and needs no support.
RUN = -1
#: Unmatched shingles that a passage may hold between two matched ones; shingles on each side of a minimum that make its context.
GAP, SIDE = 12, 24
#: Shingles in a band; which bands left and right of a minimum make a key with it; shingles around it that are compared.
BAND, BANDS, AROUND = 8, ((2, 4), (4, 2)), 72
SPAN = 256


def sequence(data: np.ndarray, offsets: np.ndarray):
    """Shingle hashes in text order, where each document's begin, and the documents' word counts and starts."""
    low = tv.LOWER[data]
    starts, ends, woff = tv.word_bounds(low, offsets)
    words = tv.word_hashes(low, starts, ends)
    h, at = tv.windows(words, woff, WIDTH)
    return h, np.searchsorted(at, woff), words, woff


def compact_windows(values: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(l, c, r) of every node of the Cartesian tree whose interval holds at least `least` values."""
    out, stack = [], [(0, len(values) - 1)]
    while stack:
        l, r = stack.pop()
        if r - l + 1 < least:
            continue
        c = l + int(values[l : r + 1].argmin())
        out.append((l, c, r))
        stack.append((l, c - 1))
        stack.append((c + 1, r))
    return out


def run_hashes(h: np.ndarray, n: int = LEAST) -> np.ndarray:
    """A hash of the n values from each place on, by doubling."""
    out, size, done = np.zeros(max(0, len(h) - n + 1), np.uint64), 0, h.astype(np.uint64)
    width = 1
    while width <= n:
        if n & width:
            out = tv.mix(out ^ done[size : size + len(out)], 300 + width)
            size += width
        done = tv.mix(done[:-width] + (done[width:] << np.uint64(1)), 400 + width) if width < len(done) else done[:0]
        width *= 2
    return out


def contexts(v: np.ndarray, c: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """The smallest of the SIDE values left of each place, and of those right of it, in its document's [s, e), as 32 bits (0: there is none)."""
    out, none = [], np.uint64(2**64 - 1)
    for sign in (-1, 1):
        low = np.full(len(c), none)
        for step in range(1, SIDE + 1):
            at = c + sign * step
            ok = (at >= s) & (at < e)
            low[ok] = np.minimum(low[ok], v[at[ok]])
        out.append(np.where(low == none, 0, (low >> np.uint64(32)).astype(np.uint32).view(np.int32)).astype(np.int32))
    return out


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), n_words, g1, g2 (a hash of the word sequence) and the windows: arrays of key, f, l, c, r and x, y (contexts)."""

    def run(batches):
        for b in batches:
            for i, j, data, off in tv.documents(b.column(1)):
                h, at, words, woff = sequence(data, off)
                place = np.arange(len(words)) - np.repeat(woff[:-1], np.diff(woff))
                g = [tv.reduce_by(tv.mix(words + tv.mix(place.astype(np.uint64), s), s), woff).view(np.int64) for s in (3, 4)]
                keys, spans, home, number = [], [], [], np.zeros(j - i + 1, np.int64)
                mixed = [tv.mix(h, 200 + f) for f in range(HASHES)]
                for d in range(j - i):
                    s, e = at[d], at[d + 1]
                    if e - s >= LEAST:
                        for f in range(HASHES):
                            v = mixed[f][s:e]
                            w = np.array(compact_windows(v), np.int32)
                            keys.append(v[w[:, 1]])
                            spans.append(np.column_stack([np.full(len(w), f, np.int32), w]))
                            home.append(np.full(len(w), d))
                            number[d + 1] += len(w)
                o = pa.array(np.cumsum(number), pa.int32())
                k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                s = np.concatenate(spans) if spans else np.zeros((0, 4), np.int32)
                d = np.concatenate(home) if home else np.zeros(0, np.int64)
                near = np.zeros((len(s), 2), np.int32)
                for f in range(HASHES):
                    mine = np.flatnonzero(s[:, 0] == f)
                    own = d[mine]
                    near[mine, 0], near[mine, 1] = contexts(mixed[(f + 1) % HASHES], at[own] + s[mine, 2], at[own], at[own + 1])
                s = np.hstack([s, near])
                lists = [pa.ListArray.from_arrays(o, pa.array(k.view(np.int64))), *(pa.ListArray.from_arrays(o, pa.array(np.ascontiguousarray(s[:, q]))) for q in range(6))]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(2)[i:j], pa.array(np.diff(woff), pa.int64()), pa.array(g[0]), pa.array(g[1]), *lists], names=["doc_id", "t", "n_words", "g1", "g2", "key", *WINDOW])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"))
    return rows.mapInArrow(run, "doc_id long, t long, n_words long, g1 long, g2 long, key array<long>, " + ", ".join(f"{x} array<int>" for x in WINDOW))


WINDOW = ("f", "l", "c", "r", "x", "y")


def _least_of(v: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on, by doubling."""
    width = 1
    while 2 * width <= n:
        v, width = np.minimum(v[:-width], v[width:]), 2 * width
    return np.minimum(v[: len(v) - (n - width)], v[n - width :])


def run_keys(h: np.ndarray, v: np.ndarray, hot: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, document) of the runs of LEAST shingles, each inside its document, whose minimum in the first hash function v is hot."""
    if len(h) < LEAST:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # equal values are hot together, so a run's minimum is hot where the least hot value is the least of all
    low = _least_of(np.where(hot, v, np.uint64(2**64 - 1)), LEAST) == _least_of(v, LEAST)
    counted = np.concatenate([[0], np.cumsum(hot)])
    near = np.flatnonzero(low & (counted[LEAST:] > counted[:-LEAST]))
    home = np.searchsorted(at, near, "right") - 1
    inside = near + LEAST <= at[home + 1]
    near, home = near[inside], home[inside]
    return run_hashes(h)[near] & ~np.uint64(1), near - at[home], home


def least_around(v: np.ndarray, c: np.ndarray, s: np.ndarray, e: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Whether v[c] is the one least value of `least` places or more of its document [s, e). Each step looks only at the places that still are."""
    reach = np.ones(len(c), np.int64)
    for sign, room in ((-1, c - s), (1, e - 1 - c)):
        alive, low = np.arange(len(c)), v[c]
        for step in range(1, least):
            alive = alive[room[alive] >= step]
            alive = alive[v[c[alive] + sign * step] > low[alive]]
            reach[alive] += 1
    return reach >= least


def joint_keys(mixed: list[np.ndarray], minima: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, document) of each window minimum that the bit map holds, together with the least values of a band on its left and one on its right.

    The values of two bands that lie far apart stand in one document only if it has the passage on both sides, so a
    document with a part of it does not take the key of those that have it whole.
    """
    keys, places, homes = [], [], []
    docs = np.searchsorted(at, np.arange(len(mixed[0])), "right") - 1
    for f, v in enumerate(mixed):
        c = np.flatnonzero(postings.held(minima, v.view(np.int64)))
        s, e = at[docs[c]], at[docs[c] + 1]
        c, s, e = (x[e - s >= LEAST] for x in (c, s, e))
        least = least_around(v, c, s, e)
        c, s, e = c[least], s[least], e[least]
        w = mixed[(f + 1) % len(mixed)]
        low = w.copy()
        for step in (1, 2, 4):  # the least of BAND values from each place on
            low[:-step] = np.minimum(low[:-step], low[step:])
        for k, (i, j) in enumerate(BANDS):
            left, right = c - BAND * (i + 1), c + 1 + BAND * j
            ok = (left >= s) & (right + BAND <= e)
            keys.append(tv.mix(v[c[ok]] ^ tv.mix(low[left[ok]] * np.uint64(3) + low[right[ok]], 500 + k), 600 + f) | np.uint64(1))
            places.append(c[ok] - s[ok])
            homes.append(docs[c[ok]])
    return np.concatenate(keys), np.concatenate(places), np.concatenate(homes)


def run_links(docs: DataFrame, own: DataFrame, keys: DataFrame, shared: DataFrame) -> DataFrame:
    """a, b, joint (0 or 1), x (place in b) and seed of the runs of LEAST shingles whose minimum is one of the keys, and of the minima `shared` by three windows or more with what stands around them.

    Each is linked with the smallest doc_id that has the same run, or the same minimum between the same bands.
    """
    bits = own.sparkSession.sparkContext.broadcast(postings.bit_map(keys, "key", KEYBITS))
    minima = own.sparkSession.sparkContext.broadcast(postings.bit_map(shared, "key", KEYBITS))
    held = own.sparkSession.sparkContext.broadcast(id_map(own, "owner"))

    def run(batches):
        for b in batches:
            bit = b.column(2).to_numpy()
            b = b.filter(pa.array(postings.held(held.value, bit)))
            for i, j, data, off in tv.documents(b.column(1)):
                h, at, _, _ = sequence(data, off)
                mixed = [tv.mix(h, 200 + f) for f in range(HASHES)]
                hot = postings.held(bits.value, mixed[0].view(np.int64))
                key, place, home = (list(x) for x in zip(joint_keys(mixed, minima.value, at), run_keys(h, mixed[0], hot, at))) if len(h) else ([], [], [])
                if key:
                    key, place, home = map(np.concatenate, (key, place, home))
                    order = np.argsort(home, kind="stable")
                    o = pa.array(np.searchsorted(home[order], np.arange(j - i + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.ListArray.from_arrays(o, pa.array(key[order].view(np.int64))), pa.ListArray.from_arrays(o, pa.array(place[order].astype(np.int32)))], names=["owner", "key", "place"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(IDBITS)).alias("bit"))
    runs = saved(texts.mapInArrow(run, "owner long, key array<long>, place array<int>"))
    ends = saved(postings.extremes(runs, ("place",)).select("key", "n", "lo_owner", "lo_place"))
    two = own.sparkSession.sparkContext.broadcast(postings.bit_map(ends, "key", KEYBITS))
    rows = postings.spread(runs.withColumnRenamed("place", "x"), two, ["owner"], ["key", "x"], "owner long, place long, key long, x int").drop("place")
    links = lookup(rows, ends, ["key"], ["lo_owner", "lo_place"], "n", ends.agg(F.sum("n")).first()[0] or 0).where("owner > lo_owner")
    # one seed for the keys of a stretch: they stand on one diagonal, and fewer than LEAST places apart
    links = links.select(F.col("lo_owner").alias("a"), F.col("owner").alias("b"), F.col("lo_place").cast("int").alias("p"), "x", F.col("key").bitwiseAND(1).alias("joint"))
    links = links.groupBy("a", "b", "joint", (F.col("x") - F.col("p")).alias("diagonal"), F.floor(F.col("x") / LEAST).alias("part")).agg(F.min("x").alias("lx"), F.max("x").alias("rx"))
    before, behind = F.when(F.col("joint") == 1, AROUND).otherwise(0), F.when(F.col("joint") == 1, AROUND).otherwise(LEAST - 1)
    spot = [F.lit(RUN).alias("f")]
    for n, shift in (("a", F.col("diagonal")), ("b", F.lit(0))):
        at = F.col("lx") - shift
        spot += [F.greatest(at - before, F.lit(0)).cast("int").alias("l" + n), at.cast("int").alias("c" + n), (F.col("rx") - shift + behind).cast("int").alias("r" + n)]
    out = saved(links.select("a", "b", "joint", F.col("lx").alias("x"), F.struct(*spot).alias("seed")))
    forget(runs, ends)
    return out


def uncovered(links: DataFrame, found: DataFrame) -> DataFrame:
    """The links whose place x in b is in none of the passages found in b so far. A passage and a link meet in a stretch of SPAN places."""
    spans = found.select(F.col("doc_id").alias("b"), "start_word", "end_word").distinct()
    spans = spans.select("b", F.explode(F.sequence(F.floor(F.col("start_word") / SPAN), F.floor(F.col("end_word") / SPAN))).alias("part"), F.col("start_word").alias("s"), F.col("end_word").alias("e"))
    at = links.select("b", "x").distinct().withColumn("part", F.floor(F.col("x") / SPAN))
    known = at.join(spans, ["b", "part"]).where("x between s and e").select("b", "x").distinct()
    return links.join(known, ["b", "x"], "left_anti")


def _seed(x: str, y: str):
    """The seed of a's window, whose columns begin with x, and b's, whose columns begin with y."""
    return F.struct("f", *[F.col(p + n).cast("int").alias(n + o) for p, o in ((x, "a"), (y, "b")) for n in "lcr"]).alias("seed")


def candidates(docs: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """a, b (a < b) and seeds: an array of (f, la, ca, ra, lb, cb, rb) of windows with one minimum in both; the links of minima between bands; and the tables that these read."""
    own = own.select(F.col("doc_id").alias("owner"), "key", *WINDOW)
    ends = saved(postings.extremes(own, WINDOW).drop("hi_owner"))
    bits = own.sparkSession.sparkContext.broadcast(postings.bit_map(ends, "key", KEYBITS))
    rows = postings.spread(own, bits, ["owner"], ["key", *WINDOW], "owner long, place long, key long, " + ", ".join(f"{x} int" for x in WINDOW)).drop("place")
    first = ["n", *(f"lo_{x}" for x in ("owner", "l", "c", "r", "x", "y"))]
    both = lookup(rows, ends, ["key"], first, "n", ends.agg(F.sum("n")).first()[0] or 0)
    both = saved(both.where("owner > lo_owner or x <> lo_x or y <> lo_y"))
    pairs = both.where("owner > lo_owner").select(F.col("lo_owner").alias("a"), F.col("owner").alias("b"), _seed("lo_", ""))
    near, read = _context_links(both)
    runs = run_links(docs, own, ends.where("lo_f = 0").select("key"), ends.where("n > 2").select("key"))
    pairs = pairs.unionByName(near).unionByName(runs.where("joint = 0").select("a", "b", "seed"))
    return _gathered(pairs), runs.where("joint = 1"), [ends, both, runs, read]


def _gathered(links: DataFrame) -> DataFrame:
    return links.groupBy("a", "b").agg(F.collect_set("seed").alias("seeds"))  # at most the windows of one document


def _context_links(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, seed: each window whose context is not that of the minimum's first owner, with the smallest doc_id that has the minimum in the same context; and the table it reads."""
    sides = F.array(*[F.when((F.col(x) != 0) & (F.col(x) != F.col("lo_" + x)), F.struct(F.lit(k).alias("side"), F.col(x).alias("ctx"))) for k, x in enumerate("xy")])
    rows = both.where("n > 2").select("key", "owner", "lo_owner", "f", "l", "c", "r", F.explode(sides).alias("s")).where("s is not null").select("*", "s.side", "s.ctx").drop("s")
    first = rows.groupBy("key", "side", "ctx").agg(F.min(F.struct("owner", "l", "c", "r")).alias("hub"), F.max("owner").alias("last"), F.count("*").alias("m"))
    first = saved(first.where("last > hub.owner").drop("last"))
    found = lookup(rows, first, ["key", "side", "ctx"], ["hub"], "m", first.agg(F.sum("m")).first()[0] or 0).where("owner > hub.owner and hub.owner <> lo_owner")
    found = found.select(F.col("hub.owner").alias("a"), F.col("owner").alias("b"), "f", "l", "c", "r", *[F.col("hub")[x].alias("hub_" + x) for x in "lcr"])
    return found.select("a", "b", _seed("hub_", "")), first


def supported(seeds: np.ndarray, support: int = SUPPORT) -> list[tuple]:
    """Interval join of one pair's seeds: (la, ra, lb, rb, ca, cb) of merged regions where windows of `support` hash functions meet.

    A seed is a rectangle of positions; seeds that meet in both texts are one region. They are swept by their place in a.
    Two seeds of which the sweep has not left either meet in a, so b is held as disjoint stretches, each with the last
    position in a of the seeds over it and one of these seeds.
    """
    seeds = seeds[np.argsort(seeds[:, 1], kind="stable")].tolist()
    parent = list(range(len(seeds)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    starts: list[int] = []
    held: list[tuple] = []  # (end, last position in a, seed) of the stretch that begins at starts[k]
    for i, (_, la, _, ra, lb, _, rb) in enumerate(seeds):
        k = bisect_right(starts, lb) - 1
        k += k < 0 or held[k][0] < lb
        new, at, e, rest = [], lb, k, []
        while e < len(starts) and starts[e] <= rb:
            s, (end, last, j) = starts[e], held[e]
            e += 1
            if last < la:
                continue
            parent[root(j)] = root(i)
            if s < lb:
                new.append((s, lb - 1, last, j))
            if at < s:
                new.append((at, s - 1, ra, i))
            at = min(end, rb) + 1
            new.append((max(s, lb), at - 1, max(last, ra), i))
            if end > rb:
                rest = [(rb + 1, end, last, j)]
        if at <= rb:
            new.append((at, rb, ra, i))
        joined: list[tuple] = []
        for x in new + rest:
            if joined and joined[-1][2] == x[2] and joined[-1][1] + 1 == x[0]:
                x = (joined.pop()[0], *x[1:])
            joined.append(x)
        starts[k:e], held[k:e] = [x[0] for x in joined], [x[1:] for x in joined]
    regions: dict[int, list] = {}
    for i, (f, la, ca, ra, lb, cb, rb) in enumerate(seeds):
        g = regions.setdefault(root(i), [la, ra, lb, rb, set(), []])
        g[0], g[1], g[2], g[3] = min(g[0], la), max(g[1], ra), min(g[2], lb), max(g[3], rb)
        g[4].add(f)
        g[5].append((ca, cb))
    return [(*g[:4], *map(list, zip(*g[5]))) for g in regions.values() if len(g[4]) >= support or RUN in g[4]]


def passages(ha: np.ndarray, hb: np.ndarray, region: tuple) -> list[tuple[int, int, int]]:
    """(first shingle in b, last shingle in b, first shingle in a) of verified passages inside a region.

    Exact ones are grown from the seeds. Where the texts differ in places, stretches of shingles of b that a's region also
    holds, with gaps of at most GAP, are joined as long as the sets of the joined stretches are similar enough. Of several
    places of a shingle in a, the one nearest to the diagonal of the closest seed counts.
    """
    la, ra, lb, rb, ca, cb = region
    out = _grown(ha, hb, ca, cb)
    a, b = ha[la : ra + 1], hb[lb : rb + 1]
    places, in_a = _aligned(a, b, np.array(ca) - la, np.array(cb) - lb)
    jump = np.flatnonzero((np.diff(places) > GAP) | (np.abs(np.diff(in_a) - np.diff(places)) > GAP)) + 1

    def alike(p, q, x, y):
        sa, sb = np.unique(a[x : y + 1]), np.unique(b[p : q + 1])
        common = len(np.intersect1d(sa, sb, assume_unique=True))
        return 100 * common >= PERCENT * (len(sa) + len(sb) - common)

    def fresh(x):
        """How many places before each one hold a shingle for the first time: differences are never more than a span's set."""
        new = np.zeros(len(x) + 1, np.int64)
        new[np.unique(x, return_index=True)[1] + 1] = 1
        return np.cumsum(new).tolist()

    fresh_a, fresh_b = fresh(a), fresh(b)
    hits = np.searchsorted(places, np.arange(len(b) + 1)).tolist()
    chains: list[tuple] = []  # (first and last place in b, in a, matches), in order of b
    for s, e in zip(np.concatenate([[0], jump]), np.concatenate([jump, [len(places)]])):
        if e == s:
            continue
        new, k = (int(places[s]), int(places[e - 1]), int(in_a[s:e].min()), int(in_a[s:e].max()), int(e - s)), len(chains) - 1
        while k >= 0:
            old = chains[k]
            both = (min(old[0], new[0]), max(old[1], new[1]), min(old[2], new[2]), max(old[3], new[3]), old[4] + new[4])
            if 100 * len(places) < PERCENT * (fresh_b[new[0]] - fresh_b[old[1] + 1]):  # ends fall down the stack: none below can join
                break
            matched = 100 * (hits[both[1] + 1] - hits[both[0]])
            possible = matched >= PERCENT * max(fresh_b[both[1] + 1] - fresh_b[both[0]], fresh_a[both[3] + 1] - fresh_a[both[2]])
            if possible and alike(*both[:4]):
                new = both
                del chains[k]
                k = len(chains)
            k -= 1
        chains.append(new)
    for p, q, x, y, n in chains:
        if n < LEAST * PERCENT // 100 or q - p + 1 < LEAST or any(u <= lb + p and lb + q <= v for u, v, _ in out):
            continue
        if alike(p, q, x, y):
            out.append((lb + p, lb + q, la + x))
    return out


def _aligned(a, b, ca, cb):
    """Places of b whose shingle a has, and for each its place in a that is nearest to the diagonal of the closest seed."""
    order = np.argsort(a, kind="stable")
    kinds, rank = np.unique(a[order], return_inverse=True)
    r = np.minimum(np.searchsorted(kinds, b), len(kinds) - 1)
    places = np.flatnonzero(kinds[r] == b)
    by = np.argsort(cb, kind="stable")
    ca, cb = ca[by], cb[by]
    right = np.minimum(np.searchsorted(cb, places), len(cb) - 1)
    left = np.maximum(right - 1, 0)
    seed = np.where(np.abs(cb[left] - places) <= np.abs(cb[right] - places), left, right)
    hoped = np.clip(places + ca[seed] - cb[seed], 0, len(a) - 1)
    key = rank.astype(np.int64) * len(a) + order
    at = np.searchsorted(key, r[places] * len(a) + hoped)
    low, high = np.maximum(at - 1, 0), np.minimum(at, len(a) - 1)
    far = lambda k: np.where(rank[k] == r[places], np.abs(order[k] - hoped), len(a) + 1)
    return places, order[np.where(far(low) < far(high), low, high)]


def _grown(ha, hb, ca, cb):
    """Maximal runs of equal shingles around the seeds, those of at least LEAST shingles."""
    out, done = [], {}
    for x, p in sorted(zip(ca, cb)):
        if done.get(x - p, -1) >= p:
            continue
        n = min(len(ha) - x, len(hb) - p)
        off = np.flatnonzero(ha[x : x + n] != hb[p : p + n])
        right = int(off[0]) if len(off) else n
        n = min(x, p)
        off = np.flatnonzero(ha[x - n : x][::-1] != hb[p - n : p][::-1])
        left = int(off[0]) if len(off) else n
        done[x - p] = p + right - 1
        if left + right >= LEAST:
            out.append((p - left, p + right - 1, x - left))
    return out


def verified(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, dup_of, start_word, end_word, dup_start_word, text_hash of the passages of b that repeat one of a.

    regions: a, b, la, na, lb, nb (first shingle and number of shingles of the parts to compare) and the seeds' places.
    Only those parts are sent.
    """
    held = docs.sparkSession.sparkContext.broadcast(id_map(regions.select(F.explode(F.array("a", "b")).alias("id")), "id"))

    def hashes(batches):
        for b in batches:
            b = b.filter(pa.array(postings.held(held.value, b.column(2).to_numpy())))
            for i, j, data, off in tv.documents(b.column(1)):
                h, at, _, _ = sequence(data, off)
                raw = h.astype(np.uint32).tobytes()  # runs of 46 or more equal 32-bit hashes are equal words
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([raw[4 * at[k] : 4 * at[k + 1]] for k in range(j - i)], pa.binary()), b.column(3)[i:j]], names=["id", "h", "t"])

    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    own = own.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(IDBITS)).alias("bit"), "t").mapInArrow(hashes, "id long, h binary, t long")
    own = saved(own.groupBy("id").agg(F.min_by("h", "t").alias("h"), F.min("t").alias("t")))

    def check(batches):
        last, mine = None, []  # b and its passages so far: the join brings the pairs of one b together
        for batch in batches:
            out = []
            for a, b, la, lb, ca, cb, ha, hb, t in zip(*(batch.column(c) for c in ("a", "b", "la", "lb", "ca", "cb", "ha", "hb", "t"))):
                if b != last:
                    out += _outermost(mine)
                    last, mine = b, []
                ha, hb = np.frombuffer(ha.as_buffer(), np.uint32), np.frombuffer(hb.as_buffer(), np.uint32)
                la, lb = la.as_py(), lb.as_py()
                ca, cb = ca.values.to_numpy() - la, cb.values.to_numpy() - lb
                here = (ca < len(ha)) & (cb < len(hb))  # a seed of another text under the same doc_id may lie outside
                if here.any():
                    region = (0, len(ha) - 1, 0, len(hb) - 1, ca[here].tolist(), cb[here].tolist())
                    mine += [(b.as_py(), a.as_py(), lb + p, lb + q + WIDTH, la + x, t.as_py()) for p, q, x in passages(ha, hb, region)]
            yield rows_of(out)
        yield rows_of(_outermost(mine))

    def rows_of(out):
        cols = list(zip(*out)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "dup_of", "start_word", "end_word", "dup_start_word", "text_hash"])

    part = lambda k: F.substr("h", (F.col("l" + k) * 4 + 1).cast("int"), (F.col("n" + k) * 4).cast("int")).alias("h" + k)
    names = ["b", "la", "lb", "nb", "ca", "cb"]
    two = regions.join(own.select(F.col("id").alias("a"), "h"), "a").select("a", *names, part("a"))
    two = two.join(own.select(F.col("id").alias("b"), "h", "t"), "b").select("a", *names, "ha", part("b"), "t")
    out = saved(two.mapInArrow(check, "doc_id long, dup_of long, start_word long, end_word long, dup_start_word long, text_hash long"))
    forget(own)
    return out


def _outermost(found: list[tuple]) -> list[tuple]:
    """The passages of one document (start and end in places 2 and 3) that no other one holds; of equal ones, that of the smallest doc_id."""
    out, end = [], -1
    for x in sorted(found, key=lambda x: (x[2], -x[3], x[1])):
        if x[3] > end:
            out.append(x)
            end = x[3]
    return out


def reach(region: tuple) -> tuple[int, int, int, int]:
    """First shingle and number of shingles of a and of b that a passage in the region can hold.

    A passage holds a seed, and one of two similar passages has at most 100 / PERCENT times the shingles of the other.
    """
    la, ra, lb, rb, ca, cb = region
    wide_a, wide_b = (100 * (r - l + 1) // PERCENT + WIDTH for l, r in ((la, ra), (lb, rb)))
    la, ra = max(la, min(ca) - wide_b), min(ra, max(ca) + wide_b)
    lb, rb = max(lb, min(cb) - wide_a), min(rb, max(cb) + wide_a)
    return la, ra - la + 1, lb, rb - lb + 1


def interval_join(found: DataFrame) -> DataFrame:
    """a, b, la, na, lb, nb, ca, cb: the regions that enough hash functions support in each pair."""
    names = ("a", "b", "la", "na", "lb", "nb", "ca", "cb")

    def run(batches):
        for batch in batches:
            rows = []
            for x, y, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                seeds = np.stack([c.to_numpy() for c in s.values.flatten()], 1).astype(np.int64)
                rows += [(x, y, *reach(g), g[4], g[5]) for g in supported(seeds)]
            cols = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if n in ("ca", "cb") else pa.int64()) for n, c in zip(names, cols)], names=names)

    return found.mapInArrow(run, "a long, b long, la long, na long, lb long, nb long, ca array<long>, cb array<long>")


def _without_copies(own: DataFrame, copies: DataFrame) -> DataFrame:
    """own without the copies. Rows that a bit map of the copies' ids clears stay where they are; only the others are shuffled for the exact test."""
    held = own.sparkSession.sparkContext.broadcast(id_map(copies, "doc_id"))

    @F.pandas_udf("boolean")
    def maybe(bit: pd.Series) -> pd.Series:
        return pd.Series(postings.held(held.value, bit.to_numpy()))

    marked = own.withColumn("_maybe", maybe(F.pmod(F.xxhash64("doc_id"), F.lit(IDBITS))))
    return marked.where("not _maybe").drop("_maybe").unionByName(marked.where("_maybe").drop("_maybe").join(copies.select("doc_id"), "doc_id", "left_anti"))


def _one_text_each(own: DataFrame) -> DataFrame:
    """own without the rows of a doc_id whose text has not the smallest hash among those of its rows."""
    other = saved(own.groupBy("doc_id").agg(F.min("t").alias("first"), F.max("t").alias("last")).where("first <> last").select("doc_id", "first"))
    if other.isEmpty():
        return own
    return own.join(other, "doc_id", "left").where("first is null or t = first").drop("first")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, dup_of, start_word, end_word (exclusive), n_words, dup_start_word, text_hash: passages of doc_id that also stand in dup_of < doc_id."""
    raw = saved(windows(docs))
    own = _one_text_each(raw)
    names = ["doc_id", "t", "n_words", "g1", "g2"]
    classes = saved(own.where(F.col("n_words") >= WORDS).groupBy("n_words", "g1", "g2").agg(F.min("doc_id").alias("head"), F.count("*").alias("c")).where("c > 1"))
    copies = lookup(own.select(*names), classes, ["n_words", "g1", "g2"], ["head"], "c", classes.agg(F.sum("c")).first()[0] or 0).where("doc_id <> head")
    zero = F.lit(0).cast("long")
    copies = saved(copies.select("doc_id", F.col("head").alias("dup_of"), zero.alias("start_word"), F.col("n_words").alias("end_word"), zero.alias("dup_start_word"), F.col("t").alias("text_hash")).distinct())
    heads = saved(_without_copies(own, copies))
    forget(raw, classes)
    found, joint, read = candidates(docs, heads)
    regions = saved(interval_join(found))
    first = verified(docs, regions)
    more = saved(interval_join(_gathered(uncovered(joint, first))))  # what has been found in b need not be found again
    forget(heads, regions, *read)
    out = copies.unionByName(first).unionByName(verified(docs, more))
    forget(more)
    return out.distinct().select("doc_id", "dup_of", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "dup_start_word", "text_hash")


def remove_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the passages cut out of their texts (n_chars follows where there is one); rows without a passage stay as they are."""
    spans = found.groupBy(F.col("doc_id").alias("_id_"), F.col("text_hash").alias("_t_")).agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("_spans_"))  # within one document
    names = docs.columns

    def run(batches):
        at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None
        for b in batches:
            cols = [b.column(k) for k in range(len(names))]
            spans = b.column(len(names)).to_pylist()
            texts = [_without(t, s) if s else t for t, s in zip(cols[at].to_pylist(), spans)]
            cols[at] = pa.array(texts, cols[at].type)
            if count is not None:
                cols[count] = pa.array([len(t) if s and t is not None else n for t, s, n in zip(texts, spans, cols[count].to_pylist())], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    joined = docs.join(spans, (F.col("doc_id").cast("long") == spans["_id_"]) & (F.xxhash64("text") == spans["_t_"]), "left")
    return joined.select(*[docs[n] for n in names], spans["_spans_"]).mapInArrow(run, docs.schema)


def _without(text: str | None, spans) -> str | None:
    if text is None:
        return None
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = tv.word_bounds(data, np.array([0, len(raw)]))
    keep = np.ones(len(raw), bool)
    for s in spans:
        i, j = s["start_word"], s["end_word"]
        keep[starts[i] : starts[j] if j < len(starts) else ends[-1]] = False
    return data[keep].tobytes().decode()


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
