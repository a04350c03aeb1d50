"""N-gram Jaccard join over count vectors in R-trees.

Two documents link when 100 * |A n B| >= 75 * |A u B| over their sets of 5-word shingles. The join is exact:

1. Documents with equal sets form one class (a hash of the set); only the classes' smallest documents go on.
2. Each document stands in the lists of its first n - ceil(0.75 n) + 1 shingles in one fixed order (frequent ones last);
   two documents that link share one of those. Lists with one smallest component (the hub of a family of texts) are one
   set of points: shingles hashed into groups, counted, once a document. R-trees over the points of the sets, joined with
   themselves from the roots down, bound each overlap by the summed minima of coordinates, so that most pairs are never
   formed. The pairs that come out at the leaves are the candidates.
3. They are verified on the sets themselves, and the components joined.

Min-hash hubs go first, as an accelerator that changes no result (hubs=False leaves them out): documents that share a
band with a smaller one and are verified against it are in one component already, and a list matters only while it holds
two different components, a tree node only while it does. So a large group of near copies costs one comparison for each
member instead of one for each pair.

A large set is cut into parts of LEAF documents, of which two go to a task. Nothing but fixed-size bit maps and counts
reaches the driver. Intermediate tables are deleted when they are no longer read.

Edge cases: null, empty or blank text has an empty set and links with nothing; texts of fewer than five words are one
shingle; repeated rows and equal texts share a component; a doc_id on rows of different texts counts as one document
that has the set of each row in turn for exact copies, and the set of one row (that with the smallest hash) for near ones;
rows without doc_id come back with their set size and the component of documents with the same set, null if there is none; an empty table gives an empty result; extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings
from . import textvec as tv
from .common import components, forget, lookup, saved, table

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 8, 3
#: Buckets of the frequency table that only decides the order of shingles, and of the bit map of candidate documents.
BUCKETS, CHUNK, IDBITS = 1 << 21, 1 << 16, 1 << 22
#: Bits of the map of keys with more than one component; coordinates of the vectors that the lists carry.
KEYBITS, COARSE = 1 << 25, 256
#: Documents in one part of a large set; children of a tree node; rows whose trees are joined together; pairs of nodes at once.
LEAF, FAN, ROWS_AT_ONCE, PAIRS = 4096, 8, 16_384, 20_000


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def prints_and_counts(docs: DataFrame) -> DataFrame:
    """One pass, two kinds of rows: doc_id, n (size of the set), f1 and f2 (a 128-bit hash of it); and k, counts of shingle buckets."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.uint32)
        for b in batches:
            for i, j, data, off in tv.documents(b.column(1)):
                h, at = tv.shingle_sets(data, off, WIDTH)
                np.add.at(counts, (h % np.uint64(BUCKETS)).astype(np.int64), np.uint32(1))
                none = pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())
                yield _batch(doc_id=b.column(0)[i:j], n=pa.array(np.diff(at), pa.int64()), f1=pa.array(tv.reduce_by(tv.mix(h, 1), at).view(np.int64)), f2=pa.array(tv.reduce_by(tv.mix(h, 2), at).view(np.int64)), k=none[0], counts=none[1])
        counts = np.minimum(counts, 65535).astype(np.uint16)
        for k in range(BUCKETS // CHUNK):
            part = counts[k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield _batch(doc_id=none, n=none, f1=none, f2=none, k=pa.array([k], pa.int32()), counts=pa.array([part.tobytes()], pa.binary()))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, k int, counts binary")


def frequent_buckets(counted: DataFrame) -> np.ndarray:
    """Which of BUCKETS shingle buckets hold far more than their part. It decides the order of shingles only, so any answer is right."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.int64)
        for b in batches:
            for x in b.column("counts"):
                total += np.frombuffer(x.as_py(), np.uint16)
        yield _batch(k=pa.array([key[0].as_py()], pa.int32()), total=pa.array([int(total.sum())], pa.int64()), counts=pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary()))

    sums = saved(counted.groupBy("k").applyInArrow(add, "k int, total long, counts binary"))
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / BUCKETS
    most = mean + 6 * mean**0.5 + 32

    def bits(batches):
        for b in batches:
            yield _batch(k=b.column(0), bits=pa.array([np.packbits(np.frombuffer(x.as_py(), np.uint32) > most).tobytes() for x in b.column(1)], pa.binary()))

    out = np.zeros(BUCKETS // 8, np.uint8)
    for r in sums.select("k", "counts").mapInArrow(bits, "k int, bits binary").collect():  # BUCKETS / 8 bytes in all
        out[r["k"] * CHUNK // 8 : (r["k"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def packed(v: np.ndarray) -> list[bytes]:
    """Rows of COARSE counts as bytes: two to a byte where none is over 15, else one a byte, 255 for all from there on."""
    low = v.max(1, initial=0) < 16
    half = (v[:, ::2] | v[:, 1::2] << 4).astype(np.uint8)
    full = np.minimum(v, 255).astype(np.uint8)
    return [half[k].tobytes() if low[k] else full[k].tobytes() for k in range(len(v))]


def unpacked(rows: list[bytes]) -> np.ndarray:
    """The counts again; 255 stands for no bound rather than a wrong one."""
    out = np.empty((len(rows), COARSE), np.int32)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    for width in (COARSE // 2, COARSE):
        k = np.flatnonzero(size == width)
        x = np.frombuffer(b"".join([rows[i] for i in k]), np.uint8).reshape(-1, width)
        if width == COARSE:
            out[k] = np.where(x == 255, 1 << 20, x)
        else:
            out[k, ::2], out[k, 1::2] = x & 15, x >> 4
    return out


def signatures(docs: DataFrame, frequent) -> DataFrame:
    """doc_id, n, f1, bands, prefix and v (the packed count vector) of each non-empty document."""

    def run(batches):
        often = np.unpackbits(frequent.value).astype(np.uint64)
        for b in batches:
            for i, j, data, off in tv.documents(b.column(1)):
                h, at = tv.shingle_sets(data, off, WIDTH)
                n = np.diff(at)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                doc = np.repeat(np.arange(j - i), n)
                low = [tv.reduce_by(tv.mix(h, 100 + k), at, np.minimum) for k in range(BANDS * ROWS)]
                bands = np.stack([tv.mix(sum(tv.mix(low[k * ROWS + r], r) for r in range(ROWS)), k) for k in range(BANDS)], 1)[full].view(np.int64)
                key = (often[(h % np.uint64(BUCKETS)).astype(np.int64)] << np.uint64(63)) | (h >> np.uint64(1))
                order = np.lexsort((key, doc))
                place = np.arange(len(h)) - np.repeat(at[:-1], n)
                take = place < np.repeat(n - -(-PERCENT * n // 100) + 1, n)
                chosen = order[take]
                poff = np.concatenate([[0], np.cumsum(np.bincount(doc[take], minlength=j - i))])[np.append(full, j - i)]
                v = np.bincount(doc * COARSE + ((h >> np.uint64(40)) % np.uint64(COARSE)).astype(np.int64), minlength=(j - i) * COARSE).reshape(-1, COARSE)[full]
                yield _batch(
                    doc_id=b.column(0)[i:j].take(pa.array(full)), n=pa.array(n[full], pa.int64()),
                    f1=pa.array(tv.reduce_by(tv.mix(h, 1), at).view(np.int64)[full]),
                    bands=pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * BANDS, pa.int32()), pa.array(bands.ravel())),
                    prefix=pa.ListArray.from_arrays(pa.array(poff, pa.int32()), pa.array((h[chosen] >> np.uint64(32)).astype(np.uint32).view(np.int32))),
                    v=pa.array(packed(v), pa.binary()),
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f1 long, bands array<long>, prefix array<int>, v binary")


def may_link(na, nb, overlap):
    """Can sets of these sizes with at most this overlap reach the threshold? 175 * overlap >= 75 * (na + nb)"""
    return ((100 + PERCENT) * overlap >= PERCENT * (na + nb)) & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb))


class RTrees:
    """Packed R-trees over count vectors, one for each group of rows; all are built and joined level by level together.

    A tree's points are ordered by size class, then by the coordinate that is widest in the group. A node holds the
    smallest and largest set size and component, and the maxima of the coordinates.
    """

    def __init__(self, group: np.ndarray, n: np.ndarray, comp: np.ndarray, vec: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))  # groups come in order
        spread = np.maximum.reduceat(vec, first) - np.minimum.reduceat(vec, first)
        widest = np.repeat(spread.argmax(1), np.diff(np.append(first, len(group))))
        self.order = np.lexsort((vec[np.arange(len(vec)), widest], np.floor(np.log(n) / np.log(1.15)), group))
        n, comp = n[self.order], comp[self.order]
        #: (group, lowest and highest size, lowest and highest component, coordinate maxima, first child) of each level's nodes
        self.levels = [(group[self.order], n, n, comp, comp, vec[self.order], None)]
        while True:
            g, lo, hi, c_lo, c_hi, top, _ = self.levels[-1]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            if len(first) == len(g):
                break
            place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
            cut = np.flatnonzero(place % FAN == 0)
            self.levels.append((g[cut], np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.minimum.reduceat(c_lo, cut), np.maximum.reduceat(c_hi, cut), np.maximum.reduceat(top, cut), cut))

    def raised(self, height: int) -> list:
        """The levels up to `height`; above a tree's own root each root is its own only child."""
        while len(self.levels) < height:
            self.levels.append((*self.levels[-1][:6], np.arange(len(self.levels[-1][0]))))
        return self.levels

    def join(self, other: "RTrees") -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (own row, other's row) of one group that may link. Joined with itself, each pair comes once."""
        height = max(len(self.levels), len(other.levels))
        a, b, same = self.raised(height), other.raised(height), self is other
        roots, x, y = np.intersect1d(a[-1][0], b[-1][0], assume_unique=True, return_indices=True)
        todo, out = [(height - 1, x, y)], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while todo:
            level, x, y = todo.pop()
            if len(x) > PAIRS:
                todo += [(level, x[k : k + PAIRS], y[k : k + PAIRS]) for k in range(0, len(x), PAIRS)]
                continue
            keep = self._may(a[level], b[level], x, y)
            x, y = x[keep], y[keep]
            if not level:
                out.append((self.order[x], other.order[y]))
                continue
            (x0, nx), (y0, ny) = (self._children(z[level][6], len(z[level - 1][0]), k) for z, k in ((a, x), (b, y)))
            pairs = nx * ny
            k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            by = np.repeat(ny, pairs)
            x, y = np.repeat(x0, pairs) + k // by, np.repeat(y0, pairs) + k % by
            if same:
                keep = x < y if level == 1 else x <= y
                x, y = x[keep], y[keep]
            todo.append((level - 1, x, y))
        return tuple(np.concatenate(z) for z in zip(*out))

    @staticmethod
    def _children(first, count, at):
        return first[at], np.append(first[1:], count)[at] - first[at]

    @staticmethod
    def _may(a, b, x, y):
        """Can two nodes hold points of different components that link?"""
        low = a[1][x] + b[1][y]
        keep = (100 * a[2][x] >= PERCENT * b[1][y]) & (100 * b[2][y] >= PERCENT * a[1][x])
        keep &= ~((a[3][x] == a[4][x]) & (b[3][y] == b[4][y]) & (a[3][x] == b[3][y]))
        at = np.flatnonzero(keep)
        overlap = np.minimum(a[5][x[at]], b[5][y[at]]).sum(1)
        keep[at] = (100 + PERCENT) * overlap >= PERCENT * low[at]
        return keep


def list_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) candidate pairs of the sets' rows (hub, i, j, side, doc, n, comp, v), which come sorted by set."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size < ROWS_AT_ONCE:
                continue
            t = pa.Table.from_batches(held)
            key = [t.column(c).to_numpy() for c in ("hub", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            if last:
                yield from emit(t.slice(0, last))
            held = t.slice(last).to_batches()
            size = len(t) - last
        if held:
            yield from emit(pa.Table.from_batches(held))

    def emit(t):
        hub, i, j, side, doc, n, comp = (t.column(c).to_numpy() for c in ("hub", "i", "j", "side", "doc", "n", "comp"))
        group = np.cumsum(np.concatenate([[False], (hub[1:] != hub[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        own = np.repeat(np.minimum.reduceat(comp, first) < np.maximum.reduceat(comp, first), np.diff(np.append(first, len(t))))
        at = np.flatnonzero(own)  # parts of two components
        if not len(at):
            return
        vec = unpacked(t.column("v").take(pa.array(at)).to_pylist())
        found = []
        for kinds in ((-1,), (0, 1)):
            sides = [np.flatnonzero((i[at] == j[at]) if k < 0 else (i[at] != j[at]) & (side[at] == k)) for k in kinds]
            if all(len(s) for s in sides):
                trees = [RTrees(group[at[s]], n[at[s]], comp[at[s]], vec[s]) for s in sides]
                p, q = trees[0].join(trees[-1])
                p, q = at[sides[0][p]], at[sides[-1][q]]
                ok = comp[p] != comp[q]
                found.append((p[ok], q[ok]))
        if found:
            p, q = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            pairs = np.unique(np.stack([np.minimum(doc[p], doc[q]), np.maximum(doc[p], doc[q])]), axis=1)
            yield _batch(a=pa.array(pairs[0]), b=pa.array(pairs[1]))

    return rows.mapInArrow(run, "a long, b long").where("a <> b")


def id_map(ids: DataFrame, column: str) -> np.ndarray:
    """A bit map of IDBITS bits that holds every id of the column (and, by chance, some others)."""
    bit = F.pmod(F.xxhash64(column), F.lit(IDBITS))
    rows = ids.select(bit.alias("x")).groupBy(F.shiftright("x", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 31 as int))")).alias("bits"))
    out = np.zeros(IDBITS // 32, np.uint32)
    for r in rows.toArrow().to_pylist():  # IDBITS / 32 rows at most
        out[r["word"]] = r["bits"]
    return out


def _counted(groups: np.ndarray) -> np.ndarray:
    """Sorted groups with repeats as different values (group, number of the repeat), so that common values are summed minima."""
    first = np.concatenate([[True], groups[1:] != groups[:-1]])
    start = np.flatnonzero(first)
    return groups.astype(np.int64) << 32 | (np.arange(len(groups)) - np.repeat(start, np.diff(np.append(start, len(groups)))))


def verified(docs: DataFrame, pairs: DataFrame, bits: int = 64) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Only documents of the bit map of the pairs' ids send their sets.

    bits = 16: the sets hashed into 65536 groups, sent as the sorted groups. The summed minima of those counts bound the
    overlap almost exactly and are less than a quarter of the size.
    """
    import zstandard

    kind = np.uint64 if bits == 64 else np.uint16
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(id_map(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id"))

    def sets(batches):
        for b in batches:
            bit = b.column(2).to_numpy()
            keep = (held.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1
            b = b.filter(pa.array(keep.astype(bool)))
            for i, j, data, off in tv.documents(b.column(1)):
                h, at = tv.shingle_sets(data, off, WIDTH)
                if bits == 16:
                    doc = np.repeat(np.arange(j - i), np.diff(at))
                    h = (h & np.uint64(0xFFFF)).astype(np.uint16)
                    h = h[np.lexsort((h, doc))]
                    first = at[:-1][at[1:] > at[:-1]]
                    lead = h[first]
                    h[1:] -= h[:-1].copy()  # sorted groups as differences, which pack well
                    h[first] = lead
                raw, w = h.tobytes(), bits // 8
                out = [raw[w * at[k] : w * at[k + 1]] for k in range(j - i)]
                yield _batch(id=b.column(0)[i:j], s=pa.array([zstandard.compress(x, 1) for x in out] if bits == 16 else out, pa.binary()), t=b.column(3)[i:j])

    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = own.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(IDBITS)).alias("bit"), F.xxhash64("text").alias("t")).mapInArrow(sets, "id long, s binary, t long")
    own = saved(own.groupBy("id").agg(F.min_by("s", "t").alias("s")))

    def check(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                if bits == 16:
                    x, y = (_counted(np.cumsum(np.frombuffer(zstandard.decompress(s.as_buffer()), kind), dtype=kind)) for s in (x, y))
                else:
                    x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= PERCENT * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    two = pairs.join(own.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    out = saved(two.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"))
    forget(own)
    return out


def near_duplicate_components(docs: DataFrame, hubs: bool = True, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest document with the same set)."""
    spark = docs.sparkSession
    both = saved(prints_and_counts(docs))
    often = spark.sparkContext.broadcast(frequent_buckets(both.where("k is not null").select("k", "counts")))
    prints = both.where("k is null").select("doc_id", "n", "f1", "f2")
    classes = saved(prints.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("_class"), F.count("*").alias("c")).where("c > 1"))
    members = lookup(prints, classes, ["n", "f1", "f2"], ["_class"], "c", classes.agg(F.sum("c")).first()[0] or 0)
    members = saved(members.select("doc_id", "n", "f1", F.coalesce("_class", "doc_id").alias("class_id")))
    forget(both, classes)
    heads = members.where("n > 0 and doc_id = class_id").select("doc_id", "f1").distinct()
    sig = saved(signatures(docs, often))
    links = _hub_links(docs, sig.select("doc_id", "f1", "bands"), heads) if hubs else None

    comps = heads.withColumn("comp", F.col("doc_id"))
    if hubs:
        first = components(links)
        comps = heads.join(first.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "f1", F.coalesce("component", "doc_id").alias("comp"))
    comps = saved(comps)
    pairs = saved(list_pairs(list_rows(sig, comps, leaf)).distinct())
    forget(sig, comps)
    near = verified(docs, pairs, 16)
    more = verified(docs, near)
    forget(pairs, near)

    final = components(links.unionByName(more) if hubs else more).select(F.col("node").alias("class_id"), "component")
    out = members.join(final, "class_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id")


def _hub_links(docs: DataFrame, sig: DataFrame, heads: DataFrame) -> DataFrame:
    """Verified links of documents with the smallest document of each of their bands."""
    rows = sig.select("doc_id", "f1", F.posexplode("bands").alias("band", "key")).join(heads, ["doc_id", "f1"], "left_semi").select("doc_id", "band", "key")
    hub = saved(rows.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("c")).where("c > 1"))
    stars = lookup(rows, hub, ["band", "key"], ["hub"], "c", hub.agg(F.sum("c")).first()[0] or 0)
    stars = saved(stars.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())
    forget(hub)
    links = verified(docs, stars)
    forget(stars)
    return links


def list_rows(sig: DataFrame, comps: DataFrame, leaf: int = LEAF) -> DataFrame:
    """The documents of each hub, whose lists hold two components or more, sorted by hub (and by part of a large set)."""
    spark = sig.sparkSession
    lists = saved(sig.select("doc_id", "f1", F.col("prefix").alias("key")).join(comps, ["doc_id", "f1"]).select(F.col("comp").alias("owner"), "doc_id", "key"))
    open_ = saved(postings.extremes(lists.select("owner", "key")).select("key", F.col("lo_owner").alias("hub"), "n"))
    bits = spark.sparkContext.broadcast(postings.bit_map(open_, "key", KEYBITS))
    rows = postings.spread(lists, bits, ["doc_id"], ["key"], "doc_id long, place long, key long").drop("place")
    met = lookup(rows, open_, ["key"], ["hub"], "n", open_.agg(F.sum("n")).first()[0] or 0).where("hub is not null").select("hub", "doc_id").distinct()
    met = saved(met)
    forget(lists, open_)
    sizes = saved(met.groupBy("hub").agg(F.count("*").alias("c"), F.ceil(F.count("*") / leaf).cast("int").alias("parts")))
    rows = lookup(met, sizes, ["hub"], ["parts"], "c", sizes.agg(F.sum("c")).first()[0] or 0)
    rows = rows.join(sig.select("doc_id", "f1", "n", "v").join(comps, ["doc_id", "f1"]).drop("f1"), "doc_id").withColumnRenamed("doc_id", "doc")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("hub", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "doc", "n", "comp", "v")
    return rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
