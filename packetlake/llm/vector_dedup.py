"""Embedding near-dedup by sorted projection passes.

Each pass sorts the vectors of a label, less the label's mean, by the concatenated signs of its own random projections
(then by one more projection) and compares each vector with a window of neighbours in that order, also where the order
passes from one task to the next. The number of passes and the window follow from the label's size and spread, so that
a pair at the threshold is met with a chance of RECALL. The pairs found over all passes are joined into components. A
window is a bound on partners, so the rest is done exactly: inside each component every pair is compared, block by
block, and counted without being written out.

The chance holds for labels that are one cloud: in a label of several narrow clouds the mean says less about each, and
pairs at the threshold inside one are met less often.

Edge cases: very small and very large components (down to the smallest doubles) count like any others, as each vector is
scaled before its norm is taken; a vector that is null, empty, zero or holds null or non-finite components links with nothing, and so does one
without a label; vectors of different length link with nothing; equal vectors are compared once and counted with their
multiplicity; repeated vec_ids count as rows; an empty table gives an empty result; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, table

#: PASSES and WINDOW are the least that any label gets.
COSINE, PASSES, BITS, WINDOW, BLOCK = 0.98, 12, 24, 24, 512
RECALL = 0.99
#: What a pass costs for a vector besides its window, in comparisons.
PASS_COST = 150
CHUNK = 256


def _matrix(column) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is first scaled by a power of two, which is exact, so that no square under- or overflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plan(n: int, spread: float, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> tuple[int, int]:
    """(passes, window) of the least cost that meet a pair at the threshold with a chance of RECALL.

    Of two vectors of cosine c in a label where 1 - |mean|^2 is `spread`, the centred ones have a cosine of about
    1 - (1 - c) / spread, a plane leaves them on one side with a chance of q, and after log2(n / window) planes they are
    in one window.
    """
    centred = min(1.0, max(0.0, 1 - (1 - cosine) / max(spread, 1e-12)))
    q = 1 - np.arccos(centred) / np.pi
    best = None
    for w in (window << k for k in range(5)):
        p = q ** np.log2(n / w) if n > w + 1 else 1.0
        need = 1 if p >= RECALL else int(np.ceil(np.log(1 - RECALL) / np.log1p(-p)))
        cost = max(passes, need) * (min(w, n) + PASS_COST)
        if best is None or cost < best[0]:
            best = cost, max(passes, need), w
    return best[1:]


def centres(classes: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """label, d, mean (of the unit vectors), passes, window."""

    def sums(batches):
        held = {}
        for b in batches:
            label, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dim in np.unique(d):
                x, own = _unit(_matrix(b.filter(pa.array(d == dim)).column(2))), label[d == dim]
                for k in np.unique(own):
                    s, n = held.get((k, dim), (0.0, 0))
                    held[k, dim] = s + x[own == k].sum(0), n + int((own == k).sum())
            if len(held) > 1000:
                yield from _sums(held)
                held = {}
        yield from _sums(held)

    def plans(batches):
        for b in batches:
            out = [plan(n, 1 - sum(y * y for y in m), cosine, passes, window) for n, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([x for x, _ in out], pa.int32()), pa.array([y for _, y in out], pa.int32())], names=["label", "d", "mean", "passes", "window"])

    part = classes.select("label", "d", "v").mapInArrow(sums, "label int, d int, s array<double>, n long").select("label", "d", "n", F.posexplode("s").alias("at", "s"))
    mean = part.groupBy("label", "d", "at").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("m"))
    mean = mean.groupBy("label", "d").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda x: x["m"]).alias("mean"))  # d of them
    return mean.select("label", "d", "n", "mean").mapInArrow(plans, "label int, d int, mean array<double>, passes int, window int")


def _sums(held: dict):
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([int(k) for k, _ in held], pa.int32()), pa.array([int(d) for _, d in held], pa.int32()), pa.array([s.tolist() for s, _ in held.values()], pa.list_(pa.float64())), pa.array([n for _, n in held.values()], pa.int64())], names=["label", "d", "s", "n"])


ROWS = "pass int, label int, d int, window int, code long, tie double, id long, v array<double>"


def projected(vectors: DataFrame, bits: int = BITS) -> DataFrame:
    """A row for each vector and pass: pass, label, d, window, code (sign bits, first projection highest), tie, id, v; vectors have their label's mean, passes and window."""

    def run(batches):
        planes = {}
        for b in batches:
            d = b.column(2).to_numpy()
            for dim in np.unique(d):
                part = b.filter(pa.array(d == dim))
                x, passes = _unit(_matrix(part.column(3))) - _matrix(part.column(4)), part.column(5).to_numpy()
                for p in range(int(passes.max())):
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng(1000 * p + 7).normal(size=(int(dim), bits + 1))
                    here = passes > p
                    rows = part.filter(pa.array(here))
                    y = x[here] @ planes[p, dim]
                    code = ((y[:, :bits] > 0) @ (1 << np.arange(bits)[::-1])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), p, np.int32)), rows.column(1), rows.column(2), rows.column(6), pa.array(code), pa.array(y[:, bits]), rows.column(0), rows.column(3)], names=["pass", "label", "d", "window", "code", "tie", "id", "v"])

    return vectors.select("id", "label", "d", "v", "mean", "passes", "window").mapInArrow(run, ROWS)


ORDER = ("pass", "d", "label", "code", "tie", "id")


def window_pairs(rows: DataFrame, widest: int, cosine: float = COSINE) -> DataFrame:
    """(a, b) of the pairs within `window` places of each other in their pass's order.

    Each task also hands on its first and last `widest` rows; in order, these hold all neighbours that stand in different
    tasks.
    """
    names = [f.split()[0] for f in ROWS.split(", ")]
    nothing = {"a": pa.int64(), "b": pa.int64()}

    def near(part, done):
        """Pairs of which the second row is at `done` or later."""
        x, ids, wide = _unit(_matrix(part.column("v"))), part.column("id").to_numpy(), part.column("window").to_numpy()
        group = part.column("pass").to_numpy().astype(np.int64) << 32 | part.column("label").to_numpy().astype(np.int64) & 0xFFFFFFFF
        out = []
        for s in range(done, len(x), CHUNK):
            e = min(s + CHUNK, len(x))
            low = max(0, s - int(wide[s:e].max()))
            i, j = np.nonzero(x[s:e] @ x[low:e].T >= cosine)
            i, j = i + s, j + low
            ok = (j < i) & (i - j <= wide[i]) & (group[i] == group[j])
            out.append(np.stack([ids[j[ok]], ids[i[ok]]]))
        return np.unique(np.sort(np.concatenate(out, 1), 0), axis=1)

    def pairs_of(batches, ends):
        keep, tail, seen = None, None, 0
        for b in batches:
            if ends and len(b):
                if seen < widest:
                    yield from edge(pa.Table.from_batches([b.slice(0, widest - seen)]))
                    seen += min(len(b), widest - seen)
                tail = pa.Table.from_batches([b]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([b])])
                tail = tail.slice(max(0, len(tail) - widest))
            d = b.column(2).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(d[1:] != d[:-1]) + 1, [len(d)]])
            for s, e in zip(cut, cut[1:]):
                if s == e:
                    continue
                part, done = pa.Table.from_batches([b.slice(s, e - s)]), 0
                if keep is not None and keep.column("d")[0].as_py() == d[s]:
                    part, done = pa.concat_tables([keep, part]), len(keep)
                pairs = near(part, done)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64()), *(pa.nulls(pairs.shape[1], f.type) for f in part.schema)], names=[*nothing, *names])
                keep = part.slice(max(0, len(part) - widest))
        if tail is not None:
            yield from edge(tail)

    def edge(part):
        for b in part.combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(b), k) for k in nothing.values()), *b.columns], names=[*nothing, *names])

    schema = "a long, b long, " + ROWS
    found = saved(rows.mapInArrow(lambda batches: pairs_of(batches, True), schema))
    edges = found.where("id is not null").select(*names).dropDuplicates(["pass", "id"]).repartition("pass", "d", "label").sortWithinPartitions(*ORDER)
    across = edges.mapInArrow(lambda batches: pairs_of(batches, False), schema)
    return found.select("a", "b").unionByName(across.select("a", "b")).where("a <> b").distinct()


def component_links(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """id, n: the weight of the other vectors that each links with, from rows (comp, i, j, side, id, weight, v) sorted by block."""

    def count(t):
        comp, side = t.column("comp").to_numpy(), t.column("side").to_numpy()
        i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
        ids, w = t.column("id").to_numpy(), t.column("weight").to_numpy()
        x = _unit(_matrix(t.column("v")))
        new = np.concatenate([[0], np.flatnonzero((comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(t)]])
        out = []
        for s, e in zip(new, new[1:]):
            if i[s] == j[s]:
                near = x[s:e] @ x[s:e].T >= cosine
                np.fill_diagonal(near, False)
                out.append((ids[s:e], near @ w[s:e]))
            else:
                p, q = np.flatnonzero(side[s:e] == 0) + s, np.flatnonzero(side[s:e] == 1) + s
                near = x[p] @ x[q].T >= cosine
                out += [(ids[p], near @ w[q]), (ids[q], near.T @ w[p])]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a for a, _ in out])), pa.array(np.concatenate([b for _, b in out]).astype(np.int64))], names=["id", "n"])

    def run(batches):
        tail = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if tail is None else pa.concat_tables([tail, t])
            key = [t.column(c).to_numpy() for c in ("comp", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            if last:
                yield count(t.slice(0, last))
            tail = t.slice(last)
        if tail is not None and len(tail):
            yield count(tail)

    return rows.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    own = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = own.where(good & F.col("vec_id").isNotNull())
    classes = saved(usable.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).withColumn("d", F.size("v")))
    middle = saved(centres(classes, cosine, passes, window))
    widest = middle.agg(F.max("window")).first()[0] or window
    rows = projected(classes.join(middle, ["label", "d"]))
    rows = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    comp = saved(components(saved(window_pairs(rows, widest, cosine))))

    sizes = comp.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = comp.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(F.col("component").alias("comp"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), F.col("node").alias("id"))
    members = members.join(classes.select("id", "weight", "v"), "id").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    links = component_links(members.select("comp", "i", "j", "side", "id", "weight", "v"), cosine)

    per_class = classes.join(links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    per_class = per_class.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = usable.join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = own.where(~F.coalesce(good & F.col("vec_id").isNotNull(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
