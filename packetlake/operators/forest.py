"""Isolation forest over feature windows: trees grown from all windows level by level, scores by broadcast node tables.

A cut is drawn between a feature's least and greatest value, so features need no common scale. What a level needs of the
windows are the ends of each feature in each of its nodes: every task finds them for its own windows, and they are merged,
so no task holds more than a batch of windows and a level's nodes, and only nodes come to the driver.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.operators.features import FEATURES

#: LEVELS: cuts from a root to a leaf at most, so that a forest has a fixed size; a leaf of many windows counts as a tree of them.
TREES, LEVELS = 200, 8
NODES = "tree int, node int, feature int, cut double, left int, right int, path double, size long"


def _path(size):
    """Mean depth of an unsuccessful search among `size` windows."""
    size = np.asarray(size, float)
    return np.where(size > 2, 2 * (np.log(np.maximum(size - 1, 1)) + 0.5772156649) - 2 * (size - 1) / np.maximum(size, 1), np.where(size == 2, 1.0, 0.0))


def _walk(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The node of each row of x; tree: rows feature, cut, left, right of its nodes."""
    at = np.zeros(len(x), int)
    while True:
        f = tree[at, 0].astype(int)
        go = f >= 0
        if not go.any():
            return at
        below = x[np.arange(len(x)), np.maximum(f, 0)] < tree[at, 1]
        at = np.where(go, np.where(below, tree[at, 2], tree[at, 3]).astype(int), at)


def _grow(x: np.ndarray, r: np.random.Generator, most: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, path length, size); feature -1 is a leaf."""
    nodes: list = []

    def node(rows, depth):
        at = len(nodes)
        nodes.append(None)
        wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if depth >= most or not len(wide):
            nodes[at] = (-1, 0.0, 0, 0, depth + float(_path(len(rows))), len(rows))
            return at
        f = int(r.choice(wide))
        cut = float(r.uniform(rows[:, f].min(), rows[:, f].max()))
        below = rows[:, f] < cut
        left, right = node(rows[below], depth + 1), node(rows[~below], depth + 1)
        nodes[at] = (f, cut, left, right, 0.0, len(rows))
        return at

    node(x, 0)
    return nodes


def _ends(features: DataFrame, trees: list[np.ndarray], first: list[int]) -> pd.DataFrame:
    """tree, node, n, and the ends l0, h0, l1, ... of the features, of the windows in each node from the number `first` of its tree on."""
    shared, k = features.sparkSession.sparkContext.broadcast((trees, first)), len(FEATURES)
    schema = "tree int, node int, n long, " + ", ".join(f"l{i} double, h{i} double" for i in range(k))

    def run(batches):
        held = [(np.zeros(len(t) - f, int), np.full((len(t) - f, k), np.inf), np.full((len(t) - f, k), -np.inf)) for t, f in zip(*shared.value)]
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
            for t, f, (n, low, high) in zip(*shared.value, held):
                at = _walk(t, x) - f if f else np.zeros(len(x), int)
                order = np.argsort(at, kind="stable")
                order = order[np.searchsorted(at[order], 0) :]  # those in leaves of earlier levels have come to their end
                if len(order):
                    start = np.flatnonzero(np.diff(at[order], prepend=-1))
                    nodes, rows = at[order[start]], x[order]
                    n[nodes] += np.diff(start, append=len(order))
                    low[nodes] = np.minimum(low[nodes], np.minimum.reduceat(rows, start))
                    high[nodes] = np.maximum(high[nodes], np.maximum.reduceat(rows, start))
        for tree, (f, (n, low, high)) in enumerate(zip(shared.value[1], held)):
            some = np.flatnonzero(n)
            if len(some):
                sides = [pa.array(side[some, i]) for i in range(k) for side in (low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), tree, np.int32)), pa.array((some + f).astype(np.int32)), pa.array(n[some]), *sides], [c.split()[0] for c in schema.split(", ")])

    parts = features.select(*FEATURES).mapInArrow(run, schema).groupBy("tree", "node")
    out = parts.agg(F.sum("n").alias("n"), *[g(f"{s}{i}").alias(f"{s}{i}") for i in range(k) for s, g in (("l", F.min), ("h", F.max))]).toArrow().to_pandas()
    shared.unpersist()
    return out


def _levels(features: DataFrame, trees: int, seed: int, levels: int) -> list[list[list]]:
    """The nodes of each tree, grown from all windows: feature, cut, left, right, path length, size."""
    grown, first = [[[-1, 0.0, 0, 0, 0.0, 0]] for _ in range(trees)], [0] * trees
    for depth in range(levels + 1):
        table = _ends(features, [np.array([n[:4] for n in g]) for g in grown], first)
        first = [len(g) for g in grown]
        low, high = (table[[f"{s}{i}" for i in range(len(FEATURES))]].to_numpy(float) for s in "lh")
        for row in np.lexsort((table["node"], table["tree"])):
            tree, at, size = int(table["tree"][row]), int(table["node"][row]), int(table["n"][row])
            wide = np.flatnonzero(high[row] > low[row])
            if depth >= levels or not len(wide):
                grown[tree][at][4:] = [depth + float(_path(size)), size]
                continue
            r = np.random.default_rng([seed, tree, at])
            f = int(r.choice(wide))
            k = len(grown[tree])
            grown[tree][at] = [f, float(r.uniform(low[row, f], high[row, f])), k, k + 1, 0.0, size]
            grown[tree] += [[-1, 0.0, 0, 0, depth + 1.0, 0] for _ in range(2)]
        if all(f == len(g) for f, g in zip(first, grown)):
            break
    return grown


def train(features: DataFrame, trees: int = TREES, sample: int | None = None, seed: int = 42) -> DataFrame:
    """(tree, node, feature, cut, left, right, path, size): every tree from all windows, LEVELS deep; where a `sample` is asked for, each from its own `sample` of all windows."""
    if sample is None:
        rows = [(t, k, *n) for t, nodes in enumerate(_levels(features, trees, seed, LEVELS)) for k, n in enumerate(nodes) if nodes[0][5]]
        names = [c.split()[0] for c in NODES.split(", ")]
        table = pd.DataFrame(rows, columns=names).astype({n: t for n, t in zip(names, ("int32", "int32", "int32", "float64", "int32", "int32", "float64", "int64"))})
        return features.sparkSession.createDataFrame(pa.Table.from_pandas(table, preserve_index=False), NODES)
    rows = features.select(F.array(*FEATURES).alias("x"), F.col("slot"))
    n = rows.count()
    dealt = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", F.xxhash64("slot", "tree"))
    if n > 4 * sample:  # most copies are dropped before the shuffle; four times the sample leaves a tree short practically never
        dealt = dealt.where(F.pmod("h", F.lit(1_000_000)) < -(-4_000_000 * sample // n))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(h=pdf["h"] % 1_000_000).nsmallest(sample, ["h", "slot"])
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        nodes = _grow(x, np.random.default_rng([seed, int(key[0])]), int(np.ceil(np.log2(max(2, len(x))))))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path", "size"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", int(key[0]))
        return out

    return dealt.groupBy("tree").applyInPandas(build, NODES)


def score(features: DataFrame, forest: DataFrame, sample: int | None = None) -> DataFrame:
    """slot and anomaly (0 to 1): 2 ** -(mean path / expected path among the windows that a tree was grown from). The forest's size does not depend on their number."""
    nodes = forest.toPandas().sort_values(["tree", "node"])
    shared = features.sparkSession.sparkContext.broadcast([t[["feature", "cut", "left", "right", "path"]].to_numpy() for _, t in nodes.groupby("tree")])
    norm = float(_path(sample or nodes["size"].max() if len(nodes) else 0))

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(FEATURES)))
        total = np.zeros(len(m))
        for t in shared.value:
            total += t[_walk(t, m), 4]
        mean = total / max(1, len(shared.value))
        return pd.Series(2.0 ** -(mean / norm if norm else np.ones(len(m))))  # a window alone is neither near to others nor far

    return features.select("slot", run(F.array(*FEATURES)).alias("anomaly"))


def cutoff(scored: DataFrame, contamination: float = 0.25) -> float:
    """The anomaly that a `contamination` share of the training windows is over."""
    return scored.agg(F.percentile("anomaly", 1 - contamination)).first()[0] or 0.0


def excess(scored: DataFrame, at: float) -> DataFrame:
    """slot and forest: how far a window's anomaly is over the cut-off, 0 below it."""
    return scored.select("slot", F.least(F.greatest(F.col("anomaly") - at, F.lit(0.0)), F.lit(1.0)).alias("forest"))
