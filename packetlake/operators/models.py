"""Versions of the anomaly model: an isolation forest trained every hour on the windows so far, and each window scored by the newest one before it.

The first model is trained at the window that makes GATE of them, the next at the first window of each following hour (counted
from the first). A model sees the newest HISTORY windows up to its own; each of its trees draws SAMPLE of them. All draws
are the first 32 bits of the MD5 of their own names, so a model can be built again anywhere, from the table alone. A cut
lies between a feature's least and greatest value in a node, so standardising the features would move the cut with
the values and leave every split as it is.

A model's table: model (the slot it was trained at), tree, node (children of n are 2n and 2n + 1), feature (-1: a leaf), cut,
size (windows in the node), depth.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake.operators.features import FEATURES
from packetlake.operators.stored import stored
from packetlake.operators.windows import sums_before

GATE, EVERY, HISTORY, TREES, SAMPLE, CONTAMINATION = 200, 720, 15_000, 200, 256, 0.25
NODES = "model long, tree int, node int, feature int, cut double, size int, depth int"


def numbered(features: DataFrame) -> DataFrame:
    """slot, number (from 0, in order of the slots), x (the features)."""
    before = sums_before(features, "slot", number=F.count("*"))
    # an array counts as one number to the planner, which would broadcast all windows through the driver
    return features.select("slot", F.array(*FEATURES).alias("x")).hint("merge").join(before, "slot").select("slot", "number", "x")


def schedule(rows: DataFrame, gate: int = GATE, every: int = EVERY, history: int = HISTORY) -> DataFrame:
    """model, low, high: when models are trained, and the numbers [low, high) of their windows, in cells of time of `every` slots from `begin` on.

    Empty before `gate` windows.
    """
    first = rows.where(F.col("number") == gate - 1).select("slot").first()
    begin = first[0] if first else 2**62
    due = rows.where(F.col("slot") >= begin).withColumn("cell", F.floor((F.col("slot") - begin) / every))
    models = due.groupBy("cell").agg(F.min_by(F.struct("slot", "number"), "slot").alias("m"))
    models = models.select("cell", F.col("m.slot").alias("model"), (F.col("m.number") + 1).alias("high"))
    return models.withColumn("low", F.greatest(F.col("high") - history, F.lit(0))).withColumn("begin", F.lit(begin))


def _draw(*names) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(n).cast("string") if isinstance(n, str) else n for n in names])), 1, 8), 16, 10).cast("long")


def draw(*names) -> int:
    return int(hashlib.md5("|".join(map(str, names)).encode()).hexdigest()[:8], 16)


def samples(models: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """model, tree, number: the windows that each tree is grown from. Twice `sample` draws, of which the first different ones count."""
    draws = models.select("model", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * sample - 1))).alias("j"))
    draws = draws.withColumn("number", F.col("low") + _draw("model", "tree", "j", F.lit("s")) % (F.col("high") - F.col("low")))
    kept = draws.groupBy("model", "tree", "number").agg(F.min("j").alias("j"))
    place = F.row_number().over(W.partitionBy("model", "tree").orderBy("j"))  # 2 * sample rows a tree
    return kept.withColumn("_place", place).where(F.col("_place") <= sample).select("model", "tree", "number")


def grow(model: int, tree: int, x: np.ndarray, most: int) -> list[tuple]:
    """Rows of a model's table for one tree."""
    out = []

    def node(rows, at, depth):
        low, high = rows.min(0), rows.max(0)
        wide = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(wide):
            out.append((model, tree, at, -1, 0.0, len(rows), depth))
            return
        f = int(wide[draw(model, tree, at, "f") % len(wide)])
        cut = float(low[f] + draw(model, tree, at, "c") / 2**32 * (high[f] - low[f]))
        out.append((model, tree, at, f, cut, len(rows), depth))
        over = rows[:, f] >= cut
        # a cut on the least value itself leaves one side empty
        for side, part in ((0, rows[~over]), (1, rows[over])):
            if len(part):
                node(part, 2 * at + side, depth + 1)

    node(x, 1, 0)
    return out


def train(rows: DataFrame, models: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """The model table: every tree of every model grown on its own, from at most `sample` windows."""
    most = int(np.ceil(np.log2(sample)))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        return pd.DataFrame(grow(int(key[0]), int(key[1]), np.stack(pdf["x"].to_numpy()).astype(float), most), columns=[c.split()[0] for c in NODES.split(", ")])

    # made from few rows, draws look small to the planner, which would broadcast all of them through the driver
    drawn = samples(models, trees, sample).hint("merge").join(rows.select("number", "x"), "number")
    return drawn.groupBy("model", "tree").applyInPandas(build, NODES)


def path(size):
    """Mean depth of an unsuccessful search among `size` windows."""
    size = np.asarray(size, float)
    return np.where(size > 2, 2 * (np.log(np.maximum(size - 1, 1)) + 0.5772156649) - 2 * (size - 1) / np.maximum(size, 1), np.where(size == 2, 1.0, 0.0))


def anomalies(x: np.ndarray, nodes: pd.DataFrame, sample: int) -> np.ndarray:
    """2 ** -(mean depth / expected depth) of each row."""
    total, trees = np.zeros(len(x)), 0
    for _, t in nodes.groupby("tree"):
        size = int(t["node"].max()) + 2
        feature, cut, depth = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = t["node"].to_numpy()
        feature[at], cut[at], depth[at] = t["feature"], t["cut"], t["depth"] + path(t["size"])
        place = np.ones(len(x), int)
        while (inner := feature[place] >= 0).any():
            f = np.maximum(feature[place], 0)
            place = np.where(inner, 2 * place + (x[np.arange(len(x)), f] >= cut[place]), place)
        total, trees = total + depth[place], trees + 1
    return 2.0 ** -(total / max(1, trees) / float(path(sample)))


def serving(rows: DataFrame, models: DataFrame, every: int = EVERY) -> DataFrame:
    """slot, model: the newest model trained before each window; windows before the first model are left out."""
    known = models.select("cell", "model", "begin").orderBy("cell").collect()  # a row an hour
    if not known:
        return rows.select("slot", F.lit(None).cast("long").alias("model")).where("false")
    begin, newest = known[0]["begin"], rows.agg(F.max("slot")).first()[0]
    spans, k = [], 0
    for cell in range((newest - begin) // every + 1):  # the model trained in a cell of time, and the newest one before
        while k + 1 < len(known) and known[k + 1]["cell"] <= cell:
            k += 1
        spans += [(cell, x["model"]) for x in known[max(0, k - 1) : k + 1]]
    spans = rows.sparkSession.createDataFrame(spans, "cell long, model long")
    cells = rows.where(F.col("slot") > begin).select("slot", F.floor((F.col("slot") - begin) / every).alias("cell"))
    return cells.join(F.broadcast(spans), "cell").where("model < slot").groupBy("slot").agg(F.max("model").alias("model"))  # two rows an hour


def scores(rows: DataFrame, models: DataFrame, nodes: DataFrame, every: int = EVERY, sample: int = SAMPLE, contamination: float = CONTAMINATION) -> DataFrame:
    """slot, model, anomaly, forest: the anomaly of each window by the model that serves it, and how far it is over the level that `contamination` of the model's own windows are over.

    A group holds a model's trees, its own windows (at most HISTORY) and those that it serves (an hour's).
    """

    def run(key, windows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(windows) or not len(trees):
            return pd.DataFrame({"slot": [], "model": [], "anomaly": [], "forest": []}, dtype=float)
        own = windows["own"].to_numpy()
        own_size = int(own.sum())
        a = anomalies(np.stack(windows["x"].to_numpy()).astype(float), trees, min(sample, own_size))
        over = np.clip(a - np.quantile(a[own], 1 - contamination), 0.0, 1.0)
        return pd.DataFrame({"slot": windows["slot"], "model": windows["model"], "anomaly": a, "forest": over})[~own]

    own = models.select("model", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("number")).hint("merge").join(rows, "number").select("model", "slot", "x", F.lit(True).alias("own"))
    served = serving(rows, models, every).hint("merge").join(rows, "slot").select("model", "slot", "x", F.lit(False).alias("own"))
    both = own.unionByName(served)
    return both.groupBy("model").cogroup(nodes.groupBy("model")).applyInPandas(run, "slot long, model long, anomaly double, forest double")


def scored(features: DataFrame, gate: int = GATE, every: int = EVERY, history: int = HISTORY, trees: int = TREES, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(scores, model table) of a history of windows."""
    rows = stored(numbered(features))
    models = stored(schedule(rows, gate, every, history))
    nodes = stored(train(rows, models, trees, sample))
    return scores(rows, models, nodes, every, sample), nodes
