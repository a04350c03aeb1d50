"""Versions of the anomaly model: gate, cadence, history, and scores against a plain walk over the trees."""

import math

import numpy as np

from packetlake.operators import models
from packetlake.operators.features import FEATURES


def history(spark, slots):
    x = np.random.default_rng(3).normal(size=(len(slots), len(FEATURES))).round(6)
    x[-1] += 9
    rows = [(s, *map(float, v)) for s, v in zip(slots, x)]
    return spark.createDataFrame(rows, "slot long, " + ", ".join(f"{f} double" for f in FEATURES)), x


def test_versions_gate_and_scores(spark):
    slots = [s for s in range(100, 190) if not 130 <= s < 151]  # a pause longer than two periods
    df, x = history(spark, slots)
    scored, nodes = models.scored(df, gate=20, every=10, history=30, trees=7, sample=16)
    got = {r.slot: r for r in scored.collect()}
    trees = {}
    for r in nodes.collect():
        trees.setdefault((r.model, r.tree), {})[r.node] = r
    born = [119, 129, 151, 159, 169, 179, 189]
    assert sorted({m for m, _ in trees}) == born and len(trees) == 7 * len(born)
    assert sorted(got) == [s for s in slots if s > 119]

    def length(tree, row):
        at = 1
        while tree[at].feature >= 0:
            at = 2 * at + int(row[tree[at].feature] >= tree[at].cut)
        n = tree[at].size
        return tree[at].depth + (2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2))

    def anomaly(model, row, seen):
        n = min(16, seen)
        return 2 ** -(np.mean([length(trees[model, t], row) for t in range(7)]) / (2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n))

    for s, r in got.items():
        model = max(m for m in born if m < s)
        end = slots.index(model) + 1
        own = range(max(0, end - 30), end)
        a = anomaly(model, x[slots.index(s)], len(own))
        level = np.quantile([anomaly(model, x[k], len(own)) for k in own], 0.75)
        assert r.model == model and abs(r.anomaly - a) < 1e-9 and abs(r.forest - min(max(a - level, 0), 1)) < 1e-9
    assert max(got, key=lambda s: got[s].anomaly) == 189
    for (model, _), tree in trees.items():
        assert tree[1].size <= 16 and sum(t.size for t in tree.values() if t.feature < 0) == tree[1].size


def test_no_model_before_the_gate(spark):
    scored, nodes = models.scored(history(spark, range(10))[0], gate=20)
    assert scored.count() == 0 and nodes.count() == 0
