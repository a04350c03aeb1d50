"""A forest is grown from all windows, whatever their number."""

import numpy as np

from packetlake.operators import forest
from packetlake.operators.features import FEATURES


def test_every_window_counts_in_every_tree(spark):
    n = 20_000
    x = np.round(np.random.default_rng(2).normal(size=(n, len(FEATURES))), 3)
    x[0] += 30  # the oldest window
    x[:, 5] = 1.0
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "slot long, " + ", ".join(f"{f} double" for f in FEATURES)).repartition(3)
    model = forest.train(rows, trees=5)
    nodes = model.toPandas().sort_values(["tree", "node"])
    assert set(nodes["tree"]) == set(range(5)) and set(nodes[nodes["node"] == 0]["size"]) == {n}
    depths = np.zeros(n)
    for _, t in nodes.groupby("tree"):
        assert len(t) <= 2 ** (forest.LEVELS + 1) - 1 and list(t["node"]) == list(range(len(t)))
        t = t.to_dict("list")
        held = {0: (np.arange(n), 0)}
        for k in range(len(t["node"])):
            part, depth = held[k]
            assert t["size"][k] == len(part)
            if t["feature"][k] < 0:
                assert abs(t["path"][k] - depth - float(forest._path(len(part)))) < 1e-9
                assert depth == forest.LEVELS or len(part) <= 1 or (x[part] == x[part[0]]).all()
                depths[part] += t["path"][k]
                continue
            v = x[part, t["feature"][k]]
            assert t["feature"][k] != 5 and v.min() <= t["cut"][k] <= v.max()
            held[t["left"][k]], held[t["right"][k]] = (part[v < t["cut"][k]], depth + 1), (part[v >= t["cut"][k]], depth + 1)
    got = {r.slot: r.anomaly for r in forest.score(rows, model).collect()}
    want = 2.0 ** -(depths / 5 / float(forest._path(n)))
    assert max(abs(got[k] - want[k]) for k in range(n)) < 1e-9 and max(got, key=got.get) == 0
    again = forest.train(rows.repartition(7), trees=5).toPandas().sort_values(["tree", "node"])
    assert again.reset_index(drop=True).equals(nodes.reset_index(drop=True))


def test_one_window_and_none(spark):
    one = spark.createDataFrame([(1, *[2.0] * len(FEATURES))], "slot long, " + ", ".join(f"{f} double" for f in FEATURES))
    assert [r.anomaly for r in forest.score(one, forest.train(one, trees=2)).collect()] == [0.5]
    none = one.where("slot > 1")
    assert forest.score(none, forest.train(none, trees=2)).count() == 0
