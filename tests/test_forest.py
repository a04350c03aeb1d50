"""The forest ranks planted outliers first and repeats itself."""

import numpy as np

from packetlake.operators import features, forest


def test_outliers_rank_first_and_seed_is_stable(spark):
    x = np.random.default_rng(1).normal(size=(300, len(features.FEATURES)))
    x[:3] += 9
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "slot long, " + ", ".join(f"{f} double" for f in features.FEATURES))
    model = forest.train(rows, trees=40, sample=128)
    got = {r.slot: r.anomaly for r in forest.score(rows, model, 128).collect()}
    assert set(sorted(got, key=got.get)[-3:]) == {0, 1, 2}
    again = {r.slot: r.anomaly for r in forest.score(rows, forest.train(rows, trees=40, sample=128), 128).collect()}
    assert got == again
    scored = forest.score(rows, model, 128)
    over = {r.slot: r.forest for r in forest.excess(scored, forest.cutoff(scored, 0.01)).collect()}
    assert {k for k, v in over.items() if v > 0} == {0, 1, 2} and all(0 <= v <= 1 for v in over.values())
