import numpy as np

from packetlake.llm import vector_dedup as vd


def dense(n, planted, seed=3):
    """A label whose vectors have a mean cosine of about 0.92, with isolated pairs at 0.98 or just over."""
    r = np.random.default_rng(seed)
    mean = r.normal(size=64)
    mean *= np.sqrt(0.92) / np.linalg.norm(mean)
    x = mean + r.normal(size=(n, 64)) * np.sqrt(0.08 / 64)
    for k in range(planted):
        step = r.normal(size=64)
        x[n - 1 - k] = x[k] + step * 0.19 / np.linalg.norm(step)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x):
    return spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)


def test_pairs_of_a_dense_label_are_found_at_the_target_recall(spark):
    x = dense(8000, 400)
    near = x @ x.T >= vd.COSINE
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in vd.near_duplicates(frame(spark, x)).collect()}
    found = sum(got.values()) / near.sum()
    print("pairs", near.sum() // 2, "recall", found)
    assert near.sum() >= 700
    assert found >= vd.RECALL - 0.01


def test_neighbours_in_different_tasks_are_compared(spark):
    r = np.random.default_rng(4)
    x = [r.normal(size=8)]
    for _ in range(199):
        x.append(x[-1] + r.normal(size=8) * 0.3)
    x = np.array(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(0, 1, 8, 5, 0, float(k), k, v.tolist()) for k, v in enumerate(x)], vd.ROWS)
    want = {(i, j) for i in range(200) for j in range(i + 1, min(i + 6, 200)) if u[i] @ u[j] >= 0.9}
    for parts in (1, 7, 90):
        got = {(r.a, r.b) for r in vd.window_pairs(rows.repartitionByRange(parts, "tie").sortWithinPartitions(*vd.ORDER), 5, 0.9).collect()}
        assert got >= want and all(u[i] @ u[j] >= 0.9 for i, j in got)


def test_tiny_and_huge_vectors_link_and_spoil_nothing(spark):
    x = dense(1200, 60)
    r = np.random.default_rng(8)
    odd = []
    for scale in (1e-200, 1e-300, 1e200, 1e307):
        v = r.normal(size=64)
        odd += [v * scale, (v + r.normal(size=64) * 0.02) * scale, v * 1.0]
    odd += [np.full(64, 1e-320), np.full(64, 5e-324)]
    own = np.concatenate([x, np.array(odd)])
    unit = np.array([v / np.abs(v).max() for v in own])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= vd.COSINE
    np.fill_diagonal(near, False)
    got = {q.vec_id: q.n_links for q in vd.near_duplicates(frame(spark, own)).collect()}
    assert all(got[k] == near[k].sum() >= 2 for k in range(1200, 1212)) and got[1212] == got[1213] == 1
    assert sum(got.values()) >= 0.99 * near.sum()
