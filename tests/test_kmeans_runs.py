"""All k-means runs in one scan an iteration, against a plain version of each run."""

import numpy as np
from pyspark.ml.linalg import Vectors

from tabulens.ml.kmeans_runs import least_inertias, lloyd, pack, plus_plus


def _frame(spark, x, parts=4):
    return spark.createDataFrame([(Vectors.dense(r),) for r in x.tolist()], ["features"]).repartition(parts)


def _plain(x, c, tol=1e-4):
    for _ in range(300):
        d2 = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        near = d2.argmin(axis=1)
        new = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        inertia = d2.min(axis=1).sum()
        if ((new - c) ** 2).sum(axis=1).max() <= tol * tol:
            break
        c = new
    return inertia


def test_every_run_equals_a_plain_one(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 1, (150, 3)) for m in (-4, 0, 5)])
    blocks = pack(_frame(spark, x))
    chains = plus_plus(blocks, 5, 4, 7, 3)
    rows = {tuple(r) for r in x.tolist()}
    assert all(len(c) == 5 and len(np.unique(c, axis=0)) == 5 and {tuple(r) for r in c.tolist()} <= rows for c in chains)
    runs = {(k, i): c[:k] for k in (1, 2, 3, 5) for i, c in enumerate(chains)}
    got = lloyd(blocks, runs)
    assert got.keys() == runs.keys()
    for run, c in runs.items():
        assert np.isclose(got[run][0], _plain(x, c), rtol=1e-9)


def test_draws_follow_the_squared_distance(spark):
    # one far group of three rows among 300: nearly every second centre is drawn from it
    x = np.concatenate([np.random.default_rng(1).normal(0, 1e-3, (300, 2)), np.full((3, 2), 50.0) + np.eye(3, 2)])
    chains = plus_plus(pack(_frame(spark, x)), 2, 30, 11, 2)
    far = [(c > 25).all(axis=1).any() for c in chains]
    assert np.mean(far) > 0.9


def test_equal_rows_fewer_values_than_centres_and_repeated_runs(spark):
    x = np.repeat(np.array([[0.0, 0.0], [1.0, 1.0]]), 40, axis=0)
    frame = _frame(spark, x)
    assert np.allclose(least_inertias(frame, [1, 2, 4], 5, 3, "plus_plus"), [40.0, 0.0, 0.0])
    y = np.concatenate([np.random.default_rng(9).normal(m, 1, (80, 2)) for m in (-6, 0, 6)])
    frame = _frame(spark, y)
    a = least_inertias(frame, [2, 3, 4], 5, 6, "plus_plus")
    assert a[0] > a[1] > a[2] and least_inertias(frame, [], 5, 6) == []
    from pyspark.ml.clustering import KMeans
    best = min(KMeans(k=3, seed=s, maxIter=300).fit(frame).summary.trainingCost for s in range(6))
    assert a[1] <= best * 1.001


def test_runs_of_mixed_sizes_and_equal_centres():
    from tabulens.ml.kmeans_runs import _assigned, _nearest
    x = np.random.default_rng(4).normal(size=(3000, 3))
    runs = [x[:2], np.vstack([x[5], x[5]]), x[10:14], x[20:24], x[30:33]]          # the second holds one centre twice
    seen = {j: [] for j in range(len(runs))}
    for _, j, near, gap in _nearest(x, runs):
        seen[j].append((near, gap))
    for j, c in enumerate(runs):
        d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (np.concatenate([n for n, _ in seen[j]]) == d2.argmin(axis=1)).all()
        assert np.allclose(np.concatenate([g for _, g in seen[j]]), d2.min(axis=1))
    for _, rows, found in _assigned(x, runs):
        assert all((own.sum(axis=0) == 1).all() for _, own in found) and len(rows) <= 3000
    assert [first for first, _ in found] == [0, 2, 4]
