"""k-means over boxes of neighbours: the same sums as row by row, and MLlib's own seedings for all runs in a few scans."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors

from tabulens.ml import kmeans_runs as K
from tabulens.ml.kmeans_seeds import first_place, uniforms


def _frame(spark, x, parts=4):
    return spark.createDataFrame([(Vectors.dense(r),) for r in x.tolist()], ["features"]).repartition(parts)


def _plain(x, c):
    d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    near = d2.argmin(axis=1)
    return np.array([[*x[near == j].sum(axis=0), (near == j).sum(), d2[near == j, j].sum()] for j in range(len(c))])


def _block(x):
    m = np.ascontiguousarray(x[K.neighbours(x)])
    return m, K._sizes(K.boxes(m), len(m))


@pytest.mark.parametrize("n,d", [(1, 2), (15, 1), (16, 3), (17, 2), (5000, 3), (20011, 4), (3000, 9)])
def test_boxes_add_up_to_the_rows(n, d):
    rng = np.random.default_rng(n)
    for x in (rng.normal(size=(n, d)), rng.integers(0, 4, (n, d)).astype(float), np.full((n, d), 2.5)):
        m, sizes = _block(x)
        assert sorted(map(tuple, m.tolist())) == sorted(map(tuple, x.tolist()))
        for size in sizes:
            assert size.count.sum() == n and np.allclose(size.total.sum(axis=1), x.sum(axis=0))
        for k in (1, 2, 7):
            c = rng.normal(size=(k, d)) * 2
            sums = np.zeros((k, d + 2))
            K._sweep(sums, m, sizes, c, True)
            assert np.allclose(sums, _plain(x, c), rtol=1e-9, atol=1e-9)
        twice = np.vstack([x[0], x[0]])                     # equally near: the first centre has the rows
        sums = np.zeros((2, d + 2))
        K._sweep(sums, m, sizes, twice, True)
        assert sums[0, d] == n and sums[1, d] == 0


def test_rows_of_boxes_on_one_side_are_not_read():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(-10, 1, (4096, 3)), rng.normal(10, 1, (4096, 3))])
    m, sizes = _block(x)
    c = np.array([[-9.0] * 3, [9.5] * 3])
    sums = np.zeros((2, 5))
    K._sweep(sums, np.full_like(m, np.nan), sizes, c, True)
    assert np.allclose(sums, _plain(x, c))


def test_seedings_are_those_of_mllib_in_four_scans(spark, monkeypatch):
    scans = []
    plain = K._scan
    monkeypatch.setattr(K, "_scan", lambda blocks, runs, d, costs=False: scans.append(len(runs)) or plain(blocks, runs, d, costs))
    x = np.random.default_rng(8).normal(size=(2500, 3))
    frame = _frame(spark, x, 5).localCheckpoint()
    rows = K.numbered(frame)
    runs = [(k, i) for k in (2, 5) for i in range(3)]
    got = K.parallel_seeds(rows, K.blocks_of(rows), runs, 42, 3)
    for k, i in runs:
        want = KMeans(k=k, seed=42 + i, maxIter=1, featuresCol="features").fit(frame).clusterCenters()
        assert np.allclose(got[(k, i)], want, rtol=0, atol=1e-12)
    assert len(scans) == 4


def test_numbers_do_not_depend_on_where_they_are_drawn():
    whole = uniforms([7, -3], 0, 5000)
    assert whole.min() >= 0 and whole.max() < 1 and 0.45 < whole.mean() < 0.55
    assert (uniforms([-3], 1234, 700)[0] == whole[1, 1234:1934]).all()
    assert first_place({0: 0, 2: 1}, 5) == (2, 0)


def test_blocks_hold_all_rows_whatever_the_borders(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 600)
    x = np.concatenate([np.random.default_rng(2).normal(size=(1500, 2)), np.zeros((2000, 2))])     # many equal rows
    blocks = K.pack(_frame(spark, x, 3))
    held = [np.frombuffer(bytes(r["data"])).reshape(-1, 2) for r in blocks.collect()]
    assert max(map(len, held)) <= 300 and len(held) > 10
    assert sorted(map(tuple, np.concatenate(held).tolist())) == sorted(map(tuple, x.tolist()))


def test_values_without_end_are_refused(spark):
    with pytest.raises(Exception, match="NaN or infinite"):
        K.numbered(_frame(spark, np.array([[1.0, np.inf]] * 60)))
