import math

import numpy as np

from tunedata.llm import whitening as W


def test_bit_slices_give_exact_products():
    rng = np.random.default_rng(1)
    for n, dim, most in ((1, 3, 5), (63, 4, 1 << 11), (64, 2, 1 << 11), (200, 5, 1 << 40), (130, 3, 1)):
        y = rng.integers(0, most, (n, dim))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(dim)] for i in range(dim)]
        assert W.cross_products(W.bit_planes(y)).tolist() == want
    t = W.Scatter(3)
    x = rng.integers(-(1 << 45), 1 << 45, (50, 3))
    t.add(x[:20]), t.add(x[20:])
    assert t.sums.tolist() == [sum(map(int, x[:, i])) for i in range(3)] and t.n == 50
    assert t.products[0, 2] == sum(int(a) * int(b) for a, b in zip(x[:, 0], x[:, 2]))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    src = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([[math.floor(1024 * c) + 100000 for c in r.embedding] for r in src])
    n, s = len(x), x.sum(0)
    e, v = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    e, v = e[::-1], v[:, ::-1]
    rows = W.op13_whitening(spark, sf).collect()
    assert len(rows) == 8 * n and {r.n for r in rows} == {n}
    got = np.zeros((n, 8))
    place = {r.vec_id: k for k, r in enumerate(src)}
    deviation = ((n * x - s) ** 2).sum(1)
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]]
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    assert np.abs(np.cov(got.T, bias=True) - np.eye(8)).max() < 1e-9
    want = (x - s / n) @ v[:, :8] / np.sqrt(e[:8])
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-6


def test_partitioning_does_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a, b = (sorted(map(tuple, W.whitened(df.repartition(k)).collect())) for k in (1, 7))
    assert a == b


def test_odd_rows(spark):
    docs = [
        (1, [0.5, 0.25, 3.0], 1.0), (2, [-0.5, 0.25, 1.0], 1.0), (2, [-0.5, 0.25, 1.0], 1.0), (None, [1e300, 0.25, 0.0], 0.0), (4, None, 0.0), (5, [], 0.0),
        (6, [float("nan"), 1.0, 1.0], 0.0), (7, [None, 1.0, 1.0], 0.0), (8, [1.0], 0.0), (9, [float("inf"), 0.0, 0.0], 0.0), (10, [0.0, 0.25, 0.0], 0.0),
    ]
    df = spark.createDataFrame(docs, "vec_id long, embedding array<double>, whitened double")
    rows = W.whitened(df).collect()
    by = {}
    for r in rows:
        by.setdefault((r.n, r.component), []).append(r)
    assert set(by) == {(5, 1), (5, 2), (5, 3), (1, 1)}
    assert {len(v) for k, v in by.items() if k[0] == 5} == {5}
    assert all(r.whitened == 0 and r.explained == 0 and r.deviation == 0 for r in by[1, 1])
    assert all(r.whitened == 0 for r in by[5, 3])  # a dimension does not vary
    assert all(math.isfinite(r.whitened) and r.identity_error < 1e-4 for r in rows)
    assert W.whitened(df.limit(0)).collect() == []
