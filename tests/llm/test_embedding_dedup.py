import numpy as np
import pytest

from tunedata.llm import embedding_dedup as E


def brute(rows, cosine=0.95):
    ok = {}
    for k, (i, v) in enumerate(rows):
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, float) / max(map(abs, v))
        ok[k] = v / np.linalg.norm(v)
    linked = {k: [j for j in ok if j != k and len(ok[j]) == len(ok[k]) and ok[k] @ ok[j] >= cosine] for k in ok}
    return linked


def component_of(rows, linked):
    comp = {i: i for i, _ in rows if i is not None}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for k, js in linked.items():
        for j in js:
            x, y = sorted((find(rows[k][0]), find(rows[j][0])))
            comp[y] = x
    return {i: find(i) for i in comp}


def data(seed, n, hot=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 32)).astype(np.float32)
    rows = [b.tolist() for b in base]
    for b in base[: n // 3]:
        for _ in range(rng.integers(1, 4)):
            rows.append((b + rng.normal(size=32).astype(np.float32) * 0.15).tolist())
    rows += [(base[0] + rng.normal(size=32).astype(np.float32) * 0.1).tolist() for _ in range(hot)] + [rows[1]] * 5
    order = rng.permutation(len(rows))
    return [(int(i) * 3, rows[k]) for i, k in enumerate(order)]


def check(spark, rows, least=1.0, **kw):
    df = spark.createDataFrame([(i, v, 1, 7) for i, v in rows], "vec_id long, embedding array<float>, n_links int, node int")
    got = E.near_duplicates(df, **kw).collect()
    assert len(got) == len(rows)
    linked = brute(rows)
    want = {rows[k][0]: len(js) for k, js in linked.items()}
    have = {r.vec_id: r.n_links for r in got}
    total, found = sum(want.values()), sum(have.values())
    assert all(have[i] <= want.get(i, 0) for i in have) and found >= least * total
    if found == total:
        assert {r.vec_id: r.component_id for r in got if r.vec_id is not None} == component_of(rows, linked)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_recall(spark):
    check(spark, data(1, 400), least=0.98)


def test_dense_group_in_pieces(spark):
    check(spark, data(2, 60, hot=150), least=0.98, list_size=40)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (9, [1.0, 2.0, 0.0]), (10, [1.0, 2.0]), (11, [-1.0, -2.0]), (12, [1e-30, 2e-30]), (13, [1e30, 2e30]), (14, [0.0, 1.0])]
    check(spark, rows)
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect())
    assert got == [("1", 1, 1, True), ("1", 1, 1, True), ("None", 0, None, False)]


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def planted(seed, n, cosines, common):
    """``n`` unit vectors that share a mean (cosines of about ``common``), and for each of them one at every cosine."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(np.sqrt(common) * unit(rng.normal(size=64)) + np.sqrt(1 - common) * unit(rng.normal(size=(n, 64))))
    away = rng.normal(size=(len(cosines), n, 64))
    away = unit(away - (away * base).sum(2, keepdims=True) * base)
    near = [c * base + np.sqrt(1 - c * c) * w for c, w in zip(cosines, away)]
    return [v.tolist() for v in np.concatenate([base, *near])]


@pytest.mark.parametrize("common", [0.0, 0.5])
def test_recall_at_the_border(spark, common):
    """Pairs planted at cosines of 0.9501 to 0.96, beside the vectors of a table, through 1,024 pivots."""
    table = [r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()]
    vectors = planted(3, 500, (0.9501, 0.955, 0.96), common) + table
    rows = list(enumerate(vectors))
    check(spark, rows, least=0.97, pivots=1024)


def test_order_of_pivots_and_shared_counts():
    rng = np.random.default_rng(5)
    u, pivots = E._unit(rng.normal(size=(40, 8))), E._unit(rng.normal(size=(30, 8))).astype(np.float32)
    near = E.describe(u, pivots, 6)
    assert (near == np.argsort(-(u.astype(np.float32) @ pivots.T), axis=1, kind="stable")[:, :6]).all()
    want = [[len(set(x) & set(y)) for y in near.tolist()] for x in near[:9].tolist()]
    assert E._shared(near[:9], E._lists_of(near), 40).tolist() == want


def test_pivots_grow_and_lie_apart():
    assert [E.pivots_for(n) for n in (0, 10_000, 1_000_000, 10**12)] == [64, 400, 4000, 16384]
    rng = np.random.default_rng(6)
    dense = rng.normal(size=16) + 0.01 * rng.normal(size=(300, 16))  # a dense group takes one pivot
    chosen = E.choose_pivots([*dense, *rng.normal(size=(300, 16)), np.ones(3)], 100)
    assert len(chosen[16]) == 100 and chosen[3].shape == (1, 3)
    each = chosen[16] @ chosen[16].T - 2 * np.eye(100)
    assert each.max() < 0.9
