import numpy as np
import pytest

from tunedata.llm import neighbour_graph as G

SF = "/root/testdata/sf0.1"


def brute(rows, every=20, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for i in np.nonzero(ids % every == 0)[0]:
        s = x @ x[i]
        own = ids != ids[i]
        order = np.lexsort((ids[own], -s[own]))[:k]
        out.setdefault(int(ids[i]), list(zip(ids[own][order].tolist(), s[own][order].tolist())))
    return out


def compare(df, want, k=20):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    hits = total = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        key = [(-r.score, r.vec_id) for r in rows]
        assert key == sorted(key) and len({r.vec_id for r in rows}) == len(rows)
        truth = dict(want[q])
        for r in rows:
            if r.vec_id in truth:
                assert np.isclose(r.score, truth[r.vec_id], rtol=1e-12, atol=1e-12)
        hits, total = hits + sum(r.vec_id in truth for r in rows), total + len(truth)
    return hits / max(total, 1)


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert compare(G.op11_nn_descent(spark, SF), brute(rows)) >= 0.95


def test_recall_with_groups_and_lengths(spark):
    """Near copies in bulk, vectors of very different lengths, several blocks and rounds."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    x[:900] = x[0] + 0.02 * rng.normal(size=(900, 24))
    x[1000:1030] = x[1000] + 0.01 * rng.normal(size=(30, 24))
    x[2000:] *= np.exp(rng.normal(size=(1000, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    assert compare(G.nearest(df, beam=128, step=32), brute(rows)) >= 0.9


def test_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(1, 60)]
    copies = [(i, rows[3][1]) for i in range(100, 160)]
    odd = [(200, None), (220, [0.0] * 5), (240, [float("nan")] * 5), (260, [None, 1.0, 0.0, 0.0, 0.0]), (None, rows[0][1]), (280, [])]
    short = [(300, [1.0, 2.0]), (302, [3.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + copies + odd + short + rows[:7]], "vec_id long, embedding array<double>, node int, score double")
    padded = rows + copies + [(i, v + [0.0] * (5 - len(v))) for i, v in short]
    assert compare(G.nearest(df), brute(padded)) == 1.0
    few = df.where("vec_id in (1, 2, 20)")
    assert compare(G.nearest(few), brute([r for r in rows if r[0] in (1, 2, 20)])) == 1.0
    assert G.nearest(df.where("vec_id = 20")).collect() == []
    assert G.nearest(df.limit(0)).collect() == []


def test_queries_that_are_no_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    df = G.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    q = rng.normal(size=(30, 8))
    queries = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    got = G.search(G.build(df), queries, k=5).collect()
    want = {(1000 + i, int(j)) for i, v in enumerate(q) for j in np.argsort(-(x @ v))[:5]}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.97 * len(want)


def test_best_of():
    u, w, s, f = (np.array(c) for c in ([1, 1, 1, 0, 1], [5, 5, 6, 5, 7], [0.5, 0.5, 0.9, 0.1, 0.2], [True, False, True, True, False]))
    got = G.best_of(u, w, s, f, 2)
    assert [c.tolist() for c in got] == [[0, 1, 1], [5, 6, 5], [0.1, 0.9, 0.5], [True, True, False]]


@pytest.mark.parametrize("n", [0, 1, 7])
def test_places(n):
    keys = np.array([0, 0, 3, 3, 3, 4, 9])[:n]
    assert G._places(keys).tolist() == [0, 1, 0, 1, 2, 0, 0][:n]
