import itertools

import numpy as np
from pyspark.sql import functions as F

from tunedata.llm import quality_crf as Q


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    count = np.array([3, 0, 1, 5, 5, 2])
    u, trans = rng.normal(size=count.sum()) * 2, rng.normal(size=(2, 2))
    good, pairs, log_z = Q._Chains(count).marginals(u, trans)
    want, want_pairs, want_z, at = np.zeros(len(u)), np.zeros((2, 2)), 0.0, 0
    for n in count:
        if not n:
            continue
        ys = list(itertools.product((0, 1), repeat=int(n)))
        s = np.array([sum(y * x for y, x in zip(path, u[at : at + n])) + sum(trans[a, b] for a, b in zip(path, path[1:])) for path in ys])
        p = np.exp(s - s.max())
        want_z += np.log(p.sum()) + s.max()
        p /= p.sum()
        for path, q in zip(ys, p):
            want[at : at + n] += q * np.array(path)
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += q
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_features_do_not_depend_on_the_batch():
    texts = [b"One line\nTWO!!\n\n  \nOne line", b"", b"x", b"\n", "é | è".encode(), b"%%% $$$\r\nlast"]
    x, length, count = Q.line_features(texts)
    assert count.tolist() == [3, 0, 1, 0, 1, 2] and len(length) == 7
    alone = [Q.line_features([t])[0] for t in texts]
    assert np.array_equal(x, np.concatenate(alone))
    assert Q.line_features([])[0].shape == (0, 3 * Q.N_OWN)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op2_quality_crf(spark, sf)
    assert got.count() == got.select("doc_id").distinct().count() == 1000
    r = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.avg(F.when(F.col("quality") == 1, F.col("predicted"))),
        F.avg(F.when(F.col("quality") == 0, F.col("predicted"))),
    ).first()
    assert r[0] >= 0.97 and r[1] >= 0.98 and r[2] <= 0.1


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 0.5), (2, None, 0.1), (3, "", 0.1), (None, "x\n" * 3000, 0.1), (1, "good words here", 0.5), (5, "%%%% !!!!", 1.0)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (3, None)], "doc_id long, quality int")
    rows = Q.score(docs, Q.fit(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    by = {(r.doc_id, r.n_lines): r.score for r in rows}
    assert by[2, 0] == by[3, 0] == 0.5 and by[1, 1] > 0.5 > by[5, 1]
    none = Q.fit(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, none).where("n_lines = 0").collect()} == {0.5}
    assert Q.score(docs.limit(0), none).collect() == []
