import numpy as np
from pyspark.sql import functions as F

from tunedata.llm import toxicity as T


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = T.op4_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    r = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))),
    ).first()
    assert r[0] >= 0.8 and r[1] <= 0.01, r  # 300 toxic labels; the check tables, with 1,600, give 1.0 and 0.0


def test_label_model_recovers_accuracies_and_shares_correlated_weight():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    good = np.stack([(rng.random(6000) < np.where(y, 0.5, 0.02)) for _ in range(5)], 1)
    votes = np.concatenate([good, good[:, :1], good[:, :1], (rng.random((6000, 1)) < 0.1)], 1).astype(float)
    clean = (votes[:, :5].sum(1) == 0).astype(float)
    post, accuracy, keep = T.label_model(votes, clean, 0.2)
    assert ((post > 0.5) == y).mean() > 0.95
    assert accuracy[1] > accuracy[-1] + 0.3
    assert keep[0] < 0.5 and keep[5] < 0.5 and keep[1] > 0.9


def test_hits():
    lex = T.Lexicon(["idiot", "lowe*", "lowei*"])
    votes, count, words = lex.hits("Idiot! loweient lowe LOWEN idiots idiot")
    assert votes == [0, 1, 2] and count == 4 and words == 6
    assert lex.hits("") == ([], 0, 0)


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(i, "you bad fool " * 3 if i % 3 == 0 else "nice words only", "x") for i in range(60)] + [(None, None, "x"), (99, "", "x"), (0, "x" * 10000, "x")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    rows = T.score(docs, T.fit(docs, labels)).collect()
    assert len(rows) == 63 and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score >= T.THRESHOLD) == (r.n_hits > 0) for r in rows)
    assert {r.score for r in T.score(docs, T.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert T.score(docs.limit(0), T.fit(docs, labels)).collect() == []
