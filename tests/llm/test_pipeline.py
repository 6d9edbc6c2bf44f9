"""The pipeline against a stage-by-stage brute-force version on a small table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_simhash import brute_components, brute_fp
from test_suffix_dedup import brute as brute_repeats
from tunedata.llm import mixing, quality_crf
from tunedata.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        out.append((docs, f(spark, docs, SF)))
        docs = written(out[-1][1], "pipeline-test")
    return out


def rows(df):
    return sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def test_quality_keeps_what_the_classifier_keeps(spark, stages):
    docs, got = stages[0]
    model = quality_crf.fit(docs, quality_crf.training_labels(spark, SF))
    keep = {r.doc_id for r in quality_crf.score(docs, model).where("score >= 0.5").collect()}
    assert rows(got) == rows(docs.where(F.col("doc_id").isin(list(keep)))) and 0 < len(keep) < docs.count()


def test_near_duplicates(stages):
    docs, got = stages[1]
    d = docs.collect()
    comp = brute_components([r.doc_id for r in d], [brute_fp(r.text) for r in d])
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(comp.values()))


def test_repeated_strings(stages):
    docs, got = stages[2]
    d = docs.collect()
    gone = brute_repeats([(r.doc_id, r.text) for r in d])
    want = {r.doc_id: np.frombuffer(r.text.encode(), np.uint8)[~gone[r.doc_id, r.text]].tobytes().decode("utf-8", "ignore") for r in d}
    have = got.collect()
    assert {r.doc_id: r.text for r in have} == want and len(have) == len(d)
    assert all(r.n_chars == len(r.text) for r in have)
    assert {(r.doc_id, r.lang, r.source) for r in have} == {(r.doc_id, r.lang, r.source) for r in d}


def test_mix(stages):
    docs, got = stages[3]
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    have = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert have == {i: n for i, n in copies.items() if n}
    assert set(rows(got)) <= set(rows(docs))


def test_packing(stages):
    docs, got = stages[4]
    sizes = {(r.doc_id, r.doc_tokens): r["sum(length)"] for r in got.groupBy("doc_id", "doc_tokens").sum("length").collect()}
    n = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert {i for i, _ in sizes} == set(n)
    assert all(total == n[i] * tokens for (i, tokens), total in sizes.items())


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()
