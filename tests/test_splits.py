"""Exact sizes, disjointness and order of the distributed rank and splits."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tunedata.operators import sft, splits
from tunedata.plans.rank import rank_by_hash, rank_by_key


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


@pytest.mark.parametrize("n", [0, 1, 4, 5, 10, 1000])
def test_split_sizes(spark, n):
    rows = splits.split_random(ids(spark, n), "k", 0.8, seed=3).collect()
    assert sum(r.split == "train" for r in rows) == int(0.8 * n)
    assert len(rows) == n
    rows = splits.split_test_size(ids(spark, n), "k", 0.2, seed=3).collect()
    assert sum(r.split == "test" for r in rows) == math.ceil(0.2 * n)
    rows = splits.split_head_tail(ids(spark, n), ["k"], 0.8).collect()
    assert sorted(r.k for r in rows if r.split == "train") == list(range(int(0.8 * n)))


def test_hash_rank_is_md5_order(spark):
    rows = rank_by_hash(ids(spark, 500), "k", 42).collect()
    expect = sorted(range(500), key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))
    assert [r.k for r in sorted(rows, key=lambda r: r["rank"])] == expect
    assert sorted(r["rank"] for r in rows) == list(range(1, 501))


def test_composite_key_rank(spark):
    df = spark.createDataFrame([(p, i) for p in ("b", "a", "c") for i in range(300)], "path string, idx int")
    rows = rank_by_key(df, ["path", "idx"]).collect()
    expect = sorted((r.path, r.idx) for r in rows)
    assert [(r.path, r.idx) for r in sorted(rows, key=lambda r: r["rank"])] == expect


def test_partition_check(spark):
    s = splits.split_random(ids(spark, 100), "k", 0.8, seed=1)
    parts = [s.where(F.col("split") == "train"), s.where(F.col("split") == "valid")]
    r = splits.check_partition(ids(spark, 100), parts, "k").first()
    assert (r.n_all, r.n_parts, r.n_overlap, r.n_missing, r.n_extra) == (100, 100, 0, 0, 0)
    bad = splits.check_partition(ids(spark, 100), [parts[0], parts[0]], "k").first()
    assert bad.n_overlap == 80 and bad.n_missing == 20


def test_same_result_any_partitioning(spark):
    a = {r.k: r.shuffle_pos for r in splits.shuffle_rows(ids(spark, 300), "k", 9).collect()}
    b = {r.k: r.shuffle_pos for r in splits.shuffle_rows(ids(spark, 300).repartition(7), "k", 9).collect()}
    assert a == b


@pytest.mark.parametrize("n,batches", [(20, 2), (7, 0), (16, 2)])
def test_minibatches_drop_last(spark, n, batches):
    rows = sft.assign_batches(ids(spark, n), ["k"], batch_size=8, grad_accum=1).collect()
    assert len({r.batch_id for r in rows}) == batches
    assert len(rows) == batches * 8
    assert all(r.batch_id == r.k // 8 for r in rows)


def test_sparse_integer_keys_stay_bounded(spark):
    keys = [(k * 1_000_003_117) % (1 << 62) - (1 << 61) for k in range(2000)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    rows = rank_by_key(df, ["k"]).collect()
    assert [r.k for r in sorted(rows, key=lambda r: r["rank"])] == sorted(keys)


def test_null_string_and_outlier_keys_lose_no_row(spark):
    some = spark.createDataFrame([(1,), (None,), (3,), (None,), (2,)], "k long")
    assert splits.split_random(some, "k", 0.8).count() == 5
    assert splits.split_head_tail(some, ["k"], 0.8).count() == 5
    assert sorted(r.shuffle_pos for r in splits.shuffle_rows(some, "k").collect()) == [1, 2, 3, 4, 5]
    assert splits.split_test_size(some, "k").count() == 5
    assert sft.assign_batches(some, ["k"], 2, drop_last=False).count() == 5
    text = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("s"))
    rows = rank_by_key(text, ["s"]).collect()
    assert [r.s for r in sorted(rows, key=lambda r: r["rank"])] == sorted(r.s for r in rows)
    far = spark.range(2000).select(F.when(F.col("id") == 7, F.lit(1 << 60)).otherwise(F.col("id")).alias("k"))
    rows = rank_by_key(far, ["k"]).collect()
    assert [r.k for r in sorted(rows, key=lambda r: r["rank"])] == sorted(r.k for r in rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = rank_by_key(far, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in parts) < 1500  # no task holds all rows but the outlier
