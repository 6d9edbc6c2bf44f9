"""Orders per epoch, shards with an index, and inference that goes on where it stopped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunedata.operators import inference, splits
from tunedata.plans.permute import PRIME, permuted, round_constants
from tunedata.sources import shards


def brute(n, key):
    at = list(range(n))
    for k, a, b in round_constants(key):
        for i, x in enumerate(at):
            y = (k - x) % n
            if (max(x, y) % PRIME * (a + 1) + b) % PRIME < PRIME // 2:
                at[i] = y
    return at


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation_is_a_bijection_with_its_inverse(spark, n):
    df = spark.range(n).withColumn("at", permuted("id", n, "s|1")).withColumn("back", permuted("at", n, "s|1", inverse=True))
    rows = df.orderBy("id").collect()
    assert [r["at"] for r in rows] == brute(n, "s|1")
    assert sorted(r["at"] for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)


def test_permutation_of_odd_positions(spark):
    df = spark.createDataFrame([(None,), (-1,), (10,), (1 << 40,)], "x long")
    assert [r.at for r in df.select(permuted("x", 10, "k").alias("at")).collect()] == [None] * 4
    big = (1 << 45) + 7
    got = spark.range(big - 500, big).select("id", permuted("id", big, "k").alias("at"))
    rows = got.withColumn("back", permuted("at", big, "k", inverse=True)).collect()
    assert len({r["at"] for r in rows}) == 500 and all(r.back == r.id and 0 <= r["at"] < big for r in rows)


def test_permutation_mixes(spark):
    n = 20_000
    at = np.array([r["at"] for r in spark.range(n).select("id", permuted("id", n, "a").alias("at")).orderBy("id").collect()])
    cells = np.histogram2d(np.arange(n), at, bins=10)[0]
    assert np.sum((cells - n / 100) ** 2 / (n / 100)) < 160  # chi-square, 81 degrees of freedom
    assert abs(np.corrcoef(np.diff(at[:-1]), np.diff(at[1:]))[0, 1] + 0.5) < 0.05  # as of independent places


def test_epochs_do_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.col("id").alias("k"))
    a, b = (splits.epoch_orders(df.repartition(p), ["k"], [0, 1], seed=5).collect() for p in (1, 7))
    places = lambda rows: {(r.k, r.epoch): r.epoch_pos for r in rows}
    assert places(a) == places(b) and len(a) == 600
    assert [r.epoch_pos for r in a if r.epoch == 0] != [r.epoch_pos for r in a if r.epoch == 1]
    assert splits.epoch_orders(df.limit(0), ["k"], [0]).collect() == []


def test_shards_read_back_any_range(spark, tmp_path):
    df = spark.range(1003).select((F.col("id") * 3 % 1003).alias("k"), F.col("id").cast("string").alias("v")).repartition(5)
    path = f"{tmp_path}/s"
    shards.write_shards(df, ["k"], path, rows_per_shard=100)
    index = shards.shard_index(spark, path).orderBy("shard").collect()
    assert [(r.shard, r.first_row, r.rows) for r in index] == [(i, 100 * i, min(100, 1003 - 100 * i)) for i in range(11)]
    part = shards.read_rows(spark, path, 250, 420)
    assert sorted((r.k, r.row) for r in part.collect()) == [(i, i) for i in range(250, 420)]
    assert len(part.inputFiles()) == 3
    b = shards.read_batches(spark, path, 8, first_batch=120)
    assert sorted((r.k, r.batch_id) for r in b.collect()) == [(i, i // 8) for i in range(960, 1000)]
    assert len(b.inputFiles()) == 1
    assert shards.read_batches(spark, path, 8, 3, 2).count() == 16
    beyond = shards.read_batches(spark, path, 8, first_batch=500)
    assert beyond.collect() == [] and set(beyond.columns) == {"k", "v", "row", "batch_id"}


def test_shards_of_nothing_and_clashes(spark, tmp_path):
    shards.write_shards(spark.range(0), ["id"], f"{tmp_path}/e")
    assert shards.read_batches(spark, f"{tmp_path}/e", 4).collect() == []
    with pytest.raises(ValueError):
        shards.write_shards(spark.range(3).withColumnRenamed("id", "Row"), ["Row"], f"{tmp_path}/c")


def make_fails_on(bad, log):
    def make():
        def predict(text):
            if bad in set(text):
                raise RuntimeError("killed")
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in text)
            return np.array([f"x [/INST] {t}!" for t in text], dtype=object)

        return predict

    return make


def test_killed_inference_goes_on(spark, tmp_path):
    df = spark.range(200).select("id", F.concat(F.lit("t"), F.col("id")).alias("text"))
    kw = dict(key=["id"], path=f"{tmp_path}/run", groups=10, groups_at_once=2)
    bad = [r.text for r in df.where(F.pmod(F.xxhash64("id"), F.lit(10)) == 7).collect()][0]  # in the fourth round
    log = f"{tmp_path}/log"
    with pytest.raises(Exception, match="killed"):
        inference.predict_resumable(df, make_fails_on(bad, log), ["text"], **kw)
    before = open(log).read().split()
    committed = {r.row_group for r in spark.read.parquet(f"{tmp_path}/run/commits").collect()}
    assert committed == set(range(6))
    out = inference.predict_resumable(df, make_fails_on("none", log), ["text"], **kw)
    again = inference.predict_resumable(df, make_fails_on("t1", log), ["text"], **kw)  # nothing is left to score
    for o in (out, again):
        assert sorted((r.id, r.prediction) for r in o.collect()) == [(i, f"t{i}!") for i in range(200)]
    rescored = open(log).read().split()[len(before) :]
    kept = {r.text for r in df.where(F.pmod(F.xxhash64("id"), F.lit(10)) < 6).collect()}
    assert not kept & set(rescored) and len(rescored) == len(set(rescored)) == 200 - len(kept)


def test_resumable_inference_on_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id long, text string")
    out = inference.predict_resumable(df, make_fails_on("a", f"{tmp_path}/l"), ["text"], ["id"], f"{tmp_path}/r", groups=4)
    assert out.collect() == [] and out.columns == ["id", "text", "prediction"]
