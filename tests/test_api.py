"""Sinks, counters, training-table guard and single-system inference."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunedata.operators import inference, sft, stats
from tunedata.sources import jsonl


def test_observation_and_noop(spark):
    df = spark.range(25)
    observed, obs = stats.with_metrics(df, "n", n_rows=F.count(F.lit(1)), total=F.sum("id"))
    jsonl.write_noop(observed)
    assert obs.get == {"n_rows": 25, "total": 300}


def test_jsonl_skips_blank_lines_and_keeps_extra_fields(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"src": "a", "tgt": "b", "lang": "it-IT", "x": 1}\n\n   \n{"src": "è", "tgt": "c\\nd"}\n', encoding="utf-8")
    df = jsonl.read_jsonl(spark, str(p), "src string, tgt string, lang string, x int")
    rows = df.collect()
    assert len(rows) == 2 and rows[1].src == "è" and rows[1].tgt == "c\nd" and rows[1].lang is None
    out = tmp_path / "out"
    jsonl.write_jsonl(df, str(out), ascii=True)
    lines = [line for f in out.glob("part-*") for line in f.read_text(encoding="ascii").splitlines()]
    assert sorted(json.loads(x)["src"] for x in lines) == ["a", "è"]
    assert all(x.isascii() for x in lines)


def test_training_table_rejects_wrong_length(spark, tmp_path):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3], "train")], "input_ids array<int>, labels array<int>, split string")
    sft.to_training_table(df, str(tmp_path / "ok"), 3)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1
    with pytest.raises(Exception):
        sft.to_training_table(df, str(tmp_path / "bad"), 4)


def test_predict_single_system(spark):
    def make_upper():  # local, so it is pickled by value for the Python workers
        def predict(prompt):
            return np.array([f"{p} [/INST]  {p.upper()} " for p in prompt], dtype=object)

        return predict

    df = spark.createDataFrame([("ab",), ("cd",)], "q string")
    got = inference.predict(df, make_upper, ["q"], batch_size=1).orderBy("q").collect()
    assert [(r.q, r.prediction) for r in got] == [("ab", "AB"), ("cd", "CD")]
    raw = inference.predict(df, make_upper, ["q"], reply_only=False).orderBy("q").first()
    assert raw.prediction == "ab [/INST]  AB "


def test_max_abs_delta_and_diff(spark):
    a = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 2.0])], "k int, v array<double>")
    b = spark.createDataFrame([(1, [0.5, -1.0]), (2, [2.0, 2.0])], "k int, v array<double>")
    assert {r.k: r.max_abs_delta for r in inference.max_abs_delta(a, b, ["k"], "v").collect()} == {1: 2.0, 2: 0.0}
    pa = spark.createDataFrame([(1, "x"), (2, "y")], "k int, prediction string")
    pb = spark.createDataFrame([(1, "x"), (2, "z")], "k int, prediction string")
    r = inference.diff_predictions(pa, pb, ["k"]).first()
    assert (r.n_rows, r.n_diff) == (2, 1)


def test_ascii_sink_matches_json_dumps_escapes(spark, tmp_path):
    text = "caffè 😀   \"q\"\n"
    df = spark.createDataFrame([(text,)], "t string")
    out = tmp_path / "a"
    jsonl.write_jsonl(df, str(out), ascii=True)
    line = [x for f in out.glob("part-*") for x in f.read_text(encoding="ascii").splitlines() if x][0]
    assert json.loads(line)["t"] == text
    assert "\\ud83d\\ude00" in line and "\\u00e8" in line
    assert json.loads(line) == json.loads(json.dumps({"t": text}))


def test_predict_systems_makes_strings_of_few_rows_at_a_time(spark):
    import tracemalloc

    import pyarrow as pa

    def make_label():
        return lambda q, k: np.array([f"{'null' if x is None else x[:3]}:{n}" for x, n in zip(q, k)], dtype=object)

    batch = (pa.array(["x" * 4000] * 5000), pa.array(range(5000)))  # 20 MB
    tracemalloc.start()
    out = [a.to_pylist() for a in inference._answers([make_label, make_label], 64)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(out, []) == [[f"xxx:{i}"] * 2 for i in range(5000)] and peak < 8 << 20

    df = spark.range(0, 50, 1, 1).select("id", F.when(F.col("id") != 3, F.concat(F.lit("q"), "id")).alias("q"))
    for n in (50, 0):
        rows = inference.predict_systems(df.where(F.col("id") < n), {"a": make_label, "b": make_label}, ["q", "id"], batch_size=4).collect()
        want = [(i, s, f"{f'q{i}'[:3] if i != 3 else 'null'}:{i}") for i in range(n) for s in "ab"]
        assert sorted((r.id, r.system, r.prediction) for r in rows) == want
