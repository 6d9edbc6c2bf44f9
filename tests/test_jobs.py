"""The file-to-file jobs end to end on TMX files written to a temporary folder."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunedata.plans import jobs
from test_tmx import CASES, document


def _lines(folder):
    return [json.loads(x) for f in sorted(folder.rglob("part-*")) for x in f.read_text(encoding="utf-8").splitlines() if x.strip()]


def test_jobs_chain(spark, tmp_path):
    tmx = tmp_path / "tmx"
    tmx.mkdir()
    good = [u for name, units in CASES if name != "malformed" for u in units]
    (tmx / "a.tmx").write_bytes(document(good * 3).encode("utf-16-le"))
    (tmx / "b.tmx").write_bytes(document(CASES[-1][1] + CASES[0][1]).encode("utf-16-le"))

    jobs.tmx_to_sft(spark, str(tmx), str(tmp_path / "sft"))
    sft = _lines(tmp_path / "sft")
    assert {"prompt", "completion", "path", "tu_idx", "lang_pos"} <= set(sft[0])
    assert any(r["prompt"] == "Translate the following English text to IT: 'European Parliament'" for r in sft)

    jobs.tmx_to_validation_set(spark, str(tmx), str(tmp_path / "val"), max_tus=20)
    val = _lines(tmp_path / "val")
    assert all(r["path"].endswith("a.tmx") for r in val)  # the file with a malformed unit gives nothing
    assert {"src", "tgt", "lang"} <= set(val[0])

    jobs.fix_lang_codes(spark, str(tmp_path / "val"), str(tmp_path / "val2"))
    assert {r["lang"] for r in _lines(tmp_path / "val2")} <= {"IT", "GA", "FR", "DE", ""}

    jobs.split_dataset(spark, str(tmp_path / "sft"), str(tmp_path / "train"), str(tmp_path / "valid"), seed=1)
    n_train, n_valid = len(_lines(tmp_path / "train")), len(_lines(tmp_path / "valid"))
    assert n_train == int(0.8 * len(sft)) and n_train + n_valid == len(sft)

    jobs.flatten_dataset(spark, str(tmp_path / "train"), str(tmp_path / "flat"))
    assert all(" Output: " in r["text"] for r in _lines(tmp_path / "flat"))

    jobs.tokenise_dataset(spark, str(tmp_path / "sft"), str(tmp_path / "tok"), max_length=16, vocab_size=40)
    tok = spark.read.parquet(str(tmp_path / "tok"))
    assert tok.where(F.size("input_ids") != 16).count() == 0
    assert {r.split for r in tok.select("split").distinct().collect()} == {"train", "valid"}

    def make_echo():
        def predict(prompt, src, tgt):
            return np.array([f"{p} {s}" for p, s in zip(prompt, src)], dtype=object)

        return predict

    scores = jobs.evaluate(spark, str(tmp_path / "val2"), {"echo": make_echo}, str(tmp_path / "eval"), by_lang=False)
    assert scores.count() == 1
    assert (tmp_path / "eval" / "predictions").exists()


def test_cli(spark, tmp_path):
    from tunedata.__main__ import main

    tmx = tmp_path / "tmx"
    tmx.mkdir()
    (tmx / "a.tmx").write_bytes(document(CASES[0][1] * 10).encode("utf-16-le"))
    assert main(["tmx-to-sft", str(tmx), str(tmp_path / "sft")]) == 0
    assert main(["split", str(tmp_path / "sft"), str(tmp_path / "train"), str(tmp_path / "valid")]) == 0
    assert (len(_lines(tmp_path / "train")), len(_lines(tmp_path / "valid"))) == (8, 2)
    assert main(["tmx-to-validation", str(tmx), str(tmp_path / "val"), "3"]) == 0
    assert len(_lines(tmp_path / "val")) == 3
    assert main(["unknown"]) == 2


def test_jobs_on_plain_files(spark, tmp_path):
    """Files without order columns, with a field of their own, a blank line, and a malformed line."""
    rows = [{"prompt": f"p{i}", "completion": f"c{i}", "note": {"n": i}} for i in range(50)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n  \n")
    jobs.split_dataset(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "train"), str(tmp_path / "valid"), seed=3)
    train, valid = _lines(tmp_path / "train"), _lines(tmp_path / "valid")
    assert len(train) == 40 and len(valid) == 10
    assert sorted(map(str, train + valid)) == sorted(str({k: r[k] for k in sorted(r)}) for r in rows)
    assert {r["prompt"] for r in valid} != {f"p{i}" for i in range(40, 50)}  # shuffled
    jobs.tokenise_dataset(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "tok"), max_length=8, vocab_size=60)
    assert spark.read.parquet(str(tmp_path / "tok")).groupBy("split").count().collect() != []

    ev = [{"src": "a", "tgt": "b", "lang": "it-IT", "id": 7}, {"src": "c", "tgt": "d", "id": 8}]
    (tmp_path / "ev.jsonl").write_text("\n".join(map(json.dumps, ev)))
    jobs.fix_lang_codes(spark, str(tmp_path / "ev.jsonl"), str(tmp_path / "ev2"))
    assert sorted((r["id"], r["lang"]) for r in _lines(tmp_path / "ev2")) == [(7, "IT"), (8, "")]

    from tunedata.sources.jsonl import read_jsonl, read_jsonl_quarantine

    (tmp_path / "bad.jsonl").write_text('{"src": "a"}\nnot json\n\n{"src": "b"}\n')
    with pytest.raises(Exception):
        read_jsonl(spark, str(tmp_path / "bad.jsonl"), "src string").collect()
    good, bad = read_jsonl_quarantine(spark, str(tmp_path / "bad.jsonl"), "src string")
    assert sorted(r.src for r in good.collect()) == ["a", "b"] and [r.record for r in bad.collect()] == ["not json"]


def test_lang_codes_keep_fields_of_any_type(spark, tmp_path):
    rows = [{"lang": "it-IT", "id": 7, "x": 1}, {"x": {"a": [1, None, {"b": "\u00fc\""}]}, "lang": None}, {"x": "s", "lang": {"no": "text"}, "z": 1.5},
            {"x": None, "big": 12345678901234567890, "e": 1e300, "t": True}]
    (tmp_path / "m.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n  \n")
    jobs.fix_lang_codes(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "out"))
    want = [r | {"lang": "IT" if r.get("lang") == "it-IT" else ""} for r in rows]
    order = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(_lines(tmp_path / "out"), key=order) == sorted(want, key=order)
    for bad in ("not json", "[1]", '{"a":1,"a":2}'):
        (tmp_path / "bad.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception):
            jobs.fix_lang_codes(spark, str(tmp_path / "bad.jsonl"), str(tmp_path / "bad-out"))
