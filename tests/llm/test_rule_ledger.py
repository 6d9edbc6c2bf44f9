import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tunedata.llm import rule_ledger as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    upper = sum(bool(re.search("[A-Z]", x)) and not re.search("[a-z]", x) for x in w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines), w.count("|"), upper)


def texts():
    rng = random.Random(4)
    words = ["a", "É", "bb", "CC", "|", "d%%", "日本", "x y", "<<>>"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 50, 400]))) for _ in range(60)]
    out += ["\n".join(rng.choice(["l one", "l two", " ", "", "l one "]) for _ in range(30)), "a\r\nb\x0bc\x0cd\te", "abc " * 5000, "", None, "\n\n", "q w e q w e"]
    return out


def test_measures_equal_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "null id"), (3, texts()[3])]
    docs = spark.createDataFrame([(i, t, 5, True) for i, t in rows], "doc_id long, text string, n_words int, kept boolean")
    got = sorted((str(r.doc_id), *(r[m] for m in R.MEASURES)) for r in R.ledger(docs).collect())
    assert got == sorted((str(i), *brute(t)) for i, t in rows)


def test_masks_policies_and_ablations(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    led = R.ledger(docs).cache()
    for bit, (name, cond) in enumerate(R.RULES.items()):
        assert led.where(f"({cond}) <> ((failed & {1 << bit}L) <> 0)").count() == 0, name
    for version in R.POLICIES:
        kept = {r.doc_id for r in R.apply_policy(led, version).where("kept").collect()}
        failing = " OR ".join(f"({R.RULES[r]})" for r in R.POLICIES[version])
        assert kept == {r.doc_id for r in led.where(f"NOT ({failing})").collect()}
        for r in R.ablations(led, version).collect():
            rest = " OR ".join(f"({R.RULES[x]})" for x in R.POLICIES[version] if x != r.rule) or "false"
            assert r.failed == led.where(R.RULES[r.rule]).count()
            assert r.kept_without == led.where(f"NOT ({rest})").count()
            assert r.failed_alone == r.kept_without - len(kept)


def test_query_and_empty(spark):
    assert R.ledger(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    sf = "/root/testdata/sf0.001"
    got = R.op10_rule_ledger(spark, sf)
    assert got.where("base_failed AND kept").count() == 0
    good = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 AND NOT base_failed")
    assert good.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.98
