"""Corpus BLEU against a Counter implementation written from the metric's definition."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tunedata.operators import metrics
from test_text import py_13a


def py_bleu(hyps, refs_list):
    """refs_list[i] is the list of references of segment i."""
    correct, total = [0] * 4, [0] * 4
    sys_len = ref_len = 0
    for h, refs in zip(hyps, refs_list):
        ht = py_13a(h)
        rts = [py_13a(r) for r in refs]
        sys_len += len(ht)
        lens = [len(r) for r in rts]
        ref_len += min(lens, key=lambda x: (abs(x - len(ht)), x))
        for n in range(1, 5):
            hc = Counter(tuple(ht[i:i + n]) for i in range(len(ht) - n + 1))
            best = Counter()
            for r in rts:
                for g, v in Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1)).items():
                    best[g] = max(best[g], v)
            correct[n - 1] += sum(min(v, best[g]) for g, v in hc.items())
            total[n - 1] += max(0, len(ht) - n + 1)
    bp = 1.0 if sys_len >= ref_len else (math.exp(1 - ref_len / sys_len) if sys_len > 0 else 0.0)
    if not any(correct):
        return 0.0
    p, smooth = [0.0] * 4, 1.0
    for n in range(4):
        if total[n] == 0:
            break
        if correct[n] == 0:
            smooth *= 2
            p[n] = 100.0 / (smooth * total[n])
        else:
            p[n] = 100.0 * correct[n] / total[n]
    return bp * math.exp(sum(math.log(x) if x > 0 else -9999999999 for x in p) / 4)


CASES = {
    "identical": (["the cat sat on the mat"], [["the cat sat on the mat"]]),
    "no_overlap": (["a b c d e"], [["v w x y z"]]),
    "short_hyp": (["the cat sat"], [["the cat sat on the mat today"]]),
    "no_4gram": (["the cat the mat on"], [["the mat on the cat sat"]]),
    "tiny": (["a b", "c"], [["a b"], ["c"]]),
    "punct": (["It costs 1,000.5 (2024-2029) &amp; more."], [["It costs 1,000.5 ( 2024 - 2029 ) & more ."]]),
    "tie": (["one two three four five"], [["one two three four", "one two three four five six"]]),
    "clip": (["the the the the"], [["the cat the"]]),
    "corpus": (["x y z w", "the quick brown fox jumps", ""], [["x y z w q"], ["a quick brown fox jumped"], ["nothing here"]]),
}


@pytest.mark.parametrize("method", ["arrow", "relational"])
@pytest.mark.parametrize("case", sorted(CASES))
def test_bleu_cases(spark, case, method):
    hyps, refs = CASES[case]
    width = max(len(r) for r in refs)
    rows = [(i, h, [r[j] if j < len(r) else None for j in range(width)]) for i, (h, r) in enumerate(zip(hyps, refs))]
    df = spark.createDataFrame(rows, "k int, h string, refs array<string>")
    df = df.withColumn("refs", F.filter("refs", lambda x: x.isNotNull()))
    got = metrics.corpus_bleu(df, ["k"], "h", F.col("refs"), method=method).first().score
    assert got == pytest.approx(py_bleu(hyps, refs), abs=1e-9)


def test_identical_is_100_and_order_free(spark):
    rows = [(i, f"w{i} x{i} y{i} z{i} q") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, t string")
    s = metrics.corpus_bleu(df, ["k"], "t", F.array("t")).first()
    assert s.score == pytest.approx(100.0)
    s2 = metrics.corpus_bleu(df.repartition(5).orderBy(F.desc("k")), ["k"], "t", F.array("t")).first()
    assert s2.score == pytest.approx(100.0)


def test_grouped_and_compare(spark):
    rows = [("A", 0, "the cat sat on the mat", "the cat sat on the mat"), ("B", 0, "the cat", "the cat sat on the mat"),
            ("A", 1, "a b c d e", "a b c d e"), ("B", 1, "a b", "a b c d e")]
    df = spark.createDataFrame(rows, "system string, k int, h string, r string")
    scores = metrics.corpus_bleu(df, ["system", "k"], "h", F.array("r"), ["system"])
    cmp = {r.system: r for r in metrics.compare_systems(scores, "A").collect()}
    assert cmp["A"].delta == 0.0
    assert cmp["B"].score == pytest.approx(py_bleu(["the cat", "a b"], [["the cat sat on the mat"], ["a b c d e"]]))


def test_first_hypothesis_against_all_references(spark):
    rows = [(0, "the cat sat on the mat", "the cat is on the mat"), (1, "zzz", "a cat sat on the mat"), (2, "q", "the dog")]
    df = spark.createDataFrame(rows, "k int, h string, r string")
    got = metrics.bleu_first_hypothesis(df, ["k"], "h", "r").first().score
    # the scorer pairs only the first hypothesis, with every target as an alternative reference
    assert got == pytest.approx(py_bleu(["the cat sat on the mat"], [[r for _, _, r in rows]]), abs=1e-9)
    grouped = metrics.bleu_first_hypothesis(df.withColumn("s", F.lit("x")), ["k"], "h", "r", ["s"]).first().score
    assert grouped == pytest.approx(got, abs=1e-12)


def test_segments_are_counted_in_slices(monkeypatch):
    """A worker holds the arrays of a bounded number of tokens, not of a whole Arrow batch."""
    import random

    import pyarrow as pa

    rng = random.Random(4)
    text = lambda n: [rng.choice("abcd") for _ in range(n)]
    hyps = [text(rng.choice([0, 1, 3, 30])) for _ in range(60)] + [text(900)]
    refs = [[text(rng.choice([0, 2, 25])) for _ in range(rng.choice([0, 1, 3]))] for _ in range(60)] + [[text(400)] * 2]
    batch = pa.array(hyps, pa.list_(pa.string())), pa.array(refs, pa.list_(pa.list_(pa.string())))
    whole = [tuple(x.values()) for x in next(metrics._clipped_slices(iter([batch]))).to_pylist()]
    monkeypatch.setattr(metrics, "TOKENS", 200)
    # a slice of a larger batch, as Arrow hands them out
    cut = list(metrics._clipped_slices(iter([(batch[0].slice(0, 40), batch[1].slice(0, 40)), (batch[0].slice(40), batch[1].slice(40))])))
    sizes = [len(h) + sum(map(len, r)) for h, r in zip(hyps, refs)]
    at = 0
    for c in cut:
        assert len(c) == 1 or sum(sizes[at : at + len(c)]) <= 200
        at += len(c)
    assert at == len(hyps) and len(cut) > 5
    assert [tuple(x.values()) for c in cut for x in c.to_pylist()] == whole
    for h, r, (sys_len, ref_len, *clipped) in zip(hyps, refs, whole):
        assert sys_len == len(h) and ref_len == min((len(x) for x in r), key=lambda x: (abs(x - len(h)), x), default=0)
        for n, got in enumerate(clipped, 1):
            grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))  # noqa: E731, B023
            best = Counter()
            for x in r:
                best |= grams(x)
            assert got == (grams(h) & best).total()
