import random

import numpy as np

from tunedata.llm import suffix_dedup as S


def brute(rows):
    """{(id, text): removed positions} by looking at every 50-byte string."""
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), S.NO_ID if i is None else i
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], i), i)
    out = {}
    for i, t in rows:
        b, k = (t or "").encode(), S.NO_ID if i is None else i
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < k:
                gone[s : s + 50] = True
        out[i, t] = gone
    return out


def corpus(seed, n, hot=False):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "é", "an", "re"]) for _ in range(rng.randrange(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randrange(8, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = text(rng.choice([0, 3, 20, 60]))
        for _ in range(rng.randrange(3)):
            t += rng.choice([" ", "\n", ""]) + rng.choice(passages) + " " + text(rng.randrange(12))
        if hot and i % 3 == 0:
            t = text(3) + " the very same passage of more than fifty bytes is in a third of all " + text(3)
        rows.append((rng.randrange(10**6), t))
        if rng.random() < 0.3 and t:
            cut = rng.randrange(len(t))
            rows.append((rng.randrange(10**6), t[:cut] + rng.choice(["", "x", "yy"]) + t[cut:]))
    rows += [(5, "ab" * 300), (3, "ab" * 200 + "c"), (4, "a" * 49), (2, "a" * 50), (9, "a" * 51), (8, None), (7, ""), (1, "a" * 2000)]
    return rows


def check(spark, rows, parts=5, **kw):
    docs = spark.createDataFrame([(i, t, 1, 2, "p") for i, t in rows], "doc_id long, text string, th int, k int, pos string").repartition(parts)
    got = S.remove_repeats(docs, **kw).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.n_bytes), []).append(r)
    for (i, t), gone in want.items():
        b = np.frombuffer((t or "").encode(), np.uint8)
        kept = b[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
        assert any((bytes(r.kept), r.n_removed, r.n_spans) == (kept, gone.sum(), runs) for r in have[i, len(b)]), (i, t)


def test_anchors_cover_every_window():
    rng = np.random.default_rng(1)
    for n in (10, 49, 50, 51, 300, 5000):
        for kinds in (2, 200):
            x = rng.integers(0, kinds, n).astype(np.uint8)
            p, _ = S.anchors(x)
            assert len(set(p.tolist())) == len(p)
            if n >= 50:
                hit = np.zeros(n, bool)
                hit[p] = True
                assert all(hit[s : s + S.SPAN].any() for s in range(n - 49))
            # equal strings hold the same anchors, wherever they are and however they are cut up
            if n == 300:
                y = np.concatenate([rng.integers(0, 250, S.PIECE - 130).astype(np.uint8), x])
                q = S.anchors(y)[0] - (S.PIECE - 130)
                inner = set(p[(p >= S.SPAN) & (p < n - S.LENGTH)].tolist())
                assert inner == {v for v in q.tolist() if S.SPAN <= v < n - S.LENGTH}


def test_multikey_order():
    x = np.random.default_rng(0).integers(0, 3, (500, 5)).astype(np.uint64)
    assert x[S.multikey_order(x)].tolist() == sorted(x.tolist())


def test_equals_brute_force(spark):
    check(spark, corpus(1, 120))


def test_hot_anchors_are_cut_up(spark):
    check(spark, corpus(2, 90, hot=True), hot_least=2)


def test_buckets_grow_with_the_text(spark):
    """Far more buckets than shuffle partitions (and than a slice fills) change nothing."""
    check(spark, corpus(3, 60, hot=True), hot_least=2, bucket_bytes=400)


def test_nulls_ties_and_repeats(spark):
    long = "some words that are long enough to be found again elsewhere, surely so"
    check(spark, [(1, long), (1, long), (1, "x" + long), (None, long), (None, "q " + long), (2, long + "é"), (3, "é" * 60), (4, "é" * 60)], parts=3)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
