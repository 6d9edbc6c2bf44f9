import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tunedata.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, inside=50, most=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        longer = Counter()
        for p, v in cand.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longer[p[s : s + m]] = max(longer[p[s : s + m]], v)
        got = []
        for p, a in cand.items():
            if longer[p] and 100 * longer[p] >= inside * a:
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(got)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert len(want) > 100
    assert result(C.op12_collocations(spark, sf)) == want


@pytest.mark.parametrize("longest", [2, 4])
def test_other_lengths_and_top(spark, longest):
    rows = [("en", "a b c d e. a b c d\tx, A B é c!! a b") for _ in range(6)] + [(None, "q q q q q q q q"), ("und", "q q q"), ("en", None), ("de", ""), ("de", " . ")]
    docs = spark.createDataFrame([(t, l, 1, "n") for l, t in rows], "text string, lang string, n int, phrase string").repartition(5)
    got = C.top(C.collocations(docs, longest=longest, least=3, inside=90), 4)
    assert result(got) == brute(rows, longest, 3, 90, 4)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(C, "SLICE", 7)
    text = b"ab cd ef gh ij kl mn op qr st uv wx yz ab cd ef. ab cd ef, " * 3
    want = Counter()
    for piece in re.split(rb"[.,]", text) + [b"zz"]:
        w = piece.split()
        want.update((tuple(w[i : i + 3]) + (b"", b""))[:3] for i in range(len(w)))
    for limit in (1, 5, 17, 10**6):
        counter, groups = C.WindowCounter(3, 4, limit), {}
        for b in [*counter.add("x", text), *counter.add("x", b"zz"), *counter.flush()]:
            for r in b.to_pylist():
                groups.setdefault(r["part"], C.Group(3, 1, limit)).add(r["names"], r["codes"], r["n"])
        got = Counter()
        for g in groups.values():
            for b in g.rows("x"):
                for r in b.to_pylist():
                    got[r["w1"], r["w2"], r["w3"]] += r["n"]
        assert got == want


def test_unique_rows():
    rng = np.random.default_rng(0)
    cols, n = [rng.integers(0, 4, 200) for _ in range(3)], rng.integers(1, 9, 200)
    want = Counter()
    for *key, v in zip(*cols, n):
        want[tuple(key)] += v
    for base in (4, 1 << 40):
        got, total = C.unique_rows(cols, n, base)
        assert list(zip(*(c.tolist() for c in got))) == sorted(want) and total.tolist() == [want[k] for k in sorted(want)]
    assert len(C.unique_rows([c[:0] for c in cols], n[:0], 4)[1]) == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert C.top(C.collocations(docs)).collect() == []


def test_products_past_64_bits(spark, monkeypatch):
    big = 4_000_000_000
    p = [("x", 0, [], "", 10 * big), *(("x", 1, [w], w, 2 * big) for w in "ab"), ("x", 2, ["a", "b"], "a b", big)]
    monkeypatch.setattr(C, "phrases", lambda *a, **k: spark.createDataFrame(p, "lang string, k int, words array<string>, phrase string, f bigint"))
    (r,) = C.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    assert (r.a, r.l, r.r, r.score) == (big, 2 * big, 2 * big, 250_000)
