import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tunedata.llm import simhash
from tunedata.llm.common import components, grouped


def brute_fp(text, shingle=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "")) if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    sh = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps, radius=2):
    comp = {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if i < j and (a ^ b).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", "a", "A b", "a b c", "ÀB c d e\x0bf É", "x " * 1000, "one two three four one two three"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fp(text)


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(260):
        words = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.choice([0, 1, 2, 5, 60, 300]))]
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:  # a copy, or one with few words changed
            for _ in range(rng.randrange(3)):
                if words:
                    words[rng.randrange(len(words))] = "zz"
            rows.append((1000 + i, " ".join(words)))
    rows += [(5000, None), (5001, "   "), (5002, "dup"), (5002, "dup")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, component_id string")
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows)
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in got}
    assert fps == {i: brute_fp(t) for i, t in rows}
    want = brute_components(list(fps), list(fps.values()))
    assert {r.doc_id: r.component_id for r in got} == want
    kept = [r.doc_id for r in simhash.deduplicated(docs).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_pieces_and_dense_groups(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 6)
    fps = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (60, 2))} | {0, -1})
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    want = brute_components(range(len(fps)), [f & (1 << 64) - 1 for f in fps])
    for rows in (7, 1 << 15):
        got = {r.node: r.component for r in components(simhash.links(classes, tile_rows=rows)).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_grouped(spark):
    import pyarrow as pa

    keys = sorted(random.Random(1).choices(range(30), k=200))
    table = pa.table({"k": keys, "v": list(range(200))})
    got = {int(g["k"][0]): len(g["v"]) for g in grouped(iter(table.to_batches(max_chunksize=7)), ["k"])}
    assert got == Counter(keys)


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (None, "a b c d"), (None, "x y z w"), (None, "x y z w"), (2, "q")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in simhash.deduplicated(docs).collect())
    assert got == [("1", "a b c d"), ("2", "q"), ("None", "x y z w")]


def test_near_copies_without_an_id_and_texts_that_share_one(spark):
    """Rows without an id link within the radius like others, and a repeated id loses no text."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(999)}" for _ in range(3000)]
    near = next(  # a copy with one word changed, at one or two bits
        t for k in range(len(words)) for t in [" ".join([*words[:k], "zz", *words[k + 1 :]])] if 1 <= (brute_fp(t) ^ brute_fp(" ".join(words))).bit_count() <= 2
    )
    text, other = " ".join(words), "some text of its own altogether"
    only = spark.createDataFrame([(None, text), (None, near), (None, other)], "doc_id long, text string")
    assert sorted(r.text == other for r in simhash.deduplicated(only).collect()) == [False, True]
    beside = spark.createDataFrame([(4, text), (None, near), (3, other), (3, "a second text of id three")], "doc_id long, text string")
    assert sorted(r.component_id for r in simhash.simhash_components(beside).collect()) == [3, 3, 4, 4]
    got = {(r.doc_id, r.text) for r in simhash.deduplicated(beside).collect()}
    assert got == {(4, text), (3, other), (3, "a second text of id three")}


def test_a_column_of_the_same_name_is_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "y"), (3, "other words here now", "z")], "doc_id long, text string, simhash_key string")
    assert sorted((r.doc_id, r.simhash_key) for r in simhash.deduplicated(docs).collect()) == [(1, "x"), (3, "z")]
