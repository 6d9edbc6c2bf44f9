import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tunedata.llm import packing

ODD = [
    "", None, " ", "don't it's 'sx 's", "a<|endoftext|>b <|startoftext|> x<|endoftext|>!", "É é%%% İ%%% İx ΑΣ ΑΣ. ﬁ",
    "abc123 a1b2 ... ,,,abc abc,,,abc 12 ½ x² ²", "tab\tnl\nvt\x0bff\x0ccr\r\x1c\x1f\x85\xa0nbsp　z", "日本語 テキスト。 é́%%",
    "HELLO,WORLD! a_b `q` ~~ A<B>C x=1;y", "́abc ́%%% á á%%", "😀😀abc😀", "''' 's's 'll x'll X'LL", "﻿​word​",
]


TOKENIZER = Tokenizer.from_file(packing.tokenizer_path())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def test_chunk_encoder_equals_tokenizer():
    enc = packing.ChunkEncoder(packing.tokenizer_path())
    rng = random.Random(5)
    alphabet = "abcXYZ'.,!%<|>éÉßÑñüÜçÇŒœǅﬀ́İΣς12½ \n\t日語_-&;😀Ⅷª"
    texts = [t for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)]
    for t in texts:
        assert enc((t or "").encode()).tolist() + [1] == ids_of(t), repr(t)


def check(rows, texts, size):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.length > 0 and r.length * 4 == len(r.ids)
    want = {i: ids_of(t) for i, t in texts}
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        got, at = [], 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[i])
            got += np.frombuffer(p.ids, "<u4").tolist()
            at += p.length
        assert got == want[i]
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return by_seq


def test_pack(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "x%%"]) for _ in range(int(rng.paretovariate(0.8) * 5) % 900))) for i in range(400)]
    texts += [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in texts], "doc_id long, text string, start int, ids string").repartition(70)
    rows = packing.pack(docs, size=64, open_windows=4).collect()
    seqs = check(rows, texts, 64)
    short = sum(sum(p.length for p in ps) < 64 for ps in seqs.values())
    assert short <= 4
    out = packing.sequences(spark.createDataFrame(rows), 64).collect()
    assert len(out) == len(seqs)
    for r in out:
        ps = sorted(seqs[r.sequence_id], key=lambda p: p.offset)
        flat = [x for p in ps for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert r.input_ids == flat + [0] * (64 - len(flat)) and r.doc_ids == [p.doc_id for p in ps]


def test_empty_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.length) for r in packing.pack(docs).collect()) == [("7", 3), ("7", 3), ("None", 2)]


def test_best_fit_emits_fullest():
    p = packing.Packer(10, 2)
    x = lambda n: np.zeros(n, np.uint32)
    assert list(p.add(1, 0, 7, x(7))) == [] and list(p.add(2, 0, 6, x(6))) == []
    (w,) = p.add(3, 0, 3, x(3))  # fits both; the first best
    assert [q[0] for q in w] == [1, 3]
    list(p.add(4, 0, 8, x(8)))
    (w,) = p.add(5, 0, 9, x(9))  # none fits: the fullest goes, filled up
    assert [(q[0], len(q[3])) for q in w] == [(4, 8), (5, 2)]
    assert sum(len(q[3]) for w in p.rest() for q in w) == 6 + 7


def test_crc_is_unsigned_little_endian(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    r = packing.pack(docs).selectExpr("crc32(ids) c").first()
    assert r.c == zlib.crc32(np.array(ids_of("some words here"), "<u4").tobytes())


def test_memory_of_words_is_no_work_for_the_collector():
    import gc

    enc = packing.ChunkEncoder(packing.tokenizer_path())
    for t in ("alpha beta, gamma. x%%", "É éà ab1 don't"):
        enc(t.encode())
    gc.collect()
    assert enc.parts and not any(map(gc.is_tracked, enc.parts.values()))
