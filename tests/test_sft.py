"""Padding, masks and the label modes (fixture: L = 8, pad = eos = 2, prompt length 3)."""

from pyspark.sql import functions as F

from tunedata.operators import sft

IDS = [1, 5, 6, 7, 8, 2]


def one(spark, expr):
    df = spark.createDataFrame([(IDS, [7, 8, 2], [])], "ids array<int>, comp array<int>, empty array<int>")
    return df.select(expr.alias("x")).first().x


def test_shapes(spark):
    ids = F.col("ids")
    assert one(spark, sft.pad(ids, 8)) == [1, 5, 6, 7, 8, 2, 2, 2]
    assert one(spark, sft.attention(ids, 8)) == [1, 1, 1, 1, 1, 1, 0, 0]
    assert one(spark, sft.pad(ids, 4)) == [1, 5, 6, 7]
    padded = sft.pad(ids, 8)
    assert one(spark, sft.mask_prefix(padded, F.lit(3))) == [-100, -100, -100, 7, 8, 2, 2, 2]
    assert one(spark, sft.mask_value(padded, 2)) == [1, 5, 6, 7, 8, -100, -100, -100]
    intended = F.zip_with(sft.mask_prefix(padded, F.lit(3)), sft.attention(ids, 8), lambda x, m: F.when(m == 1, x).otherwise(-100))
    assert one(spark, intended) == [-100, -100, -100, 7, 8, 2, -100, -100]
    assert one(spark, sft.mask_value(sft.pad(F.col("comp"), 8), 2)) == [7, 8, -100, -100, -100, -100, -100, -100]
    assert one(spark, sft.pad(F.col("comp"), 8, -100)) == [7, 8, 2, -100, -100, -100, -100, -100]
    assert one(spark, sft.pad(F.array(F.lit(2)), 8, -100)) == [2] + [-100] * 7


def py_tokens(text):
    import regex

    return regex.findall(r"</?s>|\[/?INST\]|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", text)


def test_label_modes_against_python(spark):
    rows = [("p one two", "c three"), ("a prompt that is much longer than the limit of tokens", "x"), ("q", "")]
    df = spark.createDataFrame(rows, "prompt string, completion string").withColumn("id", F.monotonically_increasing_id())
    chat = sft.chat_template(df)
    vocab = sft.build_vocab(chat, ["full_text"], 12)
    table = {r.token: r.id for r in vocab.collect()}
    enc = sft.encoder(vocab, 12)

    def e(text, bos=True):
        ids = [table.get(t, 0) for t in py_tokens(text)]
        return ([1] if bos else []) + ids

    L = 8
    for mode in sft.LABEL_MODES:
        got = sft.tokenize_sft(df, enc, mode, L, keep=["prompt", "completion"]).collect()
        for r in got:
            p, c = r.prompt, r.completion
            user, full = f"<s>[INST] {p} [/INST]", f"<s>[INST] {p} [/INST] {c}</s>"
            if mode in ("prompt_masked", "prompt_masked_bos", "collated", "intended"):
                ids = e(full)[:L]
                ids = ids + [2] * (L - len(ids))
                u = min(len(e(user, mode in ("prompt_masked_bos", "intended"))), L)
                if mode == "collated":
                    lab = [-100 if x == 2 else x for x in ids]
                elif mode == "intended":
                    n = min(len(e(full)), L)
                    lab = [-100 if i < u or i >= n else x for i, x in enumerate(ids)]
                else:
                    lab = [-100] * u + ids[u:]
                assert r.input_ids == ids and r.labels == lab, (mode, p)
            elif mode == "seq2seq":
                pi, ci = e(p)[:L], e(c)[:L]
                assert r.input_ids == pi + [2] * (L - len(pi))
                assert r.labels == [-100 if x == 2 else x for x in ci + [2] * (L - len(ci))]
            else:
                pi = e(p) if p else [2]
                ci = e(c) if c else [2]
                assert r.input_ids == pi[:L] + [2] * (L - len(pi[:L]))
                assert r.labels == ci[:L] + [-100] * (L - len(ci[:L]))


def test_validate_and_vocab_size(spark):
    df = spark.createDataFrame([([1, 2], [1, None]), ([1, 2, 3], [1, 2, 3])], "input_ids array<int>, labels array<int>")
    r = sft.validate_tokens(df, 2).first()
    assert (r.n_rows, r.n_null, r.n_bad_length) == (2, 1, 1)
    docs = spark.createDataFrame([("a a a b b c d",)], "text string")
    v = sft.build_vocab(docs, ["text"], 5).orderBy("id").collect()
    assert [(x.token, x.id) for x in v] == [("<unk>", 0), ("<s>", 1), ("</s>", 2), ("a", 3), ("b", 4)]


def test_every_token_has_an_id(spark):
    """No token of the corpus becomes <unk>, and ids and order survive any split into hot and rare."""
    texts = [" ".join(f"w{j}" for j in range(i, i + 40)) + " the the" for i in range(0, 4000, 8)] + ["", None, "the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    numbered = sft.number_tokens(docs, ["text"])
    table = {r.token: r.id for r in numbered.collect()}
    assert sorted(table.values()) == list(range(len(table))) and len(table) > 4000 and table["the"] == 3
    want = {k: [table[t] for t in py_tokens(x or "")] for k, x in enumerate(texts)}
    for hot in (0, 5, 100_000):
        got = sft.encode_all(docs, {"ids": sft.word_tokens("text")}, numbered, hot=hot).collect()
        assert {r.k: r.ids for r in got} == want and sft.UNK_ID not in {i for r in got for i in r.ids}


def test_coded_words_equal_the_join(spark):
    """The same ids for any size of the dictionaries; a dictionary has each word once, whatever its share."""
    texts = ["the the the the", "", None, "a the b a", "unseen the"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    numbered = sft.number_tokens(docs.where("text <> 'unseen the'"), ["text"])
    tokens = {"ids": sft.word_tokens("text"), "twice": F.slice(sft.word_tokens("text"), 1, 2)}
    want = sorted(map(tuple, sft.encode_all(docs, tokens, numbered).collect()), key=str)
    assert any(sft.UNK_ID in r[2] for r in want)
    for limit in (1, 7, 10**6):
        assert sorted(map(tuple, sft.encode_words(docs, tokens, numbered, limit=limit).collect()), key=str) == want
    assert sft.encode_words(docs.limit(0), tokens, numbered).collect() == []
    coded = docs.select(F.col("k").cast("long").alias("__row"), sft.word_tokens("text").alias("t")).coalesce(1)
    packs = coded.mapInArrow(sft._code(["t"], 10**6), "chunk bigint, rows binary, sizes binary, codes binary, words array<string>").collect()
    assert sum(len(p.words) for p in packs) == 4 and sum(len(p.codes) for p in packs) == 4 * 40 * (4 + 4 + 2)
