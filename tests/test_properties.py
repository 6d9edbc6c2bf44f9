"""Property tests (hypothesis): TMX round trip, split sizes, label lengths, BLEU identities."""

import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunedata.functions.text import xml_escape
from tunedata.operators import bitext, metrics, sft, splits
from tunedata.sources.tmx import parse_tmx, tu_xml, tuv_xml, write_tmx_bytes

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
# XML 1.0 text: no control characters except tab/newline, no surrogates, no U+FFFE/U+FFFF.
TEXT = st.text(
    alphabet=st.characters(blacklist_categories=("Cs", "Cc"), blacklist_characters="￾￿") | st.sampled_from("\t\n<>&'\""),
    min_size=1,
    max_size=30,
).filter(lambda t: t.strip() != "")
LANG = st.sampled_from(["IT-IT", "FR-FR", "DE-DE", "GA-IE"])


@SETTINGS
@given(st.lists(st.tuples(TEXT, TEXT, LANG), min_size=1, max_size=12))
def test_bitext_tmx_roundtrip(spark, rows):
    df = spark.createDataFrame([(i, s, t, l) for i, (s, t, l) in enumerate(rows)], "i int, s string, t string, l string")
    units = df.select(
        F.lit("f").alias("path"),
        F.col("i").alias("pos"),
        tu_xml(tuv_xml(F.lit("EN-GB"), xml_escape("s")), tuv_xml(F.col("l"), xml_escape("t"))).alias("tu"),
    )
    got = bitext.tmx_to_pairs(parse_tmx(write_tmx_bytes(units))).orderBy("tu_idx").collect()
    want = [(i, s.strip(), t.strip(), l) for i, (s, t, l) in enumerate(rows)]
    assert [(r.tu_idx, r.src, r.tgt, r.lang) for r in got] == want


@SETTINGS
@given(st.integers(0, 400), st.integers(0, 1000), st.floats(0.05, 0.95))
def test_split_sizes_and_disjoint(spark, n, seed, frac):
    rows = splits.split_random(spark.range(n).withColumnRenamed("id", "k"), "k", frac, seed=seed).collect()
    train = {r.k for r in rows if r.split == "train"}
    assert len(train) == int(frac * n)
    assert len(rows) == n and sorted(r.shuffle_pos for r in rows) == list(range(1, n + 1))


@SETTINGS
@given(st.lists(st.tuples(st.text(string.ascii_letters + " ", max_size=40), st.text(string.ascii_letters + " ", max_size=40)), min_size=1, max_size=6),
       st.integers(2, 24))
def test_label_lengths(spark, rows, length):
    df = spark.createDataFrame(rows, "prompt string, completion string")
    vocab = sft.build_vocab(sft.chat_template(df), ["full_text"], 30)
    enc = sft.encoder(vocab, 30)
    for mode in sft.LABEL_MODES:
        out = sft.tokenize_sft(df, enc, mode, length)
        bad = sft.validate_tokens(out, length, [c for c in ("input_ids", "attention_mask", "labels") if c in out.columns]).first()
        assert bad.n_null == 0 and bad.n_bad_length == 0


@SETTINGS
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d", "e", "f"]), min_size=4, max_size=12), min_size=1, max_size=6),
       st.integers(1, 5))
def test_bleu_identity_and_partitioning(spark, docs, parts):
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "k int, t string")
    s1 = metrics.corpus_bleu(df, ["k"], "t", F.array("t")).first().score
    s2 = metrics.corpus_bleu(df.repartition(parts), ["k"], "t", F.array("t"), method="relational").first().score
    assert abs(s1 - 100.0) < 1e-9 and abs(s2 - 100.0) < 1e-9


PUNCT_TEXT = st.lists(
    st.sampled_from(list("ab1.,-'\"&;<>()[]{}~@/:!?$% \t\n") + ["&amp;", "&quot;", "&lt;", "-\n", "<skipped>", " ", "\x85", "é", "2024", "1,000.5"]),
    max_size=25,
).map("".join)


@SETTINGS
@given(st.lists(PUNCT_TEXT, min_size=1, max_size=20))
def test_tok13a_equals_definition(spark, texts):
    from test_text import py_13a

    from tunedata.functions.text import tok_13a

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", tok_13a("t").alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [py_13a(t) for t in texts]


SEG_PIECE = st.sampled_from(["a", "Hello", " ", "  ", "\t", "&lt;", "&amp;", "x&gt;y", "<ph/>", '<bpt i="1">b</bpt>', "<ept>e</ept>",
                             "<it>i</it>", "é", "'q'", "1,5", "\n", "<!-- c -->", "<![CDATA[c<d]]>", "&lt;ph/&gt;"])


@SETTINGS
@given(st.lists(st.lists(SEG_PIECE, max_size=6).map("".join), min_size=1, max_size=10))
def test_leading_text_equals_elementtree(spark, segs):
    import xml.etree.ElementTree as ET

    from tunedata.sources.tmx import parse_tmx

    units = "".join(f'<tu><tuv xml:lang="EN-GB"><seg>{s}</seg></tuv></tu>' for s in segs)
    doc = f'<?xml version="1.0" encoding="UTF-16LE"?><tmx><body>{units}</body></tmx>'
    files = spark.createDataFrame([("f", doc)], "path string, x string").select("path", F.encode("x", "UTF-16LE").alias("content"))
    got = {r.tu_idx: r.seg_raw for r in parse_tmx(files).collect()}
    for i, s in enumerate(segs):
        text = ET.fromstring(f"<seg>{s}</seg>").text
        assert got[i] == (text or ""), (s, got[i], text)
