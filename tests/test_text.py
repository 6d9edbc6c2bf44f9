"""Scalar functions against their Python definitions."""

import re

from pyspark.sql import functions as F

from tunedata.functions import text as T


def test_ustrip_equals_python_strip(spark):
    chars = [chr(c) for c in range(0, 0x3100) if not 0xD800 <= c <= 0xDFFF]
    rows = [(c, f"{c}x{c}{c}") for c in chars]
    df = spark.createDataFrame(rows, "c string, s string")
    got = df.select("c", T.ustrip("s").alias("a"), T.urstrip("s").alias("b")).collect()
    for r in got:
        s = f"{r.c}x{r.c}{r.c}"
        assert r.a == s.strip(), hex(ord(r.c))
        assert r.b == s.rstrip(), hex(ord(r.c))


def test_ws_split_equals_python_split(spark):
    texts = ["a  b\tc d e\n", "", "   ", "x\u200by", "a\x1cb\x85c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.ws_split("t")).collect()]
    assert got == [t.split() for t in texts]


def test_language_codes(spark):
    df = spark.createDataFrame([("GA-IE",), ("it",), ("gle-IE",), (None,), ("",)], "lang string")
    got = df.select(T.iso2("lang").alias("i"), T.lang_label("lang").alias("l")).collect()
    assert [r.i for r in got] == ["GA", "IT", "GL", "", ""]
    assert [r.l for r in got[:3]] == ["GA", "IT", "GLE"]


def test_extract_reply(spark):
    texts = ["<s>[INST] a [/INST] b ", "  no marker ", "x [/INST] y [/INST]  z\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.extract_reply("t")).collect()]
    assert got == [t.split("[/INST]")[-1].strip() for t in texts]


def py_13a(line):
    """The '13a' tokenizer, from its published definition."""
    line = line.rstrip()
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        line = line.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def test_tok_13a(spark):
    texts = [
        "Hello, world.", "1,000.5 and 2024-2029", "a &amp; b &lt;c&gt; &quot;q&quot;", "line-\nbreak\nnext",
        "<skipped> x", "it's (fine) [ok] {yes} ~ @ # $ % ^", "end.", "3.14, 2.0.", "", "   ", "e.g. U.S.A. 5-6",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.tok_13a("t")).collect()]
    assert got == [py_13a(t) for t in texts]


def test_tok_13a_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html")
    rows = pages.select("html", T.tok_13a("html").alias("t")).collect()
    for r in rows:
        assert r.t == py_13a(r.html)


def test_xml_escape_roundtrip(spark):
    import xml.etree.ElementTree as ET

    texts = ["a < b & c > d", "&amp; already", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, r in zip(texts, df.select(T.xml_escape("t")).collect()):
        assert ET.fromstring(f"<s>{r[0]}</s>").text == t


def test_13a_rules_match_no_space_and_take_points_in_pairs(spark):
    assert not any(re.search(pattern, " " * 9) for pattern, _ in T.RULES_13A)  # most of a text's characters
    texts = ["a,,2", "1,,2", "a.,.2", "1..,.a", "a b", "é.,x", "5-6-", "\U0001f600.2", ".", ",,,,1", "a , b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in df.select(T.tok_13a("t")).collect()] == [py_13a(t) for t in texts]
