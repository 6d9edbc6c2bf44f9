"""The scale design, checked on physical plans: where the shuffles are, and where they are not."""

import re

from pyspark.sql import functions as F

from tunedata.operators import bitext, metrics, sft
from tunedata.sources.tmx import parse_tmx
from test_tmx import CASES, document


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|RoundRobinPartitioning|rangepartitioning|SinglePartition)", plan)


def test_tmx_to_pairs_has_one_shuffle_on_the_unit(spark):
    rows = [(name, document(units)) for name, units in CASES]
    files = spark.createDataFrame(rows, "path string, x string").select("path", F.encode("x", "UTF-16LE").alias("content"))
    ex = exchanges(bitext.tmx_to_pairs(parse_tmx(files), policy="training"))
    assert len(ex) == 1 and ex[0].startswith("hashpartitioning(path") and "tu_idx" in ex[0], ex


def test_units_are_parsed_once_above_the_exchange(spark):
    rows = [(name, document(units)) for name, units in CASES]
    files = spark.createDataFrame(rows, "path string, x string").select("path", F.encode("x", "UTF-16LE").alias("content"))
    plan = bitext.tmx_to_pairs(parse_tmx(files), policy="training")._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning(path", 1)
    assert above.count("from_xml(") == 2 and "from_xml(" not in below  # the two views of one unit


def test_arrow_encoder_and_segment_stats_do_not_shuffle(spark):
    df = spark.createDataFrame([(i, f"w{i} x y", f"w{i} x z") for i in range(40)], "k int, a string, b string")
    vocab = spark.createDataFrame([("<unk>", 0), ("<s>", 1), ("</s>", 2), ("x", 3)], "token string, id int")
    enc = sft.encoder(vocab, 10)
    assert exchanges(df.select(enc(F.col("a"), True).alias("ids"))) == []
    assert exchanges(metrics.segment_stats(df, ["k"], "a", F.array("b"))) == []


def test_corpus_bleu_shuffles_only_the_group_sums(spark):
    df = spark.createDataFrame([(i, "s" + str(i % 3), "a b c d", "a b c e") for i in range(40)], "k int, g string, h string, r string")
    ex = exchanges(metrics.corpus_bleu(df, ["k"], "h", F.array("r"), ["g"]))
    assert len(ex) == 1 and ex[0].startswith("hashpartitioning(g"), ex
