"""Bitext derived from the driver tables, and TMX documents built from it.

``conversations``: a ``user`` turn ``t`` followed by an ``assistant`` turn ``t+1`` of the
same conversation is one source/target pair (an equi-join, so no conversation is ever
gathered in one task). ``pages``: the page HTML is an English segment and the URL its
translation, which exercises XML escaping.

Every unit gets one deterministic variant ``k = (conv_id + turn) % 10`` covering the
cases a TMX builder must handle (blank/empty/duplicate/inline/missing languages), and
``(conv_id * 7 + turn) % 13 = 0`` makes a malformed unit. Files hold at most 8
conversations x 64 turns, so every document is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.functions.text import xml_escape
from tunedata.sources.tmx import tu_xml, tuv_xml, write_tmx_bytes

# Target languages by conv_id % 5, and the third language of variant 1.
TARGET_LANGS = ["IT-IT", "FR-FR", "DE-DE", "ES-ES", "GA-IE"]
THIRD_LANG = "MT-MT"
# A unit in a comment, which is no unit, and a unit without segments, which has a position.
COMMENTED_UNIT = '<!-- <tu><tuv xml:lang="EN-GB"><seg>old</seg></tuv></tu> -->'
EMPTY_UNITS = '<tu tuid="e" note="a &gt; b"/>\n'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the cluster when its files give fewer scan tasks than cores."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over ``defaultParallelism`` tasks only when the plan yields fewer
    partitions (e.g. one large parquet row group); a wide scan is left alone, so at cluster
    scale this adds no shuffle. Planning only - no job is run."""
    try:
        want = df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # no RDD access (e.g. a Spark Connect session): leave the plan as is
        return df
    return df.repartition(want) if have < want else df


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, src, tgt)``: user turn and the assistant reply right after it."""
    conv = table(spark, sf_dir, "conversations")
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    reply = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    return user.join(reply, ["conv_id", "turn"])


def _unit_xml(k: Column, bad: Column, lang: Column, s: Column, t: Column) -> Column:
    en = F.lit("EN-GB")
    tuv = tuv_xml
    return (
        F.when(bad, tu_xml(tuv(en, F.concat(F.lit("broken & "), s)), tuv(lang, t)))
        .when(k == 0, tu_xml(tuv(en, s), tuv(lang, t)))
        .when(k == 1, F.concat(F.lit(COMMENTED_UNIT), tu_xml(tuv(en, s), tuv(lang, t), tuv(F.lit(THIRD_LANG), F.concat(t, F.lit(" (mt)<![CDATA[ </tu>]]>"))))))
        .when(k == 2, tu_xml(tuv(en, s), tuv(lang, F.lit("  "))))
        .when(k == 3, tu_xml(tuv(en, s), F.concat(F.lit('<tuv xml:lang="'), lang, F.lit('"><seg/></tuv>'))))
        .when(k == 4, tu_xml(tuv(en, F.concat(F.lit("<!-- </tu> -->"), s)), tuv(lang, F.lit("draft")), tuv(lang, t)))
        .when(k == 5, tu_xml(tuv(en, F.concat(s, F.lit('<ph x="1"/> (note)'))), tuv(lang, t)))
        .when(k == 6, tu_xml(tuv(en, s), tuv(lang, F.concat(F.lit('<bpt i="1"/>'), t))))
        .when(k == 7, tu_xml(tuv(F.lit("en-gb"), s), tuv(lang, t)))
        .when(
            k == 8,
            tu_xml(F.lit("<tuv/>"), tuv(en, s), F.lit("<tuv><seg>x</seg></tuv>"), tuv(lang, t)),
        )
        .otherwise(F.concat(F.lit(EMPTY_UNITS), tu_xml(tuv(en, F.concat(F.lit("  "), s, F.lit("\u2003"))), tuv(lang, F.concat(F.lit("\t"), t, F.lit(" \n"))))))
    )


def bitext_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, pos, tu)``: every ``<tu>`` fragment of the test corpus with its file and order."""
    p = conversation_pairs(spark, sf_dir)
    lang = F.element_at(F.array(*[F.lit(x) for x in TARGET_LANGS]), (F.col("conv_id") % 5 + 1).cast("int"))
    conv_units = p.select(
        F.concat(
            F.lit("conv/"), (F.col("conv_id") / 8).cast("bigint").cast("string"), F.lit("/"),
            (F.col("turn") / 64).cast("bigint").cast("string"), F.lit(".tmx"),
        ).alias("path"),
        F.struct("conv_id", "turn").alias("pos"),
        _unit_xml(
            (F.col("conv_id") + F.col("turn")) % 10,
            (F.col("conv_id") * 7 + F.col("turn")) % 13 == 0,
            lang,
            xml_escape("src"),
            xml_escape("tgt"),
        ).alias("tu"),
    )
    pages = table(spark, sf_dir, "pages")
    page_units = pages.select(
        F.concat(F.lit("pages/"), (F.col("page_id") / 8).cast("bigint").cast("string"), F.lit(".tmx")).alias("path"),
        F.struct(F.col("page_id").alias("conv_id"), F.lit(0).cast("bigint").alias("turn")).alias("pos"),
        tu_xml(tuv_xml(F.lit("EN-GB"), xml_escape("html")), tuv_xml(F.lit("IT-IT"), xml_escape("url"))).alias("tu"),
    )
    return conv_units.unionByName(page_units)


def bitext_tmx(spark: SparkSession, sf_dir: str, *, bom: bool = True, encoding: str = "UTF-16LE") -> DataFrame:
    """``(path, content)``: the test corpus as TMX documents (UTF-16LE with a BOM by default)."""
    return write_tmx_bytes(bitext_units(spark, sf_dir), encoding=encoding, bom=bom and encoding.upper().startswith("UTF-16"))
