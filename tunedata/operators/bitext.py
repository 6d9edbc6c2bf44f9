"""Bitext shaping: segment rules, per-unit language de-dup, source/target pairing, rendering.

Every per-unit step groups on ``(path, tu_idx)`` (plus ``lang``); after
:func:`tunedata.sources.tmx.parse_tmx` the rows are already hash-partitioned on those
keys, so the aggregate and the window below run without another exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tunedata.functions.text import is_blank, iso2, lang_label, ustrip

# The training prompt and the flattened-text joiner.
PROMPT_TEMPLATE = "Translate the following English text to {lang}: '{src}'"
FLAT_JOINER = " Output: "

# Our own display names for language codes (ISO 639-1, upper case), used by lang_style="name".
LANGUAGE_NAMES = {
    "BG": "Bulgarian", "CS": "Czech", "DA": "Danish", "DE": "German", "EL": "Greek", "EN": "English",
    "ES": "Spanish", "ET": "Estonian", "FI": "Finnish", "FR": "French", "GA": "Irish", "HR": "Croatian",
    "HU": "Hungarian", "IT": "Italian", "LT": "Lithuanian", "LV": "Latvian", "MT": "Maltese", "NL": "Dutch",
    "PL": "Polish", "PT": "Portuguese", "RO": "Romanian", "SK": "Slovak", "SL": "Slovenian", "SV": "Swedish",
}


def valid_segments(segments: DataFrame, policy: str = "training") -> DataFrame:
    """Keep the ``<tuv>`` rows a builder uses, with the stripped text in ``seg``.

    training:   a non-empty language and a ``<seg>`` element (an empty one reads as '').
    validation: a non-empty language and non-empty raw text (whitespace-only is kept and
                becomes '' after the strip).
    """
    lang_ok = F.col("lang").isNotNull() & (F.col("lang") != "")
    if policy == "training":
        keep = lang_ok & F.col("seg_raw").isNotNull()
    elif policy == "validation":
        keep = lang_ok & F.col("seg_raw").isNotNull() & (F.col("seg_raw") != "")
    else:
        raise ValueError(f"policy={policy!r}")
    return segments.where(keep).select("path", "tu_idx", "tuv_idx", "lang", ustrip("seg_raw").alias("seg"))


def dedup_langs(segments: DataFrame) -> DataFrame:
    """One row per ``(path, tu_idx, lang)``: the last text wins, the first position is kept."""
    return segments.groupBy("path", "tu_idx", "lang").agg(
        F.max_by("seg", "tuv_idx").alias("seg"), F.min("tuv_idx").alias("lang_pos")
    )


def pair_segments(segments: DataFrame, src_lang: str = "EN-GB", policy: str = "training") -> DataFrame:
    """``(path, tu_idx, lang, seg, lang_pos)`` → ``(path, tu_idx, lang_pos, src, tgt, lang)``.

    The source text of a unit is the segment of ``src_lang`` (exact, case-sensitive);
    units without a non-empty source give nothing. Training also drops empty targets.
    """
    unit = Window.partitionBy("path", "tu_idx")
    src = F.max(F.when(F.col("lang") == src_lang, F.col("seg"))).over(unit)
    out = segments.withColumn("src", src).where(
        F.col("src").isNotNull() & (F.col("src") != "") & (F.col("lang") != src_lang)
    )
    if policy == "training":
        out = out.where(F.col("seg") != "")
    elif policy != "validation":
        raise ValueError(f"policy={policy!r}")
    return out.select(
        "path", "tu_idx", F.col("lang_pos").cast("int").alias("lang_pos"), "src", F.col("seg").alias("tgt"), "lang"
    )


def limit_tus(segments: DataFrame, max_tus: int = 20) -> DataFrame:
    """First ``max_tus`` units of every file, counted before any source/target rule."""
    return segments.where(F.col("tu_idx") < max_tus)


def tmx_to_pairs(
    segments: DataFrame, *, policy: str = "training", src_lang: str = "EN-GB", max_tus: int | None = None
) -> DataFrame:
    """The two builders of the reference: training pairs, or the capped validation set."""
    if max_tus is not None:
        segments = limit_tus(segments, max_tus)
    return pair_segments(dedup_langs(valid_segments(segments, policy)), src_lang=src_lang, policy=policy)


def lang_names(spark: SparkSession) -> DataFrame:
    """Lookup table ``(code, name)`` (24 rows)."""
    return spark.createDataFrame(sorted(LANGUAGE_NAMES.items()), "code string, name string")


def with_lang_names(df: DataFrame, lang_col: str = "lang", out_col: str = "lang_name") -> DataFrame:
    """Add the display name of a language code; unknown codes fall back to the upper-case label."""
    names = F.broadcast(lang_names(df.sparkSession))  # fixed 24 rows
    label = lang_label(lang_col)
    return (
        df.withColumn("__code", label)
        .join(names.withColumnRenamed("code", "__code"), "__code", "left")
        .withColumn(out_col, F.coalesce(F.col("name"), F.col("__code")))
        .drop("__code", "name")
    )


def render_prompt(src: Column, label: Column, template: str = PROMPT_TEMPLATE) -> Column:
    """Fill ``{lang}`` and ``{src}`` of a template (no quote escaping)."""
    before, rest = template.split("{lang}", 1)
    middle, after = rest.split("{src}", 1)
    return F.concat(F.lit(before), label, F.lit(middle), src, F.lit(after))


def to_sft(pairs: DataFrame, *, template: str = PROMPT_TEMPLATE, lang_style: str = "code", keep: list[str] | None = None) -> DataFrame:
    """Pairs → ``(prompt, completion)`` training examples (plus ``keep`` columns for order)."""
    keep = keep or []
    if lang_style == "code":
        df, label = pairs, lang_label("lang")
    elif lang_style == "name":
        df, label = with_lang_names(pairs), F.col("lang_name")
    else:
        raise ValueError(f"lang_style={lang_style!r}")
    return df.select(*keep, render_prompt(F.col("src"), label, template).alias("prompt"), F.col("tgt").alias("completion"))


def to_eval_set(pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return pairs.select(*(keep or []), "src", "tgt", "lang")


def to_flat_text(sft: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``"{prompt} Output: {completion}"`` as one ``text`` column."""
    return sft.select(*(keep or []), F.concat("prompt", F.lit(FLAT_JOINER), "completion").alias("text"))


def drop_blank(df: DataFrame, cols: list[str] = ("prompt", "completion")) -> DataFrame:
    """Drop rows where any of ``cols`` is NULL, empty or whitespace only."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~is_blank(c)
    return df.where(cond)


def fix_lang_codes(df: DataFrame, col: str = "lang") -> DataFrame:
    """Rewrite ``lang`` to its upper-case first two letters (missing/NULL → ''), other fields kept."""
    if col not in df.columns:
        return df.withColumn(col, F.lit(""))
    return df.withColumn(col, iso2(col))
