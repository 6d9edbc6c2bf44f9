"""Quality rules as a bitmask ledger.

Every rule is measured once per document; the ledger keeps the measurements and one long whose
bit k says that rule k failed. A policy is only a mask, so any version of it, and the effect of
leaving rules out, comes from the ledger by bit operations, without touching the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import read, ship_package

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_pipe_words", "n_upper_words",
)

#: name -> SQL condition under which a document FAILS. The order fixes the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > 3 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "table_like": "10 * n_pipe_words > 3 * n_words",
    "shouting": "10 * n_upper_words > 5 * n_words",
}
#: Policies by version: the rules that count.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbol_heavy", "duplicate_lines"),
    "v2": tuple(RULES),
}
PRODUCTION = "v2"


def policy_mask(version: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[version])


def _repeat_words(words: list[bytes]) -> int:
    """Words covered by a three-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    v = len(ids)
    if v < 1 << 21:
        key = (w[:-2] * v + w[1:-1]) * v + w[2:]
    else:  # would not fit in 63 bits: number the word pairs first
        pair = np.unique(w[:-1] * v + w[1:], return_inverse=True)[1]
        key = np.unique(pair[:-1] * np.int64(v) + w[2:], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


_SYMBOLS = bytes(b"#*$%&|<>")
_CONTINUATION = bytes(range(0x80, 0xC0))


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text (UTF-8)."""
    words = text.split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONTINUATION))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = sum(map(bytes.isupper, words))
    return (
        len(words), chars, symbols, len(lines) - len(set(lines)), _repeat_words(words), len(lines), words.count(b"|"), upper,
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [measure(t.as_py() or b"") for t in b.column(1)]
        cols = [pa.array([x[i] for x in got], pa.int64()) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, measurements..., failed long)`` with one row per input row.

    A null or blank text has zero words and fails ``few_words``; repeated rows give repeated
    rows; other columns of ``docs`` are ignored whatever their names.
    """
    ship_package(docs.sparkSession)
    schema = "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    bits = " + ".join(f"IF({cond}, {1 << i}L, 0L)" for i, cond in enumerate(RULES.values()))
    return src.mapInArrow(_measured, schema).withColumn("failed", F.expr(bits))


def apply_policy(led: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """The ledger with ``kept``: no failure among the rules of the policy."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(led: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone (leaving it out would keep
    them), and that are kept without it. One aggregation by failure mask (at most 2^rules rows),
    then bit operations on that small table."""
    mask = policy_mask(version)
    hist = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("f")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit")) for r in POLICIES[version]])
    x = hist.select("f", "n", F.explode(rules).alias("r")).select("f", "n", "r.rule", "r.bit")
    has = F.col("f").bitwiseAND(F.col("bit")) != 0
    alone = F.col("f") == F.col("bit")
    return x.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(alone | (F.col("f") == 0), F.col("n")).otherwise(0)).alias("kept_without"),
    )


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(read(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(policy_mask("base"))) != 0
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "n_lines", "n_pipe_words", "failed",
    )


_R = " + ".join(f"CASE WHEN {cond} THEN {1 << i} ELSE 0 END" for i, cond in enumerate(RULES.values()))
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
p AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) - 1)) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
c AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS pos FROM g WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: x = '|')) AS BIGINT) AS n_pipe_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lw USING (doc_id)),
f AS (SELECT *, CAST({_R} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {policy_mask("base")}) <> 0 AS base_failed,
       (failed & {policy_mask(PRODUCTION)}) = 0 AS kept, n_lines, n_pipe_words, failed
FROM f"""
