"""Corpus BLEU (13a tokens, n = 1..4, exponential smoothing, closest reference length).

Per segment, hypothesis and reference n-grams are exploded and counted; clipping takes, per
n-gram, the hypothesis count capped by its largest count in any one reference. The rows are
hash-partitioned on the segment key once, so every per-segment aggregation after that runs
in place; only the final per-group sums shuffle, after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import LongType, StructField, StructType

from tunedata.functions.text import format_score, ngrams, tok_13a

MAX_ORDER = 4
STAT_COLS = ["sys_len", "ref_len"] + [f"c{n}" for n in range(1, MAX_ORDER + 1)] + [f"t{n}" for n in range(1, MAX_ORDER + 1)]


def _tag(n: int):
    # transform() reads a two-argument lambda as (element, index): bind n by closure instead.
    return lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"))


def _all_ngrams(tokens: Column) -> Column:
    parts = [F.transform(ngrams(tokens, n), _tag(n)) for n in range(1, MAX_ORDER + 1)]
    return F.flatten(F.array(*parts))


def segment_stats(
    df: DataFrame,
    key: Sequence[str],
    hyp: str,
    refs: Column,
    *,
    carry: Sequence[str] = (),
    method: str = "arrow",
    num_partitions: int | None = None,
) -> DataFrame:
    """Per segment: ``key + carry + [sys_len, ref_len, c1..c4, t1..t4]``.

    ``refs`` is an array<string> column (one or more references per segment); ``carry``
    columns (constant per segment, e.g. system and language) ride along. Tokens are always
    13a expressions on the JVM. ``method``:

    arrow       clipped counts per segment in an Arrow-batched UDF, a bounded number of tokens at
                a time: no shuffle at all, segments are independent.
    relational  n-grams exploded and counted with group-bys after one hash repartition on
                ``key`` (all later aggregations reuse that partitioning).
    """
    if method == "arrow":
        return _segment_stats_arrow(df, key, hyp, refs, carry)
    if method != "relational":
        raise ValueError(f"method={method!r}")
    return _segment_stats_relational(df, key, hyp, refs, carry, num_partitions)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _clipped_counts(hyps: pa.ListArray, refs: pa.ListArray) -> np.ndarray:
    """A row per segment: sys_len, closest ref_len (ties → shorter) and the clipped matches for
    n = 1..4, vectorised over all segments.

    All tokens are dictionary-encoded once, in Arrow; the code of an n-gram is the factorised pair
    (code of its (n-1)-gram prefix, code of its last token), formed only where the n-gram fits inside
    its own text. Counts per (text, n-gram), the largest count over a segment's references, and the
    clipped sums are sorts and reductions over int64 keys - exact, no hashing of n-grams.
    """
    nseg = len(hyps)
    out = np.zeros((nseg, 2 + MAX_ORDER), dtype=np.int64)
    each = refs.flatten()
    hl, rl = _lengths(hyps), _lengths(each)
    ref_seg = np.repeat(np.arange(nseg), _lengths(refs))
    out[:, 0] = hl
    if len(rl):
        longest = int(rl.max()) + 1
        closest = np.full(nseg, np.iinfo(np.int64).max)
        np.minimum.at(closest, ref_seg, np.abs(rl - hl[ref_seg]) * longest + rl)
        out[ref_seg, 1] = closest[ref_seg] % longest
    seg_of, lengths = np.concatenate([np.arange(nseg), ref_seg]), np.concatenate([hl, rl])
    is_hyp = np.arange(len(lengths)) < nseg
    total = int(lengths.sum())
    if total == 0:
        return out
    tok = pa.concat_arrays([hyps.flatten(), each.flatten()]).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    text_at = np.repeat(np.arange(len(lengths)), lengths)
    left = lengths[text_at] - (np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths))  # tokens from here to text end
    gram = tok.astype(np.int64)
    width = int(tok.max()) + 1
    for n in range(1, MAX_ORDER + 1):
        if n > 1:
            nxt = np.zeros(total, dtype=np.int64)
            nxt[: total - (n - 1)] = tok[n - 1 :]
            gram, _ = pd.factorize(gram * width + nxt)
            gram = gram.astype(np.int64)
        ok = left >= n
        if not ok.any():
            break
        t, g = text_at[ok], gram[ok]
        span = int(g.max()) + 1
        key, cnt = np.unique(t * span + g, return_counts=True)  # counts per (text, n-gram)
        tt, gg = key // span, key % span
        seg = seg_of[tt]
        hyp_side = is_hyp[tt]
        per_seg = seg * span + gg
        rk, rc = per_seg[~hyp_side], cnt[~hyp_side]
        if len(rk) == 0:
            continue
        order = np.argsort(rk, kind="stable")
        rk, rc = rk[order], rc[order]
        uk, first = np.unique(rk, return_index=True)
        rmax = np.maximum.reduceat(rc, first)  # largest count of the n-gram in any one reference
        hk, hc = per_seg[hyp_side], cnt[hyp_side]
        at = np.minimum(np.searchsorted(uk, hk), len(uk) - 1)
        clipped = np.where(uk[at] == hk, np.minimum(hc, rmax[at]), 0)
        out[:, 1 + n] = np.bincount(seg[hyp_side], weights=clipped, minlength=nseg).astype(np.int64)
    return out


TOKENS = 1 << 18  # of segments that are counted together, so that a worker's arrays are bounded
_STATS_TYPE = StructType([StructField(c, LongType(), False) for c in ["sys_len", "ref_len"] + [f"c{n}" for n in range(1, MAX_ORDER + 1)]])


def _clipped_slices(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """:func:`_clipped_counts` of slices of each Arrow batch, ``TOKENS`` tokens (one segment at least)."""
    for hyps, refs in batches:
        sizes = np.concatenate([[0], np.cumsum(_lengths(refs.flatten()))])
        refs_at = np.concatenate([[0], np.cumsum(_lengths(refs))])
        ends, i = np.cumsum(_lengths(hyps)) + sizes[refs_at[1:]], 0
        while i < len(hyps):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOKENS, "right")))
            counts = _clipped_counts(hyps.slice(i, j - i), refs.slice(i, j - i))
            yield pa.StructArray.from_arrays([pa.array(c) for c in counts.T.copy()], _STATS_TYPE.names)
            i = j


_clipped_udf = F.arrow_udf(_clipped_slices, _STATS_TYPE)


def _segment_stats_arrow(df: DataFrame, key: Sequence[str], hyp: str, refs: Column, carry: Sequence[str]) -> DataFrame:
    key = list(key)
    carry = [c for c in carry if c not in key]
    st = df.select(*key, *carry, _clipped_udf(tok_13a(hyp), F.transform(refs, lambda r: tok_13a(r))).alias("s"))
    return st.select(
        *key,
        *carry,
        "s.sys_len",
        "s.ref_len",
        *[F.col(f"s.c{n}") for n in range(1, MAX_ORDER + 1)],
        *[F.greatest(F.col("s.sys_len") - (n - 1), F.lit(0)).cast("bigint").alias(f"t{n}") for n in range(1, MAX_ORDER + 1)],
    )


def _segment_stats_relational(
    df: DataFrame, key: Sequence[str], hyp: str, refs: Column, carry: Sequence[str], num_partitions: int | None
) -> DataFrame:
    """One pass, no join: the lengths are computed before the explode and carried as grouping
    keys (they depend on the segment only), and each segment emits one marker row (n = 0)
    so a segment with no hypothesis n-gram still reaches the sums.
    """
    key = list(key)
    carry = [c for c in carry if c not in key]
    base = df.select(*key, *carry, tok_13a(hyp).alias("__h"), F.transform(refs, lambda r: tok_13a(r)).alias("__rs"))
    base = base.repartition(num_partitions, *key) if num_partitions else base.repartition(*key)
    hl = F.size("__h")
    closest = F.array_min(F.transform("__rs", lambda r: F.struct(F.abs(F.size(r) - hl).alias("d"), F.size(r).alias("len"))))
    seg = key + carry + ["sys_len", "ref_len"]
    marker = F.array(F.struct(F.lit(-1).alias("side"), F.lit(0).alias("n"), F.lit("").alias("gram")))
    hyp_grams = F.transform(_all_ngrams(F.col("__h")), lambda g: F.struct(F.lit(-1).alias("side"), g["n"].alias("n"), g["gram"].alias("gram")))
    ref_grams = F.flatten(
        F.transform(
            "__rs",
            lambda r, i: F.transform(_all_ngrams(r), lambda g: F.struct(i.alias("side"), g["n"].alias("n"), g["gram"].alias("gram"))),
        )
    )
    rows = base.select(
        *key,
        *carry,
        hl.cast("bigint").alias("sys_len"),
        F.coalesce(closest["len"], F.lit(0)).cast("bigint").alias("ref_len"),
        F.explode(F.concat(marker, hyp_grams, ref_grams)).alias("g"),
    ).select(*seg, "g.side", "g.n", "g.gram")
    counts = rows.groupBy(*seg, "n", "gram", "side").agg(F.count("*").alias("cnt"))
    per_gram = counts.groupBy(*seg, "n", "gram").agg(
        F.sum(F.when(F.col("side") == -1, F.col("cnt"))).alias("hc"),
        F.max(F.when(F.col("side") >= 0, F.col("cnt"))).alias("rc"),
    ).where(F.col("hc").isNotNull())
    clipped = F.least(F.col("hc"), F.coalesce(F.col("rc"), F.lit(0)))
    out = per_gram.groupBy(*seg).agg(
        *[F.sum(F.when(F.col("n") == n, clipped).otherwise(0)).alias(f"c{n}") for n in range(1, MAX_ORDER + 1)]
    )
    return out.select(
        *seg,
        *[F.col(f"c{n}").cast("bigint").alias(f"c{n}") for n in range(1, MAX_ORDER + 1)],
        *[F.greatest(F.col("sys_len") - (n - 1), F.lit(0)).cast("bigint").alias(f"t{n}") for n in range(1, MAX_ORDER + 1)],
    )


def ngram_stats(stats: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Long form ``group + (n, correct, total)`` of summed segment statistics."""
    g = stats.groupBy(*group_cols).agg(*[F.sum(c).alias(c) for c in STAT_COLS])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"c{n}").alias("correct"), F.col(f"t{n}").alias("total")) for n in range(1, MAX_ORDER + 1)]))
    return g.select(*group_cols, rows.alias("r")).select(*group_cols, F.col("r.n").cast("int").alias("n"), F.col("r.correct").cast("bigint").alias("correct"), F.col("r.total").cast("bigint").alias("total"))


def bleu_from_stats(sums: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Closed form of corpus BLEU from summed statistics (exp smoothing)."""
    c = [F.col(f"c{n}") for n in range(1, MAX_ORDER + 1)]
    t = [F.col(f"t{n}") for n in range(1, MAX_ORDER + 1)]
    any_correct = c[0] + c[1] + c[2] + c[3] > 0
    precisions = []
    for n in range(MAX_ORDER):
        zeros = sum((F.when(c[k] == 0, 1).otherwise(0) for k in range(n + 1)), F.lit(0))
        p = (
            F.when(~any_correct | (t[n] == 0), F.lit(0.0))
            .when(c[n] == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t[n]))
            .otherwise(F.lit(100.0) * c[n] / t[n])
        )
        precisions.append(p.alias(f"p{n + 1}"))
    sys_len, ref_len = F.col("sys_len"), F.col("ref_len")
    bp = (
        F.when(sys_len >= ref_len, F.lit(1.0))
        .when(sys_len > 0, F.exp(F.lit(1.0) - ref_len / sys_len))
        .otherwise(F.lit(0.0))
    )
    with_p = sums.select(*group_cols, *precisions, bp.alias("bp"), sys_len.cast("bigint").alias("sys_len"), ref_len.cast("bigint").alias("ref_len"))
    ps = [F.col(f"p{n}") for n in range(1, MAX_ORDER + 1)]
    all_pos = ps[0] * ps[1] * ps[2] * ps[3] > 0
    score = F.when(all_pos, F.col("bp") * F.exp((F.log(ps[0]) + F.log(ps[1]) + F.log(ps[2]) + F.log(ps[3])) / 4)).otherwise(F.lit(0.0))
    return with_p.select(*group_cols, score.alias("score"), "bp", *ps, "sys_len", "ref_len")


def corpus_bleu(
    df: DataFrame,
    key: Sequence[str],
    hyp: str,
    refs: Column,
    group_cols: Sequence[str] = (),
    *,
    method: str = "arrow",
    num_partitions: int | None = None,
) -> DataFrame:
    """``group + (score, bp, p1..p4, sys_len, ref_len)``; segments pair row by row with their references."""
    stats = segment_stats(df, key, hyp, refs, carry=group_cols, method=method, num_partitions=num_partitions)
    sums = stats.groupBy(*group_cols).agg(*[F.sum(x).alias(x) for x in STAT_COLS])
    return bleu_from_stats(sums, group_cols)


def bleu_first_hypothesis(
    df: DataFrame, order: Sequence[str], hyp: str, ref: str, group_cols: Sequence[str] = ()
) -> DataFrame:
    """BLEU of the first hypothesis of each group (in ``order``) against *all* of the group's
    references as alternatives - what a corpus scorer computes when handed N one-element
    reference lists instead of reference streams.

    The first hypothesis is picked by ``min_by`` (one row per group); every reference's
    n-grams are joined to its n-grams, counted per reference, then maxed. Marker rows (n = 0) carry the lengths.
    """
    given = list(group_cols)
    g = given or ["__all"]
    if not given:
        df = df.withColumn("__all", F.lit(0))
    order = list(order)
    okeys = [f"__o{i}" for i in range(len(order))]
    marker = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("gram")))

    first = df.groupBy(*g).agg(F.min_by(F.col(hyp), F.struct(*order)).alias("__hyp"))
    hyp_grams = (
        first.select(*g, tok_13a("__hyp").alias("__h"))
        .select(*g, F.size("__h").alias("hl"), F.explode(F.concat(marker, _all_ngrams(F.col("__h")))).alias("x"))
        .groupBy(*g, F.col("x.n").alias("n"), F.col("x.gram").alias("gram"))
        .agg(F.count("*").alias("hc"), F.first("hl").alias("hl"))
    )
    ref_grams = (
        df.select(*g, *[F.col(c).alias(k) for c, k in zip(order, okeys)], tok_13a(ref).alias("__r"))
        .select(*g, *okeys, F.size("__r").alias("rl"), F.explode(F.concat(marker, _all_ngrams(F.col("__r")))).alias("x"))
        .select(*g, *okeys, "rl", F.col("x.n").alias("n"), F.col("x.gram").alias("gram"))
    )
    j = ref_grams.join(hyp_grams, [*g, "n", "gram"])  # broadcast by Spark only where its measured size allows
    per_ref = j.groupBy(*g, *okeys, "n", "gram").agg(
        F.count("*").alias("rc"), F.first("hc").alias("hc"), F.first("hl").alias("hl"), F.first("rl").alias("rl")
    )
    closest = F.min(F.struct(F.abs(F.col("rl") - F.col("hl")).alias("d"), F.col("rl").alias("len")))["len"]
    lengths = per_ref.where(F.col("n") == 0).groupBy(*g).agg(
        F.first("hl").cast("bigint").alias("sys_len"), closest.cast("bigint").alias("ref_len")
    )
    clipped = (
        per_ref.where(F.col("n") > 0)
        .groupBy(*g, "n", "gram")
        .agg(F.least(F.first("hc"), F.max("rc")).alias("m"))
        .groupBy(*g)
        .agg(*[F.sum(F.when(F.col("n") == n, F.col("m")).otherwise(0)).alias(f"c{n}") for n in range(1, MAX_ORDER + 1)])
    )
    sums = lengths.join(clipped, g, "left").select(
        *g,
        "sys_len",
        "ref_len",
        *[F.coalesce(F.col(f"c{n}"), F.lit(0)).alias(f"c{n}") for n in range(1, MAX_ORDER + 1)],
        *[F.greatest(F.col("sys_len") - (n - 1), F.lit(0)).alias(f"t{n}") for n in range(1, MAX_ORDER + 1)],
    )
    return bleu_from_stats(sums, given)


def compare_systems(scores: DataFrame, baseline: str, group_cols: Sequence[str] = (), system_col: str = "system") -> DataFrame:
    """Each system's score next to the baseline system's, with the difference."""
    # One row per (system, group): a window over that small table puts the baseline beside each.
    base = F.max(F.when(F.col(system_col) == baseline, F.col("score"))).over(Window.partitionBy(*group_cols))
    j = scores.withColumn("baseline_score", base)
    return j.select(system_col, *group_cols, "score", "baseline_score", (F.col("score") - F.col("baseline_score")).alias("delta"))


__all__ = ["segment_stats", "ngram_stats", "bleu_from_stats", "corpus_bleu", "bleu_first_hypothesis", "compare_systems", "format_score"]
