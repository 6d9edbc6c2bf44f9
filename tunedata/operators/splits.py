"""Reproducible exact-size splits and shuffles (train/valid as a column, never two jobs).

Sizes follow the reference: a train share gives ``floor(share * n)`` train rows (Python
``int(0.8 * n)``), a test share gives ``ceil(share * n)`` test rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.plans.permute import permuted
from tunedata.plans.rank import rank_by_hash, rank_by_key


def shuffle_rows(df: DataFrame, key: str | Sequence[str], seed: int = 42, *, pos_col: str = "shuffle_pos") -> DataFrame:
    """Add a seeded random permutation position (1-based) of a unique key."""
    return rank_by_hash(df, key, seed, rank_col=pos_col)


def split_random(
    df: DataFrame, key: str | Sequence[str], train_frac: float = 0.8, seed: int = 42, *, pos_col: str = "shuffle_pos"
) -> DataFrame:
    """Shuffle, then the first ``floor(train_frac * n)`` rows are ``train``, the rest ``valid``."""
    r = rank_by_hash(df, key, seed, rank_col=pos_col, total_col="__n")
    n_train = F.floor(F.lit(float(train_frac)) * F.col("__n"))
    return r.withColumn("split", F.when(F.col(pos_col) <= n_train, "train").otherwise("valid")).drop("__n")


def split_test_size(
    df: DataFrame, key: str | Sequence[str], test_size: float = 0.2, seed: int = 42, *, pos_col: str = "shuffle_pos"
) -> DataFrame:
    """Shuffle, then the first ``ceil(test_size * n)`` rows are ``test``, the rest ``train``."""
    r = rank_by_hash(df, key, seed, rank_col=pos_col, total_col="__n")
    n_test = F.ceil(F.lit(float(test_size)) * F.col("__n"))
    return r.withColumn("split", F.when(F.col(pos_col) <= n_test, "test").otherwise("train")).drop("__n")


def split_head_tail(df: DataFrame, order: list[str], train_frac: float = 0.8, *, pos_col: str = "pos") -> DataFrame:
    """Keep the order: the first ``floor(train_frac * n)`` rows are ``train``, the rest ``valid``."""
    r = rank_by_key(df, order, rank_col=pos_col, total_col="__n")
    n_train = F.floor(F.lit(float(train_frac)) * F.col("__n"))
    return r.withColumn("split", F.when(F.col(pos_col) <= n_train, "train").otherwise("valid")).drop("__n")


def epoch_orders(df: DataFrame, order: list[str], epochs: Sequence[int], seed: int = 42, *, pos_col: str = "epoch_pos", total_col: str = "n_rows") -> DataFrame:
    """Every row once per epoch with its 0-based place in that epoch's order. The rows are ranked once,
    by ``order`` (a unique key); each epoch's order is a keyed permutation of the ranks, so it depends on
    the seed, the epoch and the rank alone and not on the partitioning."""
    ranked = rank_by_key(df, order, rank_col="__pos", total_col=total_col)
    places = [F.struct(F.lit(e).cast("int").alias("epoch"), permuted(F.col("__pos") - 1, F.col(total_col), f"{seed}|{e}").alias("at")) for e in epochs]
    out = ranked.withColumn("__e", F.explode(F.array(*places)))
    return out.select(*df.columns, total_col, F.col("__e.epoch").alias("epoch"), F.col("__e.at").alias(pos_col))


def check_partition(all_rows: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """One row ``(n_all, n_parts, n_overlap, n_missing, n_extra)`` checking that ``parts`` are
    disjoint and together equal ``all_rows`` (by ``key``)."""
    tagged = None
    for i, p in enumerate(parts):
        t = p.select(F.col(key).alias("__k"), F.lit(i).alias("__part"))
        tagged = t if tagged is None else tagged.unionByName(t)
    per_key = tagged.groupBy("__k").agg(F.count("*").alias("__c"))
    base = all_rows.select(F.col(key).alias("__k"), F.lit(1).alias("__in_all"))
    j = base.join(per_key, "__k", "full_outer")
    return j.agg(
        F.count_if(F.col("__in_all").isNotNull()).cast("bigint").alias("n_all"),
        F.coalesce(F.sum("__c"), F.lit(0)).cast("bigint").alias("n_parts"),
        F.count_if(F.col("__c") > 1).cast("bigint").alias("n_overlap"),
        F.count_if(F.col("__in_all").isNotNull() & F.col("__c").isNull()).cast("bigint").alias("n_missing"),
        F.count_if(F.col("__in_all").isNull()).cast("bigint").alias("n_extra"),
    )
