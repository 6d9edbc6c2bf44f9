"""Exact global positions without pulling every row into one task.

A ``row_number()`` with no ``PARTITION BY`` sorts the whole table in one task. Instead the rows are
range-partitioned on the order key at Spark's sampled quantiles, sorted within their partition, and
written once to the shared folder with their partition and place in it. The position is

    (rows in all earlier partitions) + (place in the partition)

The only global step sums one count per partition, so it is bounded by the number of partitions,
whatever the type, spread or number of NULLs of the key. The written table fixes the partition
bounds, so nothing changes when a lost executor's part of it is read again. The order key should be
unique; rows that tie are numbered in the order in which they were written. NULLs come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tunedata.session import scratch_path


def hash_order(key: Column | str, seed: int) -> Column:
    """Reproducible pseudo-random order: md5 of ``'{seed}|{key}'`` (same function in DuckDB)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(k.cast("string"), F.lit(""))))


def exact_rank(df: DataFrame, order: list[Column | str], *, rank_col: str = "rank", total_col: str | None = None) -> DataFrame:
    """Add the 1-based global position of each row under ``order`` (and the row count)."""
    spark = df.sparkSession
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    mid = F.monotonically_increasing_id()  # partition in the upper bits, place in it in the lower 33
    placed = placed.withColumn("__mid", mid)
    path = scratch_path(spark, "rank")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("__part", F.shiftright("__mid", 33))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__part",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(Window.partitionBy()).alias("__total"),
    )
    # Broadcast: one row per partition of the written table.
    out = placed.join(F.broadcast(offsets), "__part")
    place = F.col("__mid") - F.shiftleft("__part", 33)
    out = out.withColumn(rank_col, (F.col("__offset") + place + 1).cast("bigint"))
    if total_col:
        out = out.withColumn(total_col, F.col("__total").cast("bigint"))
    return out.drop("__part", "__mid", "__offset", "__total")


def key_column(key: str | Sequence[str]) -> Column:
    """One column for a (possibly composite) unique key: the column itself, or the JSON of the
    tuple (distinct tuples give distinct strings)."""
    if isinstance(key, str):
        return F.col(key)
    return F.to_json(F.struct(*[F.col(c) for c in key]))


def rank_by_hash(df: DataFrame, key: str | Sequence[str], seed: int, **kw) -> DataFrame:
    """Position in the seeded md5 order of a unique key (one column or several)."""
    k = key_column(key)
    return exact_rank(df, [hash_order(k, seed), k], **kw)


def rank_by_key(df: DataFrame, order: list[str], **kw) -> DataFrame:
    """Position in the order of unique key columns of any type."""
    return exact_rank(df, list(order), **kw)
