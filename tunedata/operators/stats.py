"""Previews and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window


def preview(df: DataFrame, n: int, order_cols: list[str], cols: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in ``order_cols`` order, numbered ``example_no`` 1..n.

    A top-n (each task keeps its n best, one merge); the numbering runs on those n rows.
    """
    top = df.orderBy(*order_cols).limit(n)
    numbered = top.withColumn("example_no", F.row_number().over(Window.orderBy(*order_cols)))
    return numbered.select("example_no", *(cols or [c for c in df.columns]))


def dataset_stats(df: DataFrame, group_cols: list[str], unit_cols: list[str] | None = None, file_col: str | None = None) -> DataFrame:
    """Counters per group: rows, distinct units and distinct files (all exact)."""
    aggs: list[Column] = [F.count("*").cast("bigint").alias("n_rows")]
    if unit_cols:
        aggs.append(F.count_distinct(*[F.col(c) for c in unit_cols]).cast("bigint").alias("n_units"))
    if file_col:
        aggs.append(F.count_distinct(F.col(file_col)).cast("bigint").alias("n_files"))
    return df.groupBy(*group_cols).agg(*aggs)


def with_metrics(df: DataFrame, name: str = "metrics", **exprs: Column) -> tuple[DataFrame, Observation]:
    """Attach one-pass counters to a plan; read ``obs.get`` after the first action on it."""
    obs = Observation(name)
    exprs = exprs or {"n_rows": F.count(F.lit(1))}
    return df.observe(obs, *[e.alias(k) for k, e in exprs.items()]), obs
