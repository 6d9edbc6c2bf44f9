"""A vectorised row-batch function over a table; slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType | str, keep_columns: bool = False) -> DataFrame:
    """``fn`` gets each Arrow batch as ``{column: Series}`` and returns ``{column: values}`` of ``schema``.

    With ``keep_columns`` the input columns come first (``fn`` must return as many values as there
    are rows); a returned column replaces an input column of its name. An empty batch is not passed.
    """
    spark = df.sparkSession
    new = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    names = [f.name for f in new]
    kept = [f for f in df.schema if keep_columns and f.name not in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                got = fn({c: b[c] for c in b.columns})
                yield pd.DataFrame({**{f.name: b[f.name] for f in kept}, **{n: list(got[n]) for n in names}})

    return df.mapInPandas(run, T.StructType([*kept, *new]))


def small(batches: Iterator[pa.RecordBatch], texts, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows with at most ``limit`` bytes of text (one row at least), so that
    neither the worker nor the JVM holds a large batch of results. ``texts``: batch -> its texts."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(texts(b)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right")))
            yield b.slice(i, j - i)
            i = j
