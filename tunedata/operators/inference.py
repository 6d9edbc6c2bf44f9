"""Batch inference over an eval set and comparisons between systems.

The model is the caller's: ``make_predict_fn()`` is called once per Python worker and
returns a function from numpy arrays (one per input column) to an array of generated
texts; it is fed ``batch_size`` rows at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.model_cache import ModelCache
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.functions.text import extract_reply


def predict(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable],
    input_cols: Sequence[str],
    *,
    batch_size: int = 64,
    output_col: str = "prediction",
    reply_only: bool = True,
) -> DataFrame:
    """Append the model output of every row (input columns kept). With ``reply_only`` the
    generated text is cut to the reply after the last ``[/INST]`` and stripped."""
    udf = predict_batch_udf(make_predict_fn, return_type=T.StringType(), batch_size=batch_size)
    out = udf(*[F.col(c) for c in input_cols])
    return df.withColumn(output_col, extract_reply(out) if reply_only else out)


def _answers(makers: Sequence[Callable[[], Callable]], batch_size: int) -> Callable:
    """Arrow columns -> for each row the list of all models' outputs. Only ``batch_size`` rows at a time
    are Python strings, however many an Arrow batch has. The models are made once per worker."""
    key = uuid.uuid4()

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        fns = ModelCache.get(key)
        if fns is None:
            ModelCache.add(key, fns := [m() for m in makers])
        for cols in batches:
            cols = cols if isinstance(cols, tuple) else (cols,)
            for i in range(0, len(cols[0]), batch_size):
                some = [c.slice(i, batch_size).to_pandas().to_numpy() for c in cols]
                out = np.stack([np.asarray(f(*some), dtype=object) for f in fns], axis=1)
                yield pa.array(out.tolist(), pa.list_(pa.string()))

    return run


def predict_systems(
    df: DataFrame,
    systems: Mapping[str, Callable[[], Callable]],
    input_cols: Sequence[str],
    *,
    batch_size: int = 64,
    output_col: str = "prediction",
) -> DataFrame:
    """Every system over the same eval set in one pass: one Python UDF runs all models on
    each Arrow batch (one worker round trip per batch), then the outputs become one long
    table with a ``system`` column."""
    names = list(systems)
    makers = [systems[n] for n in names]
    if not 1 <= len(input_cols) <= 5:
        raise ValueError("predict_systems takes 1 to 5 input columns")

    udf = F.arrow_udf(_answers(makers, batch_size), T.ArrayType(T.StringType()))
    outs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("system"), udf(*[F.col(c) for c in input_cols]).alias("raw"))
    return df.withColumn("__p", F.explode(outs)).select(
        *df.columns, F.col("__p.system").alias("system"), extract_reply(F.col("__p.raw")).alias(output_col)
    )


def persist_predictions(df: DataFrame, path: str, partition_by: str | None = "system") -> DataFrame:
    """Write predictions once (Parquet, partitioned by system) and read them back: scoring
    never re-runs a model, and the lineage is cut at the shared folder."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


_COMMITS = "row_group int, n_rows bigint"


def _commits(spark: SparkSession, path: str) -> dict[int, int] | None:
    """What the commit log under ``path`` holds; None if there is none yet."""
    try:
        return {r.row_group: r.n_rows for r in spark.read.schema(_COMMITS).parquet(path).collect()}
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def predict_resumable(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable],
    input_cols: Sequence[str],
    key: Sequence[str],
    path: str,
    *,
    groups: int = 256,
    groups_at_once: int = 32,
    files_per_group: int = 8,
    stop_after: int | None = None,
    **options,
) -> DataFrame:
    """:func:`predict` with a commit log, so that a run that was cut off goes on where it stopped.

    The rows are dealt into ``groups`` by a hash of ``key`` and written to ``path/input`` once, in at
    most ``files_per_group`` parts a group. Then ``groups_at_once`` groups at a time are scored into
    ``path/rows``, a folder per group, and entered in ``path/commits`` once they are written. A
    call with the same ``path`` takes the input as written by the first and scores only groups without
    an entry; what an unfinished run left of a group is overwritten. Returned are the rows of
    committed groups; ``stop_after`` ends the call after so many rounds. The driver holds a number
    per group. ``df`` must have no column ``row_group``.
    """
    if "row_group" in {c.lower() for c in df.columns}:
        raise ValueError("column row_group is the log's own")
    spark, path = df.sparkSession, path.rstrip("/")
    place = [F.pmod(F.xxhash64(*key), F.lit(groups)).cast("int").alias("row_group")]
    schema = df.select(*df.columns, *place).schema
    if _commits(spark, f"{path}/input-commits") is None:
        part = F.pmod(F.xxhash64(*input_cols, *key), F.lit(files_per_group))
        dealt = df.select(*df.columns, *place).repartition("row_group", part)
        dealt.write.mode("overwrite").partitionBy("row_group").parquet(f"{path}/input")
        spark.range(1).select(F.lit(groups).alias("row_group"), F.lit(0).cast("bigint").alias("n_rows")).write.mode("overwrite").parquet(f"{path}/input-commits")
    groups = max(_commits(spark, f"{path}/input-commits"))
    rows = spark.read.schema(schema).parquet(f"{path}/input")
    scored = predict(rows, make_predict_fn, input_cols, **options)
    done = _commits(spark, f"{path}/commits") or {}
    todo = [g for g in range(groups) if g not in done]
    for k, i in enumerate(range(0, len(todo), groups_at_once)):
        if k == stop_after:
            break
        now = F.col("row_group").isin(todo[i : i + groups_at_once])
        out = scored.where(now).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("row_group").parquet(f"{path}/rows")
        n = spark.read.schema(scored.schema).parquet(f"{path}/rows").where(now).groupBy("row_group").agg(F.count("*").alias("n_rows"))
        all_now = spark.createDataFrame([(g,) for g in todo[i : i + groups_at_once]], "row_group int")
        log = all_now.join(n, "row_group", "left").select("row_group", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))
        log.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    done = _commits(spark, f"{path}/commits")
    if not done:
        return scored.drop("row_group").where(F.lit(False))
    return spark.read.schema(scored.schema).parquet(f"{path}/rows").where(F.col("row_group").isin(sorted(done))).drop("row_group")


def diff_predictions(a: DataFrame, b: DataFrame, key: Sequence[str], group_cols: Sequence[str] = (), col: str = "prediction") -> DataFrame:
    """Rows compared and rows whose outputs differ between two systems (per group)."""
    j = a.select(*key, *group_cols, F.col(col).alias("__a")).join(b.select(*key, F.col(col).alias("__b")), list(key))
    return j.groupBy(*group_cols).agg(
        F.count("*").cast("bigint").alias("n_rows"),
        F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).cast("bigint").alias("n_diff"),
    )


def max_abs_delta(a: DataFrame, b: DataFrame, key: Sequence[str], col: str) -> DataFrame:
    """Per key, the largest absolute element-wise difference of two numeric arrays."""
    j = a.select(*key, F.col(col).alias("__x")).join(b.select(*key, F.col(col).alias("__y")), list(key))
    delta: Column = F.array_max(
        F.zip_with("__x", "__y", lambda p, q: F.abs(p.cast("double") - q.cast("double")))
    )
    return j.select(*key, delta.alias("max_abs_delta"))
