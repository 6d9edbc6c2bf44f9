"""Training rows in shards of a fixed size, with a sparse index from row numbers to files.

``path/data`` holds the rows in order, a Parquet file per ``rows_per_shard`` rows; ``path/index`` a row
``(shard, first_row, rows, file)`` per file. Batch ``k`` is the rows ``k * batch_size ..``, so a
trainer that stopped there opens the files that the index names for its range and no others; inside a file
``row`` is sorted, so Parquet's statistics skip the row groups and pages before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.plans.rank import exact_rank

ROW = "row"
_INDEX = "shard bigint, first_row bigint, rows bigint, file string"


def write_shards(df: DataFrame, order: Sequence[str], path: str, rows_per_shard: int = 100_000) -> None:
    """Write ``df`` in ``order`` (a unique key) under ``path``, which must not exist yet. The index is
    written last: without it a run was cut off. ``df`` must have no columns ``row`` and ``shard``."""
    if rows_per_shard < 1:
        raise ValueError("rows_per_shard: at least 1")
    clash = {ROW, "shard"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the shards' own")
    spark, path = df.sparkSession, path.rstrip("/")
    ranked = exact_rank(df, list(order), rank_col=ROW).withColumn(ROW, F.col(ROW) - 1)
    shards = ranked.withColumn("shard", F.floor(F.col(ROW) / rows_per_shard).cast("bigint"))
    # A shard is in one task, so it is one file; its rows are sorted.
    shards.repartition("shard").sortWithinPartitions("shard", ROW).write.partitionBy("shard").parquet(f"{path}/data")
    data = spark.read.schema(shards.schema).parquet(f"{path}/data").select("shard", ROW, F.col("_metadata.file_path").alias("file"))
    index = data.groupBy("shard", "file").agg(F.min(ROW).alias("first_row"), F.count("*").alias("rows"))
    index.select("shard", "first_row", "rows", "file").write.parquet(f"{path}/index")


def shard_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{path.rstrip('/')}/index")


def read_rows(spark: SparkSession, path: str, first: int, stop: int | None = None) -> DataFrame:
    """The rows ``first .. stop-1`` (to the end without ``stop``) with their number in ``row``. The driver
    sees the names of the files of this range only."""
    index = shard_index(spark, path).where(F.col("first_row") + F.col("rows") > first)
    wanted = F.col(ROW) >= first
    if stop is not None:
        index, wanted = index.where(F.col("first_row") < stop), wanted & (F.col(ROW) < stop)
    files = [r.file for r in index.select("file").orderBy("first_row").collect()]
    data = f"{path.rstrip('/')}/data"
    if not files:  # nothing is there to take the schema from if the table is empty
        names = shard_index(spark, path).select("file").limit(1).collect()
        if not names:
            return spark.createDataFrame([], f"{ROW} bigint")
        return spark.read.option("basePath", data).parquet(names[0].file).drop("shard").where(F.lit(False))
    return spark.read.option("basePath", data).parquet(*files).drop("shard").where(wanted)


def read_batches(spark: SparkSession, path: str, batch_size: int, first_batch: int = 0, batches: int | None = None) -> DataFrame:
    """The full batches ``first_batch ..`` (at most ``batches`` of them) with ``batch_id``; a last batch
    that is not full is no batch."""
    total = shard_index(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    last = total // batch_size
    if batches is not None:
        last = min(last, first_batch + batches)
    rows = read_rows(spark, path, first_batch * batch_size, last * batch_size)
    return rows.withColumn("batch_id", F.floor(F.col(ROW) / batch_size).cast("bigint"))
