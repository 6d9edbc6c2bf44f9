"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.operators.batches import small
from tunedata.session import scratch_path, ship_package

__all__ = ["ASCII_SPACE", "WORD", "components", "grouped", "read", "row_key", "scratch_path", "ship_package", "small", "unused", "written"]

#: The contracts' word pattern and white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and reread: cuts the lineage,
    so what follows survives lost executors without recomputing what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(df: DataFrame) -> Column:
    """SHA-256 of all columns: equal for rows that are equal in all of them."""
    return F.sha2(F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}), 256)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a long, b long)`` -> ``(node long, component long)``,
    the component being the smallest node id of it. Nodes without an edge are not returned.

    Alternating large-star and small-star rounds: every node links its larger (then smaller)
    neighbours to its smallest one. A round moves two longs per edge, never a neighbour list, and
    its result is written, so a hub is just many rows of one join (which AQE can split) and the
    edge count never grows. The rounds grow with the logarithm of the longest chain.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "cc-edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        e = written(small.select("x.u", "x.v").where("u <> v").distinct(), "cc-edges")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of a partition sorted by the integer columns ``keys``, each as numpy columns.

    Holds one group and one Arrow batch at a time, without the cost that a call per group has.
    """
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        if held and any(held[-1][k][-1] != cols[k][0] for k in keys):
            yield {n: np.concatenate([h[n] for h in held]) for n in cols}
            held = []
        cuts = [0, *np.nonzero(change)[0].tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            part = {n: c[i:j] for n, c in cols.items()}
            if j < b.num_rows:
                yield {n: np.concatenate([*(h[n] for h in held), c]) for n, c in part.items()} if held else part
                held = []
            else:
                held.append(part)
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}
