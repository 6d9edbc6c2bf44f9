"""Whitening of vectors from an exact scatter matrix, by bit slices.

Entries become integers. A task takes its rows in blocks, shifts each dimension of a block by its
least value and packs every bit of the shifted numbers across the rows into 64-bit words. The sum of
products of two dimensions is then the weighted sum of the popcounts of the ANDs of their bit planes;
undoing the shift gives the block's exact cross-products. Spark adds them up as integers, so the
scatter is the same for any partitioning; it is centred as integers too, and only the covariance
becomes floating point, once, before its eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import read, ship_package

SCALE, OFFSET = 1024, 100_000  # an entry c becomes floor(SCALE * c) + OFFSET
HELD = 1 << 45  # integers are held within +- this (entries of 3e10), so that sums of products have 38 digits
COMPONENTS = 8
BLOCK = 1 << 22  # entries of a block


def integers(x: np.ndarray) -> np.ndarray:
    return (np.clip(np.floor(x * float(SCALE)), -HELD, HELD)).astype(np.int64) + OFFSET


def bit_planes(y: np.ndarray) -> np.ndarray:
    """Bits of ``y`` (rows x dimensions, not negative) as words over the rows: bits x dimensions x words."""
    bits, words = max(1, int(y.max(initial=0)).bit_length()), -(-len(y) // 64)
    planes = np.zeros((bits, y.shape[1], 8 * words), np.uint8)
    for k in range(bits):
        packed = np.packbits(((y >> k) & 1).astype(bool), axis=0)
        planes[k, :, : len(packed)] = packed.T
    return planes.view(np.uint64)


def cross_products(planes: np.ndarray) -> np.ndarray:
    """Sums over the rows of products of all pairs of dimensions, as Python integers."""
    bits, dim, words = planes.shape
    kind = np.int64 if 2 * bits + (64 * words).bit_length() < 63 else object
    weights = np.array([1 << k for k in range(bits)], kind)
    total = np.zeros((dim, dim), object)
    for i in range(dim):
        for k in range(bits):
            count = np.bitwise_count(planes[k, i] & planes[:, i:]).sum(2, dtype=np.int64)
            total[i, i:] += ((weights @ count.astype(kind)) * weights[k]).astype(object)
        total[i:, i] = total[i, i:]
    return total


class Scatter:
    """Number of rows, sums, and sums of products, as integers."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, np.zeros(dim, object)
        self.products = np.zeros((dim, dim), object)

    def add(self, x: np.ndarray) -> None:
        n, least = len(x), x.min(axis=0)
        y = x - least
        m, s = least.astype(object), y.astype(object).sum(axis=0) if y.max() > 1 << 40 else y.sum(axis=0).astype(object)
        self.products = self.products + cross_products(bit_planes(y)) + np.outer(m, s) + np.outer(s, m) + n * np.outer(m, m)
        self.sums = self.sums + s + n * m
        self.n += n


class Model(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    explained: np.ndarray
    scale: np.ndarray  # 1 / sqrt(value), 0 where the value is 0 but for rounding
    identity_error: float


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vector)`` of the rows whose vector has entries, all of them finite numbers."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", odd))


def _by_length(b: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each vector length: their places and their entries."""
    col = b.column(k)
    flat, offsets = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    for dim in np.unique(size):
        at = np.nonzero(size == dim)[0]
        yield at, flat[offsets[at][:, None] + np.arange(dim)]


def scatter(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(dim, i, j, value decimal(38,0))`` for the ``vector`` column, per vector length: the sums of
    products of dimensions i <= j, the sums as j = -1, the number of rows as i = j = -1."""
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Scatter] = {}
        held: dict[int, list[np.ndarray]] = {}

        def add(dim: int) -> None:
            totals.setdefault(dim, Scatter(dim)).add(np.concatenate(held.pop(dim)))

        for b in batches:
            for _, x in _by_length(b, 0):
                dim = x.shape[1]
                held.setdefault(dim, []).append(integers(x))
                if sum(map(len, held[dim])) * dim >= block:
                    add(dim)
        for dim in sorted(held):
            add(dim)
        for dim, t in sorted(totals.items()):
            i, j = np.triu_indices(dim)
            value = [t.n, *t.sums, *t.products[i, j]]
            i, j = np.concatenate([[-1], np.arange(dim), i]), np.concatenate([[-1], np.full(dim, -1), j])
            cols = [pa.array(np.full(len(i), dim)), pa.array(i), pa.array(j), pa.array([Decimal(int(x)) for x in value], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(cols, ["dim", "i", "j", "value"])

    parts = vectors.select("vector").mapInArrow(run, "dim bigint, i bigint, j bigint, value decimal(38,0)")
    return parts.groupBy("dim", "i", "j").agg(F.sum("value").cast("decimal(38,0)").alias("value"))


def solve(n: int, sums: list[int], products: dict[tuple[int, int], int], components: int = COMPONENTS) -> Model:
    dim = len(sums)
    cov = np.zeros((dim, dim))
    for (i, j), p in products.items():
        cov[i, j] = cov[j, i] = (n * p - sums[i] * sums[j]) / (n * n)  # integers until here: rounded once
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(dim)] < 0, -1.0, 1.0)
    trace = np.trace(cov)
    real = values > values[0] * dim * np.finfo(float).eps
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
    explained = values / trace if trace else np.zeros(dim)
    k = min(components, dim)
    w = vectors[:, :k] * scale[:k]
    error = float(np.abs(w.T @ cov @ w - np.diag(real[:k].astype(float))).max())
    return Model(n, sums, values[:k], vectors[:, :k], explained[:k], scale[:k], error)


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, Model]:
    """A model per vector length. The driver gets one scatter matrix of each length: its size depends
    on the number of dimensions, not of rows."""
    by: dict[int, tuple] = {}
    for r in scatter(usable(vectors, id_col, vector_col)).collect():
        n, sums, products = by.setdefault(r.dim, ([0], [0] * r.dim, {}))
        if r.i < 0:
            n[0] = int(r.value)
        elif r.j < 0:
            sums[r.i] = int(r.value)
        else:
            products[r.i, r.j] = int(r.value)
    return {dim: solve(n[0], sums, products, components) for dim, (n, sums, products) in by.items()}


def _deviations(x: np.ndarray, model: Model) -> pa.Array:
    """Exact sums over the dimensions of (n x - S)^2."""
    most = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums))
    if most * most * x.shape[1] < 1 << 63:
        d = model.n * x - np.array(model.sums, np.int64)
        return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
    d = model.n * x.astype(object) - np.array(model.sums, object)
    exact = (d * d).sum(1)
    return pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def transform(vectors: DataFrame, models: dict[int, Model], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, dim, deviation decimal(38,0), whitened array<double>)``, one row per usable row."""
    ship_package(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, values in _by_length(b, 1):
                model = models[values.shape[1]]
                x = integers(values)
                centred = (x.astype(object) * model.n - np.array(model.sums, object)) if model.n.bit_length() + 47 > 62 else x * model.n - np.array(model.sums, np.int64)
                w = np.einsum("nd,dk->nk", (centred / model.n).astype(np.float64), model.vectors) * model.scale  # row by row, whatever the batch
                k = w.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.ravel()))
                cols = [b.column(0).take(pa.array(at)), pa.array(np.full(len(w), values.shape[1])), _deviations(x, model), lists]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "dim", "deviation", "whitened"])

    return usable(vectors, id_col, vector_col).mapInArrow(run, "vec_id bigint, dim bigint, deviation decimal(38,0), whitened array<double>")


def whitened(vectors: DataFrame, components: int = COMPONENTS, **kw) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row per usable row and
    component.

    Rows whose vector is null, empty or holds null or non-finite entries have none. Vectors of each
    length are whitened among themselves. A component without variance has ``whitened`` 0 (and 0
    in place of 1 in the identity). Null ids and repeated rows are rows like any other; an empty table
    gives no row; other columns are ignored. ``deviation`` has up to 38 digits (null beyond).
    """
    models = fit(vectors, components, **kw)
    spark = vectors.sparkSession
    facts = [(d, k + 1, m.n, float(m.explained[k]), m.identity_error) for d, m in sorted(models.items()) for k in range(len(m.values))]
    # Broadcast: a row per vector length and component.
    facts = F.broadcast(spark.createDataFrame(facts, "dim bigint, component int, n bigint, explained double, identity_error double"))
    rows = transform(vectors, models, **kw).select("vec_id", "dim", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    rows = rows.withColumn("component", F.col("pos") + 1)
    return rows.join(facts, ["dim", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
