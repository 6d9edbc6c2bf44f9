"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``NEAREST`` reference points (pivots) in order of nearness. It is entered
in the inverted lists of the first ``POSTED`` of them, with all of them. In a list, the entries' ordered
pivots are inverted once more, which counts the pivots that two entries share; pairs that share at
least ``SHARED`` are candidates, and candidates are verified by their cosine in double precision. A pair
meets in several lists and is counted in one of them only, that of its least common posted pivot.

Pivots grow with the square root of the number of vectors, so that lists do too. They come from a bounded sample
and lie apart from each other, so that a dense group does not use them up; all vectors are indexed.
Identical vectors are one entry with a count. A list with more than ``LIST`` entries is cut into pieces that
are compared pair by pair in tasks of their own, and a task returns link counts and a spanning forest,
never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import components, grouped, read, ship_package, written
from tunedata.llm.simhash import _forest

COSINE = 0.95
GROWTH = 4  # pivots per square root of the number of vectors
PIVOTS_LEAST, PIVOTS_MOST = 64, 16384  # the broadcast of pivots is bounded by the latter
SAMPLE = 4  # vectors that a pivot is chosen from, the first by a hash of their id
APART = (0.5, 0.7, 0.9)  # pivots' cosines with each other are below the first; if too few are, below the next
NEAREST, POSTED, SHARED = 12, 6, 2
LIST = 4096
ROWS = 512  # rows compared with a list, or with the pivots, at once


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision (first by their largest entry, against overflow)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """All rows as ``(vec_id, vector)``, with ``vector`` null where it can link with nothing, and the
    distinct vectors as ``(node, n, vector)`` with their smallest id and number of rows."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("v").isNotNull() & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0)
    rows = v.select("vec_id", F.when(usable, F.col("v")).alias("vector"))
    distinct = rows.where("vector IS NOT NULL AND vec_id IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    return rows, distinct.select("node", "n", "vector")


def pivots_for(vectors: int) -> int:
    return min(PIVOTS_MOST, max(PIVOTS_LEAST, math.ceil(GROWTH * math.sqrt(vectors))))


def choose_pivots(sample: list[np.ndarray], pivots: int) -> dict[int, np.ndarray]:
    """Per dimension: at most so many vectors of the sample, none close to one chosen before."""
    out: dict[int, np.ndarray] = {}
    for dim in sorted({len(v) for v in sample}):
        left = _unit(np.array([v for v in sample if len(v) == dim])).astype(np.float32)
        chosen = np.zeros((0, dim), np.float32)
        for apart in APART:
            for i in range(0, len(left), ROWS):
                block = left[i : i + ROWS]
                near = (block @ chosen.T).max(axis=1, initial=-1.0)
                each = block @ block.T
                for k in range(len(block)):
                    if near[k] < apart and len(chosen) < pivots:
                        chosen = np.concatenate([chosen, block[k : k + 1]])
                        near = np.maximum(near, each[k])
            if len(chosen) == pivots:
                break
        out[dim] = chosen
    return out


def describe(u: np.ndarray, pivots: np.ndarray | None, nearest: int = NEAREST) -> np.ndarray:
    """The numbers of the nearest pivots of each row, nearest first."""
    if pivots is None:
        return np.zeros((len(u), 0), np.int64)
    out = np.zeros((len(u), min(nearest, len(pivots))), np.int64)
    for i in range(0, len(u), ROWS):
        near = -(u[i : i + ROWS].astype(np.float32) @ pivots.T)
        k = out.shape[1]
        some = np.sort(np.argpartition(near, k - 1, axis=1)[:, :k], axis=1) if k else out[i : i + ROWS]
        order = np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable")
        out[i : i + ROWS] = np.take_along_axis(some, order, 1)
    return out


def _vectors(col) -> list[np.ndarray]:
    flat, offsets = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[i:j] for i, j in zip(offsets, offsets[1:])]


def _index(pivots: dict[int, np.ndarray], nearest: int, posted: int):
    """Entries -> one row per list that they are in, with their pivots in order. ``key`` numbers the list: its
    dimension and its pivot (none for a dimension without pivots in the sample: one list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, vs = b.column("node").to_numpy(), _vectors(b.column("vector"))
            dims = np.fromiter(map(len, vs), np.int64, len(vs))
            for dim in np.unique(dims):
                rows = np.nonzero(dims == dim)[0]
                near = describe(_unit(np.stack([vs[i] for i in rows])), pivots.get(int(dim)), nearest)
                keys = near[:, :posted] + 1 if near.shape[1] else np.zeros((len(rows), 1), np.int64)
                keys = keys + int(dim) * (PIVOTS_MOST + 1)
                piv = np.array([x.tobytes() for x in near.astype("<i2")], object)
                times = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(node[rows], times)), pa.array(keys.ravel()), pa.array(np.repeat(piv, times), pa.binary())],
                    ["node", "key", "pivots"],
                )

    return run


def _own_list(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows of posted pivots: the least that both have."""
    both = (a[:, :, None] == b[:, None, :]).any(2)
    return np.where(both, a, PIVOTS_MOST).min(axis=1, initial=PIVOTS_MOST)


def _lists_of(piv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverted lists of the rows' pivots: where each pivot's list starts, and the lists' rows."""
    order = np.argsort(piv, axis=None, kind="stable")
    starts = np.searchsorted(piv.ravel()[order], np.arange(PIVOTS_MOST + 1))
    return starts, order // max(1, piv.shape[1])


def _shared(piv: np.ndarray, lists: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """How many pivots each row of ``piv`` shares with each of the ``size`` rows behind ``lists``."""
    starts, rows = lists
    first, n = starts[piv.ravel()], starts[piv.ravel() + 1] - starts[piv.ravel()]
    x = np.repeat(np.arange(len(piv)).repeat(piv.shape[1]), n)
    at = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return np.bincount(x * size + rows[at], minlength=len(piv) * size).reshape(len(piv), size)


def _compare(cosine: float, posted: int, shared: int, rows_at_once: int):
    """Lists -> ``(node, links, other)``: either a link count to add, or a link of the forest."""

    def pairs_of(u, pu, v, pv, same):
        """Pairs that share enough pivots and are near enough."""
        least, lists = min(shared, pu.shape[1]), _lists_of(pv)
        for i in range(0, len(u), rows_at_once):
            some = slice(i, i + rows_at_once)
            candidate = _shared(pu[some], lists, len(v)) >= least
            x, y = np.nonzero(candidate & (u[some] @ v.T >= cosine))
            x = x + i
            if same:
                x, y = x[x < y], y[x < y]
            yield x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ("key", "p", "q")):
            size = len(g["pivots"][0]) // 2
            piv = np.frombuffer(b"".join(g["pivots"]), "<i2").reshape(len(g["node"]), size).astype(np.int64)
            dim = len(g["vector"][0]) // 8
            u = _unit(np.frombuffer(b"".join(g["vector"]), "<f8").reshape(-1, dim))
            node, n = g["node"], g["n"]
            p, q = g["p"][0], g["q"][0]
            if p == q:
                first = second = np.arange(len(node))
            else:
                first, second = np.nonzero(g["piece"] == p)[0], np.nonzero(g["piece"] == q)[0]
            pivot = int(g["key"][0]) % (PIVOTS_MOST + 1) - 1
            links = np.zeros(len(node), np.int64)
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for x, y in pairs_of(u[first], piv[first], u[second], piv[second], p == q):
                x, y = first[x], second[y]
                for c in range(0, len(x), 1 << 18):
                    xc, yc = x[c : c + (1 << 18)], y[c : c + (1 << 18)]
                    if size:
                        own = _own_list(piv[xc, :posted], piv[yc, :posted]) == pivot
                        xc, yc = xc[own], yc[own]
                    links += np.bincount(xc, n[yc], len(node)).astype(np.int64) + np.bincount(yc, n[xc], len(node)).astype(np.int64)
                    if len(xc):
                        a, b = _forest(np.concatenate([a, node[xc]]), np.concatenate([b, node[yc]]))
            hit = np.nonzero(links)[0]
            if len(hit):
                cols = [np.concatenate([node[hit], a]), np.concatenate([links[hit], np.zeros(len(a), np.int64)]), np.concatenate([node[hit], b])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "links", "other"])

    return run


def links(
    distinct: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, posted: int = POSTED, shared: int = SHARED, list_size: int = LIST,
    pivots: int | None = None,
) -> DataFrame:
    """``(node, links, other)`` for the entries of ``classes``: link counts (other is node) and the
    links of a forest over linked entries (links is 0)."""
    ship_package(distinct.sparkSession)

    @F.pandas_udf("binary")
    def as_binary(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, "<f8").tobytes())

    pivots = min(pivots or pivots_for(distinct.count()), PIVOTS_MOST)
    some = distinct.orderBy(F.xxhash64("node"), "node").limit(SAMPLE * pivots).select(as_binary("vector").alias("vector"))
    chosen = choose_pivots([np.frombuffer(r.vector, "<f8") for r in some.collect()], pivots)
    post = written(distinct.select("node", "vector").mapInArrow(_index(chosen, nearest, posted), "node bigint, key bigint, pivots binary"), "pivot-lists")
    # Lists of one entry can't link; vectors are attached to the others only.
    sizes = post.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    post = post.join(sizes.select("key", F.ceil(F.col("size") / list_size).cast("int").alias("pieces")), "key")
    packed = distinct.select("node", "n", as_binary(F.col("vector")).alias("vector"))
    post = post.join(packed, "node").withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    post = post.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    post = post.select("key", F.least("piece", "o").alias("p"), F.greatest("piece", "o").alias("q"), "piece", "node", "n", "pivots", "vector")
    tasks = post.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return tasks.mapInArrow(_compare(cosine, posted, shared, ROWS), "node bigint, links bigint, other bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", **kw) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Null, zero and not wholly finite vectors, and rows without an id, link with nothing (component:
    the own id); vectors of different lengths do not link. Rows that repeat an id and vector count
    as vectors of their own; rows that share an id only share its links. Other columns are ignored.
    """
    rows, distinct = classes(vectors, id_col, vector_col)
    distinct = written(distinct, "vector-classes")
    found = written(links(distinct, cosine, **kw), "vector-links")
    counts = found.where("node = other").groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    per = distinct.join(counts, "node", "left").join(comp, "node", "left")
    per = per.select(
        F.col("vector").alias("class_vector"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component")
    )
    can = F.col("vec_id").isNotNull()
    out = rows.join(per, can & (F.col("vector") == F.col("class_vector")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op3_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
