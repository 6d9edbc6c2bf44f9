"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, queries walk it.

Nodes are the distinct vectors. They are numbered along a tree of hyperplanes from a bounded sample
(``SAMPLE`` vectors), so that near vectors mostly have near numbers, and stored in blocks of ``BLOCK``
numbers, entries as 8-bit integers of one scale per vector. A node's list starts with the best of its
block and some random nodes. Each round of NN-descent joins the lists with themselves on the common
neighbour: of what a node has as neighbours or is a neighbour of, a sample of ``SIDE`` fresh and
``SIDE`` older ones each way is compared pair by pair where one of the two is fresh, and a pair
enters both lists if it is better than their last entry. Rounds end when few entries change.

For inner products all vectors get one more coordinate that makes them equally long, so that
near means near for the graph (neighbours of neighbours are worth a look); a query has 0 there.
A query starts at its own node, if it has one, and at ``STARTS`` others, keeps the best ``BEAM`` nodes
and looks at the links (lists and their best reverses) of all of these, ``STEP`` at a time. Its best
``EXACT`` nodes are scored again on the original vectors in double precision.

Every step is a shuffle by block: nodes of a block ask other blocks for vectors once per block, and each
block of queries for scores. Tables of a round are written, so a lost executor costs one round.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunedata.llm.common import read, ship_package, written
from tunedata.plans.rank import exact_rank

K = 20
SAMPLE = 8192  # vectors that the tree's planes come from, the first by a hash of their id
LEAF = 512  # nodes of a leaf of the tree, about
PLANES = 1 << 19  # entries of all planes at most
BLOCK = 1024
DEGREE = 32  # length of a list
RANDOM = 8  # of a list's first entries
SIDE = 16
SETTLED = 0.002  # rounds end when so small a share of all entries changes
ROUNDS = 30
REVERSE = 64  # links at most that a node gets from the lists of others, the best
STARTS = 16
BEAM = 256
STEP = 64
EXACT = 48
QUERIES = 32  # queries of a block

MESSAGE = "block bigint, kind int, src bigint, data binary"
POINTS, LISTS, EDGES, WANT, VECTORS, FOUND, LINKS, STATE, SEEN, NEIGHBOURS, ASK, SCORED, EXPAND = range(13)


# --- messages: rows to a block, their content pickled numpy arrays -----------------------------------


def _message(block, kind: int, src, *content) -> tuple:
    return int(block), kind, int(src), pickle.dumps(content, 5)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["block", "kind", "src", "data"])

    for r in rows:
        held.append(r)
        size += len(r[3])
        if size > 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _each(df: DataFrame, f: Callable) -> DataFrame:
    """``f(block, {kind: [(src, content), ..]})`` for every row on its own."""

    def run(batches):
        for b in batches:
            for block, kind, src, data in zip(*(c.to_pylist() for c in b.columns)):
                yield from _batches(f(block, {kind: [(src, pickle.loads(data))]}))

    return df.mapInArrow(run, MESSAGE)


def _by_block(f: Callable, *tables: DataFrame) -> DataFrame:
    """``f`` for all rows of a block together, in the order of kind and sender."""
    df = tables[0]
    for t in tables[1:]:
        df = df.unionByName(t)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        at, held = None, {}

        def done():
            if at is not None:
                yield from _batches(f(at, held))

        for b in batches:
            for block, kind, src, data in zip(*(c.to_pylist() for c in b.columns)):
                if block != at:
                    yield from done()
                    at, held = block, {}
                held.setdefault(kind, []).append((src, pickle.loads(data)))
        yield from done()

    return df.repartition(parts, "block").sortWithinPartitions("block", "kind", "src").mapInArrow(run, MESSAGE)


def _to_blocks(kind: int, src: int, by: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """One message to the block of each node of ``by``, with its rows of ``arrays``."""
    block = by // BLOCK
    order = np.argsort(block, kind="stable")
    targets, first = np.unique(block[order], return_index=True)
    for t, i, j in zip(targets, first, [*first[1:], len(order)]):
        yield _message(t, kind, src, *(a[order[i:j]] for a in arrays))


def _concat(messages: list, n: int, kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, kinds[i]), *(m[1][i] for m in messages)]) for i in range(n)]


def _places(sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each row among those of its key."""
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))[: len(sorted_keys)]
    first = np.nonzero(new)[0]
    return np.arange(len(sorted_keys)) - np.repeat(first, np.diff([*first, len(sorted_keys)]))


# --- nodes --------------------------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vector)``: the distinct rows that take part."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", odd) & F.exists("vector", lambda x: x != 0)).distinct()


def _matrix(col, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    flat, offsets = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


class Tree(NamedTuple):
    normals: np.ndarray
    limits: np.ndarray
    depth: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            right = np.einsum("nd,nd->n", x, self.normals[at]) > self.limits[at]
            at = 2 * at + 1 + right
        return at


def grow_tree(sample: np.ndarray, depth: int) -> Tree:
    """Each plane lies between two vectors of its part of the sample, at the part's median."""
    rng = np.random.default_rng(0)
    normals, limits = np.zeros((max(1, (1 << depth) - 1), sample.shape[1])), np.zeros(max(1, (1 << depth) - 1))
    parts = {0: np.arange(len(sample))}
    for k in range((1 << depth) - 1):
        rows = parts.pop(k)
        if len(rows) > 1:
            a, b = rng.choice(rows, 2, replace=False)
            normals[k] = sample[a] - sample[b]
            at = sample[rows] @ normals[k]
            limits[k] = np.median(at)
            parts[2 * k + 1], parts[2 * k + 2] = rows[at <= limits[k]], rows[at > limits[k]]
        else:
            parts[2 * k + 1] = parts[2 * k + 2] = rows
    return Tree(normals, limits, depth)


class Index(NamedTuple):
    nodes: DataFrame  # node, vector
    members: DataFrame  # node, vec_id
    points: DataFrame  # messages
    links: DataFrame  # messages
    dim: int
    n: int


def _pack_points(dim: int, longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done():
            if at is not None:
                x = np.concatenate(held)
                factor = np.abs(x).max(axis=1) / 127
                extra = np.sqrt(np.maximum(longest - (x * x).sum(1), 0))
                yield from _batches(iter([_message(at, POINTS, 0, np.rint(x / factor[:, None]).astype(np.int8), factor.astype(np.float32), extra.astype(np.float32))]))

        for b in batches:
            block, x = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            cuts = [0, *(np.nonzero(np.diff(block))[0] + 1).tolist(), len(block)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j and block[i] != at:
                    yield from done()
                    at, held = block[i], []
                held.append(x[i:j])
        yield from done()

    return run


def _floats(codes, factor, extra) -> np.ndarray:
    return np.concatenate([codes * factor[:, None], extra[:, None]], 1).astype(np.float32)


# --- NN-descent -----------------------------------------------------------------------------------


def best_of(u, w, s, fresh, most: int):
    """Per u the ``most`` best distinct w; of equal pairs the older entry."""
    order = np.lexsort((fresh, w, u))
    order = order[np.concatenate(([True], (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])))[: len(order)]]
    order = order[np.lexsort((w[order], -s[order], u[order]))]
    order = order[_places(u[order]) < most]
    return u[order], w[order], s[order], fresh[order]


def _as_lists(u, w, s, fresh, first: int, size: int, degree: int):
    """Rows sorted by u and rank -> lists of the nodes ``first`` and on."""
    out = np.full((size, degree), -1, np.int64), np.full((size, degree), -np.inf, np.float32), np.zeros((size, degree), bool)
    at = u - first, _places(u)
    for table, values in zip(out, (w, s, fresh)):
        table[at] = values
    return out


def _first_lists(n: int, degree: int):
    def f(block, got):
        z = _floats(*got[POINTS][0][1])
        first, size = block * BLOCK, len(z)
        s = z @ z.T
        np.fill_diagonal(s, -np.inf)
        k = min(degree - min(RANDOM, degree // 2), size - 1)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((size, 0), np.int64)
        rng = np.random.default_rng(block)
        far = rng.integers(0, n, (size, degree))  # more than needed: some repeat
        u = np.arange(first, first + size)
        us = np.concatenate([np.repeat(u, k), np.repeat(u, degree)])
        ws = np.concatenate([(top + first).ravel(), far.ravel()])
        # Random nodes come last, in a random order, until their scores are known.
        ss = np.concatenate([np.take_along_axis(s, top, 1).ravel(), -1e38 * (1 + rng.random(far.size).astype(np.float32))]).astype(np.float32)
        ok = us != ws
        lists = _as_lists(*best_of(us[ok], ws[ok], ss[ok], np.ones(ok.sum(), bool), degree), first, size, degree)
        yield _message(block, LISTS, size, *lists)

    return f


def _sampled(lists, block: int, turn: int, side: int):
    """What of the lists takes part in a round: (rows, places) of fresh and of older entries."""
    nbr, _, fresh = lists
    key = np.random.default_rng([block, turn]).random(nbr.shape, np.float32)
    out = []
    for mask in (fresh & (nbr >= 0), ~fresh & (nbr >= 0)):
        order = np.argsort(np.where(mask, key, 2), axis=1)[:, :side]
        rows, cols = np.nonzero(np.take_along_axis(mask, order, 1))
        out.append((rows, order[rows, cols]))
    return out


def _some(target, other, most: int, rng):
    """At most ``most`` of the pairs of each target."""
    order = np.lexsort((rng.random(len(target)), target))
    order = order[_places(target[order]) < most]
    return target[order], other[order]


def _sample_edges(turn: int, side: int):
    def f(block, got):
        lists = got[LISTS][0][1]
        rng = np.random.default_rng([block, turn, 1])
        for fresh, (rows, cols) in zip((True, False), _sampled(lists, block, turn, side)):
            v, u = rows + block * BLOCK, lists[0][rows, cols]
            yield _message(block, EDGES, block, v, u, np.full(len(v), fresh), np.zeros(len(v), bool))
            u, v = _some(u, v, side, rng)
            yield from _to_blocks(EDGES, block, u, u, v, np.full(len(v), fresh), np.ones(len(v), bool))

    return f


def _gather(turn: int, side: int):
    """Both sides of a node's sample, the reverse one cut to ``side``; asks for the vectors, once each."""

    def f(block, got):
        v, u, fresh, back = _concat(got[EDGES], 4, (np.int64, np.int64, bool, bool))
        rng = np.random.default_rng([block, turn, 2])
        sides = []
        for kind in (True, False):
            there = ~back & (fresh == kind)
            rv, ru = _some(v[back & (fresh == kind)], u[back & (fresh == kind)], side, rng)
            sides.append((np.concatenate([v[there], rv]), np.concatenate([u[there], ru]), np.full(there.sum() + len(rv), kind)))
        v, u, fresh = (np.concatenate(x) for x in zip(*sides))
        order = np.lexsort((~fresh, u, v))  # an edge that is fresh on one side is fresh
        order = order[np.concatenate(([True], (v[order][1:] != v[order][:-1]) | (u[order][1:] != u[order][:-1])))[: len(order)]]
        yield _message(block, EDGES, 0, (v[order] - block * BLOCK).astype(np.int16), u[order], fresh[order])
        want = np.unique(u)
        yield from _to_blocks(WANT, block, want, want)

    return f


def _serve(block, got):
    codes, factor, extra = got[POINTS][0][1]
    worst = got[LISTS][0][1][1][:, -1]
    for src, (nodes,) in got.get(WANT, ()):
        at = nodes - block * BLOCK
        yield _message(src, VECTORS, block, nodes, codes[at], factor[at], extra[at], worst[at])


def _padded(v, u) -> np.ndarray:
    """Rows sorted by v -> one row per node of the block, padded with -1."""
    at = _places(v)
    out = np.full((BLOCK, int(at.max(initial=-1)) + 1), -1, np.int64)
    out[v, at] = u
    return out


def _join_neighbours(degree: int, rows: int = 64):
    def f(block, got):
        if VECTORS not in got or EDGES not in got:
            return
        v, u, fresh = got[EDGES][0][1]
        v = v.astype(np.int64)
        parts = [m[1] for m in got[VECTORS]]
        nodes = np.concatenate([p[0] for p in parts])
        z = np.concatenate([_floats(*p[1:4]) for p in parts])
        worst = np.concatenate([p[4] for p in parts])
        order = np.argsort(nodes)
        nodes, z, worst = nodes[order], z[order], worst[order]
        u = np.searchsorted(nodes, u)
        new, old = (_padded(v[m], u[m]) for m in (fresh, ~fresh))
        found = []
        for i in range(0, BLOCK, rows):
            a = new[i : i + rows]
            b = np.concatenate([a, old[i : i + rows]], 1)
            s = z[a] @ z[b].transpose(0, 2, 1)
            ok = (a >= 0)[:, :, None] & (b >= 0)[:, None, :] & (a[:, :, None] != b[:, None, :])
            left, right = np.broadcast_to(a[:, :, None], s.shape), np.broadcast_to(b[:, None, :], s.shape)
            for x, y in ((left, right), (right, left)):
                m = ok & (s > worst[x])
                found.append((x[m], y[m], s[m]))
        x, y, s = (np.concatenate(c) for c in zip(*found))
        x, y, s, _ = best_of(x, y, s, np.zeros(len(x), bool), degree)
        yield from _to_blocks(FOUND, block, nodes[x], nodes[x], nodes[y], s)

    return f


def _merge(turn: int, side: int, degree: int):
    def f(block, got):
        nbr, s, fresh = lists = got[LISTS][0][1]
        fresh = fresh.copy()
        fresh[_sampled(lists, block, turn, side)[0]] = False
        first, size = block * BLOCK, len(nbr)
        u, w, t = _concat(got.get(FOUND, []), 3, (np.int64, np.int64, np.float32))
        rows, cols = np.nonzero(nbr >= 0)
        have = rows + first, nbr[rows, cols], s[rows, cols], fresh[rows, cols]
        # A pair that is found again brings the score of a random entry.
        known = have[2] > -1e37
        again = ~known & np.isin(have[0] << 20 ^ have[1] * 0x9E3779B1, u << 20 ^ w * 0x9E3779B1)
        have = tuple(c[~again] for c in have)
        all_u, all_w = np.concatenate([have[0], u]), np.concatenate([have[1], w])
        all_s, all_f = np.concatenate([have[2], t]), np.concatenate([have[3], np.ones(len(u), bool)])
        out = _as_lists(*best_of(all_u, all_w, all_s, all_f, degree), first, size, degree)
        changed = int((out[2] & (out[0] != nbr)).sum())
        yield _message(block, LISTS, changed, *out)

    return f


def _reverse(most: int):
    def f(block, got):
        nbr, s, _ = got[LISTS][0][1]
        rows, cols = np.nonzero(nbr >= 0)
        u, v, s = nbr[rows, cols], rows + block * BLOCK, s[rows, cols]
        u, v, s, _ = best_of(u, v, s, np.zeros(len(u), bool), most)
        yield from _to_blocks(FOUND, block, u, u, v, s)

    return f


def _links(most: int):
    def f(block, got):
        nbr = got[LISTS][0][1][0]
        u, v, s = _concat(got.get(FOUND, []), 3, (np.int64, np.int64, np.float32))
        u, v, _, _ = best_of(u, v, s, np.zeros(len(u), bool), most)
        rows, cols = np.nonzero(nbr >= 0)
        a, b = np.concatenate([rows, u - block * BLOCK]), np.concatenate([nbr[rows, cols], v])
        order = np.lexsort((b, a))
        order = order[np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))[: len(order)]]
        ends = np.concatenate([[0], np.cumsum(np.bincount(a[order], minlength=len(nbr)))])
        yield _message(block, LINKS, 0, ends, b[order])

    return f


def build(vectors: DataFrame, degree: int = DEGREE, side: int = SIDE, settled: float = SETTLED, rounds: int = ROUNDS) -> Index | None:
    """The index of ``usable`` rows (None without any). Equal vectors are one node."""
    spark = vectors.sparkSession
    ship_package(spark)
    nodes = written(vectors.groupBy("vector").agg(F.min("vec_id").alias("least")), "ann-classes")
    n, dim, longest = nodes.agg(
        F.count("*"), F.max(F.size("vector")), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    ).first()
    if not n:
        return None
    depth = max(0, min(math.ceil(math.log2(n / LEAF)) if n > LEAF else 0, int(math.log2(max(2, PLANES / dim)))))
    sample = nodes.orderBy(F.xxhash64("least"), "least").limit(SAMPLE).select("vector").collect()
    tree = grow_tree(_matrix(pa.array([r.vector for r in sample], pa.list_(pa.float64())), dim), depth)

    def leaves(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf(_matrix(b.column(0), dim)))], ["vector", "least", "leaf"])

    placed = nodes.select("vector", "least").mapInArrow(leaves, "vector array<double>, least bigint, leaf bigint")
    placed = exact_rank(placed, ["leaf", F.xxhash64("least"), "least"], rank_col="node").withColumn("node", F.col("node") - 1)
    nodes = written(placed.select("node", "least", "vector"), "ann-nodes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = nodes.withColumn("block", F.floor(F.col("node") / BLOCK)).repartition(parts, "block").sortWithinPartitions("block", "node")
    points = written(blocks.select("block", "vector").mapInArrow(_pack_points(dim, longest), MESSAGE), "ann-points")
    lists = written(_each(points, _first_lists(n, degree)), "ann-lists")
    for turn in range(rounds):
        near = written(_by_block(_gather(turn, side), _each(lists, _sample_edges(turn, side))), "ann-edges")
        served = _by_block(_serve, near.where(F.col("kind") == WANT), points, lists)
        found = _by_block(_join_neighbours(degree), near.where(F.col("kind") == EDGES), served)
        lists = written(_by_block(_merge(turn, side, degree), lists, found), "ann-lists")
        if lists.agg(F.sum("src")).first()[0] <= settled * n * degree:
            break
    links = written(_by_block(_links(REVERSE), lists, _each(lists, _reverse(REVERSE))), "ann-links")
    members = vectors.join(nodes.select("node", F.col("vector").alias("class")), F.col("vector") == F.col("class")).select("node", "vec_id")
    return Index(nodes.select("node", "vector"), written(members, "ann-members"), points, links, dim, n)


# --- greedy search ----------------------------------------------------------------------------------

_NODE = 48  # bits of a node's number beside a query's


def _states(dim: int, n: int, beam: int):
    """Queries of a block -> their state, and the nodes they start at as if these were neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        starts = np.unique(np.linspace(0, n - 1, STARTS).astype(np.int64))

        def done():
            if at is None:
                return
            keys, own = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            x = np.concatenate([h[2] for h in held]).astype(np.float32)
            m = len(keys)
            q = np.arange(m, dtype=np.int64) << _NODE
            first = np.unique(np.concatenate([(q[:, None] | starts).ravel(), (q | own)[own >= 0]]))
            pool = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, np.float32), np.zeros((m, beam), bool)
            yield from _batches(iter([_message(at, STATE, 1, keys, x, *pool), _message(at, NEIGHBOURS, 0, first)]))

        for b in batches:
            block, key, own = (b.column(i).to_numpy() for i in range(3))
            x = _matrix(b.column(3), dim)
            cuts = [0, *(np.nonzero(np.diff(block))[0] + 1).tolist(), len(block)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j and block[i] != at:
                    yield from done()
                    at, held = block[i], []
                held.append((key[i:j], own[i:j], x[i:j]))
        yield from done()

    return run


def _ask(block, got):
    """Asks for the scores of neighbours not seen before."""
    keys, x, nodes, s, done = got[STATE][0][1]
    seen = np.cumsum(got[SEEN][0][1][0]) if SEEN in got else np.zeros(0, np.int64)
    new = np.unique(_concat(got.get(NEIGHBOURS, []), 1, (np.int64,))[0])
    at = np.searchsorted(seen, new)
    if len(seen):
        new = new[seen[np.minimum(at, len(seen) - 1)] != new]
    seen = np.sort(np.concatenate([seen, new]), kind="stable")
    yield _message(block, STATE, 0, keys, x, nodes, s, done)
    yield _message(block, SEEN, 0, np.diff(seen, prepend=0))  # small numbers, which compress
    q, node = new >> _NODE, new & ((1 << _NODE) - 1)
    order = np.argsort(node // BLOCK, kind="stable")
    q, node = q[order], node[order]
    targets, first = np.unique(node // BLOCK, return_index=True)
    for t, i, j in zip(targets, first, [*first[1:], len(node)]):
        used, qs = np.unique(q[i:j], return_inverse=True)
        yield _message(t, ASK, block, used.astype(np.int32), x[used], s[used, -1], qs.astype(np.int32), node[i:j])


def _score(block, got):
    if ASK not in got:
        return
    codes, factor, _ = got[POINTS][0][1]
    for src, (used, x, worst, q, node) in got[ASK]:
        at = node - block * BLOCK
        s = np.einsum("nd,nd->n", codes[at].astype(np.float32), x[q]) * factor[at]
        m = s > worst[q]
        if m.any():
            yield _message(src, SCORED, block, used[q[m]].astype(np.int64), node[m], s[m])


def _advance(step: int):
    """Takes scores into the beams; the next ``step`` nodes of each that were not looked at are next."""

    def f(block, got):
        keys, x, nodes, s, done = got[STATE][0][1]
        q, w, t = _concat(got.get(SCORED, []), 3, (np.int64, np.int64, np.float32))
        rows, cols = np.nonzero(nodes >= 0)
        flag = np.concatenate([done[rows, cols], np.zeros(len(q), bool)])
        q, w, t, flag = best_of(np.concatenate([rows, q]), np.concatenate([nodes[rows, cols], w]), np.concatenate([s[rows, cols], t]), flag, nodes.shape[1])
        nodes, s, done = _as_lists(q, w, t, flag, 0, len(keys), nodes.shape[1])
        left = (nodes >= 0) & ~done
        go = left & (np.cumsum(left, axis=1) <= step)
        done |= go
        rows, cols = np.nonzero(go)
        yield _message(block, STATE, len(rows), keys, x, nodes, s, done)
        yield from _to_blocks(EXPAND, block, nodes[rows, cols], rows, nodes[rows, cols])

    return f


def _expand(block, got):
    if EXPAND not in got:
        return
    ends, nbr = got[LINKS][0][1]
    for src, (q, node) in got[EXPAND]:
        at = node - block * BLOCK
        size = ends[at + 1] - ends[at]
        flat = np.repeat(ends[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        yield _message(src, NEIGHBOURS, block, np.unique(np.repeat(q, size) << _NODE | nbr[flat]))


def search(index: Index, queries: DataFrame, k: int = K, beam: int = BEAM, step: int = STEP, exact: int = EXACT) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for ``queries (query_id, vector)``: the ``k`` largest inner products
    found with vectors of other ids, ties to the smaller id.

    Queries need not be rows of the index. Each distinct pair of id and vector is a query.
    """
    spark = queries.sparkSession
    ship_package(spark)
    own = index.nodes.select(F.col("vector").alias("v"), "node")
    queries = queries.select("query_id", "vector").distinct().join(own, F.col("vector") == F.col("v"), "left").select("query_id", "vector", "node")
    queries = exact_rank(queries, [F.coalesce("node", F.lit(-1)), "query_id", F.xxhash64("vector")], rank_col="key")
    queries = written(queries.withColumn("key", F.col("key") - 1), "ann-queries")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = queries.select(F.floor(F.col("key") / QUERIES).alias("block"), "key", F.coalesce("node", F.lit(-1)).alias("own"), "vector")
    first = first.repartition(parts, "block").sortWithinPartitions("block", "key").mapInArrow(_states(index.dim, index.n, beam), MESSAGE)
    state = written(first, "ann-state")
    near, seen = state.where(F.col("kind") == NEIGHBOURS), state.where(F.col("kind") == SEEN)
    while True:
        asked = written(_by_block(_ask, state.where(F.col("kind") == STATE), near, seen), "ann-asked")
        seen = asked.where(F.col("kind") == SEEN)
        scored = _by_block(_score, asked.where(F.col("kind") == ASK), index.points)
        state = written(_by_block(_advance(step), asked.where(F.col("kind") == STATE), scored), "ann-state")
        if not state.where(F.col("kind") == STATE).agg(F.sum("src")).first()[0]:
            break
        near = _by_block(_expand, state.where(F.col("kind") == EXPAND), index.links)

    def rows(batches):
        for b in batches:
            for data in b.column("data").to_pylist():
                keys, _, nodes, *_ = pickle.loads(data)
                r, c = np.nonzero(nodes[:, :exact] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(keys[r]), pa.array(nodes[r, c])], ["key", "node"])

    found = state.where(F.col("kind") == STATE).mapInArrow(rows, "key bigint, node bigint")
    product = F.aggregate(F.zip_with("vector", "v", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    found = found.join(queries.select("key", "query_id", "vector"), "key").join(index.nodes.select("node", F.col("vector").alias("v")), "node")
    found = found.select("key", "query_id", "node", product.alias("score"))
    # Of equal vectors the k + 1 smallest ids can be in an answer.
    least = index.members.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(f"place <= {k + 1}")
    found = found.join(least.select("node", "vec_id"), "node").where("vec_id <> query_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(f"rank <= {k}")
    return found.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", **kw) -> DataFrame:
    """``search`` of the rows whose id is divisible by ``every`` among all rows.

    Rows without an id, and vectors that are null, zero or hold null or non-finite entries, take no part;
    a shorter vector counts as padded with zeros; repeated rows count once; other columns are ignored; an
    empty table gives no row.
    """
    rows = written(usable(vectors, id_col, vector_col), "ann-rows")
    index = build(rows)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return search(index, rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), k, **kw)


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
