"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within ``radius`` bits are linked; linked documents form components. Only distinct
fingerprints are compared, and each pair of them at most once. Two fingerprints can lie within
the radius only if the population counts of their four 16-bit quarters differ by no more than the
radius in sum, so the quarters' counts are the tile: a fingerprint goes to its own tile as a
resident and to the following tiles within reach as a visitor (at most 20 for radius 2), whatever
the corpus size. Tile pairs beyond the radius are never formed. Inside a tile numpy compares
blocks by exclusive-or and bit counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import components, grouped, read, row_key, ship_package, unused, written

SHINGLE = 3
RADIUS = 2
SEED = 42  # fixed value: of XXH64
BLOCK = 1 << 22  # fingerprint pairs compared at once (bounds a task's memory)
TILE_ROWS = 1 << 15  # rows of a tile that one task compares with each other


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the XXH64 of all word shingles, repeats included (no word: 0)."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle]))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """``(doc_id, fp long)``, and ``key`` from ``key_col`` if given; ``fp`` holds the 64 bits as a signed
    long. A null text has no words."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"", shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *key])

    key = ["key"] if key_col else []
    src = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *[F.col(key_col).alias(k) for k in key]
    )
    return src.mapInArrow(run, "doc_id bigint, fp bigint" + (", key string" if key else ""))


def _reach(radius: int) -> list[tuple[int, ...]]:
    """Steps to the tiles after one's own (in lexicographic order) whose counts lie within reach."""
    steps = product(range(-radius, radius + 1), repeat=4)
    return [s for s in steps if sum(map(abs, s)) <= radius and s > (0, 0, 0, 0)]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a[i]-b[i]`` reduced to one link per node, to the smallest node it can reach."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[: len(a)], idx[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _links_within(fa: np.ndarray, na: np.ndarray, fb: np.ndarray, nb: np.ndarray, radius: int, same: bool):
    """Links between two groups of fingerprints (or inside one), as a forest over their nodes."""
    got_a, got_b, held = [], [], 0
    step = max(1, BLOCK // max(1, len(fb)))
    for i in range(0, len(fa), step):
        x, y = np.nonzero(np.bitwise_count(fa[i : i + step, None] ^ fb[None, :]) <= radius)
        if same:
            x, y = x[x + i < y], y[x + i < y]
        if len(x):
            got_a.append(na[i + x])
            got_b.append(nb[y])
            held += len(x)
        if held > BLOCK:  # a dense group: keep a forest, not its pairs
            u, v = _forest(np.concatenate(got_a), np.concatenate(got_b))
            got_a, got_b, held = [u], [v], len(u)
    if not got_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(got_a), np.concatenate(got_b))


def links(classes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``classes (fp, node)``, one row per distinct fingerprint -> ``(a, b)``: links that connect
    exactly the nodes whose fingerprints are connected by pairs within ``radius`` bits.

    A tile with more rows than ``tile_rows`` is cut into pieces by hash and its pieces are
    compared pair by pair in tasks of their own.
    """
    ship_package(classes.sparkSession)
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(4)]
    steps = F.array(*[F.array(*[F.lit(v) for v in s]) for s in [(0, 0, 0, 0), *_reach(radius)]])
    rows = classes.select("fp", "node", *[q.alias(f"q{k}") for k, q in enumerate(quarter)], F.explode(steps).alias("s"))

    def tile(shift: bool) -> Column:
        parts = [F.col(f"q{k}") + (F.col("s")[k] if shift else 0) for k in range(4)]
        return sum((p * (17 ** (3 - k)) for k, p in enumerate(parts)), F.lit(0))

    inside = F.lit(True)
    for k in range(4):
        inside &= (F.col(f"q{k}") + F.col("s")[k]).between(0, 16)
    rows = rows.where(inside).select("fp", "node", tile(True).alias("tile"), (tile(True) == tile(False)).alias("home"))
    # Which tiles have residents, and how many pieces they need: one row per tile (at most 17^4).
    count = rows.groupBy("tile").agg(F.count("*").alias("n"), F.count_if("home").alias("residents"))
    count = count.where("residents > 0").select("tile", F.ceil(F.col("n") / tile_rows).cast("int").alias("pieces"))
    # Broadcast: bounded by the number of tiles, 17^4 rows of two numbers, whatever the corpus.
    rows = rows.join(F.broadcast(count), "tile").withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    # Piece p of a tile meets each piece q: as (min, max), so that each pair of pieces meets once.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select("tile", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), "piece", "fp", "node", "home")

    def compare(p, q, piece, fp, node, home):
        if p == q:
            yield _links_within(fp[home], node[home], fp[home], node[home], radius, True)
            yield _links_within(fp[home], node[home], fp[~home], node[~home], radius, False)
            return
        x, y = piece == p, piece == q
        for a, b in ((x & home, y & home), (x & home, y & ~home), (y & home, x & ~home)):
            yield _links_within(fp[a], node[a], fp[b], node[b], radius, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in grouped(batches, ("tile", "p", "q")):
            found = list(compare(cols["p"][0], cols["q"][0], cols["piece"], cols["fp"].view(np.uint64), cols["node"], cols["home"]))
            if any(len(a) for a, _ in found):
                a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    tasks = rows.repartition("tile", "p", "q").sortWithinPartitions("tile", "p", "q")
    return tasks.mapInArrow(run, "a bigint, b bigint")


def _roots(fps: DataFrame, radius: int) -> DataFrame:
    """``(fp, root)``, one row per distinct fingerprint: ``root`` is the smallest fingerprint of its
    component. A fingerprint is its own node, so rows without an id link like any other."""
    nodes = written(fps.select("fp").distinct(), "simhash-classes")
    comp = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    return nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, **cols: str) -> DataFrame:
    """``(doc_id, fp long, component_id long)``, one row per input row.

    Null and blank texts have fingerprint zero and link like any other; equal fingerprints are one
    class. ``component_id`` is the smallest doc_id of the component, also for its rows without an id
    (null if the component has no id). Other columns are ignored.
    """
    fps = written(fingerprints(docs, shingle, **cols), "simhash-fp")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    classes = written(_roots(fps, radius).join(least, "fp"), "simhash-roots")
    # written: a join with a plain table, which AQE may split or broadcast by measured size
    lowest = written(classes.groupBy("root").agg(F.min("node").alias("component_id")), "simhash-lowest")
    return fps.join(classes.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` per component: that with the smallest id; rows without an id come last, and
    ties are decided by the fingerprint and the hash of the row."""
    row = unused(docs, "simhash_key")
    keyed = docs.withColumn(row, row_key(docs))
    fps = written(fingerprints(keyed, shingle, key_col=row), "simhash-fp")
    least = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x"))
    classes = _roots(fps, radius).join(least, "fp")
    best = classes.groupBy("root").agg(F.min(F.struct("x.none", "x.doc_id", "fp", "x.key")).alias("x"))
    kept = keyed.join(best.select(F.col("x.key").alias(row)), row, "left_semi")
    return kept.dropDuplicates([row]).select(*docs.columns)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(read(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
