"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its state score sees features of the line and of both neighbours; the
chain's transitions let clean-looking lines inside a bad document be judged by their context.
Forward-backward gives each line's marginal probability of being good; their mean weighted by
line length is the document's score.

Training takes a bounded sample (``SAMPLE`` labelled documents per class, the first by a hash of
their id), each line marked with its document's label, and maximises the chain's likelihood on the
driver; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import read, ship_package, small

SAMPLE = 3000  # training documents per class
LINES = 128  # consecutive lines that a training document gives at most, from a place that its text decides
ROUNDS = 200  # steps of the optimiser
DECAY = 1e-3  # of the weights
SLICE = 4 << 20  # bytes of text handled together

# Classes of bytes that are counted per line.
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>", b"|", b"!", b".,;:?'\"()-",
    bytes(range(0x80, 0x100)), b"@[]^_`{}~+=/\\",
)
_TABLE = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _TABLE[list(_chars)] = _k + 1

# Ratios that also enter as "more than": column, limit. Junk is a matter of degree only up to a point.
_LIMITS = ((0, 0.5), (3, 0.05), (4, 0.05), (5, 0.05), (len(_CLASSES), 0.3), (len(_CLASSES) + 1, 0.5))
# Ratios of classes, words equal to the one before, words seen before in the line, words per byte,
# log length, line seen before in the text, the limits, and 1 (0 for a neighbour that is missing).
N_OWN = len(_CLASSES) + 5 + len(_LIMITS) + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word, their lengths in bytes, and the number of lines of each text."""
    lines_of = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    count = np.fromiter(map(len, lines_of), np.int64, len(texts))
    lines = [x for ls in lines_of for x in ls]
    if not lines:
        return np.zeros((0, 3 * N_OWN)), np.zeros(0), count
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    cls = _TABLE[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    starts = np.concatenate(([0], np.cumsum(length + 1)[:-1]))
    own = np.zeros((len(lines), N_OWN))
    for k in range(len(_CLASSES)):
        own[:, k] = np.add.reduceat(cls == k + 1, starts, dtype=np.int64) / length
    at = len(_CLASSES)
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.int64, len(lines))
    own[:, at] = np.fromiter((sum(map(eq, w, w[1:])) for w in words), np.int64, len(lines)) / n_words
    own[:, at + 1] = 1 - np.fromiter((len(set(w)) for w in words), np.int64, len(lines)) / n_words
    own[:, at + 2] = n_words / length
    own[:, at + 3] = np.log(length)
    again = []
    for ls in lines_of:
        seen: set[bytes] = set()
        for x in ls:
            again.append(x in seen)
            seen.add(x)
    own[:, at + 4] = again
    for k, (column, limit) in enumerate(_LIMITS):
        own[:, at + 5 + k] = own[:, column] > limit
    own[:, -1] = 1.0
    first = np.zeros(len(lines), bool)
    first[(np.cumsum(count) - count)[count > 0]] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    before[first] = 0  # no line before: all zero, also the last column
    after[:-1] = own[1:]
    after[:-1][first[1:]] = 0
    return np.concatenate([own, before, after], 1), length.astype(np.float64), count


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the state "good" against "bad"
    transitions: np.ndarray  # 2 x 2
    prior: float  # score of a text without lines


class _Chains:
    """Lines of many chains, in the order of time: step t holds the t-th line of every chain that has
    one, the longest chains first."""

    def __init__(self, count: np.ndarray):
        starts = np.cumsum(count) - count
        by = np.argsort(-count, kind="stable")
        active = np.searchsorted(-count[by], -np.arange(1, count.max(initial=0) + 1), "right")
        self.steps = [starts[by[:n]] + t for t, n in enumerate(active)]

    def marginals(self, u: np.ndarray, trans: np.ndarray):
        """Marginals of "good" per line, pair marginals summed (2 x 2), and the log normaliser summed."""
        e = np.exp(trans - trans.max())
        p = 1 / (1 + np.exp(-u))
        local = np.stack([1 - p, p], 1) + 1e-300
        alpha, beta = np.zeros_like(local), np.ones_like(local)
        log_z = np.logaddexp(0, u).sum()
        scale = np.ones(len(u))
        a = None
        for at in self.steps:
            a = local[at] if a is None else (a[: len(at)] @ e) * local[at]
            s = a.sum(1)
            a = a / s[:, None]
            alpha[at], scale[at] = a, s
        pairs = np.zeros((2, 2))
        for now, nxt in zip(self.steps[-2::-1], self.steps[:0:-1]):
            prev = now[: len(nxt)]  # chains that go on
            m = local[nxt] * beta[nxt]
            pairs += np.einsum("ni,ij,nj->ij", alpha[prev], e, m / scale[nxt, None])
            beta[prev] = (m @ e.T) / scale[nxt, None]
        g = alpha * beta
        n_pairs = sum(map(len, self.steps[1:]))
        return g[:, 1] / g.sum(1), pairs, log_z + np.log(scale).sum() + n_pairs * trans.max()


def train(x: np.ndarray, count: np.ndarray, label: np.ndarray, prior: float, rounds: int = ROUNDS) -> Model:
    """Fits the chain; ``count`` lines and one label per document, classes weighing the same."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    chains = [(_Chains(count[label == y]), np.repeat(label, count) == y, y) for y in (0, 1)]
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    theta, m, v = np.zeros(len(w) + 4), 0.0, 0.0
    for k in range(1, rounds + 1):
        w, trans = theta[:-4], theta[-4:].reshape(2, 2)
        grad = DECAY * theta
        for chain, rows, y in chains:
            n = rows.sum()
            if not n:
                continue
            zr = z[rows]
            good, pairs, _ = chain.marginals(zr @ w, trans)
            observed = np.zeros((2, 2))
            observed[y, y] = pairs.sum()
            grad = grad + np.concatenate([zr.T @ (good - y), (pairs - observed).ravel()]) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), prior)


def score_texts(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, number of lines and number of lines more likely bad, of each text."""
    x, length, count = line_features(texts)
    score = np.full(len(texts), model.prior)
    bad = np.zeros(len(texts), np.int64)
    if len(x):
        good, _, _ = _Chains(count).marginals(((x - model.mean) / model.scale) @ model.weights, model.transitions)
        has = count > 0
        starts = (np.cumsum(count) - count)[has]
        score[has] = np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts)
        bad[has] = np.add.reduceat((good < 0.5).astype(np.int64), starts)
    return np.clip(score, 0.0, 1.0), count, bad


def id_share(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null for a null id)."""
    return F.crc32(id_col.cast("bigint").cast("string").cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on at most ``sample`` documents of each class among ``labels (doc_id, quality)``, of each on
    at most ``LINES`` consecutive lines: what the driver gets is bounded, however long a text.

    Labels other than 0 and 1 are ignored. With one class or none, scores are that class's share
    (0.5 without labels).
    """
    ship_package(docs.sparkSession)
    labels = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    n_good, n = labels.agg(F.coalesce(F.sum("quality"), F.lit(0)), F.count("*")).first()
    prior = n_good / n if n else 0.5
    if n_good in (0, n):
        return Model(np.zeros(3 * N_OWN), np.ones(3 * N_OWN), np.zeros(3 * N_OWN), np.zeros((2, 2)), prior)
    # top-k by hash: each task keeps k rows at most
    some = [labels.where(F.col("quality") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    some = some[0].unionByName(some[1]).select(F.col("doc_id").alias("label_id"), "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, lambda b: b.column(1), SLICE):
            texts = [t.as_py() or b"" for t in b.column(1)]
            x, _, count = line_features(texts)
            first = np.cumsum(count) - count
            skip = [zlib.crc32(t) % (n - LINES + 1) if n > LINES else 0 for t, n in zip(texts, count.tolist())]
            rows = [x[i + k : i + k + min(n, LINES)].astype(np.float32).tobytes() for i, k, n in zip(first, skip, count)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["quality", "x"])

    # Broadcast: at most 2 * sample rows of two numbers.
    src = docs.select(F.col("doc_id").alias("d"), F.col("text").cast("binary").alias("text")).join(F.broadcast(some), F.col("d") == F.col("label_id"))
    got = src.select("quality", "text").mapInArrow(run, "quality int, x binary").collect()
    got.sort(key=lambda r: (r.quality, bytes(r.x)))  # the order of tasks must not matter
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, 3 * N_OWN) for r in got]
    count = np.array([len(x) for x in xs], np.int64)
    if not count.sum():
        return Model(np.zeros(3 * N_OWN), np.ones(3 * N_OWN), np.zeros(3 * N_OWN), np.zeros((2, 2)), prior)
    return train(np.concatenate(xs).astype(np.float64), count, np.array([r.quality for r in got]), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score double, n_lines, n_bad_lines)``, one row per input row.

    Null, empty and blank texts have no lines and get the share of good labels; repeated rows
    give repeated rows; null ids stay null; other columns are ignored.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, lambda b: b.column(1), SLICE):
            cols = score_texts([t.as_py() or b"" for t in b.column(1)], model)
            kinds = [pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "score", "n_lines", "n_bad_lines"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, score double, n_lines bigint, n_bad_lines bigint")


def filtered(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, all columns kept, in one pass."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, lambda b: b.column(text_col), SLICE):
            texts = [t.as_py() or b"" for t in b.column(text_col).cast(pa.binary())]
            yield b.filter(pa.array(score_texts(texts, model)[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").where(id_share(F.col("doc_id"), 3) != 1)


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, fit(docs, training_labels(spark, sf_dir)))
    return out.select(
        "doc_id", (id_share(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_bad_lines",
    )
