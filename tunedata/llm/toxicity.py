"""Toxicity by weak supervision.

Voters: words, word beginnings and patterns. A voter says "toxic" where it hits and abstains
elsewhere; one voter says "clean" where no lexical voter hits. A generative label model (a hidden
class per document, the rates at which each voter speaks within either class, agreement of voter
pairs beyond what the class explains as their correlation) is fitted by expectation-maximisation on
the votes alone; correlated voters share their weight. Its posterior labels train the linear
classifier that scores all documents.

Labels only choose the voters, from a bounded sample of labelled documents (``TOXIC`` and ``CLEAN`` at
most, the first of each class by a hash of their id), and give the share of toxic documents. The
voters vote on that sample and on ``OTHERS`` documents at most that are taken whatever their label, and
the label model sees no label of either. Scoring is one pass without a shuffle; only the lexicon, whose
size the sample bounds, and weights are sent out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import read, ship_package, small, written
from tunedata.llm.quality_crf import id_share

TOXIC, CLEAN = 3000, 9000  # sampled documents per class
OTHERS = 6000  # documents besides, with or without a label, that are voted on
LEAST = 4  # documents of the toxic sample that a lexical voter hits
EVIDENCE = 28.0  # least log-likelihood ratio statistic of a lexical voter: above chance for 10^6 terms
ODDS = 3.0  # least log-odds of a lexical voter
STEMS = (4, 5, 6, 7)  # lengths of word beginnings
THRESHOLD = 0.3
SAME = 0.5  # voters that agree so much more than the class explains share their weight
WORDS = re.compile(r"[^\W\d_]+")
#: Pattern voters (fixed values).
PATTERNS = {
    "exclamations": re.compile(r"!{2,}"),
    "masked_word": re.compile(r"\b\w[*@#$]{2,}\w*"),
    "shouted_words": re.compile(r"\b[A-Z]{4,}\W+[A-Z]{4,}\b"),
    "stretched_word": re.compile(r"(\w)\1{3,}"),
}


def terms(text: str) -> set[str]:
    """The words of a text and their beginnings (marked by a trailing ``*``)."""
    words = set(WORDS.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


class Lexicon:
    def __init__(self, entries: list[str]):
        self.entries = entries
        self.index = {e: k for k, e in enumerate(entries)}
        self.words = {e for e in entries if not e.endswith("*")}
        self.stems = {k: {e[:-1] for e in entries if e.endswith("*") and len(e) == k + 1} for k in STEMS}
        self.n = len(entries) + len(PATTERNS)

    def hits(self, text: str) -> tuple[list[int], int, int]:
        """Voters that hit, hits of lexical words (repeats counted), and the number of words."""
        words = WORDS.findall(text.lower())
        a, b, c, d = (self.stems[k] for k in STEMS)
        i, j, k, l = STEMS  # noqa: E741
        lexical = self.words
        found = [w for w in words if w in lexical or w[:i] in a or w[:j] in b or w[:k] in c or w[:l] in d]
        votes, count = set(), 0
        for w, n in Counter(found).items():
            of = [self.index[e] for e in (w, *(w[:k] + "*" for k in STEMS if len(w) > k)) if e in self.index]
            votes.update(of)
            count += n if of else 0
        votes.update(len(self.entries) + k for k, p in enumerate(PATTERNS.values()) if p.search(text))
        return sorted(votes), count, len(words)

    def features(self, votes: list[int], count: int, words: int) -> tuple[list[int], list[float]]:
        """Features: one per voter, then whether there are 1, 2, 3 or more lexical hits, how many, how
        many per 100 words, and 1."""
        rate = min(5.0, 100.0 * count / max(words, 20))
        return votes, [float(count >= 1), float(count >= 2), float(count >= 3), np.log1p(count), rate, 1.0]


N_DENSE = 6


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray  # per voter, then the dense features
    prior: float


def _held(evidence: np.ndarray, share: float) -> np.ndarray:
    """Posteriors whose mean is ``share``: correlated evidence would else shift it from round to round."""
    low, high = -60.0, 60.0
    for _ in range(50):
        mid = (low + high) / 2
        post = 1 / (1 + np.exp(-np.clip(evidence + mid, -30, 30)))
        low, high = (mid, high) if post.mean() < share else (low, mid)
    return post


def label_model(votes: np.ndarray, clean_vote: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of "toxic" per row, accuracy per voter, and how much of its weight each keeps.

    ``votes``: rows x voters, 1 where a voter says toxic; ``clean_vote``: 1 where the clean voter speaks. The
    class share is held at ``prior``; the rates at which voters speak given each class are learnt.
    """
    m = votes.shape[1]
    said = np.concatenate([votes, clean_vote[:, None]], 1)
    post = np.where(clean_vote > 0, prior / 10, np.clip(0.3 + 0.2 * votes.sum(1), 0, 0.95))
    rate1 = rate0 = np.full(m + 1, 0.5)
    keep = np.ones(m + 1)
    for _ in range(rounds):
        w1, w0 = post.sum(), (1 - post).sum()
        rate1, rate0 = (post @ said + 0.5) / (w1 + 1), ((1 - post) @ said + 0.5) / (w0 + 1)
        # correlation: agreement of two voters beyond what the class explains, within the toxic class
        x = (said - rate1) * np.sqrt(post)[:, None]
        cov = x.T @ x / (w1 + 1e-9)
        sd = np.sqrt(np.diag(cov)) + 1e-9
        rho = np.abs(cov / sd[:, None] / sd[None, :])
        rho[rho < SAME] = 0
        np.fill_diagonal(rho, 1)
        rho[:m, m] = 0  # the clean voter only repeats what the others leave unsaid: it yields, they don't
        keep = 1 / np.maximum(rho.sum(1), 1)
        evidence = said @ (keep * np.log(rate1 / rate0)) + (1 - said) @ (keep * np.log((1 - rate1) / (1 - rate0)))
        post = _held(evidence, prior)
    return post, (rate1 * prior / (rate1 * prior + rate0 * (1 - prior)))[:m], keep[:m]


def train_linear(x: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels."""
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def _texts(b: pa.RecordBatch, k: int) -> list[str]:
    return [t.as_py() or "" for t in b.column(k)]


def _learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> Lexicon:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, lambda b: b.column(1)):
            by = (Counter(), Counter())
            for y, t in zip(b.column(0).to_pylist(), _texts(b, 1)):
                by[y].update(terms(t))
            names = list(by[0] | by[1])
            cols = [pa.array(names, pa.string()), *(pa.array([by[y][t] for t in names], pa.int64()) for y in (1, 0))]
            yield pa.RecordBatch.from_arrays(cols, ["term", "a", "b"])

    got = sample.select("toxic", "text").mapInArrow(count, "term string, a bigint, b bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_clean + 1))
    share = n_toxic / (n_toxic + n_clean)
    both = F.col("a") + F.col("b")
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (both * p))).otherwise(0.0)
    got = got.where(F.col("a") >= LEAST).withColumn("odds", odds)
    got = got.where((F.col("odds") >= ODDS) & (2 * (part("a", share) + part("b", 1 - share)) >= EVIDENCE))
    # Forms of one family that hit the same documents are one voter, the shortest.
    family = got.groupBy(F.substring("term", 1, min(STEMS)).alias("stem"), "a", "b").agg(F.min(F.struct(F.length("term"), "term")).alias("x"))
    return Lexicon(sorted(r.term for r in family.select("x.term").collect()))


def _without_copies(sample: DataFrame) -> DataFrame:
    """The sample without most near copies, whose shared words would pass for a lexicon: of rows that
    have the same least hash of three-word shingles, by either of two hashes, one stays."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0)))
    shingles = F.transform(places, lambda i: F.xxhash64(F.concat_ws(" ", F.slice("words", i + 1, 3))))
    out = sample.withColumn("words", words).withColumn("h", shingles)
    out = out.select("d", "toxic", "text", F.array_min("h").alias("m1"), F.array_min(F.transform("h", lambda x: F.xxhash64(x))).alias("m2"))
    for m in ("m1", "m2"):
        out = out.groupBy(m).agg(F.min(F.struct("d", "toxic", "text", "m1", "m2")).alias("x")).select("x.*")
    return out.select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on ``labels (doc_id, toxic)``; labels other than 0 and 1 and null ids are ignored.

    Without labels of both classes every score is the share of toxic labels (0 without any).
    """
    ship_package(docs.sparkSession)
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n_toxic, n = labels.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    prior = n_toxic / n if n else 0.0
    empty = Model(Lexicon([]), np.zeros(len(PATTERNS) + N_DENSE), prior)
    if n_toxic in (0, n):
        return empty
    some = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for y, k in ((1, TOXIC), (0, CLEAN))]
    some = some[0].unionByName(some[1]).select(F.col("doc_id").alias("label_id"), "toxic")
    # Broadcast: at most TOXIC + CLEAN rows of two numbers.
    sample = docs.select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), F.col("d") == F.col("label_id"))
    whole = sample.select("d", "toxic", "text")
    count = lambda df: {r.toxic: r["count"] for r in df.groupBy("toxic").count().collect()}
    sample = written(_without_copies(whole), "toxicity-sample")
    sizes = count(sample)
    if min(sizes.get(0, 0), sizes.get(1, 0)) < LEAST:  # too few to learn from: copies count then
        sample = written(whole.select("toxic", "text"), "toxicity-sample")
        sizes = count(sample)
    if len(sizes) < 2:
        return empty
    lexicon = _learn_lexicon(sample, sizes[1], sizes[0])
    ids = docs.select(F.col("doc_id").alias("other_id")).where("other_id IS NOT NULL").distinct().orderBy(F.xxhash64("other_id"), "other_id").limit(OTHERS)
    # Broadcast: at most OTHERS numbers.
    others = docs.select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("d") == F.col("other_id"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, lambda b: b.column(1)):
            got = [lexicon.hits(t) for t in _texts(b, 1)]
            cols = [b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["toxic", "votes", "hits", "words"])

    voted = sample.select("toxic", "text").unionByName(others.select(F.lit(None).cast("int").alias("toxic"), "text"))
    got = voted.mapInArrow(vote, "toxic int, votes array<int>, hits bigint, words bigint").collect()
    got.sort(key=lambda r: (r.votes, r.hits, r.words))  # the order of tasks must not matter
    votes = np.zeros((len(got), lexicon.n))
    dense = np.zeros((len(got), N_DENSE))
    for k, r in enumerate(got):
        votes[k, r.votes] = 1
        dense[k] = lexicon.features(r.votes, r.hits, r.words)[1]
    clean = (votes[:, : len(lexicon.entries)].sum(1) == 0).astype(float)
    # The labels' shares give how much of what is voted on is toxic and hit by a lexical voter.
    heard = sum(r.toxic == 1 and any(k < len(lexicon.entries) for k in r.votes) for r in got) / sizes[1]
    share = heard * (sizes[1] + prior * (len(got) - sizes[0] - sizes[1])) / len(got)
    if not 0 < share < 1:
        return empty
    post, _, _ = label_model(votes, clean, share)
    return Model(lexicon, train_linear(np.concatenate([votes, dense], 1), post), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score double, n_voters, n_hits)``, one row per input row.

    Null and empty texts are scored as texts in which nothing hits; repeated rows give repeated
    rows; null ids stay null; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    lexicon, w = model.lexicon, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, lambda b: b.column(1)):
            p, voters, hits = [], [], []
            for t in _texts(b, 1):
                votes, count, words = lexicon.hits(t)
                _, dense = lexicon.features(votes, count, words)
                z = w[votes].sum() + np.dot(dense, w[lexicon.n :])
                p.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if w.any() else model.prior)
                voters.append(len(votes))
                hits.append(count)
            cols = [b.column(0), pa.array(p, pa.float64()), pa.array(voters, pa.int64()), pa.array(hits, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "n_voters", "n_hits"])

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, score double, n_voters bigint, n_hits bigint")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels").where(id_share(F.col("doc_id"), 4) != 2))
    return score(docs, model).select(
        "doc_id", (id_share(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_voters", "n_hits",
    )
