"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word with the ``longest - 1`` words that follow it in its
piece (lead columns), padded where the piece ends. Each shorter phrase is a prefix of the windows
that start with it, so its count is the sum of theirs: one ROLLUP over the window's columns gives
all orders, where a separate explosion per order would move every word once for each.

Windows are counted in their tasks first, so that a frequent word, phrase or language is no hot key, and
travel in packs of coded columns, one per task, language and group of first two words. In its group a
window's count is whole, and so are those of its prefixes of two words or more: a prefix that is too rare
to be a candidate is padded, which leaves its count to the shorter ones. What remains enters the ROLLUP,
which sums over the groups. Counts, products and scores are integers.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunedata.llm.common import read, ship_package, small, written

LONGEST = 3
LEAST = 10  # a candidate's occurrences
INSIDE = 50  # per cent of a candidate's occurrences that lie in one longer candidate drop it
TOP = 2000  # phrases per language
WORDS = 2_000_000  # words that a task counts together, so that its memory is bounded
SLICE = 4 << 20  # bytes of a text that are split together
GROUP = 8 << 20  # bytes of text whose windows make up a group, on average
SALT = 64  # parts of a language that are cut to the top on their own

# A-Z in lower case, the ends of pieces as line feeds, tabs as blanks (fixed values of the contract).
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_END = b"."  # stands for the end of a piece: no word holds it


def unique_rows(cols: list[np.ndarray], n: np.ndarray, base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of codes below ``base``, ascending, with their ``n`` added up."""
    if base ** len(cols) < 1 << 63:
        key = cols[0].astype(np.int64)
        for c in cols[1:]:
            key = key * base + c
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(cols[::-1])
        new = np.zeros(max(len(order) - 1, 0), bool)
        for c in cols:
            new |= c[order][1:] != c[order][:-1]
    first = np.concatenate(([True], new))[: len(order)].nonzero()[0]
    return [c[order[first]] for c in cols], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _pack(names: list[bytes], cols: list[np.ndarray]) -> tuple[bytes, bytes]:
    """The words in use, the pad first, and the columns in codes of these."""
    used, codes = np.unique(np.concatenate([[0], *cols]), return_inverse=True)
    return b" ".join(names[k] for k in used.tolist()), codes[1:].astype("<i4").tobytes()


class WindowCounter:
    """Packs ``(part, lang, names, codes, n)`` of the padded windows of ``longest`` words and their counts."""

    def __init__(self, longest: int, parts: int = 1, limit: int = WORDS):
        self.longest, self.parts, self.limit = longest, parts, limit
        self._reset()

    def _reset(self) -> None:
        self.codes: defaultdict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.codes[_END]
        self.held: defaultdict[str, list[np.ndarray]] = defaultdict(list)
        self.size = self.bytes = 0

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        text = text.translate(_TABLE).replace(b"\n", b" . ")
        at = 0
        while at < len(text):
            cut = text.find(b" ", at + SLICE)
            cut = len(text) if cut < 0 else cut
            self._take(lang, text[at:cut].split())
            self.bytes += cut - at
            at = cut
            if self._full() and at < len(text):
                # The last words of the slice start windows that end in the next one.
                kept = np.concatenate(self.held[lang])[1 - self.longest :]
                names = list(self.codes)
                carried = [names[k] for k in kept.tolist()]
                yield from self.flush(lang, len(carried))
                self._take(lang, carried)
        self._take(lang, [_END])
        if self._full():
            yield from self.flush()

    def _full(self) -> bool:
        return self.size >= self.limit or self.bytes > 16 * SLICE

    def _take(self, lang: str, words: list[bytes]) -> None:
        self.held[lang].append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def flush(self, open_lang: str | None = None, carried: int = 0) -> Iterator[pa.RecordBatch]:
        """What is held, in order; the last ``carried`` words of ``open_lang`` start no window yet."""
        names = [b"", *list(self.codes)[1:]]  # the end of a piece pads
        mix = np.fromiter(map(zlib.crc32, names), np.uint64, len(names))
        for lang in sorted(self.held):
            first = np.concatenate(self.held[lang])
            starts = len(first) - (carried if lang == open_lang else 0)
            cols = [first]
            for k in range(1, self.longest):
                lead = np.zeros_like(first)
                lead[:-k] = first[k:]
                lead[cols[-1] == 0] = 0
                cols.append(lead)
            own = first[:starts] > 0
            cols, n = unique_rows([c[:starts][own] for c in cols], np.ones(own.sum(), np.int64), len(names))
            part = ((mix[cols[0]] * np.uint64(0x9E3779B1) + mix[cols[1]]) % np.uint64(self.parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(self.parts + 1))
            for p in np.unique(part).tolist():
                at = order[ends[p] : ends[p + 1]]
                row = [p, lang, *_pack(names, [c[at] for c in cols]), n[at].astype("<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _PACK_TYPES)], _PACK_NAMES)
        self._reset()


_PACK_NAMES = ["part", "lang", "names", "codes", "n"]
_PACK_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]


class Group:
    """The windows of a group, put together from packs."""

    def __init__(self, longest: int, least: int, limit: int = WORDS):
        self.longest, self.least, self.limit = longest, least, limit
        self.codes: dict[bytes, int] = {b"": 0}
        self.cols, self.n, self.size = [[] for _ in range(longest)], [], 0

    def add(self, names: bytes, codes: bytes, n: bytes) -> None:
        own = np.array([self.codes.setdefault(w, len(self.codes)) for w in names.split(b" ")], np.int64)
        for held, c in zip(self.cols, np.split(own[np.frombuffer(codes, "<i4")], self.longest)):
            held.append(c)
        self.n.append(np.frombuffer(n, "<i4").astype(np.int64))
        self.size += len(self.n[-1])
        if self.size > self.limit:
            self._merge()
            self.limit = max(self.limit, 2 * self.size)

    def _merge(self) -> None:
        cols, n = unique_rows([np.concatenate(c) for c in self.cols], np.concatenate(self.n), len(self.codes))
        self.cols, self.n, self.size = [[c] for c in cols], [n], len(n)

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """The windows, prefixes of two words or more that are too rare padded."""
        self._merge()
        cols, n = [c[0] for c in self.cols], self.n[0]
        new = np.zeros(len(n), bool)
        new[:1] = True
        padded = [c.copy() for c in cols]
        for k in range(self.longest):
            new[1:] |= cols[k][1:] != cols[k][:-1]
            if k:
                f = np.add.reduceat(n, new.nonzero()[0])[np.cumsum(new) - 1]
                for c in padded[k:]:
                    c[f < self.least] = 0
        cols, n = unique_rows(padded, n, len(self.codes))
        names = pa.array(list(self.codes), pa.binary())
        for i in range(0, len(n), 1 << 16):
            some = [names.take(pa.array(c[i : i + (1 << 16)])) for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some[0]), pa.string()), *some, pa.array(n[i : i + (1 << 16)])], ["lang", *_names(self.longest), "n"])


def _names(longest: int) -> list[str]:
    return [f"w{k + 1}" for k in range(longest)]


def windows(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, w1, .., n)``: counts of windows (pads are empty). Rows add up to every prefix's count;
    prefixes of two words or more seen less than ``least`` times are padded."""
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WindowCounter(longest, parts)
        for b in small(batches, lambda b: b.column(1)):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                yield from counter.add(lang, text.as_py() or b"")
        yield from counter.flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None
        for b in batches:
            for part, lang, *pack in zip(*(c.to_pylist() for c in b.columns)):
                if (part, lang) != key:
                    if group:
                        yield from group.rows(key[1])
                    key, group = (part, lang), Group(longest, least)
                group.add(*pack)
        if group:
            yield from group.rows(key[1])

    packs = src.mapInArrow(count, "part bigint, lang string, names binary, codes binary, n binary")
    packs = packs.repartition(parts, "part").sortWithinPartitions("part", "lang")
    return packs.mapInArrow(merge, "lang string, " + "".join(f"{c} binary, " for c in _names(longest)) + "n bigint")


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, **kw) -> DataFrame:
    """``(lang, k, words, phrase, f)``: every phrase of up to ``longest`` words that occurs ``least`` times
    or more, and with ``k`` 0 each language's number of words."""
    names = _names(longest)
    counted = windows(docs, longest, least, **kw)
    rolled = docs.sparkSession.sql(
        f"SELECT lang, {', '.join(names)}, SUM(n) AS f FROM {{counted}} GROUP BY lang, ROLLUP({', '.join(names)}) "
        f"HAVING f >= {int(least)} OR w1 IS NULL",
        counted=counted,
    )
    words = F.filter(F.array(*(F.col(c).cast("string") for c in names)), lambda w: w.isNotNull())
    out = rolled.select("lang", words.alias("words"), "f").where("NOT array_contains(words, '')")
    return out.select("lang", F.size("words").alias("k"), "words", F.array_join("words", " ").alias("phrase"), F.col("f").cast("bigint").alias("f"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, **kw) -> DataFrame:
    """``(lang, phrase, k, a, cut, l, r, n, score)``, one row per candidate that no longer one holds.

    Of the cuts of a candidate the lowest-scoring one counts, then the first. Null texts have no words,
    a null language is ``und``, repeated rows count each, other columns are ignored; an empty table
    has no phrases.
    """
    p = written(phrases(docs, longest, least, **kw), "phrases")
    found = p.where("k >= 2").select("lang", "words", "phrase", "k", F.col("f").alias("a"))
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    left = p.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = p.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"CAST(1000000 AS DECIMAL(7, 0)) * {wide('a')} * {wide('a')} DIV ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("b"), F.first("k").alias("k"), F.first("a").alias("a")
    )
    # The most frequent longer candidate around each phrase.
    spans = [(s, m) for m in range(2, longest) for s in range(1, longest - m + 2)]
    holders = found.where("k > 2").select(
        "lang", "a", F.explode(F.array_distinct(F.filter(
            F.array(*(F.when(F.col("k") >= max(s + m - 1, m + 1), part(F.lit(s), F.lit(m))) for s, m in spans)) if spans else F.array().cast("array<string>"),
            lambda x: x.isNotNull(),
        ))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(holders, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(inside)} * a")
    totals = p.where("k = 0").select("lang", F.col("f").alias("n"))
    return kept.join(totals, "lang").select("lang", "phrase", "k", "a", "b.cut", "b.l", "b.r", "n", F.col("b.score").cast("bigint").alias("score"))


def top(found: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` rows of each language with their ``rank``, by score, occurrences and phrase.
    Parts of a language are cut first, so that no task sorts all its candidates."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(f"rank <= {int(most)}")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"rank <= {int(most)}")
    return found.withColumn("rank", F.col("rank").cast("bigint")).drop("salt")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(collocations(read(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), tokens AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM tokens
), f AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, any_value(w[i : i + k - 1]) AS words, count(*) AS f
    FROM places, (VALUES (1), (2), (3)) AS ks(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), n AS (
    SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (
    SELECT lang, k, phrase, words, f AS a FROM f WHERE k >= 2 AND f >= 10
), cuts AS (
    SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r,
           CAST((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1 : cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[cut + 1 : c.k], ' ')
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), holder AS (
    SELECT lang, unnest([array_to_string(words[1 : 2], ' '), array_to_string(words[2 : 3], ' ')]) AS phrase, a FROM cand WHERE k = 3
), held AS (
    SELECT lang, phrase, max(a) AS longer FROM holder GROUP BY ALL
), kept AS (
    SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * b.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept k JOIN n ON n.lang = k.lang
QUALIFY rank <= 2000
"""
