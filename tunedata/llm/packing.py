"""Packing tokenised documents into fixed windows with bounded space.

Each task packs the documents of its partition as they come: a fixed number of windows is open; a
piece goes to the open window it fits best; when none fits, the fullest window is emitted, filled
up with the head of the piece. Windows still open at the end of a partition are merged across
partitions in further rounds of the same packing. Only those leftovers are shuffled; ids of full
windows never leave their task.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import read, ship_package, written

WINDOW = 2048
OPEN = 32  # open windows per partition
END_ID = 1  # ends each document
MERGE = 64  # partitions whose leftovers one task of a merge round packs together
MEMO = 128 << 20  # bytes that a task's memory of chunks takes, about (bounds memory, not the result)
ENTRY = 150  # bytes of an entry beside its text, about
TOKENIZER = "word_bpe_49k.json"

PIECES = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, "
    "part bigint, window bigint, offset bigint, open boolean"
)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The byte alphabet of byte-level BPE, by its published rule: printable bytes stand for themselves,
# the others follow from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(_OTHERS)}


class ChunkEncoder:
    """Ids of white-space-separated chunks, remembered within a task.

    The tokenizer drops white space and no pattern of its pre-tokenizer spans it, so a text's ids
    are those of its chunks in order. A chunk of letters followed by ASCII punctuation (no quote,
    which starts a contraction, and no ``<``, which may start a special token) is cut there, as the
    pre-tokenizer does; the pieces repeat far more often than whole chunks.
    """

    # ASCII punctuation without the quote and ``<``: a run of it is one unit of the pre-tokenizer.
    PUNCTUATION = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
    PUNCTUATION_BYTES = PUNCTUATION.encode()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode_batch_fast, tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.parts: dict[bytes, tuple[int, ...]] = {}  # tuples of numbers are no work for the garbage collector
        self.flat = np.zeros(1 << 16, np.uint32)  # ids of all chunks, one after another
        self.starts = np.zeros(1 << 14, np.int64)  # chunk k has flat[starts[k]:starts[k + 1]]
        self.held = 0  # bytes, about

    def _learn(self, chunks: list[bytes]) -> None:
        parts, punctuation, known = self.parts, self.PUNCTUATION_BYTES, len(self.parts)
        first, ids, ends = len(self.index), [], []
        at = int(self.starts[first])
        tokenize, get = self.model.tokenize, parts.get
        for c in chunks:
            word = c.rstrip(punctuation)
            if (word.isalpha() and word.islower()) or not word:  # ASCII letters
                got = get(word)
                if got is None:
                    got = parts[word] = tuple(t.id for t in tokenize(word.decode())) if word else ()
                ids += got
                if len(word) < len(c):
                    tail = c[len(word) :]
                    got = get(tail)
                    if got is None:
                        got = parts[tail] = tuple(t.id for t in tokenize(tail.decode()))
                    ids += got
            elif not word.isascii() and (s := word.decode("utf-8", "replace")).isalpha() and len(low := "".join(map(str.lower, s))) == len(s):
                for p in (low.encode(), c[len(word) :]):
                    got = get(p)
                    if got is None:
                        got = parts[p] = tuple(self._ids(p.decode()))
                    ids += got
            else:
                got = get(c)
                if got is None:
                    got = parts[c] = tuple(self.encode([c.decode("utf-8", "replace")], add_special_tokens=False)[0].ids)
                ids += got
            ends.append(at + len(ids))
        self.index.update(zip(chunks, range(first, first + len(chunks))))
        self.held += sum(map(len, chunks)) + ENTRY * (len(chunks) + len(parts) - known)
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.index) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[at : at + len(ids)] = ids
        self.starts[first + 1 : len(self.index) + 1] = ends

    def _ids(self, p: str) -> list[int]:
        """Ids of lower-case letters or ASCII punctuation: one unit of the model, spelt in its byte
        alphabet, unless the normaliser would change it."""
        if not p:
            return []
        if p.isascii() or unicodedata.is_normalized("NFC", p) and "".join(map(str.lower, p)) == p:
            return [t.id for t in self.model.tokenize("".join(map(_BYTE_LETTERS.__getitem__, p.encode())))]
        return self.encode([p], add_special_tokens=False)[0].ids

    def __call__(self, text: bytes) -> np.ndarray:
        # The normaliser lower-cases, but after special tokens are found in the text as it is.
        words = (text if b"<|" in text else text.lower()).split()
        get = self.index.get
        idx = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        missing = np.nonzero(idx < 0)[0]
        if len(missing):
            if self.held > MEMO:
                self.forget()
                get, missing = self.index.get, np.arange(len(words))
            new = [words[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            idx[missing] = np.fromiter(map(get, new), np.int64, len(new))
        at = self.starts[idx]
        n = self.starts[idx + 1] - at
        total = int(n.sum())
        shift = np.repeat(at - (np.cumsum(n) - n), n)
        return self.flat[shift + np.arange(total)]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


class Packer:
    """Windows of ``size`` ids, at most ``open_windows`` of them open. A piece is a tuple
    ``(doc_id, start, doc_tokens, ids)``; ``add`` yields finished windows as lists of pieces."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.most = size, open_windows
        self.open: dict[int, list] = {}
        self.room: list[tuple[int, int]] = []  # (free ids, window), ascending: best fit is the first that is enough
        self.next = 0

    def _put(self, window: int, free: int, piece: tuple) -> Iterator[list]:
        self.open[window].append(piece)
        free -= len(piece[3])
        if free:
            insort(self.room, (free, window))
        else:
            yield self.open.pop(window)

    def add(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray) -> Iterator[list]:
        while len(ids) >= self.size:  # whole windows of a long document
            yield [(doc_id, start, doc_tokens, ids[: self.size])]
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        at = bisect_left(self.room, (len(ids), -1))
        if at == len(self.room) and len(self.room) >= self.most:
            free, window = self.room.pop(0)  # the fullest
            yield from self._put(window, free, (doc_id, start, doc_tokens, ids[:free]))
            start, ids = start + free, ids[free:]
            at = bisect_left(self.room, (len(ids), -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            free, window = self.size, self.next
            self.next += 1
            self.open[window] = []
        yield from self._put(window, free, (doc_id, start, doc_tokens, ids))

    def rest(self) -> list[list]:
        return [self.open[w] for _, w in self.room]


def _batch(windows: list[tuple[int, int, list, bool]]) -> pa.RecordBatch:
    """Rows of PIECES for ``(part, window, pieces, open)``."""
    rows = []
    for part, window, pieces, still_open in windows:
        offset = 0
        for doc_id, start, doc_tokens, ids in pieces:
            rows.append((doc_id, start, len(ids), doc_tokens, ids.astype("<u4").tobytes(), part, window, offset, still_open))
            offset += len(ids)
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3 + [pa.bool_()]
    cols = zip(*rows) if rows else [()] * 9
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "window", "offset", "open"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


def _emit(packer: Packer, part: int, pieces: Iterator[tuple], last_open: bool) -> Iterator[pa.RecordBatch]:
    done, n, held = [], 0, 0
    for p in pieces:
        for w in packer.add(*p):
            done.append((part, n, w, False))
            n += 1
            held += 1
        if held >= 512:
            yield _batch(done)
            done, held = [], 0
    for w in packer.rest():
        done.append((part, n, w, last_open))
        n += 1
    yield _batch(done)


def pack(
    docs: DataFrame, size: int = WINDOW, open_windows: int = OPEN, tokenizer: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids binary, sequence_id, offset)``: one row per piece.

    ``ids`` are little-endian unsigned 32-bit token ids; a document's tokens are those of its
    text and a final id 1, so null and empty texts have one token. Repeated rows and null ids are
    documents like any other, other columns are ignored, an empty table gives no piece. Windows
    are numbered by the partition (or merge group) that finished them, so a task that runs again
    gives the same rows. At the end at most ``open_windows`` windows of the table need padding.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)

        def pieces() -> Iterator[tuple]:
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = np.append(encode(t.as_py() or b""), np.uint32(END_ID))
                    yield i, 0, len(ids), ids

        try:
            yield from _emit(Packer(size, open_windows), TaskContext.get().partitionId(), pieces(), True)
        finally:
            encode.forget()  # the worker lives on

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    packed = written(src.mapInArrow(run, PIECES), "packed-0")
    full, rounds = packed.where("not open"), 1

    def merge(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, part, done, n = Packer(size, open_windows), None, [], 0
            for b in batches:
                d = b.to_pydict()
                for g, i, s, t, x in zip(d["part"], d["doc_id"], d["start"], d["doc_tokens"], d["ids"]):
                    if part is not None and g != part:
                        done += [(part, n + k, w, not last) for k, w in enumerate(packer.rest())]
                        packer, n = Packer(size, open_windows), 0
                    part = g
                    for w in packer.add(i, s, t, np.frombuffer(x, "<u4")):
                        done.append((part, n, w, False))
                        n += 1
                yield _batch(done)
                done = []
            if part is not None:
                yield _batch([(part, n + k, w, not last) for k, w in enumerate(packer.rest())])

        return run

    # Each round packs the leftovers of MERGE partitions together; there are fewer partitions by that
    # factor after each, so 10^6 partitions need four rounds, and no task gets more than MERGE
    # partitions' open windows.
    parts = packed.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
    out = full.withColumn("round", F.lit(0))
    left = packed.where("open")
    while True:
        last = parts <= MERGE
        grouped = left.withColumn("old", F.col("part")).withColumn("part", F.floor(F.col("part") / MERGE))
        tasks = grouped.repartition("part").sortWithinPartitions("part", "old", "window", "offset")
        merged = written(tasks.select("part", "doc_id", "start", "doc_tokens", "ids").mapInArrow(merge(last), PIECES), f"packed-{rounds}")
        out = out.unionByName(merged.where("not open").withColumn("round", F.lit(rounds)))
        if last:
            break
        left, parts, rounds = merged.where("open"), -(-parts // MERGE), rounds + 1
    seq = F.shiftleft(F.col("round").cast("long"), 58) + F.shiftleft(F.col("part"), 32) + F.col("window")
    return out.select("doc_id", "start", "length", "doc_tokens", "ids", seq.alias("sequence_id"), "offset")


def sequences(pieces: DataFrame, size: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, input_ids array<int>, doc_ids array<bigint>, used)``: the packed windows,
    padded to ``size``. A window has at most ``size`` pieces, so a group is bounded."""
    g = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    words = F.flatten(F.transform("p", lambda x: F.transform(
        F.sequence(F.lit(0), (F.length(x["ids"]) / 4 - 1).cast("int")),
        lambda k: F.conv(F.hex(F.substring(x["ids"], k * 4 + 1, 4)), 16, 10).cast("long"),
    )))
    # bytes come in little-endian order: swap them
    swap = lambda v: (F.shiftright(v, 24) + F.shiftright(v, 8).bitwiseAND(F.lit(0xFF00)) + F.shiftleft(v.bitwiseAND(F.lit(0xFF00)), 8) + F.shiftleft(v.bitwiseAND(F.lit(0xFF)), 24)).cast("int")
    ids = F.transform(words, swap)
    return g.select(
        "sequence_id",
        F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(size) - F.size(ids))).alias("input_ids"),
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
        F.size(ids).alias("used"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
