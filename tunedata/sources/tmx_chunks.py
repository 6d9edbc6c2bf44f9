"""TMX files cut by many tasks each.

A file is a sequence of byte chunks, one row (path, number) per chunk; a task reads a chunk's bytes
by a range read. Borders are moved to the next ``<``, so a border never splits a character or a
delimiter: each of them has one ``<``, at its start, or none. What a chunk means depends on where the
file stands at its start (outside a unit or inside, in text, a comment, a CDATA section or a processing
instruction). Hence two passes:

1. Each chunk gives, for each of the eight starts, the state at its end, the number of units opened
   and the text outside units. Runs from different starts meet at the first unit that both open, so
   the seven others cost little more than the first. A sorted pass over these rows, one small row per chunk,
   carries the true state and the number of units from chunk to chunk.
2. Each chunk, now with a known start, emits the units that open in it. Its last unit is read on
   beyond the border to its end; the next chunk's start says that those bytes belong to it.

The files' bytes are read twice; nothing but units is shuffled, and no row holds a file.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.session import scratch_path

CHUNK_BYTES = 16 << 20
_READ_ON = 1 << 20  # bytes read at a time beyond a chunk's end
_FLUSH = 4 << 20  # characters of units in one Arrow batch
MAX_TASKS = 100_000

_TU = r"""<tu(?=[\s>/])(?:[^<>"']|"[^"<]*"|'[^'<]*')*+(>)?"""
_SECTION = r"<!--|<!\[CDATA\[|<\?"
_OUTSIDE = re.compile(f"{_SECTION}|{_TU}", re.ASCII)
_INSIDE = re.compile(rf"{_SECTION}|</tu\s*>", re.ASCII)
_SPACE = re.compile(r"\s+", re.ASCII)
# State: 4 * (inside a unit) + the section one is in (0: none).
_SECTIONS = {"<!--": 1, "<![CDATA[": 2, "<?": 3}
_CLOSERS = ("", "-->", "]]>", "?>")
STATES = 8
OPEN, CLOSE, OFF, ON, END = range(5)


def walk(text: str, state: int) -> Iterator[tuple[int, int]]:
    """What happens in a chunk that starts in ``state``: units that open and close, sections outside
    units (``OFF``, ``ON``), each with its position; finally ``(END, state)``."""
    inside, section = divmod(state, 4)
    pos = 0
    while True:
        if section:
            i = text.find(_CLOSERS[section], pos)
            if i < 0:
                break
            pos, section = i + len(_CLOSERS[section]), 0
            if not inside:
                yield ON, pos
        m = (_INSIDE if inside else _OUTSIDE).search(text, pos)
        if m is None:
            break
        pos = m.end()
        section = _SECTIONS.get(m.group(), 0)
        if section:
            if not inside:
                yield OFF, m.start()
        elif inside:
            inside = 0
            yield CLOSE, pos
        else:
            yield OPEN, m.start()
            inside = int(not (m.group(1) and text[pos - 2] == "/"))
            if not inside:
                yield CLOSE, pos
    yield END, 4 * inside + section


def transitions(text: str, starts: range = range(STATES)) -> tuple[list[int], list[int], list[str]]:
    """For each start state: the end state, the units opened, the text outside units and sections."""
    ends, opens, rests = [], [], []
    met: dict[int, tuple[int, int]] = {}  # opening of a unit in the first run -> units and pieces before it
    first: list[str] = []
    for state in starts:
        pieces: list[str] = []
        n, since, end = 0, (0 if state == 0 else None), state
        for kind, p in walk(text, state):
            if kind in (OPEN, OFF) and since is not None:
                pieces.append(text[since:p])
                since = None
            if kind == OPEN:
                if state == 0:
                    met[p] = (n, len(pieces))
                elif p in met:
                    before, k = met[p]
                    n, end, since = n + opens[0] - before, ends[0], None
                    pieces += first[k:]
                    break
                n += 1
            elif kind in (CLOSE, ON):
                since = p
            elif kind == END:
                end = p
        if since is not None:
            pieces.append(text[since:])
        if state == 0:
            first = pieces
        ends.append(end)
        opens.append(n)
        rests.append(_SPACE.sub(" ", "".join(pieces)))
    return ends, opens, rests


class _Reader:
    """Range reads of one file, cut at ``<``."""

    _systems: dict = {}

    def __init__(self, uri: str, length: int, encoding: str):
        from pyarrow import fs

        scheme, sep, rest = uri.partition("://") if not uri.startswith("file:") else ("", "", "/" + uri[5:].lstrip("/"))
        if not sep:
            system, path = fs.LocalFileSystem(), rest or uri
        else:
            authority, _, tail = rest.partition("/")
            base = f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{authority}"
            if base not in self._systems:
                self._systems[base] = fs.FileSystem.from_uri(base + "/")
            system, root = self._systems[base]
            path = f"{root.rstrip('/')}/{tail}"
        self.file, self.length = system.open_input_file(path), length
        if codecs.lookup(encoding).name in ("utf-16", "utf-32"):  # the byte order mark tells the order
            wide = codecs.lookup(encoding).name
            big = self.file.read_at(4, 0).startswith((codecs.BOM_UTF16_BE, codecs.BOM_UTF32_BE))
            encoding = f"{wide}-{'be' if big else 'le'}"
        self.encoding, self.lt = encoding, "<".encode(encoding)

    def border(self, at: int) -> int:
        """The first ``<`` at or after ``at`` (a multiple of the character width), else the file's end."""
        if at <= 0:
            return 0
        width = len(self.lt)
        while at < self.length:
            block = self.file.read_at(min(1 << 16, self.length - at), at)
            i = block.find(self.lt)
            while i >= 0 and i % width:
                i = block.find(self.lt, i + 1)
            if i >= 0:
                return at + i
            at += len(block) if len(block) < 1 << 16 else 1 << 16
            if not block:
                break
        return self.length

    def text(self, start: int, end: int) -> str:
        return self.file.read_at(end - start, start).decode(self.encoding)

    def close(self) -> None:
        self.file.close()


def _spans(batches: Iterator[pa.RecordBatch], encoding: str, chunk_bytes: int) -> Iterator[tuple[dict, _Reader, int, int]]:
    for b in batches:
        for row in b.to_pylist():
            reader = _Reader(row["path"], row["length"], encoding)
            try:
                yield row, reader, reader.border(row["chunk"] * chunk_bytes), reader.border((row["chunk"] + 1) * chunk_bytes)
            finally:
                reader.close()


def _measure(encoding: str, chunk_bytes: int):
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("chunk", pa.int64()), ("bad", pa.bool_()),
                        ("ends", pa.list_(pa.int32())), ("opens", pa.list_(pa.int64())), ("rests", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, reader, start, end in _spans(batches, encoding, chunk_bytes):
            starts = range(STATES) if row["chunk"] else range(1)
            try:
                found, bad = transitions(reader.text(start, end), starts), False
            except UnicodeDecodeError:
                found, bad = ([0] * len(starts), [0] * len(starts), [""] * len(starts)), True
            values = [row["path"], row["length"], row["chunk"], bad, *found]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    return run


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path and chunk -> the state at each chunk's start and the units opened before it."""
    path, state, base = None, 0, 0
    for b in batches:
        states, bases, ends, rests = [], [], [], []
        for p, e, o, r in zip(*(b.column(n).to_pylist() for n in ("path", "ends", "opens", "rests"))):
            if p != path:
                path, state, base = p, 0, 0
            states.append(state)
            bases.append(base)
            rests.append(r[state])
            state, base = e[state], base + o[state]
            ends.append(state)
        columns = [b.column(n) for n in ("path", "length", "chunk", "bad")]
        columns += [pa.array(states, pa.int32()), pa.array(bases, pa.int64()), pa.array(ends, pa.int32()), pa.array(rests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["path", "length", "chunk", "bad", "state", "base", "end", "rest"])


def _rest_of_unit(reader: _Reader, at: int, state: int) -> str | None:
    """The bytes from ``at`` to the end of the unit that is open there; None if it never closes."""
    pieces = []
    while at < reader.length:
        end = reader.border(at + _READ_ON)
        text = reader.text(at, end)
        for kind, p in walk(text, state):
            if kind == CLOSE:
                return "".join([*pieces, text[:p]])
            if kind == END:
                state = p
        pieces.append(text)
        at = end
    return None


def _cut(encoding: str, chunk_bytes: int):
    def units(row: dict, reader: _Reader, start: int, end: int) -> Iterator[tuple[int, str]]:
        text, index, opened = reader.text(start, end), row["base"], None
        for kind, p in walk(text, row["state"]):
            if kind == OPEN:
                opened = p
            elif kind == CLOSE and opened is not None:
                yield index, text[opened:p]
                index, opened = index + 1, None
            elif kind == END and opened is not None:
                more = _rest_of_unit(reader, end, p)
                if more is not None:
                    yield index, text[opened:] + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, reader, start, end in _spans(batches, encoding, chunk_bytes):
            held: list[tuple[int, str]] = []
            size = 0
            for u in units(row, reader, start, end):
                held.append(u)
                size += len(u[1])
                if size >= _FLUSH:
                    yield _batch(row["path"], held)
                    held, size = [], 0
            if held:
                yield _batch(row["path"], held)

    return run


def _batch(path: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
    index, text = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array(index, pa.int64()), pa.array(text, pa.string())], ["path", "tu_idx", "tu"])


class TmxScan(NamedTuple):
    """``units``: ``(path, tu_idx, tu)``, the raw text of each unit of every decodable file.
    ``documents``: ``(path, undecodable, open_end, rest)``, one row per file: whether its bytes are
    invalid, whether it ends inside a unit or section, and its text outside units with white space
    collapsed (the rest of a document that is well formed is its frame)."""

    units: DataFrame
    documents: DataFrame


def scan_tmx(spark: SparkSession, path: str, *, encoding: str = "UTF-16LE", recursive: bool = True, glob: str = "*.tmx",
             chunk_bytes: int = CHUNK_BYTES) -> TmxScan:
    """Units and frames of the TMX files under ``path``, a task per chunk of a file.

    The files must lie on a file system that Arrow knows (local or mounted, HDFS, S3, GCS). A comment,
    CDATA section or processing instruction that never ends takes the rest of the file with it, as
    for an XML parser; a unit that never ends is no unit. Both leave ``open_end`` set. Spark's
    file sources do not list files of no bytes, so these give neither units nor a document.
    """
    if chunk_bytes < 8 or chunk_bytes % 4:
        raise ValueError("chunk_bytes: a multiple of 4, at least 8")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    cores = spark.sparkContext.defaultParallelism
    # The content is not read here; a task lists many files.
    files = reader.load(path).select("path", "length").coalesce(cores)
    last = F.greatest(F.ceil(F.col("length") / chunk_bytes) - 1, F.lit(0)).cast("bigint")
    chunks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    size = files.agg(F.sum(last + 1).alias("chunks"), F.sum("length").alias("bytes")).first()
    # A task per CHUNK_BYTES, however small the chunks are.
    tasks = max(1, min(MAX_TASKS, max((size["bytes"] or 0) // CHUNK_BYTES, min(size["chunks"] or 1, cores))))
    measured = chunks.repartition(tasks, "path", "chunk").mapInArrow(
        _measure(encoding, chunk_bytes),
        "path string, length bigint, chunk bigint, bad boolean, ends array<int>, opens array<bigint>, rests array<string>",
    )
    carried = measured.repartition("path").sortWithinPartitions("path", "chunk").mapInArrow(
        _carry, "path string, length bigint, chunk bigint, bad boolean, state int, base bigint, end int, rest string"
    )
    # Written: the second pass and the documents read it, and a lost executor repeats no first pass.
    table = scratch_path(spark, "tmx-chunks")
    carried.write.parquet(table)
    carried = spark.read.schema(carried.schema).parquet(table)
    frame = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "rest"))), lambda s: s["rest"]), "")
    documents = carried.groupBy("path").agg(
        F.max("bad").alias("undecodable"), (F.max_by("end", "chunk") != 0).alias("open_end"), frame.alias("rest")
    )
    readable = carried.join(carried.where("bad").select("path").distinct(), "path", "left_anti")
    starts = readable.select("path", "length", "chunk", "state", "base").repartition(tasks, "path", "chunk")
    return TmxScan(starts.mapInArrow(_cut(encoding, chunk_bytes), "path string, tu_idx bigint, tu string"), documents)
