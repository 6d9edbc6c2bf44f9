"""WARC archives with a two-level capture index.

Pages are range-partitioned by their reversed-host URL key and each task writes gzip-per-record
archives in that order. The captures' index lines, sorted by the key, go into compressed blocks
of a fixed number of lines (level 2); a directory keeps one row per block with its first and last
key (level 1). A look-up finds the block by binary search in the directory and the lines by binary
search in the block, then reads only the record's byte range.

Archives and blocks are files in the cluster's shared folder, written through Arrow's file systems
(local, HDFS, object stores). Each attempt of a task writes files of its own name, and only the
rows of the attempt that Spark commits refer to them, so a lost executor leaves unread files at most.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import read, scratch_path, ship_package, written

MIN_REVISIT = 1000  # payloads below this many bytes are always stored
BLOCK_LINES = 1000  # captures per index block
ROLL_BYTES = 256 << 20  # an archive file is closed beyond this size
DATE = "2024-01-01T00:00:00Z"  # fixed value: the tables have no capture time
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value

CAPTURES = "surt string, page_id bigint, file string, start bigint, length bigint"
DIRECTORY = "first_key string, last_key string, file string, start bigint, length bigint, lines bigint"


def surt(url: Column) -> Column:
    """Reversed-host key: ``http://www.a.example.org:80/x?y#z`` -> ``org,example,a)/x?y``.

    A URL without a host keeps its text after ``)``; null is ``)``. White space is percent-encoded.
    """
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^(?i)(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))
    host = F.regexp_replace(host, r"^www\d*\.", "")
    rest = F.regexp_replace(F.regexp_replace(u, r"^(?i)(?:[a-z][a-z0-9+.\-]*:)?//[^/?#]*", ""), "#.*$", "")
    rest = F.when(F.startswith(rest, F.lit("/")) | (host == ""), rest).otherwise(F.concat(F.lit("/"), rest))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.regexp_replace(key, r"[\s\x00-\x1f]", "%20")


def _filesystem(uri: str):
    """Arrow file system and path of a Hadoop-style URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``(page_id, url, surt, payload, digest, refers_to, refers_url)``, one row per input row.

    Of equal payloads of at least ``min_revisit`` bytes the largest page_id is the response; the
    others refer to it. Null html is an empty payload. Rows that repeat the response's id are
    responses too; rows without an id refer but are never referred to. Digests, not payloads, are
    grouped; a payload that a third of all pages share is one partial row per task.
    """
    p = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    big = p.where((F.octet_length("payload") >= min_revisit) & F.col("page_id").isNotNull())
    best = big.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("best"), F.count("*").alias("n"))
    best = written(best.where("n > 1").select(F.col("digest").alias("d2"), "best"), "warc-best")
    p = p.join(best, (F.col("digest") == F.col("d2")) & (F.octet_length("payload") >= min_revisit), "left")
    other = F.col("best").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("best.page_id")))
    return p.select(
        "page_id", "url", surt(F.col("url")).alias("surt"), "payload", "digest",
        F.when(other, F.col("best.page_id")).alias("refers_to"), F.when(other, F.col("best.url")).alias("refers_url"),
    )


def _record(page_id, url: str, payload: bytes, digest: str, refers_to, refers_url) -> bytes:
    """One WARC record. Both kinds hold the HTTP headers; only a response holds the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    clean = lambda u: " ".join((u or "").split()).encode("utf-8")  # noqa: E731  no line ends in a header
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Target-URI: " + clean(url),
        f"WARC-Date: {DATE}".encode(),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(),
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)),
        b"Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}".encode(),
            f"WARC-Refers-To: <urn:page:{refers_to}>".encode(),
            b"WARC-Refers-To-Target-URI: " + clean(refers_url),
            f"WARC-Refers-To-Date: {DATE}".encode(),
        ]
    head.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    page_id: int | None
    url: str
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def parse_record(raw: bytes) -> Record:
    """A record from its gzip member. A response's digest and size are taken from its payload and
    must agree with its headers; a revisit's are those its headers give for the full payload."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return Record(_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI", ""), kind, refers, size, digest, payload if kind == "response" else None)


def write_archives(pages: DataFrame, folder: str, **cols) -> DataFrame:
    """Writes ``pages`` as archives under ``folder`` -> captures ``(surt, page_id, file, start, length)``."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = _filesystem(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page_id, url, key, payload, digest, refers_to, refers_url in zip(*(c.to_pylist() for c in b.columns)):
                    if out is None or at > ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        fs.create_dir(f"{base}/archives", recursive=True)
                        out = fs.open_output_stream(f"{base}/archives/{name}", compression=None)
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = z.compress(_record(page_id, url, payload, digest, refers_to, refers_url)) + z.flush()
                    out.write(raw)
                    rows.append((key, page_id, f"archives/{name}", at, len(raw)))
                    at += len(raw)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                got = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(got, kinds)], ["surt", "page_id", "file", "start", "length"])
        finally:
            if out is not None:
                out.close()

    r = resolve(pages, **cols).select("page_id", "url", "surt", "payload", "digest", "refers_to", "refers_url")
    # page_id as second key: a host or URL with a third of all pages is still split.
    r = r.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    return written(r.mapInArrow(run, CAPTURES), "warc-captures")


def _line(key: str, page_id, file: str, start: int, length: int) -> str:
    return f"{key} {json.dumps({'page_id': page_id, 'file': file, 'start': start, 'length': length})}"


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the sorted index blocks under ``folder`` -> the directory, one row per block."""
    ship_package(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = _filesystem(folder)
        name, at, out, lines, rows = f"index/{uuid.uuid4().hex}.cdx.gz", 0, None, [], []

        def flush():
            nonlocal at, out, lines
            if out is None:
                fs.create_dir(f"{base}/index", recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = z.compress("\n".join(x for _, x in lines).encode()) + z.flush()
            out.write(raw)
            rows.append((lines[0][0], lines[-1][0], name, at, len(raw), len(lines)))
            at, lines = at + len(raw), []

        try:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    lines.append((row[0], _line(*row)))
                    if len(lines) == block_lines:
                        flush()
            if lines:
                flush()
        finally:
            if out is not None:
                out.close()
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        got = zip(*rows) if rows else [()] * 6
        names = ["first_key", "last_key", "file", "start", "length", "lines"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(got, kinds)], names)

    s = captures.select("surt", "page_id", "file", "start", "length")
    s = s.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    return written(s.mapInArrow(run, DIRECTORY), "warc-directory")


def _block(fs, base: str, file: str, start: int, length: int) -> list[str]:
    with fs.open_input_file(f"{base}/{file}") as f:
        f.seek(start)
        return zlib.decompress(f.read(length), 31).decode().split("\n")


def _captures_of(line: str) -> dict:
    return json.loads(line.split(" ", 1)[1])


def _records(fs, base: str, captures: list[dict]) -> Iterator[Record]:
    """Records of captures by range reads, a file opened once for neighbouring captures."""
    f, name = None, None
    try:
        for c in captures:
            if c["file"] != name:
                if f is not None:
                    f.close()
                f, name = fs.open_input_file(f"{base}/{c['file']}"), c["file"]
            f.seek(c["start"])
            yield parse_record(f.read(c["length"]))
    finally:
        if f is not None:
            f.close()


def lookup(directory: DataFrame, folder: str, key: str) -> list[Record]:
    """The captures of one URL key: binary search in the directory (sparse, sorted; only blocks
    whose key range holds the key are fetched), then in each block, then range reads."""
    blocks = sorted(tuple(r) for r in directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).collect())
    fs, base = _filesystem(folder)
    out = []
    lo = bisect_left([b[1] for b in blocks], key)
    for _, _, file, start, length, _ in blocks[lo:]:
        lines = _block(fs, base, file, start, length)
        keys = [x.split(" ", 1)[0] for x in lines]
        out += _records(fs, base, [_captures_of(x) for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]])
    return out


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read_archives(directory: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records by way of the index: each task takes blocks of the directory and range-reads
    their captures, which lie one after another in the archives."""
    ship_package(directory.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for b in batches:
            for file, start, length in zip(*(b.column(k).to_pylist() for k in ("file", "start", "length"))):
                captures = [_captures_of(x) for x in _block(fs, base, file, start, length)]
                rows = [
                    (r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload if payloads else None)
                    for r in _records(fs, base, captures)
                ]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = [x.split()[0] for x in READ.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    # A fixed number of tasks: the directory is small, but each of its rows stands for many records.
    n = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return directory.repartition(n, "file", "start").mapInArrow(run, READ)


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    directory = write_index(write_archives(read(spark, sf_dir, "pages"), folder), folder)
    back = read_archives(directory, folder, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS best FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id < best THEN best END AS refers_to
FROM w"""
