"""TMX translation memories as DataFrames.

Files are cut into ``<tu>`` fragments chunk by chunk (:mod:`tunedata.sources.tmx_chunks`); documents
that are rows already, by one regex pass. The fragments are hash-partitioned on
``(path, tu_idx)`` so the XML parse runs in parallel even for one huge file, and every
later per-unit step (language de-dup, source/target pairing) finds its input already
clustered: the whole TMX-to-pairs plan has a single shuffle of units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata import schemas
from tunedata.functions.text import WS_CLASS, xml_escape
from tunedata.operators.batches import small
from tunedata.session import scratch_path
from tunedata.sources.tmx_chunks import CHUNK_BYTES, scan_tmx

# One <tu> element (not <tuv>), self-closing or up to its end tag; comments, CDATA sections and
# processing instructions are consumed first, so nothing inside them opens or ends a unit.
_SKIP = r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>"
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*?"""
TU_PATTERN = rf"(?s){_SKIP}|(<tu(?=[\s>/]){_ATTRIBUTES}(?:/>|>(?:[^<]++|{_SKIP}|<(?!/tu\s*>))*+</tu\s*>))"
# What is left of a document without its units, comments and declarations: one closed element.
_DOCTYPE = r"(?s)<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>"
_ROOT = r"(?s)^[\ufeff\s]*<([\w:.\-]+)(?:\s.*)?(?:/>|</\1\s*>)\s*$"
# Comments and processing instructions are not text (an XML parser joins the text around
# them); CDATA sections are matched first and put back unchanged.
NON_TEXT_PATTERN = r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->|<\?.*?\?>"


def read_tmx(spark: SparkSession, path: str, *, recursive: bool = True, glob: str = "*.tmx") -> DataFrame:
    """TMX files as ``(path, content)`` rows, 2 GB at most each, for :func:`parse_tmx`;
    :func:`read_tmx_segments` reads files of any size."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "content")


def read_tmx_segments(
    spark: SparkSession,
    path: str,
    *,
    encoding: str = "UTF-16LE",
    inline: str = "leading",
    on_error: str = "quarantine",
    num_partitions: int | None = None,
    glob: str = "*.tmx",
    recursive: bool = True,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Segments of every TMX file under ``path``, whatever their sizes: the rows of :func:`parse_tmx`,
    each file cut by a task per ``chunk_bytes``."""
    _check_options(inline, on_error)
    scan = scan_tmx(spark, path, encoding=encoding, recursive=recursive, glob=glob, chunk_bytes=chunk_bytes)
    units = scan.units
    if on_error != "quarantine":
        broken = scan.documents.where(_frame_is_broken()).select("path")
        if on_error == "skip_file":
            units = units.join(broken, "path", "left_anti")
        elif first := broken.first():
            raise ValueError(f"malformed document: {first.path}")
    return _parse_units(_dealt(units, num_partitions), inline, on_error)


def read_tmx_errors(
    spark: SparkSession, path: str, *, encoding: str = "UTF-16LE", glob: str = "*.tmx", recursive: bool = True, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """:func:`tmx_errors` of the TMX files under ``path``, whatever their sizes."""
    scan = scan_tmx(spark, path, encoding=encoding, recursive=recursive, glob=glob, chunk_bytes=chunk_bytes)
    units = _parse_units(_dealt(scan.units, None), "leading", "quarantine", keep_errors=True)
    return units.unionByName(_document_errors(scan.documents.where(_frame_is_broken())))


def _frame_is_broken() -> Column:
    return F.col("undecodable") | F.col("open_end") | rest_is_broken(F.col("rest"))


def _document_errors(broken: DataFrame) -> DataFrame:
    return broken.select("path", F.lit(None).cast("int").alias("tu_idx"), F.lit("malformed document").alias("record"))


def _check_options(inline: str, on_error: str) -> None:
    if inline not in ("leading", "all_text", "raw"):
        raise ValueError(f"inline={inline!r}")
    if on_error not in ("quarantine", "skip_file", "fail"):
        raise ValueError(f"on_error={on_error!r}")


def _leading_text(inner: Column, parts: Column) -> Column:
    """Text of <seg> before its first child element (what ElementTree calls ``.text``).

    ``inner`` is the raw inner XML with entities decoded (NULL when <seg> is missing) and
    ``parts`` the list of its text nodes. A first text node that is a prefix of the inner
    XML is the leading text; otherwise the segment starts with whitespace or a child.
    """
    first = F.element_at(parts, 1)
    return (
        F.when(inner.isNull(), F.lit(None).cast("string"))
        .when(first.isNotNull() & F.startswith(inner, first), first)
        .otherwise(F.regexp_extract(inner, f"^({WS_CLASS}*)", 1))
    )


def parse_tmx(
    files: DataFrame,
    *,
    encoding: str = "UTF-16LE",
    inline: str = "leading",
    on_error: str = "quarantine",
    num_partitions: int | None = None,
    keep_errors: bool = False,
) -> DataFrame:
    """``(path, content)`` → one row per ``<tuv>``: ``(path, tu_idx, tuv_idx, lang, seg_raw)``.

    ``seg_raw`` is the unstripped text of ``<seg>`` (NULL when the element is missing,
    ``''`` when it is empty or starts with a child); :func:`tunedata.operators.bitext.valid_segments`
    applies the keep rules and the strip.

    inline:   "leading" (text before the first inline child), "all_text" (all text nodes),
              "raw" (inner XML).
    on_error: "quarantine" drops malformed units, "skip_file" drops every file with a malformed
              unit or a malformed document around its units (cut off, broken markup, wrong
              encoding), "fail" raises on either. :func:`tmx_errors` lists both kinds.
    """
    _check_options(inline, on_error)
    drop = on_error == "skip_file" and not keep_errors
    units = tmx_units(files, encoding=encoding, num_partitions=num_partitions, check=on_error == "fail", drop_broken=drop)
    return _parse_units(units, inline, on_error, keep_errors)


def _parse_units(units: DataFrame, inline: str, on_error: str, keep_errors: bool = False) -> DataFrame:
    """``(path, tu_idx, tu)``, dealt out -> segments, or what is quarantined."""
    mode = "FAILFAST" if on_error == "fail" else "PERMISSIVE"
    opts = {"mode": mode, "columnNameOfCorruptRecord": "_corrupt_record", "ignoreSurroundingSpaces": "false"}
    views = [F.from_xml("tu", schemas.TU_RAW_DDL, opts).alias("raw")]
    if inline != "raw":
        views.append(F.from_xml("tu", schemas.TU_PARTS_DDL, opts).alias("parts"))
    # Parsed inside a generator: a filter on its output stays above it (and above the exchange), so
    # each unit is parsed once, in the task that it was dealt to.
    parsed = units.select("path", "tu_idx", F.explode(F.array(F.struct(*views))).alias("x")).select("path", "tu_idx", "x.*")
    if on_error == "skip_file" and not keep_errors:
        # Written once: the files with a malformed unit and the units themselves are read from it.
        spark, table = units.sparkSession, scratch_path(units.sparkSession, "tmx-parsed")
        parsed.write.parquet(table)
        parsed = spark.read.schema(parsed.schema).parquet(table)
    return _segments(parsed, inline, on_error, keep_errors)


def _segments(parsed: DataFrame, inline: str, on_error: str, keep_errors: bool) -> DataFrame:
    """``(path, tu_idx, raw, parts)`` parsed units → one row per ``<tuv>``."""
    bad = F.col("raw._corrupt_record").isNotNull()
    if keep_errors:
        return parsed.where(bad).select("path", F.col("tu_idx").cast("int").alias("tu_idx"), F.col("raw._corrupt_record").alias("record"))
    good = parsed.where(~bad)
    if on_error == "skip_file":
        bad_files = parsed.where(bad).select("path").distinct()
        good = good.join(bad_files, "path", "left_anti")
    if inline == "raw":
        tuvs = good.select("path", "tu_idx", F.posexplode("raw.tuv").alias("tuv_idx", "r"))
        seg = F.col("r.seg")
    else:
        zipped = F.arrays_zip(F.col("raw.tuv").alias("r"), F.col("parts.tuv").alias("p"))
        tuvs = good.select("path", "tu_idx", F.posexplode(zipped).alias("tuv_idx", "z")).select(
            "path", "tu_idx", "tuv_idx", F.col("z.r").alias("r"), F.col("z.p").alias("p")
        )
        vals = F.col("p.seg._VALUE")
        if inline == "leading":
            seg = _leading_text(F.col("r.seg"), vals)
        else:
            seg = F.when(F.col("r.seg").isNotNull(), F.coalesce(F.array_join(vals, ""), F.col("r.seg")))
    return tuvs.select(
        "path",
        F.col("tu_idx").cast("int").alias("tu_idx"),
        F.col("tuv_idx").cast("int").alias("tuv_idx"),
        F.col("r.`_xml:lang`").alias("lang"),
        seg.alias("seg_raw"),
    )


DECODED_BYTES = 4 << 20  # of content that is decoded together


def _decode(encoding: str) -> Callable:
    def one(b: pa.Scalar) -> str | None:
        try:
            return bytes(b.as_buffer()).decode(encoding) if b.is_valid else None
        except UnicodeDecodeError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, lambda b: b.column("content"), DECODED_BYTES):
            texts = pa.array([one(x) for x in b.column("content")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("path"), texts], ["path", "text"])

    return run


def decoded(files: DataFrame, encoding: str) -> DataFrame:
    """``(path, content)`` → ``(path, text)``, NULL where the bytes are not valid in ``encoding`` (the
    built-in ``decode`` would fail the whole job).

    An Arrow batch of documents is taken in slices of ``DECODED_BYTES`` (one document at least), so a
    worker holds the texts of one slice, however many documents there are. Filters stay above.
    """
    return files.select("path", "content").mapInArrow(_decode(encoding), "path string, text string")


def document_is_broken(text: Column) -> Column:
    """Whether what surrounds the units of a document is no well-formed element."""
    return text.isNull() | rest_is_broken(F.regexp_replace(text, TU_PATTERN, ""))


def rest_is_broken(outside: Column) -> Column:
    """The same from the text outside units, comments and processing instructions."""
    rest = F.regexp_replace(outside, _DOCTYPE, "")
    parsed = F.from_xml(F.regexp_replace(rest, "^[\\ufeff\\s]+", ""), "_corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.coalesce(~rest.rlike(_ROOT) | parsed["_corrupt_record"].isNotNull(), F.lit(True))


def tmx_units(files: DataFrame, *, encoding: str = "UTF-16LE", num_partitions: int | None = None, check: bool = False, drop_broken: bool = False) -> DataFrame:
    """``(path, content)`` → ``(path, tu_idx, tu)``: each ``<tu>`` fragment in document order.
    ``check`` raises on a malformed document, ``drop_broken`` leaves it out."""
    files, text = decoded(files, encoding), F.col("text")
    if drop_broken:
        files = files.where(~document_is_broken(text))
    if check:
        text = F.when(document_is_broken(text), F.raise_error(F.concat(F.lit("malformed document: "), "path"))).otherwise(text)
    found = F.filter(F.regexp_extract_all(text, F.lit(TU_PATTERN), 1), lambda x: x != "")
    return _dealt(files.select("path", F.posexplode(found).alias("tu_idx", "tu")), num_partitions)


def _dealt(units: DataFrame, num_partitions: int | None) -> DataFrame:
    """Units without comments and processing instructions, hash-partitioned."""
    tu = F.col("tu")
    units = units.withColumn(
        "tu", F.when(tu.contains("<!--") | tu.contains("<?"), F.regexp_replace(tu, NON_TEXT_PATTERN, "$1")).otherwise(tu)
    )
    keys = [F.col("path"), F.col("tu_idx")]
    return units.repartition(num_partitions, *keys) if num_partitions else units.repartition(*keys)


def tmx_errors(files: DataFrame, *, encoding: str = "UTF-16LE", num_partitions: int | None = None) -> DataFrame:
    """What :func:`parse_tmx` quarantines: ``(path, tu_idx, record)``, a malformed unit, or, with a
    NULL ``tu_idx``, a malformed document around its units."""
    units = parse_tmx(files, encoding=encoding, num_partitions=num_partitions, keep_errors=True)
    broken = decoded(files, encoding).where(document_is_broken(F.col("text")))
    return units.unionByName(_document_errors(broken))


def tuv_xml(lang: Column, seg_xml: Column) -> Column:
    """One ``<tuv>`` element from a language code and already-escaped seg content."""
    return F.concat(F.lit('<tuv xml:lang="'), lang, F.lit('"><seg>'), seg_xml, F.lit("</seg></tuv>"))


def tu_xml(*tuvs: Column) -> Column:
    return F.concat(F.lit("<tu>"), *tuvs, F.lit("</tu>"))


def write_tmx_bytes(units: DataFrame, *, encoding: str = "UTF-16LE", bom: bool = True) -> DataFrame:
    """``(path, pos, tu)`` → ``(path, content)``: one TMX document per path, units in ``pos`` order.

    The caller bounds the number of units per path; the units of one path meet in one task.
    """
    header = ('\ufeff' if bom else "") + f'<?xml version="1.0" encoding="{encoding}"?>\n<tmx version="1.4"><header/><body>\n'
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tu"))), lambda s: s["tu"]), "\n")
    docs = units.groupBy("path").agg(body.alias("body"))
    return docs.select("path", F.encode(F.concat(F.lit(header), "body", F.lit("\n</body></tmx>\n")), encoding).alias("content"))


__all__ = ["read_tmx", "parse_tmx", "read_tmx_segments", "read_tmx_errors", "tmx_units", "tmx_errors", "tuv_xml", "tu_xml", "write_tmx_bytes", "xml_escape"]
