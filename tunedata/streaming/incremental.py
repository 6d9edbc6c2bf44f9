"""Incremental runs of the file converters over new files (Structured Streaming).

TMX files are independent of each other, so a micro-batch of new files runs the batch plan
(parse → pair → render) through ``foreachBatch``; each epoch writes its own folder, so a
replayed epoch overwrites instead of duplicating. Row-wise JSON-lines converters (language
codes, flat text) run as plain streaming projections. Checkpoints live under the session's
shared checkpoint folder unless given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from tunedata.operators import bitext
from tunedata.session import scratch_path
from tunedata.sources.tmx import parse_tmx, tmx_errors

BINARY_FILE = StructType(
    [
        StructField("path", StringType(), False),
        StructField("modificationTime", TimestampType(), False),
        StructField("length", LongType(), False),
        StructField("content", BinaryType(), True),
    ]
)


def stream_tmx_to_sft(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    *,
    checkpoint_dir: str | None = None,
    policy: str = "training",
    encoding: str = "UTF-16LE",
    glob: str = "*.tmx",
    src_lang: str = "EN-GB",
    max_tus: int | None = None,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    on_error: str = "quarantine",
    errors: str | None = None,
) -> StreamingQuery:
    """Turn every new TMX file under ``input_dir`` into prompt/completion JSON lines.

    ``on_error`` as for ``parse_tmx``; malformed units and documents of each batch are written as
    JSON lines under ``errors`` if that is given.
    """
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    files = reader.load(input_dir).select("path", "content")

    def run_batch(batch: DataFrame, epoch: int) -> None:
        if errors:
            tmx_errors(batch, encoding=encoding).write.mode("overwrite").json(f"{errors.rstrip('/')}/epoch={epoch}")
        seg = parse_tmx(batch, encoding=encoding, on_error=on_error)
        pairs = bitext.tmx_to_pairs(seg, policy=policy, src_lang=src_lang, max_tus=max_tus)
        sft = bitext.to_sft(pairs, keep=["path", "tu_idx", "lang_pos"])
        sft.write.mode("overwrite").json(f"{output_dir.rstrip('/')}/epoch={epoch}")

    w = files.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir or scratch_path(spark, "stream-ckpt"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def stream_jsonl(
    spark: SparkSession,
    input_dir: str,
    schema: StructType | str,
    transform: Callable[[DataFrame], DataFrame],
    output_dir: str,
    *,
    checkpoint_dir: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Apply a row-wise transform (no cross-row state) to every new JSON-lines file."""
    src = spark.readStream.schema(schema).json(input_dir)
    w = (
        transform(src)
        .writeStream.format("json")
        .option("path", output_dir)
        .option("checkpointLocation", checkpoint_dir or scratch_path(spark, "stream-ckpt"))
        .outputMode("append")
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def write_tmx_files(docs: DataFrame, output_dir: str) -> None:
    """Write ``(path, content)`` UTF-8 TMX documents as one text file per ``path``
    (``output_dir/path=<escaped path>/part-*.txt``)."""
    docs.select("path", F.decode("content", "UTF-8").alias("value")).write.mode("overwrite").partitionBy("path").text(output_dir)


def original_path(file_path_col: str = "path") -> F.Column:
    """The ``path`` value a file written by :func:`write_tmx_files` came from."""
    return F.url_decode(F.regexp_extract(F.col(file_path_col), r"/path=([^/]+)/", 1))
