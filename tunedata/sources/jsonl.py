"""JSON-lines source and sinks.

Reads always take a fixed schema (no inference pass over the data). Blank and
whitespace-only lines are skipped by the JSON source itself.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_NON_ASCII = re.compile(r"[^\x00-\x7f]")


def _u_escape(m: re.Match) -> str:
    cp = ord(m.group(0))
    if cp < 0x10000:
        return f"\\u{cp:04x}"
    cp -= 0x10000
    return f"\\u{0xD800 + (cp >> 10):04x}\\u{0xDC00 + (cp & 0x3FF):04x}"


@F.pandas_udf(StringType())
def ascii_escape_json(lines: pd.Series) -> pd.Series:
    """Escape every non-ASCII character of JSON text as ``\\uXXXX`` (surrogate pairs above
    U+FFFF), as ``json.dumps`` does by default. Valid because such characters only occur
    inside string literals."""
    return lines.map(lambda s: None if s is None else _NON_ASCII.sub(_u_escape, s))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, *, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines with a fixed schema. A malformed line raises; :func:`read_jsonl_quarantine` sets
    such lines apart instead. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_jsonl_quarantine(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """JSON lines with a fixed schema -> ``(rows, malformed)``, the latter with the line as ``record``."""
    fields = spark.createDataFrame([], schema).schema
    ddl = StructType([*fields, StructField("_corrupt_record", StringType())]).simpleString()
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$"))
    parsed = lines.select("value", F.from_json("value", ddl, {"mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt_record"), parsed.where(bad).select(F.col("value").alias("record"))


def read_jsonl_objects(spark: SparkSession, path: str, col: str = "row") -> DataFrame:
    """JSON lines of any fields as one ``map<string, variant>`` column: a field may be a number in one
    line and an object in the next, and nothing looks for a schema first. Blank lines are skipped; a line
    that is no JSON object, or names a field twice, raises."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$"))
    return lines.select(F.parse_json("value").cast("map<string, variant>").alias(col))


def with_field(row: Column | str, name: str, value: Column) -> Column:
    """A ``map<string, variant>`` with one field set, all others kept."""
    row = F.col(row) if isinstance(row, str) else row
    others = F.map_filter(row, lambda k, _: k != name)
    return F.map_concat(others, F.create_map(F.lit(name), value.cast("variant")))


def field_text(row: Column | str, name: str) -> Column:
    """A field as text: NULL if it is missing, null, an object or an array."""
    value = F.element_at(F.col(row) if isinstance(row, str) else row, F.lit(name))
    return F.when(~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(value, "$", "string"))


def write_jsonl_objects(df: DataFrame, path: str, col: str = "row", mode: str = "overwrite") -> None:
    """The ``map<string, variant>`` column as JSON lines."""
    df.select(F.to_json(col).alias("value")).write.mode(mode).text(path)


def write_jsonl(df: DataFrame, path: str, *, ascii: bool = False, mode: str = "overwrite", compression: str | None = None) -> None:
    """Write JSON lines, UTF-8. ``ascii=True`` escapes non-ASCII text like ``json.dumps``."""
    if not ascii:
        w = df.write.mode(mode).option("ignoreNullFields", "false")
        if compression:
            w = w.option("compression", compression)
        w.json(path)
        return
    line = ascii_escape_json(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    w = df.select(line.alias("value")).write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.text(path)


def write_noop(df: DataFrame) -> None:
    """Run the plan and discard the rows (a disabled output branch)."""
    df.write.format("noop").mode("overwrite").save()
