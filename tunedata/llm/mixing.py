"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, ... and share all words of the
corpus, but none gets more than ``max_repeat`` times its own; the excess is shared anew by weight.
That fixed point is ``target = min(max_repeat * size, level * weight)`` for one common level.

Curriculum: a source's weight changes linearly over training time t in [0, 1], so its demand up
to t is the integral ``target * ((1 - s) * t + s * t^2)``. A source's documents form one stream in
a seeded order, repeated whole; the words before a document in that stream, put into the inverse of
the demand, give its training position. The schedule is a range sort by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tunedata.llm.common import WORD, read, row_key, unused, written
from tunedata.plans.rank import exact_rank

WEIGHTS = (5.0, 2.0, 1.0)  # fixed values: by place of the source, repeating
SLOPES = (-0.5, 0.0, 0.5)  # of the schedules, by place: falling, level, rising
MAX_REPEAT = 3
SEED = 42
GROUP = 4096  # documents a piece of the seeded order, on average; pieces number at most 16^5


def _by_place(values: tuple[float, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None) -> DataFrame:
    """``(doc_id, source, size, digest, key)``: the number of words of each text (null: 0), the text's
    hash, and what tells rows of one id and text apart: ``key_col``, or else nothing (the hash)."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.sha2(F.col(text_col), 256).alias("digest"),
        (F.col(key_col) if key_col else F.sha2(F.col(text_col), 256)).alias("key"),
    )


def targets(sized: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size, weight, slope, target)``, one row per source (null is a source).

    Sources may be many (hosts, files): they are ranked by a range sort, and no task holds them all.
    The level is found by rounds of one sum each: cap the sources that it would lift above their cap,
    share what is left among the others, until no further one is capped. The level only rises, so
    a capped source stays capped.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    place = F.col("place") - 1
    per = exact_rank(per, [F.col("source").asc_nulls_last()], rank_col="place")
    per = per.withColumn("weight", _by_place(WEIGHTS, place)).withColumn("slope", _by_place(SLOPES, place)).drop("place")
    per = written(per.withColumn("cap", F.lit(max_repeat) * F.col("source_size")), "mix-sources")
    level, capped = 0.0, -1
    while True:
        is_capped = F.col("cap") / F.col("weight") < level
        row = per.agg(
            F.count_if(is_capped).alias("n"),
            F.sum("source_size").alias("total"),
            F.sum(F.when(is_capped, F.col("cap"))).alias("caps"),
            F.sum(F.when(~is_capped, F.col("weight"))).alias("weights"),
        ).first()
        if row["n"] == capped or not row["weights"]:
            break
        capped = row["n"]
        level = (row["total"] - (row["caps"] or 0)) / row["weights"]
    target = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    return per.select("source", "source_size", "weight", "slope", target.alias("target"))


def streams(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """Each document with ``start``: the words before it in its source's seeded order.

    The order is cut into ranges of its hash, the more the more documents there are; their sums give
    each range's start, and a window numbers the documents within one range of one source, so a source
    with a third of all rows is spread over all tasks. Id and text are hashed, so rows that share an
    id (or have none) are spread too, and rows equal in everything are one row with a count until
    their places are known. Rows that share id and text but not ``key`` are numbered by one task.
    """
    same = ["doc_id", "source", "size", "digest", "key"]
    d = written(sized.groupBy(*same).agg(F.count("*").alias("times")), "mix-distinct")
    digits = next((k for k in range(1, 5) if 16**k * GROUP >= d.count()), 5)
    d = d.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("digest"))))
    d = d.withColumn("b", F.substring("h", 1, digits))
    words = F.col("size") * F.col("times")
    sums = d.groupBy("source", "b").agg(F.sum(words).alias("n"))
    up_to = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s2"), F.col("b").alias("b2"), F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "b").orderBy("h", *same).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum(words).over(within), F.lit(0)))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")))
    d = d.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)))
    return d.withColumn("start", F.col("base") + F.col("inner") + F.col("nth") * F.col("size")).drop("s2", "b2", "base", "inner", "b", "nth", "times")


def _position(offset: Column) -> Column:
    """t at which the source's cumulative demand reaches ``offset`` words."""
    x = offset / F.col("target")
    s = F.col("slope")
    root = F.sqrt((1.0 - s) * (1.0 - s) + 4.0 * s * x)
    return F.when(s == 0, x).otherwise((root - (1.0 - s)) / (2.0 * s) + 0.0)


def mix(docs: DataFrame, seed: int = SEED, max_repeat: int = MAX_REPEAT, **cols: str) -> DataFrame:
    """``(doc_id, source, size, key, source_size, target, copies, start)`` with one row per input row.

    ``copies`` is how often the mix takes the document: once for each repetition of its source's
    stream in which its middle lies before the target. A source's taken words therefore miss its
    target by at most half a document at the cut. Documents without words take none (copies 1 of
    zero words if their place in the stream is reached). Repeated rows are documents of their
    own, in a fixed order; a null source is a source; other columns are ignored.
    """
    sized = written(sizes(docs, **cols), "mix-sizes")
    per = targets(sized, max_repeat).select(F.col("source").alias("s1"), "source_size", "slope", "target")
    # one row per source: a join by source, which AQE may split or broadcast by measured size
    d = streams(sized, seed).join(per, F.col("source").eqNullSafe(F.col("s1"))).drop("s1")
    middle = F.col("start") + F.col("size") / 2
    reached = [F.when(F.lit(e) * F.col("source_size") + middle <= F.col("target"), 1).otherwise(0) for e in range(max_repeat)]
    copies = sum(reached[1:], reached[0])
    return d.withColumn("copies", F.when(F.col("target") > 0, copies).otherwise(0))


def schedule(mixed: DataFrame) -> DataFrame:
    """The mix in training order: one row per taken copy with ``repeat`` (from 0) and ``position``
    in [0, 1], range-sorted by position."""
    each = mixed.where("copies > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    each = each.withColumn("position", _position(F.col("repeat") * F.col("source_size") + F.col("start")))
    return each.orderBy("position", "doc_id", "key", "repeat")


def scheduled_documents(docs: DataFrame, seed: int = SEED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-sorted by training position; all
    columns kept. Each row has its own places, also where ids are null or repeated."""
    row, place = unused(docs, "mix_key"), unused(docs, "mix_position")
    keyed = docs.withColumn(row, row_key(docs))
    plan = schedule(mix(keyed, seed, max_repeat, key_col=row)).select(F.col("key").alias(row), F.col("position").alias(place))
    # Rows equal in all columns are interchangeable: each of their places goes to one of them.
    return keyed.dropDuplicates([row]).join(plan, row).orderBy(place, "doc_id", row).select(*docs.columns)


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the schedule takes of each document: the words and the first position of its places in the
    sorted mix, which is written in training order; documents without a place take nothing."""
    row = F.monotonically_increasing_id()  # told apart by row: ids may repeat; fixed by writing
    m = written(mix(read(spark, sf_dir, "documents")).drop("digest", "h").withColumn("row", row), "mix")
    places = written(schedule(m).select("row", "size", "position"), "mix-schedule")
    per = places.groupBy("row").agg(F.sum("size").alias("taken"), F.min("position").alias("first_position"))
    return m.join(per, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        "first_position",
    )


def _case(values: tuple[float, ...]) -> str:
    whens = " ".join(f"WHEN {i} THEN CAST({v} AS DOUBLE)" for i, v in enumerate(values))
    return f"CASE place % {len(values)} {whens} END"


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5(concat_ws('|', '{SEED}', CAST(doc_id AS VARCHAR), sha256(text))) AS h
  FROM documents),
p AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, {_case(WEIGHTS)} AS weight, {_case(SLOPES)} AS slope, {MAX_REPEAT} * source_size AS cap FROM p),
c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM w),
l AS (SELECT *, CAST(total - cap_before AS DOUBLE) / (weights - weight_before) AS lv FROM c),
t AS (SELECT *, max(CASE WHEN lv <= cap / weight THEN lv END) OVER () AS level FROM l),
s AS (SELECT source, source_size, slope, least(CAST(cap AS DOUBLE), coalesce(level, 0.0) * weight) AS target FROM t),
o AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
j AS (SELECT o.*, source_size, slope, target FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source),
k AS (
  SELECT *, CASE WHEN target > 0 THEN {" + ".join(f"CASE WHEN {e} * source_size + (start + size / 2) <= target THEN 1 ELSE 0 END" for e in range(MAX_REPEAT))} ELSE 0 END AS copies
  FROM j)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * copies AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN CASE WHEN slope = 0 THEN CAST(start AS DOUBLE) / target
         ELSE (sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * (CAST(start AS DOUBLE) / target)) - (1.0 - slope)) / (2.0 * slope) + 0.0 END END AS first_position
FROM k"""
