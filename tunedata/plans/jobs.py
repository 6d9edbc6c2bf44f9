"""File-to-file jobs: the reference's scripts as Spark plans.

Each job reads its input with a fixed schema, runs the operators, and writes its output as a
folder of part files (JSON lines or Parquet). Paths may be local or on any Hadoop file system.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.functions.text import iso2
from tunedata.operators import bitext, inference, metrics, sft, splits
from tunedata.plans.corpus import spread
from tunedata.session import scratch_path, ship_package
from tunedata.sources import jsonl
from tunedata.sources.tmx import read_tmx_segments

ORDER = ["path", "tu_idx", "lang_pos"]


def _segments(spark: SparkSession, tmx_path: str, **kw) -> DataFrame:
    ship_package(spark)
    return read_tmx_segments(spark, tmx_path, **kw)


def tmx_to_sft(spark: SparkSession, tmx_path: str, out: str, *, src_lang: str = "EN-GB",
               keep_order: bool = True, on_error: str = "quarantine") -> None:
    """TMX files → ``{"prompt", "completion"}`` JSON lines (training rules). A malformed unit is
    quarantined by default; ``on_error="fail"`` stops the job as the original converter did."""
    seg = _segments(spark, tmx_path, on_error=on_error)
    pairs = bitext.tmx_to_pairs(seg, policy="training", src_lang=src_lang)
    jsonl.write_jsonl(bitext.to_sft(pairs, keep=ORDER if keep_order else []), out)


def tmx_to_validation_set(spark: SparkSession, tmx_path: str, out: str, *, max_tus: int = 20, src_lang: str = "EN-GB",
                          on_error: str = "skip_file") -> None:
    """TMX files → ``{"src", "tgt", "lang"}`` JSON lines from the first ``max_tus`` units of each
    file; by default a file with a malformed unit gives nothing, as in the reference."""
    seg = _segments(spark, tmx_path, on_error=on_error)
    pairs = bitext.tmx_to_pairs(seg, policy="validation", src_lang=src_lang, max_tus=max_tus)
    jsonl.write_jsonl(bitext.to_eval_set(pairs, keep=ORDER), out)


def _rows(spark: SparkSession, in_path: str, schema: str | None) -> DataFrame:
    """JSON lines with a given schema, or with every field that the file has (one pass finds them)."""
    return jsonl.read_jsonl(spark, in_path, schema) if schema else spark.read.option("mode", "FAILFAST").json(in_path)


def _keyed(spark: SparkSession, df: DataFrame, key: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows with the order columns they have, or, if they have none, their place in the input:
    written once, as a row's place is fixed only then."""
    have = [c for c in key if c in df.columns]
    if have:
        return df, have
    path = scratch_path(spark, "job-rows")
    df.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path), ["__row"]


def fix_lang_codes(spark: SparkSession, in_path: str, out: str, schema: str | None = None) -> None:
    """Validation JSON lines → the same, all fields kept, with two-letter upper-case language codes. Without a
    ``schema`` the lines may hold any fields, of types that differ from line to line."""
    ship_package(spark)
    if schema is None:
        rows = jsonl.read_jsonl_objects(spark, in_path)
        fixed = jsonl.with_field("row", "lang", iso2(jsonl.field_text("row", "lang")))
        return jsonl.write_jsonl_objects(rows.select(fixed.alias("row")), out)
    df = jsonl.read_jsonl(spark, in_path, schema)
    if "lang" not in df.columns:
        df = df.withColumn("lang", F.lit(None).cast("string"))
    jsonl.write_jsonl(bitext.fix_lang_codes(df), out)


def split_dataset(spark: SparkSession, in_path: str, train_out: str, valid_out: str, *,
                  key: str | list[str] = tuple(ORDER), train_frac: float = 0.8,
                  seed: int = 42, schema: str | None = None) -> None:
    """Seeded shuffle, then exactly ``floor(train_frac * n)`` rows to ``train_out`` and the rest to
    ``valid_out``, with the fields of the input. ``key`` (one column or several) is the row's
    identity; a file without these columns is shuffled by the rows' places."""
    ship_package(spark)
    df = _rows(spark, in_path, schema)
    cols = df.columns
    df, by = _keyed(spark, df, [key] if isinstance(key, str) else list(key))
    s = splits.split_random(spread(df), by[0] if len(by) == 1 else by, train_frac, seed=seed)
    jsonl.write_jsonl(s.where(F.col("split") == "train").select(*cols), train_out)
    jsonl.write_jsonl(s.where(F.col("split") == "valid").select(*cols), valid_out)


def flatten_dataset(spark: SparkSession, in_path: str, out: str, schema: str = "prompt string, completion string") -> None:
    """Prompt/completion JSON lines → ``{"text": "{prompt} Output: {completion}"}``."""
    ship_package(spark)
    jsonl.write_jsonl(bitext.to_flat_text(jsonl.read_jsonl(spark, in_path, schema)), out)


def tokenise_dataset(spark: SparkSession, in_path: str, out: str, *, mode: str = "prompt_masked", max_length: int = 256,
                     vocab_size: int | None = None, train_frac: float = 0.8, order: tuple[str, ...] = tuple(ORDER), schema: str | None = None) -> None:
    """Prompt/completion JSON lines → Parquet of fixed-length ``int32`` arrays, partitioned by
    ``split`` (head/tail split in ``order``, as the trainers do). Every token of the data has an id, unless
    ``vocab_size`` asks for the most frequent ones only."""
    ship_package(spark)
    df, by = _keyed(spark, _rows(spark, in_path, schema), list(order))
    df = splits.split_head_tail(spread(df), by, train_frac).drop("pos", "__row")
    keep = [c for c in df.columns if c not in ("prompt", "completion")]
    chat = sft.chat_template(df)
    if vocab_size is None:
        rows = sft.tokenize_all(df, sft.number_tokens(chat, ["full_text"]), mode, max_length, keep=keep)
    else:
        rows = sft.tokenize_sft(df, sft.encoder(sft.build_vocab(chat, ["full_text"], vocab_size), vocab_size), mode, max_length, keep=keep)
    sft.to_training_table(rows, out, max_length)


def evaluate(spark: SparkSession, eval_path: str, systems: Mapping[str, Callable[[], Callable]], out: str, *,
             batch_size: int = 64, style: str = "quoted", schema: str | None = None,
             by_lang: bool = True) -> DataFrame:
    """Eval JSON lines → predictions of every system (Parquet by system under ``out``/predictions)
    and corpus BLEU per system (and language). Returns the score table."""
    ship_package(spark)
    ev = _rows(spark, eval_path, schema).withColumn("__row", F.monotonically_increasing_id())
    ev = sft.infer_prompt(ev, style)
    preds = inference.predict_systems(ev, systems, ["infer_prompt", "src", "tgt"], batch_size=batch_size)
    preds = inference.persist_predictions(preds, f"{out.rstrip('/')}/predictions")
    groups = ["system", "lang"] if by_lang else ["system"]
    scores = metrics.corpus_bleu(preds, ["system", "__row"], "prediction", F.array("tgt"), groups)
    scores.write.mode("overwrite").json(f"{out.rstrip('/')}/bleu")
    return scores


COMMANDS = {
    "tmx-to-sft": tmx_to_sft,
    "tmx-to-validation": tmx_to_validation_set,
    "fix-lang-codes": fix_lang_codes,
    "split": split_dataset,
    "flatten": flatten_dataset,
    "tokenise": tokenise_dataset,
}

__all__ = [f.__name__ for f in COMMANDS.values()] + ["evaluate"]
