"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

All read the driver tables (or data Spark derives from them) in full. Column names match
the DuckDB oracle in :mod:`tunedata.plans.oracle`.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.functions.text import extract_reply, format_score, tok_13a, ustrip, word_tokens
from tunedata.operators.batches import map_batches
from tunedata.operators import bitext, inference, metrics, sft, splits, stats
from tunedata.plans import jobs
from tunedata.plans.corpus import bitext_tmx, conversation_pairs, spread, table
from tunedata.plans.systems import SYSTEMS
from tunedata.session import scratch_path, ship_package
from tunedata.sources import jsonl, shards
from tunedata.sources.tmx import parse_tmx, read_tmx_segments, tmx_errors
from tunedata.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query; it first makes the package importable by the Python workers."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


# ---------------------------------------------------------------- TMX → bitext


def _segments(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return parse_tmx(bitext_tmx(spark, sf_dir), **kw)


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitext.tmx_to_pairs(_segments(spark, sf_dir), policy="training")


def validation_pairs(spark: SparkSession, sf_dir: str, max_tus: int | None = None) -> DataFrame:
    return bitext.tmx_to_pairs(_segments(spark, sf_dir), policy="validation", max_tus=max_tus)


@query
def tmx_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _segments(spark, sf_dir)
    return seg.select("path", "tu_idx", "tuv_idx", "lang", ustrip("seg_raw").alias("seg"))


@query
def tmx_pairs_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_pairs(spark, sf_dir)


@query
def tmx_pairs_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_pairs(spark, sf_dir)


@query
def tmx_first_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_pairs(spark, sf_dir, max_tus=20)


@query
def tmx_pairs_large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs of TMX files on disk (UTF-8 here), cut by chunks. These files are small, so the
    chunks are too: most files take several, and units straddle them."""
    src = scratch_path(spark, "tmx-files")
    incremental.write_tmx_files(bitext_tmx(spark, sf_dir, encoding="UTF-8"), src)
    seg = read_tmx_segments(spark, src, encoding="UTF-8", glob="*.txt", chunk_bytes=16 << 10)
    pairs = bitext.tmx_to_pairs(seg, policy="training")  # by the files' own paths, on which units are dealt out
    # The file path is a URI: the partition folder name is percent-encoded once more.
    return pairs.withColumn("path", F.url_decode(incremental.original_path("path")))


@query
def tmx_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tmx_errors(bitext_tmx(spark, sf_dir)).groupBy("path").agg(F.count("*").cast("bigint").alias("n_bad"))


@query
def tmx_pairs_skip_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _segments(spark, sf_dir, on_error="skip_file")
    return bitext.tmx_to_pairs(seg, policy="validation")


# ---------------------------------------------------------------- rendering


@query
def sft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitext.to_sft(training_pairs(spark, sf_dir), keep=["path", "tu_idx", "lang_pos"])


@query
def flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sft = bitext.to_sft(training_pairs(spark, sf_dir), keep=["path", "tu_idx", "lang_pos"])
    return bitext.to_flat_text(sft, keep=["path", "tu_idx", "lang_pos"])


@query
def drop_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    sft = bitext.to_sft(validation_pairs(spark, sf_dir), keep=["path", "tu_idx", "lang_pos"])
    return bitext.drop_blank(sft, ["prompt", "completion"])


@query
def lang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitext.fix_lang_codes(validation_pairs(spark, sf_dir))


@query
def lang_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitext.to_sft(training_pairs(spark, sf_dir), lang_style="name", keep=["path", "tu_idx", "lang_pos"])


# ---------------------------------------------------------------- sources / sinks / counters


def _keyed_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitext.to_sft(training_pairs(spark, sf_dir), keep=["path", "tu_idx", "lang_pos"])


@query
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "jsonl")
    jsonl.write_jsonl(_keyed_sft(spark, sf_dir), out)
    return jsonl.read_jsonl(spark, out, "path string, tu_idx int, lang_pos int, prompt string, completion string")


@query
def jsonl_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "jsonl-ascii")
    jsonl.write_jsonl(_keyed_sft(spark, sf_dir), out, ascii=True)
    ddl = "path string, tu_idx int, lang_pos int, prompt string, completion string"
    lines = spark.read.text(out)
    return lines.select(
        F.from_json("value", ddl).alias("r"), F.col("value").rlike(r"^[\x00-\x7F]*$").alias("is_ascii")
    ).select("r.*", "is_ascii")


@query
def lang_codes_mixed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in which a field is a number, an object or an array, by line, with their language
    codes fixed and every field kept."""
    src, out = scratch_path(spark, "mixed-jsonl"), scratch_path(spark, "mixed-fixed")
    n, k = F.col("n_chars").cast("string"), F.col("doc_id") % 3
    meta = F.when(k == 0, n).when(k == 1, F.concat(F.lit('{"n":'), n, F.lit(',"to":null}'))).otherwise(F.concat(F.lit("["), n, F.lit(',"x"]')))
    lang = F.when(F.col("lang").isNotNull(), F.concat(F.lit('"lang":"'), "lang", F.lit('-xx",'))).otherwise("")
    docs = table(spark, sf_dir, "documents")
    docs.select(F.concat(F.lit("{"), lang, F.lit('"id":'), F.col("doc_id").cast("string"), F.lit(',"meta":'), meta, F.lit("}")).alias("value")).write.text(src)
    jobs.fix_lang_codes(spark, src, out)
    rows = jsonl.read_jsonl_objects(spark, out)
    field = lambda name: F.col("row")[name]
    return rows.select(F.try_variant_get(field("id"), "$", "bigint").alias("doc_id"), jsonl.field_text("row", "lang").alias("lang"), F.to_json(field("meta")).alias("meta"))


@query
def preview_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.preview(_keyed_sft(spark, sf_dir), 5, ["path", "tu_idx", "lang_pos"], ["prompt", "completion"])


@query
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dataset_stats(training_pairs(spark, sf_dir), ["lang"], ["path", "tu_idx"], "path")


# ---------------------------------------------------------------- splits


@query
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return splits.split_random(orders, "o_orderkey", 0.8, seed=42)


@query
def split_test_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.split_test_size(docs, "doc_id", 0.2, seed=42)


@query
def split_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return splits.split_head_tail(orders, ["o_orderkey"], 0.8)


@query
def split_pairs_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rank reads its input twice (bucket sizes, numbering): start from the written examples.
    pairs = sft_jsonl(spark, sf_dir).select("path", "tu_idx", "lang_pos")
    return splits.split_head_tail(pairs, ["path", "tu_idx", "lang_pos"], 0.8)


@query
def shuffle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.shuffle_rows(docs, "doc_id", seed=7)


@query
def split_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    s = splits.split_random(orders, "o_orderkey", 0.8, seed=42)
    parts = [s.where(F.col("split") == "train"), s.where(F.col("split") == "valid")]
    return splits.check_partition(orders, parts, "o_orderkey")


# ---------------------------------------------------------------- SFT tokenisation

KEYS = ["path", "tu_idx", "lang_pos"]
DOC_VOCAB = 5000  # rows of the report `vocab`; every other query numbers all tokens


@query
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.chat_template(_keyed_sft(spark, sf_dir)).select(*KEYS, "user_text", "full_text")


@query
def infer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = bitext.fix_lang_codes(validation_pairs(spark, sf_dir))
    q = sft.infer_prompt(ev, "quoted").withColumnRenamed("infer_prompt", "quoted")
    return sft.infer_prompt(q, "legacy").select(*KEYS, "quoted", F.col("infer_prompt").alias("legacy"))


def _doc_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.build_vocab(table(spark, sf_dir, "documents"), ["text"], DOC_VOCAB)


@query
def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_vocab(spark, sf_dir)


def _all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.number_tokens(table(spark, sf_dir, "documents"), ["text"])


def _encoded(spark: SparkSession, sf_dir: str, route: Callable) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = route(docs, {"ids": word_tokens("text")}, _all_tokens(spark, sf_dir))
    ids = F.concat(F.array(F.lit(sft.BOS_ID)), "ids")
    return got.select("doc_id", F.size(ids).cast("bigint").alias("n_ids"), F.array_join(ids, " ").alias("ids"))


def _padded(spark: SparkSession, sf_dir: str, route: Callable) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.slice(word_tokens("text"), 1, 255).alias("t"))
    got = route(docs, {"ids": F.col("t")}, _all_tokens(spark, sf_dir))
    ids = F.concat(F.array(F.lit(sft.BOS_ID)), "ids")
    return got.select("doc_id", F.array_join(sft.pad(ids, 256), " ").alias("input_ids"), F.array_join(sft.attention(ids, 256), " ").alias("attention_mask"))


@query
def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id for every token of the corpus, tokens coded by dictionaries of their tasks."""
    return _encoded(spark, sf_dir, sft.encode_words)


@query
def encode_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids as ``encode`` through the JVM-only path (explode, join, regroup)."""
    return _encoded(spark, sf_dir, sft.encode_all)


@query
def pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir, sft.encode_words)


SFT_DDL = "path string, tu_idx int, lang_pos int, prompt string, completion string"


def sft_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training examples as the reference hands them to its trainers: a JSON-lines file."""
    out = scratch_path(spark, "sft")
    jsonl.write_jsonl(_keyed_sft(spark, sf_dir), out)
    return spread(jsonl.read_jsonl(spark, out, SFT_DDL))


def tokenised(spark: SparkSession, sf_dir: str, mode: str, examples: DataFrame | None = None, route: Callable = sft.encode_words) -> DataFrame:
    examples = sft_jsonl(spark, sf_dir) if examples is None else examples
    numbered = sft.number_tokens(sft.chat_template(examples), ["full_text"])
    length = 128 if mode.startswith("seq2seq") else 256
    keep = [c for c in examples.columns if c not in ("prompt", "completion")]
    return sft.tokenize_all(examples, numbered, mode, length, keep=keep, encode=route)


def _joined(df: DataFrame) -> DataFrame:
    arrays = [c for c in ("input_ids", "attention_mask", "labels") if c in df.columns]
    return df.select(*[F.array_join(c, " ").alias(c) if c in arrays else F.col(c) for c in df.columns])


def _label_query(mode: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _joined(tokenised(spark, sf_dir, mode))

    q.__name__ = f"labels_{mode}"
    return query(q)


for _mode in sft.LABEL_MODES:
    _label_query(_mode)


# ---------------------------------------------------------------- the same by the JVM-only route


@query
def encode_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, sft.encode_all)


@query
def pad_mask_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir, sft.encode_all)


def _label_all_query(mode: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _joined(tokenised(spark, sf_dir, mode, route=sft.encode_all))

    q.__name__ = f"labels_{mode}_all"
    return query(q)


for _mode in sft.LABEL_MODES:
    _label_all_query(_mode)


@query
def training_table_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = splits.split_head_tail(sft_jsonl(spark, sf_dir), KEYS, 0.8).drop("pos")
    split = tokenised(spark, sf_dir, "intended", examples, sft.encode_all)
    out = scratch_path(spark, "training-table")
    sft.to_training_table(split, out, 256)
    return _joined(spark.read.parquet(out)).select(*KEYS, "split", "input_ids", "attention_mask", "labels")


@query
def token_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft.validate_tokens(tokenised(spark, sf_dir, "prompt_masked"), 256, ("input_ids", "attention_mask", "labels"))


@query
def token_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offending rows among id arrays with injected faults: by the id, every seventh is NULL, the next
    holds a NULL, the next is too short."""
    d, k = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("doc_id") % 7
    n = F.col("n_chars").cast("int")
    ids = F.when(k == 1, F.array(n, F.lit(None).cast("int"), n)).when(k == 2, F.array(n, n)).when(k != 0, F.array(n, n, n))
    return sft.invalid_tokens(d.select("doc_id", ids.alias("ids")), ["doc_id"], 3, ["ids"])


@query
def map_batches_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised batch function over all documents, input columns kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    count = lambda b: {"n_lines": b["text"].fillna("").str.count("\n") + 1, "text": b["text"].fillna("").str.replace("\n", "|", regex=False)}
    return map_batches(docs, count, "text string, n_lines bigint", keep_columns=True)


@query
def split_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head/tail split on a string key."""
    return splits.split_head_tail(table(spark, sf_dir, "pages").select("url", "page_id"), ["url", "page_id"], 0.8)


@query
def split_with_null_and_outlier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head/tail split on an integer key with NULLs (first) and one value far from all others."""
    k = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") == 1, F.lit(1 << 60)).otherwise(F.col("doc_id"))
    return splits.split_head_tail(table(spark, sf_dir, "documents").select(k.alias("k"), "doc_id"), ["k", "doc_id"], 0.8)


@query
def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = splits.split_head_tail(sft_jsonl(spark, sf_dir), KEYS, 0.8).drop("pos")
    split = tokenised(spark, sf_dir, "intended", examples)
    out = scratch_path(spark, "training-table")
    sft.to_training_table(split, out, 256)
    return _joined(spark.read.parquet(out)).select(*KEYS, "split", "input_ids", "attention_mask", "labels")


@query
def minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = sft_jsonl(spark, sf_dir).select(*KEYS)
    return sft.assign_batches(keys, KEYS, batch_size=8, grad_accum=4)


@query
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mini-batches of three epochs, each in an order of its own."""
    keys = sft_jsonl(spark, sf_dir).select(*KEYS)
    o = splits.epoch_orders(keys, KEYS, range(3))
    batch = F.floor(F.col("epoch_pos") / 8).cast("bigint")
    return o.where(batch < F.floor(F.col("n_rows") / 8)).select(*KEYS, "epoch", "epoch_pos", batch.alias("batch_id"))


@query
def batches_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches 20 and later, read from shards through their index as a trainer that resumes does."""
    out = scratch_path(spark, "shards")
    shards.write_shards(sft_jsonl(spark, sf_dir), KEYS, out, rows_per_shard=500)
    return shards.read_batches(spark, out, 8, first_batch=20).select(*KEYS, "prompt", "completion", "batch_id")


# ---------------------------------------------------------------- batch inference


def eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation pairs with two-letter language codes and the inference prompt."""
    ev = bitext.fix_lang_codes(validation_pairs(spark, sf_dir))
    return sft.infer_prompt(ev, "quoted")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every system over the eval set, persisted once to the shared folder."""
    ev = eval_set(spark, sf_dir)
    preds = inference.predict_systems(ev, SYSTEMS, ["infer_prompt", "src", "tgt"], batch_size=64)
    return inference.persist_predictions(preds, scratch_path(spark, "predictions"))


@query
def reply_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conversation_pairs(spark, sf_dir)
    middle = F.when(F.col("turn") % 3 == 0, F.lit(" [/INST] draft [/INST] ")).otherwise(F.lit(" [/INST] "))
    full = F.concat(F.lit("<s>[INST] "), F.col("src"), middle, F.col("tgt"))
    return p.select("conv_id", "turn", extract_reply(full).alias("reply"))


@query
def predictions_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("system", *KEYS, "lang", "prediction")


@query
def predictions_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One system, stopped after the first of four rounds and run again to the end."""
    ev, out = eval_set(spark, sf_dir), scratch_path(spark, "resumable")
    for rounds in (1, None):
        p = inference.predict_resumable(ev, SYSTEMS["reversed"], ["infer_prompt", "src", "tgt"], KEYS, out, groups=16, groups_at_once=4, stop_after=rounds)
    return p.select(*KEYS, "lang", "prediction")


@query
def prediction_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    a = p.where(F.col("system") == "echo")
    b = p.where(F.col("system") == "half")
    return inference.diff_predictions(a, b, KEYS, ["lang"])


@query
def max_abs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    shifted = emb.select((F.col("vec_id") - 1).alias("vec_id"), "embedding")
    d = inference.max_abs_delta(emb, shifted, ["vec_id"], "embedding")
    return d.select("vec_id", F.round("max_abs_delta", 6).alias("max_abs_delta"))


# ---------------------------------------------------------------- metrics (F1-F8)

BLEU_COLS = ["score", "bp", "p1", "p2", "p3", "p4"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in BLEU_COLS + ["baseline_score", "delta"] else F.col(c) for c in df.columns])


def _scores(spark: SparkSession, sf_dir: str, group_cols: list[str]) -> DataFrame:
    p = predictions(spark, sf_dir)
    return metrics.corpus_bleu(p, ["system", *KEYS], "prediction", F.array("tgt"), group_cols)


@query
def tok13a(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tok_13a("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query
def ngram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    st = metrics.segment_stats(p, ["system", *KEYS], "prediction", F.array("tgt"))
    return metrics.ngram_stats(st, ["system"])


@query
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scores(spark, sf_dir, ["system"]))


@query
def bleu_by_system_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scores(spark, sf_dir, ["system", "lang"]))


@query
def bleu_multi_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return _rounded(metrics.corpus_bleu(p, ["system", *KEYS], "prediction", F.array("tgt", "src"), ["system"]))


@query
def bleu_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluator's call as written: first prediction of each system vs all its targets."""
    p = predictions(spark, sf_dir)
    return _rounded(metrics.bleu_first_hypothesis(p, KEYS, "prediction", "tgt", ["system"]))


@query
def bleu_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, ["system"]).select("system", format_score("score").alias("bleu"))


@query
def compare_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.compare_systems(_scores(spark, sf_dir, ["system", "lang"]), "echo", ["lang"]))


# ---------------------------------------------------------------- incremental file streams


@query
def stream_tmx_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as UTF-8 TMX files, picked up by a file stream and converted batch by batch."""
    src, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    incremental.write_tmx_files(bitext_tmx(spark, sf_dir, encoding="UTF-8"), src)
    q = incremental.stream_tmx_to_sft(spark, src, out, encoding="UTF-8", glob="*.txt")
    q.awaitTermination()
    ddl = "path string, tu_idx int, lang_pos int, prompt string, completion string"
    rows = jsonl.read_jsonl(spark, out, ddl)
    return rows.select(incremental.original_path("path").alias("path"), "tu_idx", "lang_pos", "prompt", "completion")


@query
def stream_lang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation set as JSON lines, language codes fixed by a streaming projection."""
    src, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    jsonl.write_jsonl(validation_pairs(spark, sf_dir), src)
    ddl = "path string, tu_idx int, lang_pos int, src string, tgt string, lang string"
    q = incremental.stream_jsonl(spark, src, ddl, bitext.fix_lang_codes, out)
    q.awaitTermination()
    return jsonl.read_jsonl(spark, out, ddl)
