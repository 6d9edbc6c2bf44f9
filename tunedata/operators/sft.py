"""SFT examples → chat text → token ids, attention masks and labels of fixed length.

Only the id lookup may leave the JVM: :func:`encoder` maps a whole Arrow batch of token
arrays through one hash index of the (size-bounded, broadcast) vocabulary, with no shuffle;
:func:`encode_join` does the same with a broadcast join and an ordered regroup, JVM only.
Everything else - templates, truncation, padding, masks, every label mode, validation,
batching - is array expressions.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tunedata.functions.text import INST_CLOSE, INST_OPEN, iso2, word_tokens
from tunedata.operators.bitext import render_prompt
from tunedata.plans.rank import exact_rank, rank_by_key
from tunedata.session import scratch_path

# Special tokens and their ids; padding uses the end-of-sequence id.
UNK, BOS, EOS = "<unk>", "<s>", "</s>"
SPECIALS = (UNK, BOS, EOS)
UNK_ID, BOS_ID, EOS_ID = 0, 1, 2
PAD_ID = EOS_ID
IGNORE = -100
LEGACY_PROMPT = "Translate to {lang}:\n{src}"  # older inference prompt

LABEL_MODES = ("prompt_masked", "prompt_masked_bos", "collated", "intended", "seq2seq", "seq2seq_pad100")


# ---------------------------------------------------------------- templates


def chat_template(df: DataFrame, prompt: str = "prompt", completion: str = "completion", eos: str = EOS) -> DataFrame:
    """Add ``user_text = '<s>[INST] {p} [/INST]'`` and ``full_text = user_text + ' {c}</s>'``."""
    user = F.concat(F.lit(INST_OPEN), F.col(prompt), F.lit(INST_CLOSE))
    return df.withColumn("user_text", user).withColumn("full_text", F.concat(user, F.lit(" "), F.col(completion), F.lit(eos)))


def infer_prompt(df: DataFrame, style: str = "quoted", src: str = "src", lang: str = "lang") -> DataFrame:
    """Inference prompt of an eval example: ``quoted`` (the training wording) or ``legacy``."""
    if style == "quoted":
        body = render_prompt(F.col(src), F.col(lang))
    elif style == "legacy":
        body = render_prompt(F.col(src), iso2(lang), LEGACY_PROMPT)
    else:
        raise ValueError(f"style={style!r}")
    return df.withColumn("infer_prompt", F.concat(F.lit(INST_OPEN), body, F.lit(INST_CLOSE)))


# ---------------------------------------------------------------- vocabulary and ids


def build_vocab(df: DataFrame, cols: Sequence[str], max_size: int, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """``(token, id, freq)``: the specials first, then the ``max_size - len(specials)`` most
    frequent tokens (ties by token) of the given text columns."""
    toks = None
    for c in cols:
        t = df.select(F.explode(word_tokens(c)).alias("token"))
        toks = t if toks is None else toks.unionByName(t)
    spec = [F.lit(s) for s in specials]
    counts = toks.where(~F.col("token").isin(*spec)).groupBy("token").agg(F.count("*").alias("freq"))
    k = max_size - len(specials)
    top = counts.orderBy(F.desc("freq"), "token").limit(k)  # top-k: the limit is the feature
    ranked = top.select(
        "token",
        (F.row_number().over(Window.orderBy(F.desc("freq"), "token")) - 1 + len(specials)).cast("int").alias("id"),
        F.col("freq").cast("bigint"),
    )
    spark = df.sparkSession
    head = spark.createDataFrame([(s, i, 0) for i, s in enumerate(specials)], "token string, id int, freq bigint")
    return head.unionByName(ranked)


def _vocab_lookup_udf(vocab: DataFrame, max_size: int) -> Callable[[Column], Column]:
    rows = vocab.select("token", "id").limit(max_size + 1).collect()  # bounded by max_size
    if len(rows) > max_size:
        raise ValueError(f"vocabulary larger than max_size={max_size}")
    tokens = [r[0] for r in rows]
    ids = np.asarray([r[1] for r in rows], dtype=np.int32)
    bc = vocab.sparkSession.sparkContext.broadcast((tokens, ids))
    cache: dict = {}

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def lookup(batch: pd.Series) -> pd.Series:
        if "index" not in cache:
            toks, vals = bc.value
            cache["index"], cache["ids"] = pd.Index(toks), vals
        index, vals = cache["index"], cache["ids"]
        lens = np.fromiter((len(x) for x in batch), dtype=np.int64, count=len(batch))
        if lens.sum() == 0:
            return pd.Series([np.zeros(0, dtype=np.int32)] * len(batch))
        flat = np.concatenate([np.asarray(x, dtype=object) for x in batch])
        pos = index.get_indexer(flat)
        out = np.where(pos >= 0, vals[pos], UNK_ID).astype(np.int32)
        return pd.Series(np.split(out, np.cumsum(lens)[:-1]))

    return lookup


def encoder(vocab: DataFrame, max_size: int) -> Callable[[Column, bool], Column]:
    """``enc(text_col, add_bos)`` → array<int> of whole-text ids (unknown tokens → 0)."""
    lookup = _vocab_lookup_udf(vocab, max_size)

    def enc(text: Column, add_bos: bool = True) -> Column:
        ids = lookup(word_tokens(text))
        return F.concat(F.array(F.lit(BOS_ID)), ids) if add_bos else ids

    def first(text: Column, add_bos: bool, length: int) -> Column:
        """The first ``length`` ids: cut before the look-up, so no more tokens go to Python."""
        ids = lookup(F.slice(word_tokens(text), 1, length - add_bos))
        return F.concat(F.array(F.lit(BOS_ID)), ids) if add_bos else ids

    enc.first = first
    enc.count = lambda text, add_bos: F.size(word_tokens(text)) + int(add_bos)
    return enc


JOINED = object()  # in place of an encoder: ids of column c are joined already, in __ids_c


def _first(enc: Callable, text: str, add_bos: bool, length: int) -> Column:
    """The first ids of a text column, by the short way if the encoder has one."""
    if enc is JOINED:
        ids = F.slice(F.col(f"__ids_{text}"), 1, length - add_bos)
        return F.concat(F.array(F.lit(BOS_ID)), ids) if add_bos else ids
    text = F.col(text)
    return enc.first(text, add_bos, length) if hasattr(enc, "first") else truncate(enc(text, add_bos), length)


def _count(enc: Callable, text: Column, add_bos: bool) -> Column:
    if enc is JOINED:
        return F.size(word_tokens(text)) + int(add_bos)
    return enc.count(text, add_bos) if hasattr(enc, "count") else F.size(enc(text, add_bos))


def encode_join(
    df: DataFrame, key: Sequence[str], text: str, vocab: DataFrame, max_size: int, *, add_bos: bool = True,
    out_col: str = "ids", num_partitions: int | None = None,
) -> DataFrame:
    """JVM-only alternative to :func:`encoder`: ``df`` plus ``out_col`` = the ids of ``text``.

    Tokens are exploded with their positions, looked up by a broadcast join with the
    vocabulary (its size is checked against ``max_size`` first) and gathered back in order.
    ``key`` must be unique; the rows are hash-partitioned on it once, and the broadcast join,
    the regrouping and the join back all keep that partitioning (no further shuffle).
    """
    key = list(key)
    if vocab.limit(max_size + 1).count() > max_size:
        raise ValueError(f"vocabulary larger than max_size={max_size}")
    base = df.repartition(num_partitions, *key) if num_partitions else df.repartition(*key)
    toks = base.select(*key, F.posexplode(word_tokens(text)).alias("__pos", "token"))
    looked = toks.join(F.broadcast(vocab.select("token", "id")), "token", "left")  # at most max_size rows
    pairs = F.array_sort(F.collect_list(F.struct(F.col("__pos"), F.coalesce(F.col("id"), F.lit(UNK_ID)).alias("id"))))
    ids = looked.groupBy(*key).agg(F.transform(pairs, lambda x: x["id"]).alias("__ids"))
    out = base.join(ids, key, "left")
    got = F.coalesce(F.col("__ids"), F.array().cast("array<int>"))
    if add_bos:
        got = F.concat(F.array(F.lit(BOS_ID)), got)
    return out.withColumn(out_col, got.cast("array<int>")).drop("__ids")


HOT_TOKENS = 4096  # most frequent tokens, looked up by broadcast (4,096 rows whatever the corpus)


def number_tokens(df: DataFrame, cols: Sequence[str], specials: Sequence[str] = SPECIALS) -> DataFrame:
    """``(token, id, freq)`` of every token of the text columns, without a size limit: the specials
    first, then by frequency (ties by token), as in :func:`build_vocab`.

    The ids are places in a range sort written once (:func:`tunedata.plans.rank.exact_rank`).
    """
    words = F.explode(F.concat(*[F.coalesce(word_tokens(c), F.array().cast("array<string>")) for c in cols]))
    counts = df.select(words.alias("token")).where(~F.col("token").isin(*specials)).groupBy("token").agg(F.count("*").alias("freq"))
    ranked = exact_rank(counts, [F.desc("freq"), "token"])
    ranked = ranked.select("token", (F.col("rank") - 1 + len(specials)).cast("int").alias("id"), F.col("freq").cast("bigint").alias("freq"))
    head = df.sparkSession.createDataFrame([(s, i, 0) for i, s in enumerate(specials)], "token string, id int, freq bigint")
    return head.unionByName(ranked)


def encode_all(df: DataFrame, tokens: dict[str, Column], numbered: DataFrame, *, hot: int = HOT_TOKENS) -> DataFrame:
    """``df`` plus, for each ``name: array of tokens``, the array ``name`` of their ids, whatever the
    number of distinct tokens. ``numbered``: :func:`number_tokens`.

    Tokens are joined to their ids by a shuffle join; the ``hot`` smallest ids, which are the most
    frequent tokens, are broadcast apart, so no key of the shuffle join holds a large share of the rows.
    A token that ``numbered`` does not have gets ``UNK_ID``.
    """
    spark = df.sparkSession
    names = list(tokens)
    path = scratch_path(spark, "encode-rows")
    df.select("*", *[c.alias(f"__t_{n}") for n, c in tokens.items()], F.monotonically_increasing_id().alias("__row")).write.parquet(path)
    base = spark.read.parquet(path)  # written: a row's number is fixed only then
    each = [
        base.select("__row", F.lit(k).cast("tinyint").alias("__k"), F.posexplode(f"__t_{n}").alias("__pos", "token"))
        for k, n in enumerate(names)
    ]
    toks = functools.reduce(DataFrame.unionByName, each)
    ids = numbered.select("token", "id")
    top = ids.where(F.col("id") < hot).select("token", F.col("id").alias("__hot"))
    toks = toks.join(F.broadcast(top), "token", "left")
    found = toks.where("__hot IS NOT NULL").select("__row", "__k", "__pos", F.col("__hot").alias("id"))
    rare = toks.where("__hot IS NULL").drop("__hot").join(ids.where(F.col("id") >= hot), "token", "left")
    found = found.unionByName(rare.select("__row", "__k", "__pos", F.coalesce("id", F.lit(UNK_ID)).alias("id")))
    pairs = [F.array_sort(F.collect_list(F.when(F.col("__k") == k, F.struct("__pos", "id")))) for k in range(len(names))]
    got = found.groupBy("__row").agg(*[F.transform(p, lambda x: x["id"]).alias(n) for n, p in zip(names, pairs)])
    out = base.drop(*[f"__t_{n}" for n in names]).join(got, "__row", "left").drop("__row")
    for n in names:
        out = out.withColumn(n, F.coalesce(F.col(n), F.array().cast("array<int>")))
    return out


CODED = 1_000_000  # tokens that are coded together, so that a dictionary and its codes are bounded


def _code(names: Sequence[str], limit: int) -> Callable:
    """Rows of token arrays -> one row per slice of a batch: its distinct words, and the tokens as codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        for b in batches:
            lists = [b.column(n) for n in names]
            sizes = np.stack([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
            ends, i = np.cumsum(sizes.sum(0)), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
                coded = pa.concat_arrays([x.slice(i, j - i).flatten() for x in lists]).dictionary_encode()
                codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype("<i4")
                row = [chunk, b.column("__row").slice(i, j - i).to_numpy().astype("<i8").tobytes(), sizes[:, i:j].astype("<i4").tobytes(), codes.tobytes()]
                words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
                yield pa.RecordBatch.from_arrays([*(pa.array([x]) for x in row), words], ["chunk", "rows", "sizes", "codes", "words"])
                chunk, i = chunk + 1, j

    return run


def _decode(names: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows, sizes, codes = (np.frombuffer(b.column(n)[k].as_py(), t) for n, t in (("rows", "<i8"), ("sizes", "<i4"), ("codes", "<i4")))
                ids = np.append(b.column("ids")[k].values.to_numpy(zero_copy_only=False) if b.column("ids")[k].is_valid else np.zeros(0, np.int32), np.int32(UNK_ID))
                found, at, cols = ids[codes].astype(np.int32), 0, []
                for n in sizes.reshape(len(names), len(rows)):
                    offsets = np.concatenate([[0], np.cumsum(n)])
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found[at : at + offsets[-1]])))
                    at += offsets[-1]
                yield pa.RecordBatch.from_arrays([pa.array(rows), *cols], ["__row", *names])

    return run


def encode_words(df: DataFrame, tokens: dict[str, Column], numbered: DataFrame, *, limit: int = CODED) -> DataFrame:
    """What :func:`encode_all` returns, without a shuffled row per token: each task codes its tokens by
    a dictionary of the distinct words in every ``limit`` tokens, only these words are joined to their ids
    (so a frequent word is one row per dictionary), and the codes are replaced where they are.
    """
    spark = df.sparkSession
    names = list(tokens)
    path, packs = scratch_path(spark, "encode-rows"), scratch_path(spark, "encode-codes")
    df.select("*", *[c.alias(f"__t_{n}") for n, c in tokens.items()], F.monotonically_increasing_id().alias("__row")).write.parquet(path)
    base = spark.read.parquet(path)  # written: a row's number is fixed only then
    marked = [f"__t_{n}" for n in names]
    base.select("__row", *marked).mapInArrow(_code(marked, limit), "chunk bigint, rows binary, sizes binary, codes binary, words array<string>").write.parquet(packs)
    coded = spark.read.parquet(packs)
    words = coded.select("chunk", F.posexplode("words").alias("__pos", "token")).join(numbered.select("token", "id"), "token", "left")
    ids = words.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("__pos", F.coalesce("id", F.lit(UNK_ID)).alias("id")))).alias("x"))
    both = coded.drop("words").join(ids.select("chunk", F.transform("x", lambda x: x["id"]).alias("ids")), "chunk", "left")
    got = both.select("rows", "sizes", "codes", "ids").mapInArrow(_decode(names), "__row bigint, " + ", ".join(f"`{n}` array<int>" for n in names))
    return base.drop(*marked).join(got, "__row").drop("__row")


# ---------------------------------------------------------------- shaping


def truncate(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def pad(ids: Column, length: int, value: int = PAD_ID) -> Column:
    """Cut to ``length`` and right-pad with ``value``."""
    cut = truncate(ids, length)
    return F.concat(cut, F.array_repeat(F.lit(value), F.lit(length) - F.size(cut)))


def attention(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def mask_prefix(ids: Column, n: Column) -> Column:
    return F.transform(ids, lambda x, i: F.when(i < n, F.lit(IGNORE)).otherwise(x))


def mask_value(ids: Column, value: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == value, F.lit(IGNORE)).otherwise(x))


def tokenize_sft(
    df: DataFrame,
    enc: Callable[[Column, bool], Column],
    mode: str = "prompt_masked",
    max_length: int = 256,
    *,
    prompt: str = "prompt",
    completion: str = "completion",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Token ids, attention mask and labels, each exactly ``max_length`` long.

    prompt_masked      full chat text (with BOS), prompt positions → -100, pads kept (as trained by the reference).
    prompt_masked_bos  the same, the prompt also counted with its BOS.
    collated           labels = ids with every pad id → -100 (what a causal-LM collator hands the model).
    intended           prompt and padding → -100, the real end-of-sequence kept.
    seq2seq            prompt ids as input, completion ids (pads → -100) as labels.
    seq2seq_pad100     as seq2seq, labels padded with -100; an empty text encodes as [pad].
    """
    L = max_length
    if mode in ("prompt_masked", "prompt_masked_bos", "collated", "intended"):
        chat = chat_template(df, prompt, completion)
        user_bos = mode in ("prompt_masked_bos", "intended")
        full = _first(enc, "full_text", True, L)
        n_user = F.least(_count(enc, F.col("user_text"), user_bos), F.lit(L))
        tmp = chat.select(*keep, pad(full, L).alias("input_ids"), attention(full, L).alias("attention_mask"), n_user.alias("__u"))
        ids = F.col("input_ids")
        if mode == "collated":
            labels = mask_value(ids, PAD_ID)
        elif mode == "intended":
            labels = F.zip_with(mask_prefix(ids, F.col("__u")), F.col("attention_mask"), lambda x, m: F.when(m == 1, x).otherwise(F.lit(IGNORE)))
        else:
            labels = mask_prefix(ids, F.col("__u"))
        return tmp.select(*keep, "input_ids", "attention_mask", labels.alias("labels"))
    if mode == "seq2seq":
        p, c = _first(enc, prompt, True, L), _first(enc, completion, True, L)
        return df.select(*keep, pad(p, L).alias("input_ids"), attention(p, L).alias("attention_mask"), mask_value(pad(c, L), PAD_ID).alias("labels"))
    if mode == "seq2seq_pad100":
        def enc_or_pad(c: str) -> Column:
            return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array(F.lit(PAD_ID))).otherwise(_first(enc, c, True, L))

        p, c = enc_or_pad(prompt), enc_or_pad(completion)
        return df.select(*keep, pad(p, L).alias("input_ids"), pad(c, L, IGNORE).alias("labels"))
    raise ValueError(f"mode={mode!r}; one of {LABEL_MODES}")


def tokenize_all(
    df: DataFrame, numbered: DataFrame, mode: str = "prompt_masked", max_length: int = 256, *,
    prompt: str = "prompt", completion: str = "completion", keep: Sequence[str] = (), encode: Callable = encode_words,
) -> DataFrame:
    """:func:`tokenize_sft` with the ids of ``numbered`` (:func:`number_tokens`), whatever its size.
    ``encode``: :func:`encode_words`, or :func:`encode_all` (JVM only)."""
    cols = [prompt, completion] if mode.startswith("seq2seq") else ["full_text"]
    # Tokens beyond the length are cut before the look-up.
    tokens = {f"__ids_{c}": F.slice(word_tokens(c), 1, max_length) for c in cols}
    return tokenize_sft(encode(chat_template(df, prompt, completion), tokens, numbered), JOINED, mode, max_length, prompt=prompt, completion=completion, keep=keep)


# ---------------------------------------------------------------- checks, tables, batches


def validate_tokens(df: DataFrame, length: int, cols: Sequence[str] = ("input_ids", "labels")) -> DataFrame:
    """One row of counts: rows, rows with a NULL array or NULL id, rows with a wrong length."""
    has_null = F.lit(False)
    bad_len = F.lit(False)
    for c in cols:
        has_null = has_null | F.col(c).isNull() | F.exists(c, lambda x: x.isNull())
        bad_len = bad_len | (F.size(c) != length)
    return df.agg(
        F.count("*").cast("bigint").alias("n_rows"),
        F.count_if(has_null).cast("bigint").alias("n_null"),
        F.count_if(bad_len).cast("bigint").alias("n_bad_length"),
    )


def invalid_tokens(df: DataFrame, key: Sequence[str], length: int, cols: Sequence[str] = ("input_ids", "labels")) -> DataFrame:
    """The offending rows: ``key`` columns, ``array`` (the column) and ``problem``, one row for each
    array that is NULL, holds a NULL id or has another length."""
    found = []
    for c in cols:
        problem = (
            F.when(F.col(c).isNull(), "null array")
            .when(F.exists(c, lambda x: x.isNull()), "null id")
            .when(F.size(c) != length, F.concat(F.lit("length "), F.size(c).cast("string")))
        )
        found.append(F.struct(F.lit(c).alias("array"), problem.alias("problem")))
    each = df.select(*key, F.explode(F.filter(F.array(*found), lambda x: x["problem"].isNotNull())).alias("x"))
    return each.select(*key, "x.array", "x.problem")


def to_training_table(df: DataFrame, path: str, length: int, cols: Sequence[str] = ("input_ids", "labels"), partition_by: str | None = "split") -> None:
    """Write fixed-shape int32 arrays as Parquet (partitioned by ``split``); a wrong length fails the job."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(F.size(c) == length, F.col(c).cast("array<int>")).otherwise(
            F.raise_error(F.concat(F.lit(f"{c}: length "), F.size(c).cast("string"), F.lit(f" != {length}")))
        ))
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def assign_batches(df: DataFrame, order: list[str], batch_size: int, grad_accum: int = 1, drop_last: bool = True) -> DataFrame:
    """``batch_id = (position - 1) div batch_size`` in ``order``, ``step_id = batch_id div grad_accum``;
    the last partial batch is dropped (``n div batch_size`` full batches)."""
    r = rank_by_key(df, order, rank_col="__pos", total_col="__n")
    batch = F.floor((F.col("__pos") - 1) / batch_size).cast("bigint")
    out = r.withColumn("batch_id", batch).withColumn("step_id", F.floor(F.col("batch_id") / grad_accum).cast("bigint"))
    if drop_last:
        out = out.where(F.col("batch_id") < F.floor(F.col("__n") / batch_size))
    return out.drop("__pos", "__n")
