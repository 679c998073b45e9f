"""End-to-end plans for the reference's entry points, built with the
operators of this package. Ranks and vocabularies are computed when a plan is built:

* :func:`prepare_sft_cache` — instruction JSON to a token cache (§3.1):
  ``read.json -> A17 -> F4 -> T2 -> V1 -> K1``;
* :func:`training_batches` — token caches to padded, sharded batches (§3.2):
  ``S7 -> X1/X2 -> V4 -> B1``;
* :func:`create_prompt_dataset` — preference datasets to phase features (§3.3):
  ``adapter -> P3/S9 -> P2 -> F1-F3 -> T5 -> X3-X5 -> U1/U2 -> K2``;
* :func:`unsupervised_blocks` — a corpus to packed blocks (T6, S8, X6).

Everything that needs an order gets it from the seeded or dense index; the
only driver values are counts and split bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import labels_from_mask, pad_clip, value_mask
from ..functions.specials import ENDOFTEXT, IGNORE_INDEX, PAD_ID
from ..operators.adapters import apply_adapter, phase_filter, resolve_adapter
from ..operators.batches import batch_ids
from ..operators.chat import conversations_to_turns, instruct_to_conversation, sft_tokens, sft_tokens_with
from ..operators.features import pack_blocks, pack_text_blocks
from ..operators.order import (dense_index, fetch, first_n, phase_part, rank_shards, seeded_rank,
                               train_eval_split)
from ..operators.tokens import (Vocabulary, build_vocabulary, eot_features, eot_pair_features,
                               tokenize, tokenize_with, words)
from ..session import materialize
from ..sinks.token_cache import cache_rows, content_key, persist_or_reuse, write_token_cache
from ..sources.files import (CONVERSATION_SCHEMA, INSTRUCT_SCHEMA, ORDER_COLUMNS,
                             read_json_arrays, read_json_lines, unsupervised_text_column,
                             with_file_order)
from ..sources.token_cache import read_token_caches

# ------------------------------------------------------------------- §3.1


def prepare_sft_cache(spark: SparkSession, data_files: str | Sequence[str], out_path: str | None,
                      key_tag: str = "unknown", json_lines: bool = False, max_samples: int = 0,
                      conversations: bool = False, vocabulary: Vocabulary | None = None,
                      tokenizer_factory: Callable[[], object] | None = None,
                      im_end_id: int | None = None) -> DataFrame:
    """Instruction (or conversation) JSON files -> ``(key, key_tag, idx,
    input_ids, labels)``, written as a Parquet token cache when ``out_path``
    is given. Records keep file order (arrays: path order then position;
    lines: file then position); ``max_samples > 0`` keeps the first N (F4)."""
    schema = CONVERSATION_SCHEMA if conversations else INSTRUCT_SCHEMA
    if json_lines:
        raw = read_json_lines(spark, data_files, schema, ordered=True)
    else:
        raw = read_json_arrays(spark, data_files, schema)
    indexed = first_n(dense_index(raw, list(ORDER_COLUMNS), "idx"), max_samples)
    conv = indexed if conversations else instruct_to_conversation(indexed)
    turns = conversations_to_turns(conv, "idx")
    if tokenizer_factory is not None:
        if im_end_id is None:
            raise ValueError("im_end_id is required with a plug-in tokenizer")
        toks = sft_tokens_with(turns, tokenizer_factory, im_end_id)
    else:
        vocab = vocabulary or build_vocabulary([F.col("text"), F.col("role")], turns)
        toks = sft_tokens(turns, vocab)
    rows = cache_rows(toks.withColumnRenamed("conv_id", "idx"), key_tag, ["idx"], indexed=True)
    if out_path:
        write_token_cache(rows, out_path)
    return rows


# ------------------------------------------------------------------- §3.2


def training_batches(spark: SparkSession, cache_paths: str | Sequence[str], max_seq_len: int = 256,
                     pad_id: int = PAD_ID, padding_side: str = "right", batch_size: int = 8,
                     sampler: str = "distributed", world_size: int = 1, seed: int = 1234,
                     on_conflict: str = "keep_all") -> DataFrame:
    """Token caches -> padded samples in sampler order with ``shard``,
    ``batch_id`` and ``row_in_batch``. Dataset order is store order, then the
    cache index. ``sampler``: 'sequential', 'random' or 'distributed'
    (seeded shuffle, padded to a multiple of ``world_size``, round-robin)."""
    cache = read_token_caches(spark, cache_paths, on_conflict)
    # clipped before the ranking, padded and masked after it: no padding is shuffled
    samples = cache.select("store", "key", "idx", F.slice("input_ids", 1, max_seq_len).alias("input_ids"),
                           F.slice("labels", 1, max_seq_len).alias("labels"))
    if sampler == "sequential":
        ordered, n = dense_index(samples, ["store", "idx"], "pos", return_count=True)
    elif sampler in ("random", "distributed"):
        ordered, n = seeded_rank(samples, seed, ["store", "key", "idx"], "pos", return_count=True)
    else:
        raise ValueError("sampler must be 'sequential', 'random' or 'distributed'")
    world = world_size if sampler == "distributed" else 1
    sharded = rank_shards(ordered, world, "pos", n=n)
    padded = (sharded.withColumn("input_ids", pad_clip(F.col("input_ids"), max_seq_len, pad_id, padding_side))
              .withColumn("labels", pad_clip(F.col("labels"), max_seq_len, IGNORE_INDEX, padding_side))
              .withColumn("attention_mask", value_mask(F.col("input_ids"), pad_id)))
    return batch_ids(padded, batch_size)


# ------------------------------------------------------------------- §3.3


def _with_row_id(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Records with a unique ``row_id``. Where they carry none, it is a hash of their
    content; equal records are counted before anything is shuffled by it and told apart
    by a number from the second copy on. A ``row_id`` of their own is unique already."""
    if id_col in df.columns:
        return df
    hashed = df.withColumn(id_col, F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256))
    once = hashed.groupBy(id_col).agg(F.first(F.struct(*df.columns)).alias("__r"), F.count(F.lit(1)).alias("__n"))
    copies = once.select(id_col, "__r", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy"))
    numbered = F.when(F.col("__copy") == 1, F.col(id_col)).otherwise(F.concat_ws("-", id_col, F.col("__copy").cast("string")))
    return copies.select("__r.*", numbered.alias(id_col))


def _train_eval(raw: DataFrame, spec, seed: int) -> tuple[DataFrame, DataFrame]:
    """Natural splits when the records carry ``split`` and the dataset has
    named splits, else the derived 9:1 split (P3) of the train records. Ids only where
    the split is derived: the records follow with the part."""
    if "split" in raw.columns and spec.natural_splits:
        tr, ev = spec.natural_splits
        ids = raw.select("row_id", "split")
        return ids.filter(F.col("split") == tr).drop("split"), ids.filter(F.col("split") == ev).drop("split")
    base = raw.filter(F.col("split") == "train") if "split" in raw.columns else raw
    d = train_eval_split(base.select("row_id"), seed, ["row_id"], "__p3")
    return d.filter(F.col("split") == "train").select("row_id"), d.filter(F.col("split") == "eval").select("row_id")


def _phase_rows(name: str, raw: DataFrame, data_split: str, train_phase: int, seed: int
                ) -> DataFrame:
    """Adapted records of the phase's parts. Splits and parts are ranks of ids; the
    records are fetched once, by those of both parts."""
    spec = resolve_adapter(name)
    raw = _with_row_id(raw)
    parts = []
    for which, ids in zip(("train", "eval"), _train_eval(raw, spec, seed)):
        part = phase_part(ids, data_split, train_phase, seed, ["row_id"], "__order")
        parts.append(part.withColumn("which", F.lit(which)))
    rows = fetch(raw, parts[0].unionByName(parts[1]), ["row_id"])
    return apply_adapter(rows, spec, ["row_id", "__order", "which"]).withColumn("source", F.lit(name))


def data_fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: their number, and the sum and
    exclusive or of a 64-bit hash of each (columns in the order of their names)."""
    columns = sorted(df.columns)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("")
    h = F.xxhash64(text)
    n, total, mixed = df.select(h.alias("h")).agg(
        F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return f"{','.join(columns)}:{n}:{total}:{mixed}"


def create_prompt_dataset(spark: SparkSession, datasets: Sequence[tuple[str, DataFrame]],
                          data_split: str = "2,4,4", train_phase: int = 1, seed: int = 1234,
                          max_seq_len: int = 512, end_of_conversation_token: str = ENDOFTEXT,
                          sft_only: Sequence[tuple[str, DataFrame]] = (),
                          vocabulary: Vocabulary | None = None,
                          tokenizer_factory: Callable[[], object] | None = None,
                          output_root: str | None = None, tokenizer_name: str = "whitespace",
                          reload: bool = False) -> tuple[DataFrame, DataFrame]:
    """Preference datasets -> (train, eval) phase features.

    Phase 1: ``input_ids, attention_mask, labels`` of prompt+chosen (F1, T5,
    X3). Phase 2: chosen and rejected ids/masks (F2, T5, X4). Phase 3:
    reversed prompt ids/mask no longer than ``max_seq_len`` (F3, X5). Several
    datasets are blended and shuffled (U1); SFT-only datasets join phase 1
    whole (U2). :func:`prompt_dataset_counts` gives the rows kept and dropped.

    With ``output_root`` both results are stored under the content key and reused unless
    ``reload`` (K2). The key has everything the result depends on: names, splits, phase,
    seed, length, end token, the rows of the datasets and the vocabulary (or the plug-in's
    ``tokenizer_name``). Rows are read once for it; nothing else is done on a hit."""
    def build() -> dict[str, DataFrame]:
        rows = [_phase_rows(n, d, data_split, train_phase, seed) for n, d in datasets]
        if train_phase == 1:
            rows += [_phase_rows(n, d, "10,0,0", 1, seed) for n, d in sft_only]
        by_words = tokenizer_factory is None
        kept = _kept(reduce(lambda a, b: a.unionByName(b), rows), train_phase, max_seq_len, by_words)
        # the phase's records are read several times from here on (vocabulary, dictionaries,
        # ids, keys): written once, so that the datasets are not
        kept = materialize(kept, "prompt-rows")
        # one vocabulary (or plug-in) for train and eval alike
        feats = _features(kept, train_phase, max_seq_len, end_of_conversation_token, vocabulary,
                          tokenizer_factory)
        if train_phase == 3 and not by_words:
            feats = materialize(feats, "prompt-features")  # which prompts are kept shows from their ids
            kept = feats
        many = len(datasets) > 1 or (train_phase == 1 and len(sft_only) > 0)
        keys = kept.select("source", "row_id", "__order", "which")
        out = {}
        for which in ("train", "eval"):  # the order is that of keys; features are fetched by it
            order = _ordered(keys.filter(F.col("which") == which).drop("which"), many, seed)
            out[which] = fetch(feats.filter(F.col("which") == which).drop("which", "__order"), order, ["source", "row_id"])
        return out

    if output_root is None:
        made = build()
    else:
        key = content_key([n for n, _ in datasets], data_split, train_phase, seed, tokenizer_name,
                          max_seq_len, [n for n, _ in sft_only],
                          [end_of_conversation_token, *[data_fingerprint(d) for _, d in [*datasets, *sft_only]],
                           "own" if vocabulary is None else data_fingerprint(vocabulary.table)])
        made = persist_or_reuse(spark, build, output_root, key, reload)
    return made["train"], made["eval"]


def _ordered(part: DataFrame, many: bool, seed: int) -> DataFrame:
    """Keys with their final ``order``."""
    if many:
        return seeded_rank(part.drop("__order"), seed, ["source", "row_id"], "order")
    return dense_index(part, ["__order"], "order").drop("__order")


def _kept(rows: DataFrame, phase: int, max_seq_len: int, by_words: bool) -> DataFrame:
    """The rows a phase uses; phase 3 knows a prompt's length without its ids only
    where they are words."""
    kept = phase_filter(rows, phase)
    return kept.filter(F.size(words(F.col("prompt"))) <= max_seq_len) if phase == 3 and by_words else kept


def prompt_dataset_counts(datasets: Sequence[tuple[str, DataFrame]], data_split: str = "2,4,4",
                          train_phase: int = 1, seed: int = 1234, max_seq_len: int = 512) -> DataFrame:
    """M11 beside :func:`create_prompt_dataset`: source, which, and the rows of the
    phase's part that are kept and dropped (phase 3: ``filtered`` are too long), with the
    vocabulary job's lengths."""
    rows = reduce(lambda a, b: a.unionByName(b),
                  [_phase_rows(n, d, data_split, train_phase, seed) for n, d in datasets])
    fields = {1: ["prompt_and_chosen"], 2: ["prompt_and_chosen", "prompt_and_rejected"], 3: ["prompt"]}[train_phase]
    given = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])
    long = (F.size(words(F.col("prompt"))) > max_seq_len) if train_phase == 3 else F.lit(False)

    def count(test):
        return F.sum(F.when(test, 1).otherwise(0)).cast("long")

    return rows.groupBy("source", "which").agg(count(given & ~long).alias("kept"), count(~given).alias("dropped"),
                                               count(given & long).alias("filtered"))


def _features(rows: DataFrame, phase: int, max_seq_len: int, eot: str, vocab, factory) -> DataFrame:
    keys = ["source", "row_id", "__order", "which"]
    kept = rows
    if phase in (1, 2):
        fields = ["prompt_and_chosen"] + (["prompt_and_rejected"] if phase == 2 else [])
        if factory is None and vocab is None:
            vocab = build_vocabulary([F.concat(F.col(f), F.lit(eot)) for f in fields], kept)
        if phase == 1:
            f = eot_features(kept, "prompt_and_chosen", vocab, keys, max_seq_len, eot,
                             factory=factory)
            return f.withColumn("labels", labels_from_mask(F.col("input_ids"),
                                                           F.col("attention_mask")))
        return eot_pair_features(kept, {"chosen_": "prompt_and_chosen",
                                        "rejected_": "prompt_and_rejected"},
                                 vocab, keys, max_seq_len, eot, factory=factory)
    if phase == 3:
        if factory is not None:
            tok = tokenize_with(kept.select(*keys, "prompt"), "prompt", factory, "__ids")
        else:
            vocab = vocab or build_vocabulary(F.col("prompt"), kept)
            tok = tokenize(kept, "prompt", vocab, keys, "__ids")
        ok = tok.filter(F.size("__ids") <= max_seq_len)
        return ok.select(*keys, F.reverse("__ids").alias("prompt_input_ids"),
                         F.transform("__ids", lambda x: F.lit(1)).alias("prompt_attention_mask"),
                         F.lit(PAD_ID).alias("pad_token_id"))
    raise ValueError("train_phase must be 1, 2 or 3")


# --------------------------------------------------------- unsupervised corpus


def unsupervised_blocks(spark: SparkSession, corpus: DataFrame, max_prompt_seq_len: int = 256,
                        max_answer_seq_len: int = 256, rows_per_group: int = 1000,
                        order_by: Sequence[str] | None = None,
                        vocabulary: Vocabulary | None = None,
                        tokenizer_factory: Callable[[], object] | None = None) -> DataFrame:
    """S8 + T6 + X6: the text column (``text`` or the first column), packed
    into blocks of ``max_prompt_seq_len + max_answer_seq_len`` ids per group
    of ``rows_per_group`` rows in corpus order (labels = ids). A plug-in
    tokenizer encodes each row map-side; the vocabulary job goes from words
    straight to blocks."""
    col = unsupervised_text_column(corpus)
    block = max_prompt_seq_len + max_answer_seq_len
    if order_by:
        base, order = corpus.select(col, *order_by), list(order_by)
    else:  # corpus order: file name, then position in the file
        base = with_file_order(corpus.select(col))
        order = list(ORDER_COLUMNS)
    # the order of a corpus without ids is that of its rows: they go through the index once
    indexed = dense_index(base, order, "idx")
    if tokenizer_factory is not None:
        tok = tokenize_with(indexed.select("idx", col), col, tokenizer_factory, "input_ids")
        return pack_blocks(tok, block, rows_per_group, indexed=True)
    vocab = vocabulary or build_vocabulary(F.col(col), corpus)
    return pack_text_blocks(indexed, col, vocab, block, rows_per_group)


__all__ = ["prepare_sft_cache", "training_batches", "create_prompt_dataset", "unsupervised_blocks"]
