"""Registered queries for sources, caches, samplers and whole flows that the other
modules do not reach (S1, S3-S7, S9, K1, K2, K4, V4, U1, U2, B2, B3, §3.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import join_ints
from ..functions.numeric import round_to
from ..functions.specials import ENDOFTEXT, IGNORE_INDEX, PAD_ID
from ..operators.batches import batch_ids, prompt_collate, reward_collate
from ..operators.order import dense_index, rank_shards, seeded_rank
from ..operators.trainlog import eval_perplexity
from ..session import scratch_path
from ..sinks.metrics import scalar_series
from ..sinks.token_cache import cache_rows, write_token_cache
from ..sources.files import (read_json_arrays, read_large_json_arrays, read_local_pair, read_saved_dataset,
                             split_of)
from ..sources.token_cache import lookup, read_token_cache
from . import sqlkit as q
from .prepare import create_prompt_dataset, training_batches
from .q_adapters import SHAPES, SQL_CONV_BASE, SQL_DOC_BASE, SQL_OUTPUTS, SQL_SHAPES, conv_pairs, shaped
from .q_features import (MAX_TOKEN_LEN, PROMPT_BATCH, REWARD_BATCH, WORLD, _P3, _phase3, _sft_store,
                         _sql_eot_lists, _sql_tok_cte, reward_features)
from .q_order import SEED, sql_bounds, sql_rank
from .q_prepare import DATA_SPLIT, MAX_SEQ_LEN, _pairs, _sql, _sql_training_batches, batch_columns
from .q_tokens import _LISTS
from .tables import eval_log

ARRAY_ROWS = 64
EVAL_EVERY = 1000

# ------------------------------------------------------------- file sources


ARRAY_FIELDS = "idx long, instruction string, input string, output string"


def _array_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """JSON array files of at most ARRAY_ROWS records under two folders, whose names
    need encoding, in reverse order of name."""
    recs = dense_index(conv_pairs(spark, sf_dir).select(
        "conv_id", "turn", F.col("prompt").alias("instruction"),
        F.coalesce("sys", F.lit("")).alias("input"), F.col("chosen").alias("output")),
        ["conv_id", "turn"], "idx").withColumn("chunk", F.expr(f"idx div {ARRAY_ROWS}"))
    record = F.struct("idx", "instruction", "input", "output")
    arrays = recs.groupBy("chunk").agg(F.to_json(F.sort_array(F.collect_list(record))).alias("value"))
    root = scratch_path(spark, "json-arrays")
    paths = [f"{root}/b x%20é", f"{root}/a x%20é"]
    for i, p in enumerate(paths):
        (arrays.filter(F.col("chunk") % 2 == 1 - i).select("value")
         .write.option("maxRecordsPerFile", 1).text(p))
    return paths


def json_arrays_in_path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON array files, each read whole."""
    got = read_json_arrays(spark, _array_files(spark, sf_dir), ARRAY_FIELDS)
    in_file = Window.partitionBy("source_file").orderBy("row_in_file")  # ARRAY_ROWS rows at most
    return got.select("idx", "instruction", "input", "output", "file_ordinal",
                      (F.row_number().over(in_file) - 1).cast("long").alias("pos_in_file"))


def json_arrays_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON array files cut into pieces that any task can read."""
    got = read_large_json_arrays(spark, _array_files(spark, sf_dir), ARRAY_FIELDS)
    return got.select("idx", "instruction", "input", "output", "file_ordinal",
                      F.col("row_in_file").cast("long").alias("pos_in_file"))


def _tagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a natural split: 'test' for three of sixteen hashes, else 'train'."""
    return _pairs(spark, sf_dir).withColumn(
        "split", F.when(F.substring(F.md5("row_id"), 1, 1).isin("0", "1", "2"), "test").otherwise("train"))


def local_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a local train/eval pair of JSON files, read back with its split."""
    root = scratch_path(spark, "local-pair")
    tagged = _tagged_pairs(spark, sf_dir)
    for name, part in (("train", "train"), ("eval", "test")):
        tagged.filter(F.col("split") == part).select("prompt", "chosen", "rejected").write.json(f"{root}/{name}")
    return read_local_pair(spark, f"{root}/train", f"{root}/eval")


def saved_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset saved on disk by split; its natural evaluation split."""
    path = scratch_path(spark, "saved")
    _tagged_pairs(spark, sf_dir).write.partitionBy("split").parquet(path)
    return split_of(read_saved_dataset(spark, path), "eval", names=("train", "test")).select(
        "row_id", "prompt", "chosen", "rejected")


# ------------------------------------------------------------- token caches

def _two_caches(spark: SparkSession, sf_dir: str) -> list[str]:
    """The chat tokens under two tags in two caches; the first is written twice."""
    rows, _ = _sft_store(spark, sf_dir)
    paths = [scratch_path(spark, "cache-0"), scratch_path(spark, "cache-1")]
    write_token_cache(rows, paths[0])
    write_token_cache(rows, paths[0])
    write_token_cache(cache_rows(rows, "again", [], indexed=True), paths[1])
    return paths


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key of a written cache."""
    rows, _ = _sft_store(spark, sf_dir)
    path = scratch_path(spark, "cache")
    write_token_cache(rows, path)
    return lookup(read_token_cache(spark, path), "sft_idx_7").select(
        "key", "key_tag", F.col("idx").cast("long").alias("idx"),
        join_ints(F.col("input_ids")).alias("input_ids"))


def training_batches_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: two caches on disk read as one (S7), in dataset order."""
    b = training_batches(spark, _two_caches(spark, sf_dir), max_seq_len=MAX_SEQ_LEN, batch_size=4,
                         sampler="sequential", seed=SEED)
    return b.select("key", "store", "padded_pos", "shard", "batch_id", "row_in_batch",
                    F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


def training_batches_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: one cache in the seeded order of a single process."""
    rows, _ = _sft_store(spark, sf_dir)
    path = scratch_path(spark, "cache")
    write_token_cache(rows, path)
    return batch_columns(training_batches(spark, path, max_seq_len=MAX_SEQ_LEN, padding_side="left",
                                          batch_size=4, sampler="random", seed=SEED))


# ------------------------------------------------------------- collation by shard

def reward_rows_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 over the batches of each of WORLD shards."""
    keys = ["conv_id", "turn", "padded_pos"]
    ranked, n = seeded_rank(reward_features(spark, sf_dir), SEED, ["conv_id", "turn"], return_count=True)
    b = batch_ids(rank_shards(ranked, WORLD, n=n), REWARD_BATCH)
    return reward_collate(b, keys=keys).select(
        "shard", *keys, "batch_id", "side", F.col("row_in_collated").cast("long").alias("row_in_collated"),
        join_ints(F.col("input_ids")).alias("input_ids"),
        join_ints(F.col("attention_mask")).alias("attention_mask"))


def prompt_left_pad_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 over the batches of each of WORLD shards."""
    ranked, n = seeded_rank(_phase3(spark, sf_dir), SEED, ["conv_id", "turn"], return_count=True)
    b = batch_ids(rank_shards(ranked, WORLD, n=n), PROMPT_BATCH)
    return prompt_collate(b, MAX_TOKEN_LEN, PAD_ID).select(
        "shard", "conv_id", "turn", "padded_pos", "batch_id", join_ints(F.col("prompt")).alias("prompt"),
        join_ints(F.col("prompt_att_mask")).alias("prompt_att_mask"))


# ------------------------------------------------------------- metric series

def eval_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: perplexity and loss of every evaluation, at ``epoch * len + step``. An
    evaluation is EVAL_EVERY batches of the log (M5 for each)."""
    log = eval_log(spark, sf_dir).withColumn("global_step", F.expr(f"batch_id div {EVAL_EVERY}") * EVAL_EVERY)
    wide = eval_perplexity(log, by=["global_step"])
    s = scalar_series(wide, {"1_Eval/perplexity": "perplexity", "1_Eval/loss": "eval_loss"})
    return s.select("tag", "global_step", round_to("value", 6).alias("value"))


# ------------------------------------------------------------- §3.3 flows

def prompt_dataset_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the phase 2 dataset read back by a second call with the same key."""
    root = scratch_path(spark, "prompt-datasets")
    made = None
    for _ in range(2):
        made, _eval = create_prompt_dataset(spark, [("Dahoas/rm-static", _pairs(spark, sf_dir))], DATA_SPLIT,
                                            2, seed=SEED, max_seq_len=MAX_SEQ_LEN, output_root=root)
    return made.select("row_id", F.col("order").alias("pos"),
                       join_ints(F.col("chosen_input_ids")).alias("chosen_ids"),
                       join_ints(F.col("rejected_input_ids")).alias("rejected_ids"))


#: Names as a user gives them: S5 looks for the layout's name inside.
BLEND = ("hub/Dahoas/rm-static", "hub/openai/webgpt_comparisons")
SFT_ONLY = ("hub/wangrui6/Zhihu-KOL",)


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df, keys = shaped(spark, sf_dir, name.removeprefix("hub/"))
    return df.select(F.concat_ws(":", *keys).alias("row_id"), *[c for c in df.columns if c not in keys])


def _blend_phase1(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    made = create_prompt_dataset(
        spark, [(n, _raw(spark, sf_dir, n)) for n in BLEND], DATA_SPLIT, 1, seed=SEED,
        max_seq_len=MAX_SEQ_LEN, sft_only=[(n, _raw(spark, sf_dir, n)) for n in SFT_ONLY])[which]
    return made.select("source", "row_id", F.col("order").alias("pos"),
                       join_ints(F.col("input_ids")).alias("input_ids"),
                       join_ints(F.col("attention_mask")).alias("attention_mask"),
                       join_ints(F.col("labels")).alias("labels"))


def prompt_dataset_blend_phase1_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets blended (U1) and an SFT-only one appended (U2), phase 1."""
    return _blend_phase1(spark, sf_dir, 0)


def prompt_dataset_blend_phase1_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blend_phase1(spark, sf_dir, 1)


def _natural_phase3(spark: SparkSession, sf_dir: str, which: int) -> DataFrame:
    made = create_prompt_dataset(spark, [("hub/Dahoas/rm-static", _tagged_pairs(spark, sf_dir))], DATA_SPLIT, 3,
                                 seed=SEED, max_seq_len=MAX_SEQ_LEN)[which]
    return made.select("row_id", F.col("order").alias("pos"),
                       join_ints(F.col("prompt_input_ids")).alias("prompt_ids"))


def prompt_dataset_natural_phase3_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase 3 over a dataset with its own train and test splits."""
    return _natural_phase3(spark, sf_dir, 0)


def prompt_dataset_natural_phase3_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _natural_phase3(spark, sf_dir, 1)


# ------------------------------------------------------------------ oracle SQL

SQL_ARRAYS = f"""WITH {SQL_CONV_BASE},
r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, prompt AS instruction,
             coalesce(sys, '') AS input, chosen AS output FROM base)
SELECT idx, instruction, input, output,
       CAST(CASE WHEN idx // {ARRAY_ROWS} % 2 = 1 THEN 0 ELSE 1 END AS INTEGER) AS file_ordinal,
       idx % {ARRAY_ROWS} AS pos_in_file FROM r"""

_TAGGED = f"""{SQL_CONV_BASE},
ids AS (SELECT concat_ws(':', conv_id, turn) AS row_id, prompt, chosen, rejected FROM base),
tagged AS (SELECT *, CASE WHEN left(md5(row_id), 1) IN ('0', '1', '2') THEN 'test' ELSE 'train' END AS split
           FROM ids)"""

SQL_PAIR = (f"WITH {_TAGGED} SELECT prompt, chosen, rejected, "
            "CASE split WHEN 'test' THEN 'eval' ELSE 'train' END AS split FROM tagged")
SQL_SAVED = f"WITH {_TAGGED} SELECT row_id, prompt, chosen, rejected FROM tagged WHERE split = 'test'"


def _over_sft(select: str) -> str:
    """``select`` over ``c(idx, ids)``: the chat tokens in cache order."""
    return (f"WITH {_LISTS}, c AS (SELECT ids, row_number() OVER (ORDER BY conv_id) - 1 AS idx FROM lists) "
            + select)


SQL_LOOKUP = _over_sft("SELECT 'sft_idx_7' AS key, 'sft' AS key_tag, idx, array_to_string(ids, ',') AS input_ids "
                       "FROM c WHERE idx = 7")
SQL_SEQUENTIAL = _over_sft(f""", u AS (
  SELECT 0 AS store, 'sft_idx_' || idx AS key, idx, ids FROM c UNION ALL
  SELECT 1 AS store, 'again_idx_' || idx AS key, idx, ids FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY store, idx) - 1 AS pos FROM u)
SELECT key, store, pos AS padded_pos, 0 AS shard, pos // 4 AS batch_id, CAST(pos % 4 AS INTEGER) AS row_in_batch,
       CAST(list_sum(list_resize(ids, {MAX_SEQ_LEN}, {PAD_ID})) AS BIGINT) AS id_sum FROM o""").replace(
    "FROM lists) , u AS", "FROM lists), u AS")


def _sql_shards(rank_from: str, cols: str, batch: int) -> str:
    return f"""sk AS (SELECT *, {sql_rank('conv_id, turn')} AS rank FROM {rank_from}),
cnt AS (SELECT count(*) AS n, CAST(ceil(count(*) / {WORLD}.0) * {WORLD} AS BIGINT) AS total FROM sk),
pp AS (SELECT {cols}, rank AS padded_pos FROM sk UNION ALL
       SELECT {cols}, rank + t.j * cnt.n FROM sk, cnt, range(1, 1 + {WORLD}) t(j) WHERE rank + t.j * cnt.n < cnt.total),
bt AS (SELECT *, CAST(padded_pos % {WORLD} AS INTEGER) AS shard, padded_pos // {WORLD} // {batch} AS batch_id,
              padded_pos // {WORLD} % {batch} AS rib FROM pp)"""


SQL_REWARD_SHARDED = f"""WITH {SQL_CONV_BASE},
pairs AS (SELECT conv_id, turn, prompt || chosen || '{ENDOFTEXT}' AS c, prompt || rejected || '{ENDOFTEXT}' AS r
          FROM base WHERE prompt || chosen IS NOT NULL AND prompt || rejected IS NOT NULL),
long AS (SELECT conv_id, turn, 0 AS side, c AS t FROM pairs UNION ALL
         SELECT conv_id, turn, 1 AS side, r AS t FROM pairs),
{_sql_tok_cte('long', 't', 'conv_id, turn, side')},
{_sql_shards('pairs', 'conv_id, turn', REWARD_BATCH)},
bl AS (SELECT *, count(*) OVER (PARTITION BY shard, batch_id) AS blen FROM bt)
SELECT bl.shard, bl.conv_id, bl.turn, bl.padded_pos, bl.batch_id, tok.side,
       CAST(tok.side * bl.blen + bl.rib AS BIGINT) AS row_in_collated, {_sql_eot_lists('tok.ids')}
FROM bl JOIN tok ON tok.conv_id = bl.conv_id AND tok.turn = bl.turn"""

SQL_PROMPT_SHARDED = f"""WITH {_P3}, {_sql_shards('kept', 'conv_id, turn, ids', PROMPT_BATCH)},
ln AS (SELECT *, greatest(max(len(ids)) OVER (PARTITION BY shard, batch_id), {MAX_TOKEN_LEN}) AS L FROM bt)
SELECT shard, conv_id, turn, padded_pos, batch_id,
       array_to_string(list_concat(list_resize([]::INTEGER[], L - len(ids), {PAD_ID}), ids), ',') AS prompt,
       array_to_string(list_concat(list_resize([]::INTEGER[], L - len(ids), 0),
                                   list_transform(ids, lambda x: 1)), ',') AS prompt_att_mask FROM ln"""

SQL_EVAL_SERIES = f"""WITH r AS (
  SELECT event_id // {EVAL_EVERY} * {EVAL_EVERY} AS global_step, user_id % 4 AS rank, avg(value / 10.0) AS l
  FROM events GROUP BY 1, 2),
e AS (SELECT global_step, avg(l) AS l FROM r GROUP BY 1)
SELECT '1_Eval/loss' AS tag, global_step, round(l, 6) AS value FROM e UNION ALL
SELECT '1_Eval/perplexity' AS tag, global_step, round(exp(l), 6) AS value FROM e"""


def _sql_phase_rows(names: list[tuple[str, str]], phase: int) -> str:
    """CTEs to ``kept(source, row_id, which, rk2, prompt, pc)``: each dataset's derived
    9:1 split and the rows of its phase, for ``(dataset, data split)`` pairs."""
    cols = ("prompt", "chosen", "rejected", "pc", "pr")
    parts, bounds2 = [], []
    b3_cols, b3 = sql_bounds("9,1", "n")
    for i, (name, split) in enumerate(names):
        layout = name.removeprefix("hub/")
        kind = SHAPES[layout][0]
        row_id = "concat_ws(':', conv_id, turn)" if kind == "conv" else "CAST(doc_id AS VARCHAR)"
        outs = ", ".join(f"{e} AS {c}" for e, c in zip(SQL_OUTPUTS[layout], cols))
        parts.append(f"SELECT '{name}' AS source, row_id, prompt, pc FROM (SELECT row_id, {outs} FROM ("
                     f"SELECT {row_id} AS row_id, {SQL_SHAPES[layout]} FROM {kind}_base))")
        c2, b2 = sql_bounds(split, "n")
        low = "0" if phase == 1 else b2[phase - 2]
        bounds2.append(f"SELECT source, which, {low} AS low, {b2[phase - 1]} AS high FROM ("
                       f"SELECT source, which, n, {c2} FROM n2 WHERE source = '{name}')")
    key = f"md5(concat_ws('-', '{SEED}', row_id)), row_id"
    return f"""{SQL_CONV_BASE.replace('base AS', 'conv_base AS', 1)}, {SQL_DOC_BASE.replace('base AS', 'doc_base AS', 1)},
src AS ({' UNION ALL '.join(parts)}),
r3 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {key}) - 1 AS rk FROM src),
b3 AS (SELECT source, {b3_cols} FROM (SELECT source, count(*) AS n FROM src GROUP BY source)),
sp AS (SELECT r3.*, CASE WHEN rk < {b3[0]} THEN 'train' ELSE 'eval' END AS which FROM r3 JOIN b3 USING (source)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY source, which ORDER BY {key}) - 1 AS rk2 FROM sp),
n2 AS (SELECT source, which, count(*) AS n FROM sp GROUP BY source, which),
b2 AS ({' UNION ALL '.join(bounds2)}),
kept AS (SELECT r2.* FROM r2 JOIN b2 ON r2.source = b2.source AND r2.which = b2.which
         WHERE rk2 >= low AND rk2 < high)"""


def _sql_blend(which: str) -> str:
    n = MAX_SEQ_LEN
    names = [(x, DATA_SPLIT) for x in BLEND] + [(x, "10,0,0") for x in SFT_ONLY]
    return f"""WITH {_sql_phase_rows(names, 1)},
t AS (SELECT source, row_id, which, pc || '{ENDOFTEXT}' AS t FROM kept WHERE pc IS NOT NULL),
{_sql_tok_cte('t', 't', 'source, row_id, which')}
SELECT source, row_id, row_number() OVER (ORDER BY md5(concat_ws('-', '{SEED}', source, row_id)), source, row_id) - 1
       AS pos, {_sql_eot_lists('ids')},
       array_to_string(list_transform(range(1, {n} + 1), lambda i: CASE WHEN i <= len(ids)
         THEN ids[i] ELSE {IGNORE_INDEX} END), ',') AS labels
FROM tok WHERE which = '{which}'"""


def _sql_natural(which: str) -> str:
    cols, b = sql_bounds(DATA_SPLIT, "n")
    key = f"md5(concat_ws('-', '{SEED}', row_id)), row_id"
    return f"""WITH {_TAGGED},
r2 AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {key}) - 1 AS rk2 FROM tagged),
b2 AS (SELECT split, {cols} FROM (SELECT split, count(*) AS n FROM tagged GROUP BY split)),
p AS (SELECT row_id, r2.split, rk2, prompt AS t FROM r2 JOIN b2 ON r2.split = b2.split
      WHERE rk2 >= {b[1]} AND rk2 < {b[2]} AND prompt IS NOT NULL),
{_sql_tok_cte('p', 't', 'row_id, split, rk2')}
SELECT row_id, row_number() OVER (ORDER BY rk2) - 1 AS pos, array_to_string(list_reverse(ids), ',') AS prompt_ids
FROM tok WHERE len(ids) <= {MAX_SEQ_LEN} AND split = '{which}'"""


QUERIES = {
    "json_arrays_in_path_order": (json_arrays_in_path_order, SQL_ARRAYS),
    "json_arrays_in_pieces": (json_arrays_in_pieces, SQL_ARRAYS),
    "local_pair": (local_pair, SQL_PAIR),
    "saved_split": (saved_split, SQL_SAVED),
    "cache_lookup": (cache_lookup, SQL_LOOKUP),
    "training_batches_sequential": (training_batches_sequential, SQL_SEQUENTIAL),
    "training_batches_random": (training_batches_random, _sql_training_batches(1)),
    "reward_rows_sharded": (reward_rows_sharded, SQL_REWARD_SHARDED),
    "prompt_left_pad_sharded": (prompt_left_pad_sharded, SQL_PROMPT_SHARDED),
    "eval_series": (eval_series, SQL_EVAL_SERIES),
    "prompt_dataset_reused": (prompt_dataset_reused, _sql("train")),
    "prompt_dataset_blend_phase1_train": (prompt_dataset_blend_phase1_train, _sql_blend("train")),
    "prompt_dataset_blend_phase1_eval": (prompt_dataset_blend_phase1_eval, _sql_blend("eval")),
    "prompt_dataset_natural_phase3_train": (prompt_dataset_natural_phase3_train, _sql_natural("train")),
    "prompt_dataset_natural_phase3_eval": (prompt_dataset_natural_phase3_eval, _sql_natural("test")),
}
