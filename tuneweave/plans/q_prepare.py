"""Registered queries running the end-to-end plans on the driver tables.

* §3.1 ``sft_cache_from_json``: instruction records written as JSON lines,
  read back (S2), turned into conversations (A17), tokenized (T2), indexed in
  file order (V1) and keyed as token-cache rows (K1).
* §3.2 ``training_batches``: chat tokens written as a token cache (K1), read
  back (S6/S7), left-padded (X1/X2), sampled for 3 ranks (V4), batched (B1).
* §3.3 ``prompt_dataset_phase2_*``: adjacent-turn pairs as a pairwise dataset,
  derived 9:1 split (P3), phase part of "2,4,4" (P2), pair filter (F2),
  end-of-text tokenization padded to 64 (T5, X4), in the shuffled order."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import join_ints
from ..functions.specials import ENDOFTEXT, PAD_ID
from ..session import scratch_path
from ..sinks.token_cache import write_token_cache
from . import sqlkit as q
from .prepare import create_prompt_dataset, prepare_sft_cache, training_batches
from .q_adapters import SQL_CONV_BASE, conv_pairs
from .q_features import _sft_store
from .q_order import SEED, sql_bounds
from .q_tokens import _LISTS

MAX_SEQ_LEN = 64
DATA_SPLIT = "2,4,4"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_pairs(spark, sf_dir).select(
        F.concat_ws(":", "conv_id", "turn").alias("row_id"), "prompt", "chosen", "rejected")


def _phase2(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    tr, ev = create_prompt_dataset(spark, [("Dahoas/rm-static", _pairs(spark, sf_dir))], DATA_SPLIT,
                                   2, seed=SEED, max_seq_len=MAX_SEQ_LEN)
    d = tr if which == "train" else ev
    return d.select("row_id", F.col("order").alias("pos"),
                    join_ints(F.col("chosen_input_ids")).alias("chosen_ids"),
                    join_ints(F.col("rejected_input_ids")).alias("rejected_ids"))


def prompt_dataset_phase2_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phase2(spark, sf_dir, "train")


def prompt_dataset_phase2_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phase2(spark, sf_dir, "eval")


def _sql(which: str) -> str:
    b3_cols, b3 = sql_bounds("9,1", "n")
    b2_cols, b2 = sql_bounds(DATA_SPLIT, "n")
    key = f"md5(concat_ws('-', '{SEED}', row_id)), row_id"
    n = MAX_SEQ_LEN
    return f"""WITH {SQL_CONV_BASE},
src AS (SELECT concat_ws(':', conv_id, turn) AS row_id, prompt, chosen, rejected FROM base),
r3 AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS rk FROM src),
b3 AS (SELECT {b3_cols} FROM (SELECT count(*) AS n FROM src)),
sp AS (SELECT r3.*, CASE WHEN rk < {b3[0]} THEN 'train' ELSE 'eval' END AS which FROM r3, b3),
r2 AS (SELECT *, row_number() OVER (PARTITION BY which ORDER BY {key}) - 1 AS rk2 FROM sp),
b2 AS (SELECT which, {b2_cols} FROM (SELECT which, count(*) AS n FROM sp GROUP BY which)),
p2 AS (SELECT r2.* FROM r2 JOIN b2 ON r2.which = b2.which WHERE rk2 >= b2.{b2[0]} AND rk2 < b2.{b2[1]}),
kept AS (SELECT row_id, which, rk2, prompt || chosen AS pc, prompt || rejected AS pr FROM p2
         WHERE prompt || chosen IS NOT NULL AND prompt || rejected IS NOT NULL),
long AS (SELECT row_id, which, rk2, 'c' AS field, pc || '{ENDOFTEXT}' AS t FROM kept UNION ALL
         SELECT row_id, which, rk2, 'r' AS field, pr || '{ENDOFTEXT}' AS t FROM kept),
{q.vocab_cte([("long", "t")])},
w AS (SELECT row_id, which, rk2, field, unnest({q.words('t')}) AS w,
             generate_subscripts({q.words('t')}, 1) AS p FROM long),
tok AS (SELECT row_id, which, rk2, field, list({q.id_of('w.w')} ORDER BY p) AS ids
        FROM w LEFT JOIN vocab v ON v.word = w.w GROUP BY row_id, which, rk2, field),
pad AS (SELECT row_id, which, rk2, field, list_resize(ids[1:{n}], {n}, {PAD_ID}) AS ids FROM tok),
pairs AS (SELECT c.row_id, c.which, c.rk2, array_to_string(c.ids, ',') AS chosen_ids,
                 array_to_string(r.ids, ',') AS rejected_ids
          FROM pad c JOIN pad r ON c.row_id = r.row_id AND c.which = r.which
          WHERE c.field = 'c' AND r.field = 'r')
SELECT row_id, row_number() OVER (ORDER BY rk2) - 1 AS pos, chosen_ids, rejected_ids
FROM pairs WHERE which = '{which}'"""


# §3.2: a token cache written by K1, read back (S6/S7), padded on the left,
# sampled for 3 ranks and batched by 4
TB_LEN, TB_WORLD, TB_BATCH = 64, 3, 4


def training_batches_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _sft_store(spark, sf_dir)
    path = scratch_path(spark, "token-cache")
    write_token_cache(rows, path)
    b = training_batches(spark, path, max_seq_len=TB_LEN, padding_side="left", batch_size=TB_BATCH,
                         sampler="distributed", world_size=TB_WORLD, seed=SEED)
    return batch_columns(b)


def batch_columns(b: DataFrame) -> DataFrame:
    return b.select("key", "padded_pos", "shard", "batch_id", "row_in_batch",
                    join_ints(F.col("input_ids")).alias("input_ids"),
                    join_ints(F.col("attention_mask")).alias("attention_mask"),
                    join_ints(F.col("labels")).alias("labels"))


def _sql_training_batches(w: int) -> str:
    n, bsz = TB_LEN, TB_BATCH

    def left(col: str, fill: int) -> str:
        return (f"CASE WHEN len({col}) >= {n} THEN {col}[1:{n}] ELSE list_concat("
                f"list_resize([]::INTEGER[], {n} - len({col}), {fill}), {col}) END")

    return f"""WITH {_LISTS},
c AS (SELECT ids, lab, row_number() OVER (ORDER BY conv_id) - 1 AS idx FROM lists),
k AS (SELECT 'sft_idx_' || CAST(idx AS VARCHAR) AS key, idx, {left('ids', PAD_ID)} AS ids,
             {left('lab', -100)} AS lab FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', '{SEED}', '0', key, CAST(idx AS VARCHAR))),
                                  key, idx) - 1 AS rank FROM k),
cnt AS (SELECT count(*) AS n, CAST(ceil(count(*) / {w}.0) * {w} AS BIGINT) AS total FROM k),
pp AS (SELECT key, ids, lab, rank AS padded_pos FROM r UNION ALL
       SELECT r.key, r.ids, r.lab, r.rank + t.j * cnt.n FROM r, cnt, range(1, 1 + {w}) t(j)
       WHERE r.rank + t.j * cnt.n < cnt.total),
sh AS (SELECT *, CAST(padded_pos % {w} AS INTEGER) AS shard, padded_pos // {w} AS shard_pos FROM pp)
SELECT key, padded_pos, shard, shard_pos // {bsz} AS batch_id,
       CAST(shard_pos % {bsz} AS INTEGER) AS row_in_batch,
       array_to_string(ids, ',') AS input_ids,
       array_to_string(list_transform(ids, lambda x: CASE WHEN x <> {PAD_ID} THEN 1 ELSE 0 END), ',')
         AS attention_mask,
       array_to_string(lab, ',') AS labels
FROM sh"""


# §3.1: instruction records (user turn + preceding system text as input,
# answer as output) written as JSON lines in (conv_id, turn) order, then
# read -> A17 -> T2 -> V1 -> K1 rows


def sft_cache_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = conv_pairs(spark, sf_dir).select(
        "conv_id", "turn", F.col("prompt").alias("instruction"),
        F.coalesce("sys", F.lit("")).alias("input"), F.col("chosen").alias("output"))
    path = scratch_path(spark, "instruct-jsonl")
    # range-partitioned output: part files follow (conv_id, turn) order
    (recs.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
     .select("instruction", "input", "output").write.json(path))
    rows = prepare_sft_cache(spark, os.path.join(path, "*.json"), None, key_tag="instruct",
                             json_lines=True)
    return rows.select("key", "idx", join_ints(F.col("input_ids")).alias("input_ids"),
                       join_ints(F.col("labels")).alias("labels"))


def _sql_sft_cache() -> str:
    words_role = q.words("role")
    words_text = q.words("coalesce(text, '')")
    return f"""WITH {SQL_CONV_BASE},
rec AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx,
               prompt || coalesce(sys, '') AS u, chosen AS a FROM base),
turns AS (SELECT idx, 0 AS turn, 'user' AS role, u AS text FROM rec UNION ALL
          SELECT idx, 1 AS turn, 'assistant' AS role, a AS text FROM rec),
{q.vocab_cte([("turns", "text"), ("turns", "role")])},
t AS (SELECT idx, turn, role, len({words_role}) AS nr,
             list_concat(['<|im_start|>'], {words_role}, [chr(10)], {words_text},
                         ['<|im_end|>', chr(10)]) AS ws FROM turns),
p AS (SELECT idx, turn, role, nr, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM t),
items AS (SELECT p.idx, p.turn, p.role, p.pos, p.nr, {q.id_of('p.w')} AS id
          FROM p LEFT JOIN vocab v ON v.word = p.w)
SELECT 'instruct_idx_' || CAST(idx AS VARCHAR) AS key, idx,
       {q.ints('id', 'turn, pos')} AS input_ids,
       {q.ints("CASE WHEN role = 'assistant' AND pos >= nr + 2 THEN id ELSE -100 END", 'turn, pos')} AS labels
FROM items GROUP BY idx"""


QUERIES = {
    "sft_cache_from_json": (sft_cache_from_json, _sql_sft_cache()),
    "training_batches": (training_batches_q, _sql_training_batches(TB_WORLD)),
    "prompt_dataset_phase2_train": (prompt_dataset_phase2_train, _sql("train")),
    "prompt_dataset_phase2_eval": (prompt_dataset_phase2_eval, _sql("eval")),
}
