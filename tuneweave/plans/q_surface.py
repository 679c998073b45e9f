"""Registered queries for the surfaces users plug into, and what goes with them: own
adapters (E2), own collators (E3), corpora without a ``text`` column (S8), series appended
over several epochs (K4), counts beside a dataset (M11)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import join_ints
from ..functions.numeric import round_to
from ..operators.adapters import AdapterSpec, apply_adapter, phase_filter, register_adapter, resolve_adapter
from ..operators.batches import batch_ids, collate_with
from ..operators.trainlog import report_buckets
from ..session import scratch_path
from ..sinks.metrics import append_series, global_step, scalar_series
from . import sqlkit as q
from .prepare import prompt_dataset_counts, unsupervised_blocks
from .q_adapters import SQL_CONV_BASE, SQL_DOC_BASE, doc_pairs
from .q_features import _SHARDS, TRAIN_BATCH, _shards
from .q_order import SEED, sql_bounds
from .q_prepare import DATA_SPLIT, MAX_SEQ_LEN, _pairs
from .q_trainlog import REPORT_EVERY
from .tables import step_log, table

STEPS_PER_EPOCH = 1000
PROMPT_LEN, ANSWER_LEN, GROUP_ROWS = 96, 32, 50

#: A layout of one's own, matched by a part of the dataset's name.
HEADLINES = AdapterSpec(
    "own/headlines", "own_headlines", ("train", "test"),
    prompt=lambda: F.concat(F.lit("Headline: "), F.col("question")), chosen=lambda: F.col("answer"),
    rejected=lambda: F.col("alt"),
    prompt_and_chosen=lambda: F.concat(F.lit("Headline: "), F.col("question"), F.lit("\n"), F.col("answer")),
    prompt_and_rejected=lambda: F.concat(F.lit("Headline: "), F.col("question"), F.lit("\n"), F.col("alt")))


def adapter_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through a registered adapter, found by its name inside a longer one."""
    register_adapter("own/headlines", HEADLINES)
    rows = apply_adapter(doc_pairs(spark, sf_dir), resolve_adapter("hub/own/headlines-v2"), ["doc_id"])
    return phase_filter(rows, 2).select("doc_id", "prompt", F.md5("prompt_and_chosen").alias("chosen_md5"),
                                        F.md5("prompt_and_rejected").alias("rejected_md5"))


def _joined(batch: pd.DataFrame) -> pd.DataFrame:
    """A collator: the ids of a batch in order."""
    rows = batch.sort_values("row_in_batch")
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "batch_id": [rows["batch_id"].iloc[0]],
                         "n_rows": [len(rows)], "doc_ids": [",".join(map(str, rows["doc_id"]))]})


def collate_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom collator over the batches of each shard."""
    batches = batch_ids(_shards(spark, sf_dir), TRAIN_BATCH).select("shard", "batch_id", "row_in_batch", "doc_id")
    return collate_with(batches, _joined, "shard int, batch_id long, n_rows long, doc_ids string")


def pack_blocks_first_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus whose text is its first column, in the order of its ids."""
    corpus = table(spark, sf_dir, "conversations").select(F.col("text").alias("utterance"), "conv_id", "turn")
    blocks = unsupervised_blocks(spark, corpus, PROMPT_LEN, ANSWER_LEN, GROUP_ROWS, order_by=["conv_id", "turn"])
    return blocks.select("group_id", "block_id", join_ints(F.col("input_ids")).alias("input_ids"),
                         F.size("labels").cast("long").alias("n_tokens"))


def epoch_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: the reported means of a run of several epochs of STEPS_PER_EPOCH steps, appended
    to one series by two writers and read back."""
    log = step_log(spark, sf_dir).select("rank", "loss", "n", F.expr(f"cast(step div {STEPS_PER_EPOCH} as int)").alias("epoch"),
                                         (F.col("step") % STEPS_PER_EPOCH).alias("step"))
    b = report_buckets(log, F.col("step") % REPORT_EVERY == 0)
    wide = b.withColumn("global_step", global_step("report_epoch", "report_step", STEPS_PER_EPOCH))
    s = scalar_series(wide, {"loss": "avg_loss"}, keys=["rank", "report_epoch"]).withColumn(
        "tag", F.concat(F.lit("0_Train/rank-"), F.col("rank").cast("string"), F.lit("_"), F.col("tag")))
    path = scratch_path(spark, "series")
    for part in (0, 1):
        append_series(s.filter(F.col("report_epoch") % 2 == part).select("tag", "value", "global_step"), path)
    return spark.read.parquet(path).select("tag", round_to("value", 9).alias("value"), "global_step")


def prompt_dataset_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept and dropped of the phase 2 part of the pairs, per split."""
    return prompt_dataset_counts([("Dahoas/rm-static", _pairs(spark, sf_dir))], DATA_SPLIT, 2, SEED, MAX_SEQ_LEN)


# ------------------------------------------------------------------ oracle SQL

SQL_REGISTERED = f"""WITH {SQL_DOC_BASE},
t AS (SELECT doc_id, 'Headline: ' || question AS prompt, 'Headline: ' || question || chr(10) || answer AS c,
             'Headline: ' || question || chr(10) || alt AS r FROM base)
SELECT doc_id, prompt, md5(c) AS chosen_md5, md5(r) AS rejected_md5 FROM t WHERE c IS NOT NULL AND r IS NOT NULL"""

SQL_COLLATE = f"""WITH {_SHARDS}
SELECT shard, shard_pos // {TRAIN_BATCH} AS batch_id, count(*) AS n_rows,
       string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY shard_pos) AS doc_ids
FROM sh GROUP BY shard, shard_pos // {TRAIN_BATCH}"""

_BLOCK = PROMPT_LEN + ANSWER_LEN
SQL_PACK_FIRST = f"""WITH {q.vocab_cte([('conversations', 'text')])},
d AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, {q.words('text')} AS ws FROM conversations),
o AS (SELECT idx // {GROUP_ROWS} AS grp, ws, coalesce(sum(len(ws)) OVER (PARTITION BY idx // {GROUP_ROWS} ORDER BY idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
        sum(len(ws)) OVER (PARTITION BY idx // {GROUP_ROWS}) AS tot FROM d),
p AS (SELECT grp, off, CASE WHEN tot >= {_BLOCK} THEN tot // {_BLOCK} * {_BLOCK} ELSE tot END AS keep,
             unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM o),
ids AS (SELECT grp, off + i AS pos, {q.id_of('p.w')} AS id FROM p LEFT JOIN vocab v ON v.word = p.w WHERE off + i < keep)
SELECT CAST(grp AS BIGINT) AS group_id, CAST(pos // {_BLOCK} AS BIGINT) AS block_id, {q.ints('id', 'pos')} AS input_ids,
       count(*) AS n_tokens FROM ids GROUP BY grp, pos // {_BLOCK}"""

SQL_EPOCH_SERIES = f"""WITH log AS (
  SELECT CAST(user_id % 4 AS INTEGER) AS rank, event_id // {STEPS_PER_EPOCH} AS epoch, event_id % {STEPS_PER_EPOCH} AS step,
         value AS loss, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events),
b AS (SELECT *, step % {REPORT_EVERY} = 0 AS r, coalesce(sum((step % {REPORT_EVERY} = 0)::INTEGER) OVER (
        PARTITION BY rank ORDER BY epoch, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bucket FROM log)
SELECT '0_Train/rank-' || rank || '_loss' AS tag, round(round(sum(loss * n) / nullif(sum(n), 0), 5), 9) AS value,
       max(epoch * {STEPS_PER_EPOCH} + step) FILTER (WHERE r) AS global_step
FROM b GROUP BY rank, bucket HAVING bool_or(r) AND sum(n) <> 0"""


def _sql_counts() -> str:
    cols3, b3 = sql_bounds("9,1", "n")
    cols2, b2 = sql_bounds(DATA_SPLIT, "n")
    key = f"md5(concat_ws('-', '{SEED}', row_id)), row_id"
    return f"""WITH {SQL_CONV_BASE},
r3 AS (SELECT concat_ws(':', conv_id, turn) AS row_id, prompt || chosen AS c, prompt || rejected AS r FROM base),
k3 AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS rk, count(*) OVER () AS n FROM r3),
s3 AS (SELECT row_id, c, r, CASE WHEN rk < {b3[0]} THEN 'train' ELSE 'eval' END AS which FROM (SELECT *, {cols3} FROM k3)),
k2 AS (SELECT *, row_number() OVER (PARTITION BY which ORDER BY {key}) - 1 AS rk,
              count(*) OVER (PARTITION BY which) AS n FROM s3),
p AS (SELECT * FROM (SELECT *, {cols2} FROM k2) WHERE rk >= {b2[0]} AND rk < {b2[1]})
SELECT 'Dahoas/rm-static' AS source, which, count(*) FILTER (WHERE c IS NOT NULL AND r IS NOT NULL) AS kept,
       count(*) FILTER (WHERE c IS NULL OR r IS NULL) AS dropped, CAST(0 AS BIGINT) AS filtered FROM p GROUP BY which"""


QUERIES = {
    "adapter_registered": (adapter_registered, SQL_REGISTERED),
    "collate_custom": (collate_custom, SQL_COLLATE),
    "pack_blocks_first_column": (pack_blocks_first_column, SQL_PACK_FIRST),
    "epoch_series": (epoch_series, SQL_EPOCH_SERIES),
    "prompt_dataset_counts": (prompt_dataset_counts_q, _sql_counts()),
}
