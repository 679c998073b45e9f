"""Batching and collation (B1-B4) as columns on ordered rows: no per-batch
Python, windows only over one batch (bounded by the batch size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import left_pad


def batch_ids(df: DataFrame, batch_size: int, pos_col: str = "shard_pos",
              batch_col: str = "batch_id", row_col: str = "row_in_batch") -> DataFrame:
    """B1: fixed-size batches in sampler order; the last one may be short."""
    return (df.withColumn(batch_col, F.expr(f"{pos_col} div {int(batch_size)}"))
            .withColumn(row_col, (F.col(pos_col) % batch_size).cast("int")))


def _batch_key(df: DataFrame, batch_col: str) -> list[str]:
    return [c for c in ("shard",) if c in df.columns] + [batch_col]


def reward_collate(df: DataFrame, batch_col: str = "batch_id", row_col: str = "row_in_batch",
                   chosen_cols: tuple[str, str] = ("chosen_input_ids", "chosen_attention_mask"),
                   rejected_cols: tuple[str, str] = ("rejected_input_ids",
                                                     "rejected_attention_mask"),
                   keys: list[str] | None = None) -> DataFrame:
    """B2: each batch lists all chosen rows, then all rejected rows. Emits one
    row per (pair, side) with ``row_in_collated = side * batch_len + row``. Batches
    are numbered within a shard, so a ``shard`` column is part of their key."""
    keys = [c for c in ("shard",) if c in df.columns and c not in (keys or [])] + (keys or [])
    w = Window.partitionBy(*_batch_key(df, batch_col))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col(chosen_cols[0]).alias("input_ids"),
                 F.col(chosen_cols[1]).alias("attention_mask")),
        F.struct(F.lit(1).alias("side"), F.col(rejected_cols[0]).alias("input_ids"),
                 F.col(rejected_cols[1]).alias("attention_mask")))
    out = df.withColumn("__blen", F.count(F.lit(1)).over(w)).select(
        *keys, batch_col, row_col, "__blen", F.explode(sides).alias("__s"))
    return out.select(*keys, batch_col, F.col("__s.side").alias("side"),
                      (F.col("__s.side") * F.col("__blen") + F.col(row_col)).alias("row_in_collated"),
                      F.col("__s.input_ids").alias("input_ids"),
                      F.col("__s.attention_mask").alias("attention_mask"))


def prompt_collate(df: DataFrame, max_token_len: int, pad_id: int, batch_col: str = "batch_id",
                   ids_col: str = "prompt_input_ids", mask_col: str = "prompt_attention_mask"
                   ) -> DataFrame:
    """Reversed phase-3 prompts are padded to the batch maximum, then to
    ``max_token_len``, then flipped back: left-padded prompts in natural order,
    length ``greatest(batch max, max_token_len)``."""
    w = Window.partitionBy(*_batch_key(df, batch_col))
    target = F.greatest(F.max(F.size(ids_col)).over(w), F.lit(max_token_len))
    nat_ids = F.reverse(F.col(ids_col))
    nat_mask = F.reverse(F.col(mask_col))
    return (df.withColumn("__len", target)
            .withColumn("prompt", left_pad(nat_ids, F.col("__len"), pad_id))
            .withColumn("prompt_att_mask", left_pad(nat_mask, F.col("__len"), 0))
            .drop("__len"))


def mini_batches(df: DataFrame, batch_size: int, max_size: int, small_batch_size: int,
                 rows_per_shard: int, batch_col: str = "batch_id", row_col: str = "row_in_batch"
                 ) -> DataFrame:
    """Large batches are buffered ``max_size`` at a time and each buffered
    batch is cut into ``small_batch_size`` pieces; incomplete buffers are never
    emitted. Adds ``buffer_id`` and ``mini_id`` (running over the buffer)."""
    n_batches = -(-rows_per_shard // batch_size)
    complete = n_batches // max_size
    per_batch = -(-batch_size // small_batch_size)
    out = df.withColumn("buffer_id", F.expr(f"{batch_col} div {int(max_size)}"))
    out = out.filter(F.col("buffer_id") < complete)
    return out.withColumn(
        "mini_id",
        ((F.col(batch_col) % max_size) * per_batch
         + F.expr(f"{row_col} div {int(small_batch_size)}")).cast("long"))


def collate_with(df: DataFrame, fn, schema, batch_cols: tuple[str, ...] = ("shard", "batch_id")
                 ) -> DataFrame:
    """A custom collator as ``applyInPandas`` over one batch at a time
    (a group is bounded by the batch size); use only when B1-B3 do not fit."""
    return df.groupBy(*batch_cols).applyInPandas(fn, schema)
