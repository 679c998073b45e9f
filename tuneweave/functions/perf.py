"""Arithmetic columns for training-throughput formulas (M6-M9)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def checkpoint_factor(checkpointing: Column, lora_dim: Column, hidden: Column) -> Column:
    """4 with activation checkpointing else 3, minus ``1 - 2*lora/h`` with
    LoRA."""
    base = F.when(checkpointing, F.lit(4.0)).otherwise(F.lit(3.0))
    return F.when(lora_dim > 0, base - (F.lit(1.0) - lora_dim * 2 / hidden)).otherwise(base)


def train_flops(factor: Column, batch: Column, seq: Column, layers: Column, hidden: Column,
                vocab: Column) -> Column:
    """Megatron-style FLOPs per iteration:
    ``24*f*b*s*L*h^2 * (1 + s/(6h) + V/(16*L*h))``."""
    return (F.lit(24.0) * factor * batch * seq * layers * hidden * hidden) * (
        F.lit(1.0) + seq / (F.lit(6.0) * hidden) + vocab / (F.lit(16.0) * layers * hidden))


def tflops(flops: Column, seconds: Column, gpus: Column) -> Column:
    return F.try_divide(flops, seconds * gpus * F.lit(1e12))


def scheduled_lr(it: Column, init_lr: float, base_lr: float, min_lr: float, warmup_iters: int,
                 lr_decay_iters: int) -> Column:
    """M9: linear warm-up, cosine decay, floor."""
    ratio = (it - warmup_iters) / float(lr_decay_iters - warmup_iters)
    coeff = F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * ratio))
    return (F.when(it < warmup_iters, F.lit(init_lr) + F.lit(base_lr - init_lr) * it / float(warmup_iters))
            .when(it > lr_decay_iters, F.lit(min_lr))
            .otherwise(F.lit(min_lr) + coeff * F.lit(base_lr - min_lr)))
