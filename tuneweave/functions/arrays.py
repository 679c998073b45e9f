"""Array-column expressions for padded samples (X1-X5, B3), all JVM-side
higher-order functions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .specials import IGNORE_INDEX


def pad_clip(arr: Column, max_len: int, pad_value: int, side: str = "right") -> Column:
    """Pad to ``max_len`` on ``side`` and keep the **first** ``max_len``
    elements (for either side)."""
    if side not in ("left", "right"):
        raise ValueError("padding side must be 'left' or 'right'")
    fill = F.array_repeat(F.lit(pad_value), F.greatest(F.lit(0), F.lit(max_len) - F.size(arr)))
    padded = F.concat(arr, fill) if side == "right" else F.concat(fill, arr)
    return F.slice(padded, 1, max_len)


def value_mask(arr: Column, pad_id: int) -> Column:
    """Attention mask by value (``id != pad``); real tokens equal to the
    pad id are masked too, as in the reference."""
    return F.transform(arr, lambda x: (x != F.lit(pad_id)).cast("int"))


def real_token_mask(n_real: Column, max_len: int) -> Column:
    """Mask of a right-padded row with ``n_real`` real tokens."""
    return F.transform(F.sequence(F.lit(0), F.lit(max_len - 1)),
                       lambda i: (i < n_real).cast("int"))


def labels_from_mask(ids: Column, mask: Column) -> Column:
    """Phase-1 labels, the id where the mask is set, else -100 (the prompt
    is not masked)."""
    return F.zip_with(ids, mask, lambda x, m: F.when(m == 1, x).otherwise(F.lit(IGNORE_INDEX)))


def left_pad(arr: Column, target_len: Column, pad_value: int) -> Column:
    """B3 piece: left-pad to ``target_len`` (never clips)."""
    return F.concat(F.array_repeat(F.lit(pad_value), F.greatest(F.lit(0), target_len - F.size(arr))),
                    arr)


def join_ints(arr: Column, sep: str = ",") -> Column:
    """Render an int array as text (for hashing and comparisons)."""
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), sep)
