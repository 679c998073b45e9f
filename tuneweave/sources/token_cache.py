"""Token caches as Parquet.

A cache is a table ``(key, key_tag, idx, input_ids, labels)`` (see
``sinks.token_cache``). A key lookup is a filter that Parquet row-group
statistics can skip on; several caches read as one are a union with the store
ordinal kept, so conflicts can be resolved per key without a global step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CACHE_COLUMNS = ("key", "key_tag", "idx", "input_ids", "labels")


def read_token_cache(spark: SparkSession, path: str) -> DataFrame:
    """One cache; its length is ``count()`` (Parquet metadata)."""
    return spark.read.parquet(path)


def lookup(cache: DataFrame, key: str) -> DataFrame:
    """S6 ``search_by_index``: rows of one key. The tag and index that a key is made
    of are filtered too, so that only that tag's partition is opened and row groups
    are skipped on ``idx``."""
    tag, sep, index = key.rpartition("_idx_")
    if sep and index.isdigit() and {"key_tag", "idx"} <= set(cache.columns):
        cache = cache.filter((F.col("key_tag") == tag) & (F.col("idx") == int(index)))
    return cache.filter(F.col("key") == key)


def resolve_last(union: DataFrame, key_col: str = "key", store_col: str = "store",
                 value_cols: Sequence[str] = ("input_ids", "labels")) -> DataFrame:
    """D4 ``on_conflict='last'``: every key occurrence keeps its row, but its
    values come from the store with the highest ordinal holding that key. One
    shuffle on the key; a key's rows are bounded by the number of stores."""
    w = Window.partitionBy(key_col)
    winner = F.max_by(F.struct(*[F.col(c) for c in value_cols]), F.col(store_col)).over(w)
    out = union.withColumn("__win", winner)
    for c in value_cols:
        out = out.withColumn(c, F.col("__win")[c])
    return out.drop("__win")


def union_caches(caches: Sequence[DataFrame], on_conflict: str = "keep_all",
                 store_col: str = "store") -> DataFrame:
    """Several caches as one (length and keys are the concatenation).
    ``keep_all`` (default) keeps each store's own values; ``last`` makes a
    repeated key resolve to the last store, as the reference does."""
    if not caches:
        raise ValueError("no caches given")
    tagged = [c.withColumn(store_col, F.lit(i)) for i, c in enumerate(caches)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    if on_conflict == "keep_all":
        return union
    if on_conflict == "last":
        vals = [c for c in ("input_ids", "labels") if c in union.columns]
        return resolve_last(union, "key", store_col, vals)
    raise ValueError("on_conflict must be 'keep_all' or 'last'")


def read_token_caches(spark: SparkSession, paths: str | Sequence[str],
                      on_conflict: str = "keep_all") -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    return union_caches([read_token_cache(spark, p) for p in paths], on_conflict)
