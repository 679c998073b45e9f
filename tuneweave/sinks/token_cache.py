"""Token cache writer (K1) and content-keyed dataset persistence (K2)."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import dense_index


def cache_rows(tokens: DataFrame, key_tag: str, order_by: Sequence[str],
               indexed: bool = False, index_col: str = "idx") -> DataFrame:
    """K1 rows: dense index in dataset order and ``key = {tag}_idx_{i}``."""
    if not indexed:
        tokens = dense_index(tokens, list(order_by), index_col)
    return tokens.withColumn("key_tag", F.lit(key_tag)).withColumn(
        "key", F.concat(F.lit(key_tag), F.lit("_idx_"), F.col(index_col).cast("string")))


def write_token_cache(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: Parquet partitioned by ``key_tag``; the key list and length are the
    table itself (no side files). Rows sorted by ``idx`` inside each file keep
    row-group statistics tight for key lookups. Writing a tag again replaces that
    tag's rows and leaves the other tags (``mode="append"`` adds to them)."""
    (rows.select("key", "key_tag", "idx", "input_ids", "labels")
         .sortWithinPartitions("idx")
         .write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("key_tag").parquet(path))


def content_key(data_paths: Sequence[str], data_split: str, train_phase: int, seed: int,
                tokenizer_name: str, max_seq_len: int, sft_only_paths: Sequence[str] = (),
                content: Sequence[str] = ()) -> str:
    """K2: sha256 of the build parameters, as the reference names its cache, and of
    what else the result depends on (``content``: digests of the data, vocabulary and end
    token), so that a changed input is not taken for the one that was built."""
    parts = ["_".join(data_paths), data_split, f"phase{train_phase}", f"seed{seed}",
             tokenizer_name.replace("/", "_"), f"seqlen{max_seq_len}"]
    if sft_only_paths:
        parts.append("_".join(sft_only_paths))
    parts += list(content)
    return hashlib.sha256("_".join(parts).encode()).hexdigest()


def persist_or_reuse(spark: SparkSession, build, root: str, key: str,
                     reload: bool = False) -> dict[str, DataFrame]:
    """K2: the named results of one build under ``root/key/<name>``. They are reused
    when the marker written after the last of them is there, and ``build`` is then
    not called; else ``build()`` gives ``{name: DataFrame}``, and all are written
    anew, so that no result of an interrupted build is paired with another's."""
    path = os.path.join(root, key)
    marker = os.path.join(path, "complete")
    if reload or not _exists(spark, os.path.join(marker, "_SUCCESS")):
        _delete(spark, marker)
        made = build()
        for name, df in made.items():
            df.write.mode("overwrite").parquet(os.path.join(path, name))
        spark.createDataFrame([(n,) for n in made], "name string").coalesce(1).write.parquet(marker)
    names = sorted(r.name for r in spark.read.schema("name string").parquet(marker).collect())
    return {n: spark.read.parquet(os.path.join(path, n)) for n in names}


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))
