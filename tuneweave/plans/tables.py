"""Driver tables as DataFrames (one Parquet file or directory per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.parquet(path)


def step_log(spark: SparkSession, sf_dir: str, world: int = 4) -> DataFrame:
    """The ``events`` table read as a training-step log:
    rank = user_id % world, step = event_id, loss = value, n = props.k,
    seconds = value / 100, epoch 0 (one pass)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.lit(0).alias("epoch"),
        F.col("event_id").alias("step"),
        (F.col("user_id") % world).cast("int").alias("rank"),
        F.col("value").alias("loss"),
        F.get_json_object("props", "$.k").cast("int").alias("n"),
        (F.col("value") / 100.0).alias("seconds"),
        F.col("event_type"),
        F.col("ts"))


def eval_log(spark: SparkSession, sf_dir: str, world: int = 4) -> DataFrame:
    """The ``events`` table read as an evaluation log:
    rank = user_id % world, batch_id = event_id, loss = value / 10."""
    ev = table(spark, sf_dir, "events")
    return ev.select((F.col("user_id") % world).cast("int").alias("rank"),
                     F.col("event_id").alias("batch_id"), (F.col("value") / 10.0).alias("loss"))
