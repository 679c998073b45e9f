"""Scalar metric series (K4): wide step logs to ``(tag, value, global_step)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scalar_series(df: DataFrame, tags: dict[str, str], step_col: str = "global_step",
                  keys: list[str] | None = None) -> DataFrame:
    """Unpivot ``{tag: column}`` into a long series; nulls are skipped as an
    event writer would not log them."""
    keys = keys or []
    wide = df.select(*keys, F.col(step_col).alias("global_step"),
                     *[F.col(c).cast("double").alias(t) for t, c in tags.items()])
    long = wide.unpivot([*keys, "global_step"], list(tags), "tag", "value")
    return long.filter(F.col("value").isNotNull())


def global_step(epoch: str, step: str, steps_per_epoch: int):
    """``epoch * len(loader) + step``."""
    return F.col(epoch).cast("long") * steps_per_epoch + F.col(step)


def append_series(series: DataFrame, path: str) -> None:
    series.write.mode("append").partitionBy("tag").parquet(path)
