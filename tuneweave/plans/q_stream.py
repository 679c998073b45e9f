"""Registered queries run through Structured Streaming (G1, G2). Each call
streams the ``events`` files to a Parquet sink (``availableNow``) and returns
the sink read back; the oracle is the batch SQL of the same metric."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..streaming.metrics_stream import (SERIES_SCHEMA, live_scalar_series, read_sink, run_metrics,
                                        step_log_stream)
from .q_trainlog import EMA_ALPHA, REPORT_EVERY, SQL_BUCKETS, SQL_CUMAVG, SQL_EMA
from .tables import table


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    glob = os.path.join(sf_dir, "events.parque[t]")
    log = step_log_stream(spark, glob, schema)
    # totals as the batch query adds them
    return read_sink(spark, run_metrics(log, alpha=EMA_ALPHA, report_every=REPORT_EVERY, exact=False))


def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).filter(~F.col("late"))
    return m.select("rank", "step", round_to("ema", 6).alias("ema"))


def stream_cumavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).filter(~F.col("late"))
    return m.select("rank", "step", round_to("cum_mean", 6).alias("cum_mean"))


def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).filter(F.col("report") & ~F.col("late"))
    return m.select("rank", "bucket", F.col("epoch").alias("report_epoch"),
                    F.col("step").alias("report_step"), F.col("bucket_rows").alias("n_rows"),
                    F.col("bucket_avg").alias("avg_loss"))


def stream_scalar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar series is itself the streaming query written to the
    Parquet sink (tag, value, global_step)."""
    schema = table(spark, sf_dir, "events").schema
    log = step_log_stream(spark, os.path.join(sf_dir, "events.parque[t]"), schema)
    out = run_metrics(log, alpha=EMA_ALPHA, report_every=REPORT_EVERY, project=live_scalar_series)
    s = read_sink(spark, out, SERIES_SCHEMA)
    return s.select("tag", round_to("value", 9).alias("value"), "global_step")


SQL_STREAM_SERIES = f"""WITH b AS ({SQL_BUCKETS})
SELECT '0_Train/rank-' || CAST(rank AS VARCHAR) || '_loss' AS tag, round(avg_loss, 9) AS value,
       report_step AS global_step FROM b"""

QUERIES = {
    "stream_ema": (stream_ema, SQL_EMA),
    "stream_cumavg": (stream_cumavg, SQL_CUMAVG),
    "stream_buckets": (stream_buckets, SQL_BUCKETS),
    "stream_scalar_series": (stream_scalar_series, SQL_STREAM_SERIES),
}
