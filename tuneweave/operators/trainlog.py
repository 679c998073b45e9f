"""Training-log analytics (M1-M6, M10): reset-bucket means, cumulative and
exponential means, evaluation perplexity, throughput and Dice. Aggregations
use map-side partial aggregation; ordered per-rank metrics use the chunked
scans, never a window over a whole rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_to

from .scans import exponential_mean, running_sums, sequence_positions


def report_buckets(log: DataFrame, report: Column, keys: Sequence[str] = ("rank",),
                   order_by: Sequence[str] = ("epoch", "step"), value: str = "loss",
                   weight: str = "n", digits: int = 5) -> DataFrame:
    """M1 + M2: a weighted mean ``round(sum(v*n)/sum(n), 5)`` reported at every
    row where ``report`` holds, then reset. A bucket is the rows after the
    previous report up to and including the report row; it carries over epoch
    ends; a trailing bucket without a report row is never emitted."""
    keys = list(keys)
    narrow = log.select(*keys, *order_by, value, weight, report.cast("int").alias("__r"))
    pos = sequence_positions(narrow, keys, list(order_by))
    counted = running_sums(pos, keys, "t", {"__before": F.col("__r")}, exclusive=True)
    agg = counted.groupBy(*keys, F.col("__before").alias("bucket")).agg(
        F.sum("__r").alias("__reports"),
        F.max(F.when(F.col("__r") == 1, F.struct(*[F.col(c) for c in order_by]))).alias("__at"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(value) * F.col(weight)).alias("__vn"), F.sum(weight).alias("__n"))
    out = agg.filter(F.col("__reports") > 0)
    return out.select(*keys, "bucket", *[F.col("__at")[c].alias(f"report_{c}") for c in order_by],
                      F.col("n_rows").cast("long"),
                      round_to(F.try_divide(F.col("__vn"), F.col("__n")), digits).alias("avg_loss"))


def cumulative_mean(log: DataFrame, keys: Sequence[str] = ("rank",),
                    order_by: Sequence[str] = ("epoch", "step"), value: str = "loss",
                    exact: bool = False) -> DataFrame:
    """M3: running mean per key (``total / count`` after every update). The reference
    adds doubles one after the other; with ``exact`` the total has no rounding of its own
    and is the same for any chunk, and may differ from such a loop in the last place."""
    keys = list(keys)
    pos = sequence_positions(log.select(*keys, *order_by, value), keys, list(order_by))
    run = running_sums(pos, keys, "t", {"__sum": F.col(value).cast("double")}, exact=exact)
    return run.withColumn("cum_mean", F.col("__sum") / (F.col("t") + 1)).drop("__sum")


def ema(log: DataFrame, keys: Sequence[str] = ("rank",), order_by: Sequence[str] = ("epoch", "step"),
        value: str = "loss", alpha: float = 0.9) -> DataFrame:
    """M4: exponential moving average per key (first value seeds)."""
    keys = list(keys)
    pos = sequence_positions(log.select(*keys, *order_by, value), keys, list(order_by))
    return exponential_mean(pos, keys, "t", F.col(value), alpha)


def eval_perplexity(eval_log: DataFrame, rank: str = "rank", loss: str = "loss",
                    by: Sequence[str] = ()) -> DataFrame:
    """M5: mean loss over batches per rank, then the unweighted mean over
    ranks; perplexity = exp (infinite on overflow). ``by``: one row per
    evaluation instead of one for the whole log."""
    per_rank = eval_log.groupBy(*by, rank).agg(F.avg(loss).alias("__l"))
    return per_rank.groupBy(*by).agg(F.avg("__l").alias("eval_loss")).withColumn(
        "perplexity", F.exp("eval_loss"))


def throughput(log: DataFrame, max_seq_len: int, rows: str = "n", seconds: str = "seconds",
               report: Column | None = None) -> DataFrame:
    """M6: tokens/s = rows*max_seq_len/s and samples/s, rounded to 4; the
    reference prints them for rank 0 every 1000 steps (``reported``)."""
    out = log.withColumn("tokens_per_sec", round_to(F.try_divide(
        F.col(rows) * F.lit(float(max_seq_len)), F.col(seconds)), 4)).withColumn(
        "samples_per_sec", round_to(F.try_divide(F.col(rows).cast("double"), F.col(seconds)), 4))
    if report is not None:
        out = out.withColumn("reported", report)
    return out


def dice_by_class(long: DataFrame, batch: str = "batch_id", klass: str = "class",
                  p: str = "p", t: str = "t", digits: int = 4) -> DataFrame:
    """M10 re-aimed on ``(batch, class, p, t)``: per batch and class
    ``(2*sum(p*t)+1)/(sum(p)+sum(t)+1)``, then the mean over batches."""
    per = long.groupBy(batch, klass).agg(
        ((F.lit(2.0) * F.sum(F.col(p) * F.col(t)) + 1) / (F.sum(p) + F.sum(t) + 1)).alias("__d"))
    return per.groupBy(klass).agg(round_to(F.avg("__d"), digits).alias("dice"))
