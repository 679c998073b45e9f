"""Streaming training metrics (G1) and live scalar series.

A step log arriving as files is read with ``readStream``. Every micro-batch runs through
the batch scans of ``operators.scans`` and hands its carry to the next one: per rank the
last step, the exponential mean, the exact sums and the open bucket, one small row. The
reference keeps the same numbers in Python objects: the exponential mean (first value
seeds), the cumulative mean, and the reset-bucket weighted mean reported at every report
step.

The scans order a micro-batch by ``(rank, epoch, step)`` over all tasks and cut it into
chunks, so a backlog may be one micro-batch: no task and no state holds a rank's rows, and
the results do not depend on how many files hold the backlog or in which order they were
written. Logs whose files arrive in step order can bound a micro-batch with
``max_files_per_trigger``. A row at or before the last step of its rank, or a repeated
step, is late: it stays in the output without metrics, flagged, and is counted in the carry.

Output and carry of a micro-batch lie in folders of its number, written anew when it is run
again after a failure, so each row counts once.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import round_to
from ..operators.scans import (DEFAULT_CHUNK, LIMBS, chunked_sums, exact_parts, exponential_mean, from_parts,
                               sequence_positions)
from ..session import materialize, scratch_path

OUTPUT_SCHEMA = T.StructType([
    T.StructField("rank", T.IntegerType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("step", T.LongType()),
    T.StructField("late", T.BooleanType()),
    T.StructField("ema", T.DoubleType()),
    T.StructField("cum_mean", T.DoubleType()),
    T.StructField("report", T.BooleanType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("bucket_rows", T.LongType()),
    T.StructField("bucket_avg", T.DoubleType()),
])

_PARTS = range(LIMBS + 1)
#: One row per rank; ``s_k`` and ``v_k`` are exact sums of the loss and of the open bucket's
#: loss * n.
CARRY_SCHEMA = T.StructType([
    T.StructField("rank", T.IntegerType()),
    T.StructField("last", T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("step", T.LongType())])),
    T.StructField("ema", T.DoubleType()),
    T.StructField("count", T.LongType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("b_rows", T.LongType()),
    T.StructField("b_n", T.DoubleType()),
    T.StructField("late_rows", T.LongType()),
    *[T.StructField(f"{p}_{k}", T.DoubleType() if k == LIMBS else T.LongType()) for p in "sv" for k in _PARTS],
])


def _zero(name: str) -> Column:
    return F.coalesce(F.col(f"c_{name}"), F.lit(0).cast(CARRY_SCHEMA[name].dataType))


def _with_carry(df: DataFrame, carry: DataFrame) -> DataFrame:
    before = carry.select(*[F.col(c).alias(c if c == "rank" else f"c_{c}") for c in carry.columns])
    return df.join(before, "rank", "left")


def batch_metrics(log: DataFrame, carry: DataFrame, alpha: float = 0.9, report_every: int = 100,
                  digits: int = 5, chunk: int = DEFAULT_CHUNK, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """G1 of one micro-batch: its rows (``OUTPUT_SCHEMA``) and the carry of the next,
    from a log of rank, epoch, step, loss and n. ``exact``: totals are exact sums, the same
    bits however the log is cut into micro-batches; else doubles are added in order."""
    at = F.struct("epoch", "step")
    narrow = log.select(F.col("rank").cast("int").alias("rank"), F.col("epoch").cast("int").alias("epoch"),
                        F.col("step").cast("long").alias("step"), F.col("loss").cast("double").alias("loss"),
                        F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("n"))
    first = F.row_number().over(Window.partitionBy("rank", "epoch", "step").orderBy("loss", "n"))
    marked = _with_carry(narrow, carry.select("rank", "last")).withColumn("copy", first)
    marked = materialize(marked.withColumn("late", F.coalesce(at <= F.col("c_last"), F.lit(False)) | (F.col("copy") > 1))
                         .drop("c_last", "copy"), "stream-rows")
    pos = sequence_positions(marked.filter(~F.col("late")).drop("late"), ["rank"], ["epoch", "step"])
    report = F.col("step") % report_every == 0
    loss = exact_parts(F.col("loss")) if exact else [F.lit(0).cast("long")] * LIMBS + [F.col("loss")]
    sums = {f"s_{k}": c for k, c in enumerate(loss)} | {"reports": report.cast("long")}
    flat = pos.withColumn("report", report).select("*", *[c.alias(n) for n, c in sums.items()])
    most = pos.agg(F.max("t")).first()[0] or 0
    run = _with_carry(chunked_sums(flat, ["rank"], "t", list(sums), chunk, most, False), carry)
    run = exponential_mean(run, ["rank"], "t", F.col("loss"), alpha, chunk=chunk, initial=F.col("c_ema"))
    total = [F.col(f"s_{k}") + _zero(f"s_{k}") for k in _PARTS]
    count = F.col("t") + 1 + _zero("count")
    run = materialize(run.select(
        "rank", "epoch", "step", "loss", "n", "ema", "report", count.alias("count"),
        (from_parts(total) / count).alias("cum_mean"), *[c.alias(f"s_{k}") for k, c in enumerate(total)],
        (F.col("reports") - F.col("report").cast("long") + _zero("bucket")).alias("bucket")), "stream-run")

    # what this batch adds to each bucket, and the carry where it goes on with one
    parts = exact_parts(F.col("loss") * F.col("n"))
    added = run.groupBy("rank", "bucket").agg(
        F.count(F.lit(1)).alias("b_rows"), F.sum("n").alias("b_n"), *[F.sum(c).alias(f"v_{k}") for k, c in enumerate(parts)])
    open_ = ["b_rows", "b_n", *[f"v_{k}" for k in _PARTS]]
    going = carry.select("rank", "bucket", *open_)
    buckets = added.unionByName(going).groupBy("rank", "bucket").agg(*[F.sum(c).alias(c) for c in open_])
    average = round_to(F.try_divide(from_parts([F.col(f"v_{k}") for k in _PARTS]), F.col("b_n")), digits)
    reported = buckets.select("rank", "bucket", F.lit(True).alias("report"), F.col("b_rows").alias("bucket_rows"),
                              average.alias("bucket_avg"))
    none = F.lit(None)
    rows = run.join(reported, ["rank", "bucket", "report"], "left").withColumn("late", F.lit(False)).withColumn(
        "bucket", F.when(F.col("report"), F.col("bucket")))
    late = marked.filter("late").select("rank", "epoch", "step", "late", F.lit(False).alias("report"), *[
        none.cast(OUTPUT_SCHEMA[c].dataType).alias(c) for c in ("ema", "cum_mean", "bucket", "bucket_rows", "bucket_avg")])
    names = [f.name for f in OUTPUT_SCHEMA.fields]
    rows = rows.select(*names).unionByName(late.select(*names))

    # the last row of each rank, or its old carry; then its open bucket
    end = run.groupBy("rank").agg(F.max(F.struct(
        F.struct("epoch", "step").alias("last"), "ema", "count", (F.col("bucket") + F.col("report").cast("long")).alias("bucket"),
        *[f"s_{k}" for k in _PARTS])).alias("e")).select("rank", "e.*")
    kept = ["last", "ema", "count", "bucket", *[f"s_{k}" for k in _PARTS]]
    old = carry.select("rank", *[F.col(c).alias(f"c_{c}") for c in [*kept, "late_rows"]])
    dropped = marked.groupBy("rank").agg(F.sum(F.col("late").cast("long")).alias("more"))
    new = end.join(old, "rank", "full").join(dropped, "rank", "left").select(
        "rank", *[F.coalesce(c, f"c_{c}").alias(c) for c in kept],
        (F.coalesce("c_late_rows", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("late_rows"))
    new = new.join(buckets, ["rank", "bucket"], "left")
    new = new.select(*[(F.coalesce(F.col(f.name), F.lit(0)) if f.name in open_ else F.col(f.name)).cast(f.dataType).alias(f.name)
                       for f in CARRY_SCHEMA.fields])
    return rows, new


def step_log_stream(spark: SparkSession, path_glob: str, schema: T.StructType,
                    world: int = 4, max_files_per_trigger: int | None = None) -> DataFrame:
    """Events files as a streaming step log (same mapping as the batch view:
    rank = user_id % world, step = event_id, loss = value, n = props.k)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = reader.parquet(path_glob)
    return ev.select(
        F.lit(0).alias("epoch"), F.col("event_id").alias("step"),
        (F.col("user_id") % world).cast("int").alias("rank"), F.col("value").alias("loss"),
        F.get_json_object("props", "$.k").cast("int").alias("n"))


def run_metrics(log: DataFrame, out_path: str | None = None, checkpoint: str | None = None,
                alpha: float = 0.9, report_every: int = 100, digits: int = 5,
                project=None, exact: bool = True) -> str:
    """Stream a step log (rank, epoch, step, loss, n) into a Parquet sink of
    ``OUTPUT_SCHEMA`` rows, or of what ``project`` makes of them, processing everything
    available, and return the output path; one folder ``batch=N`` for each micro-batch.
    Without ``out_path`` all goes to scratch space removed at process exit; with it, the
    checkpoint defaults to ``<out_path>/_checkpoint`` (durable, ignored by readers)."""
    spark = log.sparkSession
    if out_path is None:
        base = scratch_path(spark, "stream")
        out_path = os.path.join(base, "out")
        checkpoint = checkpoint or os.path.join(base, "checkpoint")
    checkpoint = checkpoint or os.path.join(out_path, "_checkpoint")

    def carry_path(batch: int) -> str:
        return os.path.join(checkpoint, "carry", f"batch={batch}")

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        carry = (session.read.schema(CARRY_SCHEMA).parquet(carry_path(number - 1)) if number
                 else session.createDataFrame([], CARRY_SCHEMA))
        rows, new = batch_metrics(batch, carry, alpha, report_every, digits, exact=exact)
        rows = project(rows) if project else rows
        rows.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={number}"))
        new.write.mode("overwrite").parquet(carry_path(number))

    (log.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return out_path


def read_sink(spark: SparkSession, path: str, schema: T.StructType = OUTPUT_SCHEMA) -> DataFrame:
    """The rows of all micro-batches of :func:`run_metrics` (none where none came)."""
    glob = os.path.join(path, "batch=*")
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    found = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jpath)
    return spark.read.schema(schema).parquet(glob) if found else spark.createDataFrame([], schema)


SERIES_SCHEMA = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("global_step", T.LongType()),
])


def live_scalar_series(metrics: DataFrame) -> DataFrame:
    """G2 rows: the reported bucket means as ``(tag, value, global_step)``
    (``SERIES_SCHEMA``)."""
    rep = metrics.filter(F.col("report") & ~F.col("late"))
    return rep.select(
        F.concat(F.lit("0_Train/rank-"), F.col("rank").cast("string"), F.lit("_loss")).alias("tag"),
        F.col("bucket_avg").alias("value"), F.col("step").alias("global_step"))
