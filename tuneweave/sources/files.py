"""File sources.

JSON-array files are read whole, one task per file, or in pieces by many tasks
(:func:`read_large_json_arrays`); JSON lines split across tasks. Explicit schemas avoid
the inference pass over the data.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order import dense_index
from ..operators.scans import running_sums

INSTRUCT_SCHEMA = T.StructType([
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])

CONVERSATION_SCHEMA = T.StructType([
    T.StructField("conversations", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
])

PREFERENCE_SCHEMA = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("chosen", T.StringType()),
    T.StructField("rejected", T.StringType()),
])


def with_file_order(df: DataFrame, ordinal: int = 0) -> DataFrame:
    """Columns that give records their 'path order': ``file_ordinal`` (the position
    of the path they were asked for by), ``source_file`` (the file name, to order
    files inside a glob or a directory) and ``row_in_file`` (increasing in file
    order: a file's splits are read in offset order)."""
    return (df.withColumn("file_ordinal", F.lit(ordinal))
            .withColumn("source_file", F.input_file_name())
            .withColumn("row_in_file", F.monotonically_increasing_id()))


def _in_path_order(read, paths: Sequence[str]) -> DataFrame:
    """Each path read on its own, so that its place in ``paths`` is a literal and no
    file name has to be matched; Spark raises for a path that is not there."""
    if not paths:
        raise ValueError("no paths given")
    parts = [with_file_order(read(p), i) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b), parts)


ORDER_COLUMNS = ("file_ordinal", "source_file", "row_in_file")


def read_json_arrays(spark: SparkSession, paths: str | Sequence[str],
                     schema: T.StructType = INSTRUCT_SCHEMA) -> DataFrame:
    """Files that each hold one JSON array of records, concatenated in path
    order (see :func:`with_file_order`). Each file is read whole by one task;
    convert large inputs to JSON lines or Parquet first."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _in_path_order(spark.read.schema(schema).option("multiLine", True).json, paths)


def read_large_json_arrays(spark: SparkSession, paths: str | Sequence[str],
                           schema: T.StructType = INSTRUCT_SCHEMA) -> DataFrame:
    """S1 for files of any size: the same records in the same order, a file being cut
    into pieces that many tasks read.

    A piece ends behind each ``}``. What it does to the reader's state is two numbers, the
    quotes in it and the change of depth (braces outside of strings) for either state it
    may begin in; running sums of them, in chunks, tell which braces close a record. The
    pieces of a record are joined again, by its number, and parsed. Top-level values that
    are no objects are no records; files are UTF-8."""
    paths = [paths] if isinstance(paths, str) else list(paths)

    def pieces(path: str) -> DataFrame:
        return spark.read.option("lineSep", "}").text(path)

    read = _in_path_order(pieces, paths)
    keys = ["file_ordinal", "source_file"]
    # escaped characters go first: what is left of quotes opens or closes a string
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    marks = read.withColumn("__q", F.split(F.regexp_replace(plain, r'[^"{]', ""), '"', -1))

    def braces(k: int):  # in every other stretch between quotes
        return F.aggregate(F.filter("__q", lambda x, i: i % 2 == k), F.lit(0), lambda n, x: n + F.length(x))

    quotes = (F.size("__q") - 1).cast("long")
    states = dense_index(marks.select(*keys, "row_in_file", "value", quotes.alias("__quotes"), *[
        braces(k).cast("long").alias(f"__open{k}") for k in (0, 1)]), ["row_in_file"], "__t", partition_by=keys)
    states = running_sums(states, keys, "__t", {"__before": F.col("__quotes")}, exclusive=True)
    inside = F.col("__before") % 2  # the piece begins in a string
    ends_outside = (F.col("__before") + F.col("__quotes")) % 2 == 0
    opened = F.when(inside == 0, F.col("__open0")).otherwise(F.col("__open1"))
    states = states.withColumn("__closes", ends_outside.cast("long")).withColumn("__delta", opened - ends_outside.cast("long"))
    depth = running_sums(states, keys, "__t", {"__depth": F.col("__delta")})
    closing = ((F.col("__depth") == 0) & (F.col("__closes") == 1)).cast("long")
    numbered = running_sums(depth.withColumn("__end", closing), keys, "__t", {"__record": F.col("__end")}, exclusive=True)
    parts = F.sort_array(F.collect_list(F.struct("__t", "value")))
    records = numbered.groupBy(*keys, "__record").agg(parts.alias("__p"), F.max("__end").alias("__whole"))
    text = F.concat(F.array_join(F.transform("__p", lambda p: p["value"]), "}"), F.lit("}"))
    text = F.regexp_replace(text, r"^[^{]*", "")
    parsed = records.filter("__whole = 1").select(*keys, F.col("__record").alias("row_in_file"), F.from_json(text, schema).alias("__r"))
    return parsed.select("__r.*", *ORDER_COLUMNS)


def read_json_lines(spark: SparkSession, paths: str | Sequence[str],
                    schema: T.StructType = INSTRUCT_SCHEMA, ordered: bool = False) -> DataFrame:
    """JSON-lines files (splittable); ``ordered`` adds the path-order
    columns."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    read = spark.read.schema(schema).json
    return _in_path_order(read, paths) if ordered else read(paths)


def read_local_pair(spark: SparkSession, train_path: str, eval_path: str,
                    schema: T.StructType = PREFERENCE_SCHEMA) -> DataFrame:
    """S3: local train/eval JSON pair; both files must exist. Adds ``split``."""
    for p in (train_path, eval_path):
        if not _exists(spark, p):
            raise RuntimeError(f"missing local dataset file: {p}")
    tr = spark.read.schema(schema).json(train_path).withColumn("split", F.lit("train"))
    ev = spark.read.schema(schema).json(eval_path).withColumn("split", F.lit("eval"))
    return tr.unionByName(ev)


def read_saved_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A dataset directory saved on disk; a named split is a
    sub-directory."""
    return spark.read.parquet(os.path.join(path, split) if split else path)


def unsupervised_text_column(df: DataFrame) -> str:
    """The text column is ``text`` if present, else the first column."""
    return "text" if "text" in df.columns else df.columns[0]


def split_of(df: DataFrame, which: str, split_col: str = "split",
             names: tuple[str, str] = ("train", "eval")) -> DataFrame:
    """``get_train_data`` / ``get_eval_data`` on a table with a split
    column (natural names per adapter, e.g. ('train', 'test'))."""
    name = names[0] if which == "train" else names[1]
    return df.filter(F.col(split_col) == name)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))
