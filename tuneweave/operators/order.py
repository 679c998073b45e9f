"""Deterministic order: dense index (V1), seeded shuffle (V2), exact splits
(P1-P3), blends (U1-U2), subsets (V3) and rank sharding (V4).

Global positions are computed in two passes without a single-partition window:
range-partition on the full sort key (plus a per-row tiebreak, so a hot key value
is spread over many partitions), number rows inside each partition, store the
result once in the shared checkpoint folder, then add per-partition offsets that
come from a table with one row per partition (bounded by the partition count,
so broadcasting it is safe).

Where ids are unique (``unique_ids``) only the keys go through the index; parts are
filtered on their rank and the records are fetched by one join on the ids.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_PID = "__pid"
_MID = "__mid"
_TB = "__tb"


def _as_sort_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def dense_index(df: DataFrame, order_by: Sequence[str | Column],
                index_col: str = "idx", partition_by: Sequence[str] | None = None,
                num_partitions: int | None = None, return_count: bool = False):
    """V1: 0-based dense position of every row in ``order_by`` order.

    With ``partition_by`` the position restarts at 0 in every group. Rows equal
    on the whole key get distinct consecutive positions (they are
    interchangeable). The per-partition numbering is materialised once so that
    the offset pass and the numbering pass see the same rows even after an
    executor loss or an adaptive re-plan. With ``return_count`` (global index
    only) the row count comes back too, taken from the per-partition counts
    instead of another pass.
    """
    spark = df.sparkSession
    groups = list(partition_by or [])
    sort_cols = [F.col(g) for g in groups] + _as_sort_cols(order_by) + [F.col(_TB)]
    keyed = df.withColumn(_TB, F.monotonically_increasing_id())
    # without an explicit count, adaptive execution may coalesce small range
    # partitions; partition ids are read after the shuffle, so either is exact
    ranged = (keyed.repartitionByRange(num_partitions, *sort_cols) if num_partitions
              else keyed.repartitionByRange(*sort_cols))
    tagged = (ranged
              .sortWithinPartitions(*sort_cols)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id())
              .drop(_TB))
    stored = materialize(tagged, "dense-index")
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    if not groups:
        # one row per shuffle partition: bounded by the partition count, so it
        # is collected and broadcast
        counts = sorted((r[0], r[1]) for r in stored.groupBy(_PID).count().collect())
        offsets, run = [], 0
        for pid, cnt in counts:
            offsets.append((pid, run))
            run += cnt
        off_df = spark.createDataFrame(offsets or [(0, 0)], f"{_PID} int, __off long")
        out = stored.join(F.broadcast(off_df), _PID).withColumn(index_col, F.col("__off") + local)
        out = out.drop(_PID, _MID, "__off")
        return (out, run) if return_count else out
    if return_count:
        raise ValueError("return_count is only available for a global index")
    counts = stored.groupBy(_PID, *groups).agg(
        F.count(F.lit(1)).alias("__n"), F.min(_MID).alias("__first"))
    w = Window.partitionBy(*groups).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, *groups, "__first",
                            F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    # at most (#partitions + #groups) rows; the planner chooses broadcast or shuffle
    out = (stored.join(offsets, [_PID, *groups])
           .withColumn(index_col, F.col("__off") + F.col(_MID) - F.col("__first")))
    return out.drop(_PID, _MID, "__off", "__first")


def shuffle_key(seed: int, id_cols: Sequence[str | Column]) -> Column:
    """md5 of ``seed-id1-id2...``: the seeded permutation key of V2."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[
        (F.col(c) if isinstance(c, str) else c).cast("string") for c in id_cols]))


def seeded_rank(df: DataFrame, seed: int, id_cols: Sequence[str], rank_col: str = "rank",
                partition_by: Sequence[str] | None = None, return_count: bool = False,
                unique_ids: bool = False):
    """V2: seeded shuffle. ``rank`` is the 0-based position after ordering by
    ``md5(seed-id)``; ids break the (astronomically rare) digest ties. With
    ``unique_ids`` the keys alone are ranked and the records join them."""
    if unique_ids:
        keys, n = _ranked_keys(df, seed, id_cols, rank_col, partition_by)
        out = fetch(df, keys, [*(partition_by or []), *id_cols])
        return (out, n) if return_count else out
    keyed = df.withColumn("__h", shuffle_key(seed, id_cols))
    out = dense_index(keyed, ["__h", *id_cols], rank_col, partition_by, return_count=return_count)
    if return_count:
        return out[0].drop("__h"), out[1]
    return out.drop("__h")


def _ranked_keys(df: DataFrame, seed: int, id_cols: Sequence[str], rank_col: str,
                 partition_by: Sequence[str] | None = None) -> tuple[DataFrame, int | None]:
    """The keys of ``df`` with their rank, and their number (of all groups: None)."""
    keys = df.select(*(partition_by or []), *id_cols)
    if partition_by:
        return seeded_rank(keys, seed, id_cols, rank_col, partition_by), None
    return seeded_rank(keys, seed, id_cols, rank_col, return_count=True)


def fetch(df: DataFrame, keys: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Late materialisation: the records of ``df`` whose ids are in ``keys``, with the
    other columns of ``keys``. Null ids match null ids; ids are unique on both sides."""
    index = keys.select(*[F.col(c).alias(f"__id_{i}") for i, c in enumerate(id_cols)],
                        *[c for c in keys.columns if c not in id_cols])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__id_{i}")) for i, c in enumerate(id_cols)])
    return df.join(index, same).drop(*[f"__id_{i}" for i in range(len(id_cols))])


def split_bounds(data_split: str, n: int) -> list[int]:
    """P1 bounds: each part's size is its share of the rows, rounded half to even;
    the first part makes up for all rounding, and the bounds are the running sum of
    the sizes. Sizes that do not fit (overlapping parts) raise ``ValueError``."""
    shares = [float(part) for part in data_split.split(",")]
    whole = sum(shares)
    if whole <= 0:
        raise ValueError(f"split weights must sum to a positive number: {data_split!r}")
    sizes = [round(share / whole * n) for share in shares]
    sizes[0] = n - sum(sizes[1:])
    if min(sizes) < 0:
        raise ValueError(f"split {data_split!r} of {n} rows gives invalid sizes {sizes}")
    return [0, *itertools.accumulate(sizes)]


def part_of(rank: Column, bounds: Sequence[int]) -> Column:
    """Part number of a rank given P1 bounds (empty parts never match)."""
    expr = None
    for i in range(len(bounds) - 1):
        lo, hi = bounds[i], bounds[i + 1]
        if lo == hi:
            continue
        cond = (rank >= lo) & (rank < hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr if expr is not None else F.lit(None).cast("int")


def exact_split(df: DataFrame, data_split: str, seed: int, id_cols: Sequence[str],
                rank_col: str = "rank", part_col: str = "part",
                n: int | None = None, unique_ids: bool = False) -> DataFrame:
    """Seeded shuffle, then exact proportional parts of the shuffled order.
    The only driver value is the row count."""
    source = df.select(*id_cols) if unique_ids else df
    ranked, counted = seeded_rank(source, seed, id_cols, rank_col, return_count=True)
    n = counted if n is None else n
    bounds = split_bounds(data_split, n)
    parted = ranked.withColumn(part_col, part_of(F.col(rank_col), bounds))
    return fetch(df, parted, id_cols) if unique_ids else parted


def _one_part(df: DataFrame, data_split: str, part: int, seed: int, id_cols: Sequence[str],
              rank_col: str, unique_ids: bool) -> DataFrame:
    """The records of one part; with unique ids the others are never fetched."""
    split = exact_split(df.select(*id_cols) if unique_ids else df, data_split, seed, id_cols, rank_col)
    rows = split.filter(F.col("part") == part).drop("part")
    return fetch(df, rows, id_cols) if unique_ids else rows


def phase_part(df: DataFrame, data_split: str, train_phase: int, seed: int,
               id_cols: Sequence[str], rank_col: str = "rank", unique_ids: bool = False) -> DataFrame:
    """The phase uses part ``train_phase - 1`` of the split (train and eval
    alike)."""
    return _one_part(df, data_split, train_phase - 1, seed, id_cols, rank_col, unique_ids)


def train_eval_split(df: DataFrame, seed: int, id_cols: Sequence[str],
                     rank_col: str = "rank", unique_ids: bool = False) -> DataFrame:
    """Derived 9:1 split; adds ``split`` = 'train' | 'eval'."""
    out = exact_split(df, "9,1", seed, id_cols, rank_col, unique_ids=unique_ids)
    return out.withColumn("split", F.when(F.col("part") == 0, "train").otherwise("eval")).drop("part")


def blend(datasets: dict[str, DataFrame], seed: int, id_col: str = "id",
          source_col: str = "source", rank_col: str = "rank", unique_ids: bool = False) -> DataFrame:
    """Union all datasets (tagged with their source) and shuffle the union
    with the seeded order on (seed, source, id). ``unique_ids``: ids are unique
    inside each dataset."""
    tagged = [d.withColumn(source_col, F.lit(name)) for name, d in datasets.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return seeded_rank(union, seed, [source_col, id_col], rank_col, unique_ids=unique_ids)


def sft_only_append(train: DataFrame, sft_only: dict[str, DataFrame], seed: int,
                    id_col: str = "id", source_col: str = "source",
                    rank_col: str = "rank", unique_ids: bool = False) -> DataFrame:
    """SFT-only datasets enter phase 1 whole (split ``"10,0,0"``) and the
    result is shuffled again."""
    parts = {"__train": train.drop(rank_col) if rank_col in train.columns else train}
    for name, d in sft_only.items():
        parts[name] = d
    tagged = []
    for name, d in parts.items():
        tagged.append(d if name == "__train" else d.withColumn(source_col, F.lit(name)))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return seeded_rank(union, seed, [source_col, id_col], rank_col, unique_ids=unique_ids)


def subset(df: DataFrame, index: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """V3: rows whose key appears in ``index`` (left-semi join, never a
    collected list)."""
    return df.join(index, on, "left_semi")


def rank_shards(ranked: DataFrame, world_size: int, pos_col: str = "rank",
                n: int | None = None, shard_col: str = "shard",
                shard_pos_col: str = "shard_pos") -> DataFrame:
    """V4: distributed sampling. The shuffled order is padded to a multiple of
    ``world_size`` by repeating its head; shard ``r`` takes positions
    ``r, r + world, ...``. Adds ``padded_pos``, ``shard`` and ``shard_pos``."""
    n = ranked.count() if n is None else n
    if n == 0:
        return ranked.withColumn("padded_pos", F.col(pos_col)).withColumn(
            shard_col, F.lit(0)).withColumn(shard_pos_col, F.lit(0))
    total = -(-n // world_size) * world_size
    pad = total - n
    reps = -(-pad // n) if pad else 0
    base = ranked.withColumn("padded_pos", F.col(pos_col).cast("long"))
    if pad:
        head = (ranked.filter(F.col(pos_col) < pad)
                .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(reps))))
                .withColumn("padded_pos", (F.col(pos_col) + F.col("__copy") * n).cast("long"))
                .filter(F.col("padded_pos") < total)
                .drop("__copy"))
        base = base.unionByName(head)
    return (base.withColumn(shard_col, (F.col("padded_pos") % world_size).cast("int"))
            .withColumn(shard_pos_col, F.expr(f"padded_pos div {int(world_size)}")))


def first_n(indexed: DataFrame, n: int, index_col: str = "idx") -> DataFrame:
    """first-N cap in dataset order, only when ``n > 0``."""
    return indexed.filter(F.col(index_col) < n) if n and n > 0 else indexed
