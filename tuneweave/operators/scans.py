"""Ordered scans over long per-key sequences (running sums, exponential
means) without a window over a whole key.

A rank of a training log is an unbounded sequence, so a window partitioned by
rank would put a whole key in one task. Instead every row gets its dense
position ``t`` inside the key (the distributed two-pass index), rows are cut
into chunks of ``chunk`` positions, windows or recurrences run per (key, chunk),
and what a chunk hands on is carried by the same scan one level up (chunk tables are
``chunk`` times smaller; the recursion ends when a key has at most ``chunk`` chunks).

Sums of doubles can be exact: every value is then cut into whole numbers on fixed binary
places (:func:`exact_parts`), whose sums do not depend on the order of addition, so neither
the chunk length nor the partitioning changes a bit of a running sum.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .order import dense_index
from .recurrence import scan_batches

DEFAULT_CHUNK = 1024  # rows per window partition, small so that most logs are carried across chunks


def sequence_positions(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column],
                       pos_col: str = "t") -> DataFrame:
    """Dense 0-based position of every row inside its key (V1 per group)."""
    return dense_index(df, order_by, pos_col, partition_by=list(keys))


#: An exact sum has LIMBS whole numbers of LIMB_BITS bits each, the first of them on the
#: place 2 ** (TOP_BIT - LIMB_BITS): magnitudes below 2 ** 64 and bits down to 2 ** -116.
LIMB_BITS, LIMBS, TOP_BIT = 30, 6, 64


def exact_parts(x: Column) -> list[Column]:
    """Whole numbers (longs) whose sums give the exact sum of ``x``, then a double for
    what has no such form: infinities, NaN and magnitudes of 2 ** 64 and more. Nulls add
    nothing; bits below 2 ** -116 are dropped from each value. Sums of up to 2 ** 33
    values fit."""
    x = F.coalesce(x.cast("double"), F.lit(0.0))
    plain = ~F.isnan(x) & (F.abs(x) < F.lit(2.0 ** TOP_BIT))
    v = F.when(plain, x).otherwise(0.0)
    parts = []
    for k in range(LIMBS):
        scaled = F.floor(v * F.lit(2.0 ** ((k + 1) * LIMB_BITS - TOP_BIT))) if k == 0 else _whole(
            v * F.lit(2.0 ** ((k + 1) * LIMB_BITS - TOP_BIT)))
        parts.append(scaled.cast("long"))
    return [*parts, F.when(plain, 0.0).otherwise(x)]


def _whole(x: Column) -> Column:
    """``floor(x)`` modulo 2 ** LIMB_BITS, exact for doubles of any size."""
    base = F.lit(2.0 ** LIMB_BITS)
    # doubles of 2 ** 52 and more are whole; floor() would leave the range of longs
    whole = F.when(F.abs(x) < F.lit(2.0 ** 52), F.floor(x).cast("double")).otherwise(x)
    return F.pmod(whole, base)


def from_parts(parts: Sequence[Column]) -> Column:
    """The double next to an exact sum (within an ulp), from the summed parts."""
    *limbs, other = parts
    carried, rest = [], F.lit(0).cast("long")
    for limb in reversed(limbs[1:]):
        total = limb + rest
        carried.append(total.bitwiseAND(F.lit((1 << LIMB_BITS) - 1).cast("long")))
        rest = F.shiftright(total, LIMB_BITS)
    ordered = [limbs[0] + rest, *reversed(carried)]
    terms = [c.cast("double") * F.lit(2.0 ** (TOP_BIT - (k + 1) * LIMB_BITS)) for k, c in enumerate(ordered)]
    return reduce(lambda a, b: a + b, terms) + other


def running_sums(df: DataFrame, keys: Sequence[str], pos_col: str,
                 values: dict[str, Column], chunk: int = DEFAULT_CHUNK,
                 max_pos: int | None = None, exclusive: bool = False, exact: bool = False) -> DataFrame:
    """Add inclusive (or exclusive) running sums of ``values`` over ``pos_col``
    inside each key. Windows never span more than ``chunk`` rows; nulls add 0. With
    ``exact`` the sums of floating-point values are exact up to one last rounding, the
    same bits for any chunk; else doubles are added, within a chunk in order."""
    keys, names = list(keys), list(values)
    types = df.select(*[v.alias(n) for n, v in values.items()]).schema
    split = {n: exact and isinstance(types[n].dataType, (T.DoubleType, T.FloatType)) for n in names}
    parts = {n: exact_parts(v) if split[n] else [F.coalesce(v, F.lit(0))] for n, v in values.items()}
    flat = {f"__{n}_{k}": c for n in names for k, c in enumerate(parts[n])}
    if max_pos is None:
        max_pos = df.agg(F.max(pos_col)).first()[0] or 0
    out = chunked_sums(df.select("*", *[c.alias(f) for f, c in flat.items()]), keys, pos_col, list(flat), chunk,
                        max_pos, exclusive)
    sums = {n: [F.col(f"__{n}_{k}") for k in range(len(parts[n]))] for n in names}
    return out.select(*df.columns, *[(from_parts(c) if split[n] else c[0]).alias(n) for n, c in sums.items()])


def chunked_sums(df: DataFrame, keys: list[str], pos_col: str, names: list[str], chunk: int,
                  max_pos: int, exclusive: bool) -> DataFrame:
    """``df`` with its columns ``names`` replaced by their running sums."""
    cid = f"__c_{pos_col}"
    base = df.withColumn(cid, F.expr(f"{pos_col} div {int(chunk)}"))
    last = -1 if exclusive else 0
    w = Window.partitionBy(*keys, cid).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, last)
    kept = [c for c in base.columns if c not in names]
    out = base.select(*kept, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in names])
    if max_pos >= chunk:  # chunks that others come before
        totals = base.groupBy(*keys, cid).agg(*[F.sum(n).alias(n) for n in names])
        carried = chunked_sums(totals, keys, cid, names, chunk, max_pos // chunk, True)
        carried = carried.select(*keys, cid, *[F.col(n).alias(f"__p{n}") for n in names])
        out = out.join(carried, [*keys, cid]).select(*kept, *[(F.col(n) + F.col(f"__p{n}")).alias(n) for n in names])
    return out.drop(cid)


def exponential_mean(df: DataFrame, keys: Sequence[str], pos_col: str, value: Column,
                     alpha: float = 0.9, out_col: str = "ema", chunk: int = DEFAULT_CHUNK,
                     initial: Column | None = None) -> DataFrame:
    """M4 per key: the first value seeds, then ``alpha*prev + (1-alpha)*x``;
    ``initial`` is the mean that a key's first row goes on from (null: none).

    Every row is the affine map ``(alpha, (1-alpha)*x)``, a key's first row the constant
    map of its seed. Chunks of ``chunk`` positions are scanned on their own, the map of a
    whole chunk is carried to the next one by the same scan one level up, and a row's mean
    is its prefix applied to what its chunk starts from. Rows travel once, to their chunk;
    the chunk length has nothing to do with ``alpha``."""
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must be in (0, 1)")
    keys = list(keys)
    a, b = F.lit(float(alpha)), F.lit(1.0 - float(alpha))
    x, at = value.cast("double"), F.col(pos_col)
    seed = x if initial is None else F.coalesce(initial.cast("double"), x)
    maps = df.withColumn("__a", F.when(at == 0, 0.0).otherwise(a)).withColumn(
        "__b", F.when(at == 0, a * seed + b * x).otherwise(b * x))
    max_pos = df.agg(F.max(pos_col)).first()[0] or 0
    return _affine_scan(maps, keys, pos_col, chunk, max_pos).withColumnRenamed("__b", out_col).drop("__a")


def _affine_scan(df: DataFrame, keys: list[str], pos_col: str, chunk: int, max_pos: int) -> DataFrame:
    """``df`` with its maps ``(__a, __b)`` replaced by their prefixes over a whole key."""
    cid = f"__c_{pos_col}"
    base = df.withColumn(cid, F.expr(f"{pos_col} div {int(chunk)}")).withColumn(
        "__start", F.col(pos_col) % chunk == 0)
    rows = base.repartition(*keys, cid).sortWithinPartitions(*keys, cid, pos_col)
    local = rows.mapInArrow(lambda batches: scan_batches(batches, "__a", "__b", "__start"), rows.schema).drop("__start")
    if max_pos < chunk:  # no chunk comes after another
        return local.drop(cid)
    local = materialize(local, "affine-chunks")
    ends = local.groupBy(*keys, cid).agg(F.max_by(F.struct("__a", "__b"), pos_col).alias("m"))
    ends = ends.select(*keys, cid, "m.*")
    carried = _affine_scan(ends, keys, cid, chunk, max_pos // chunk).select(
        *keys, (F.col(cid) + 1).alias(cid), F.col("__a").alias("__pa"), F.col("__b").alias("__pb"))
    out = local.join(carried, [*keys, cid], "left")
    new_b = F.when(F.col("__pb").isNull() | (F.col("__a") == 0), F.col("__b")).otherwise(F.col("__a") * F.col("__pb") + F.col("__b"))
    new_a = F.col("__a") * F.coalesce(F.col("__pa"), F.lit(1.0))
    return out.withColumn("__new", F.struct(new_a.alias("a"), new_b.alias("b"))).drop("__pa", "__pb", cid).withColumn(
        "__a", F.col("__new.a")).withColumn("__b", F.col("__new.b")).drop("__new")
