"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target of words. A source's documents are all taken
``floor(target / size)`` times, and the rest of the ratio is an inclusion
probability, the same for all its documents. The cube method rounds these
probabilities to 0 or 1 while the number of documents and the number of words
stay what the probabilities say: of any three undecided documents it moves the
probabilities along the null space of the two constraints until one is decided.

The flight phase runs in parallel over blocks of a source; the at most two
documents that each block leaves undecided meet in larger blocks, level by level,
until one block of a source is left. Its last documents are the landing problem,
rounded to the choice whose words are nearest the target.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; a source without words has target 0 and its documents are not
taken; repeated rows are sampled each for itself; an empty table gives no rows.
Only ``doc_id``, ``text`` and ``source`` are read. Reruns give the same sample:
the random numbers come from the seed, the source and the block.
"""

from __future__ import annotations

import itertools
import math
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix as a share of all words, and copies of a document at most.
TOTAL, MOST = 1.5, 2.0
#: Documents of one flight block, on average.
BLOCK = 2048
SEED = 20240601
EPS = 1e-9
#: Documents that may change sides in the landing of a source.
SWAPS = 16
FLOWN = "rid long, doc_id long, source string, size long, block long, whole int, p double"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> dict:
    """Words to take of each source: ``total`` of all words by weight; what a
    source would get above ``most`` times its size goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass"))
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = total * sum(sizes.values()), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def fly(p: list[float], size: list[int], rng: random.Random) -> None:
    """Flight phase in place: on return at most two of ``p`` are not 0 or 1, the
    sums of p and of p * size as before."""
    window: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(p[i] > 0.5)
            continue
        window.append(i)
        while len(window) == 3:
            a, b, c = (size[k] for k in window)
            u = (c - b, a - c, b - a)  # orthogonal to (1, 1, 1) and to the sizes
            if not any(u):
                u = (1, -1, 0)
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(window, u) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(window, u) if x)
            step = up if rng.random() * (up + down) < down else -down
            for k, x in zip(window, u):
                p[k] += step * x
                if p[k] < EPS or p[k] > 1 - EPS:
                    p[k] = float(p[k] > 0.5)
            window = [k for k in window if 0 < p[k] < 1]


def land(p: list[float], size: list[int], goal: float) -> None:
    """Rounds the last undecided ones, in place, to the words nearest to ``goal``,
    then to the number of documents nearest to the sum of p. A large document
    among them can leave a gap; then single documents change sides, each time the
    one that closes most of the gap, as long as that helps."""
    rest = [i for i, x in enumerate(p) if 0 < x < 1]
    gap = sum(x * n for i, (x, n) in enumerate(zip(p, size)) if i not in rest) - goal
    docs = sum(p[i] for i in rest)
    best = min(itertools.product((0.0, 1.0), repeat=len(rest)), default=(), key=lambda pick: (
        abs(gap + sum(x * size[i] for x, i in zip(pick, rest))), abs(sum(pick) - docs), pick))
    for i, x in zip(rest, best):
        p[i] = x
        gap += x * size[i]
    for _ in range(SWAPS):
        i = min(range(len(p)), key=lambda k: abs(gap + (1 - 2 * p[k]) * size[k]))
        after = gap + (1 - 2 * p[i]) * size[i]
        if abs(after) >= abs(gap):
            break
        p[i], gap = 1 - p[i], after


def _block(seed: int, level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["size"], r["doc_id"] is None, r["doc_id"] or 0, r["rid"]))
        p, size = [r["p"] for r in rows], [r["size"] for r in rows]
        goal = sum(x * n for x, n in zip(p, size))
        fly(p, size, random.Random(f"{seed}/{rows[0]['source']}/{level}/{rows[0]['block']}"))
        if last:
            land(p, size, goal)
        for r, x in zip(rows, p):
            r["p"] = x
        return pa.Table.from_pylist(rows, schema=table.schema)
    return run


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, block: int = BLOCK,
        seed: int = SEED) -> DataFrame:
    """One row per document: rid (its row in ``docs``), doc_id, source, size,
    source_size, target, copies and ``taken`` words. ``docs`` must be a table."""
    spark = docs.sparkSession
    sized = materialize(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    stats = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    words = {r["source"]: r["words"] for r in stats}
    target = targets(words, weights, total, most)
    plan = []
    for r in stats:
        ratio = min(most, target[r["source"]] / r["words"]) if r["words"] else 0.0
        whole = int(math.floor(ratio + EPS))
        plan.append((r["source"], r["words"], float(target[r["source"]]), whole, max(0.0, ratio - whole),
                     max(1, -(-r["n"] // block))))
    # one row for each source
    plan_df = spark.createDataFrame(plan, "of string, source_size long, target double, whole int, p double, blocks long")
    known = F.broadcast(plan_df)
    now = (sized.join(known, F.col("source").eqNullSafe(F.col("of")), "inner")
           .withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")))
           .select("rid", "doc_id", "source", "size", "block", "whole", "p"))
    blocks, level, done = max((x[-1] for x in plan), default=1), 0, []
    while True:
        last = blocks == 1
        # the number of a block in a source says which block of the next level it joins
        flown = now.groupBy("source", "block").applyInArrow(_block(seed, level, last), FLOWN)
        if last:
            done.append(flown)
            break
        flown = materialize(flown, f"mix-level-{level}")
        done.append(flown.filter("p = 0 or p = 1"))
        fan = max(2, block // 2)
        now = flown.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / fan).cast("long"))
        blocks, level = -(-blocks // fan), level + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    copies = F.col("whole") + F.round("p").cast("int")
    totals = F.broadcast(plan_df.select("of", "source_size", "target"))
    return rows.join(totals, F.col("source").eqNullSafe(F.col("of"))).select(
        "rid", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    taken = mix(docs, **options).select("rid", "copies")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"))
    both = rows.join(taken, "rid").filter("copies > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
