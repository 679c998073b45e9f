"""Ranked lexical search by sequential impact-sorted reads (NRA).

A posting's impact is its term's weight times its share of the document's score. The
postings of the query terms are stored by falling impact, in levels of a quarter of an
octave, and the items (queries) read on from level to level. After a round an item knows
of each document it met

* a lower bound, the sum of the impacts read so far;
* an upper bound, the lower one and the greatest impact still unread in each of the
  item's lists. That rest is kept for every item and level.

A document stays only while its upper bound reaches the item's threshold, a score that k
documents are known to reach: those with the greatest lower bounds are read to their end
ahead of the others. Once the rest is below the threshold no document that was not met
can come in, and the item reads on over the documents that are left. At the end all rests
are zero, and the bounds are the exact scores, ties included.

Each posting travels once, to the partition of its document, where the reads of all items
are summed and pruned: the bounds that are dropped are never written or shuffled. Bounds
come back in the next round as the postings of a list of the item's own.

Collected are only the totals of the corpus, two levels a round, and a bit map of the
hashes of query terms of fixed size (``BITS``), which only spares postings that the join
on the terms would drop. Where rounds end steers cost, not results.

Defined results: a null text has no terms; rows of documents or items with equal or null
ids stand for themselves; null doc_ids come last among equal scores; an item without a
document of score above 0, and an empty table, give no rows; other columns are ignored.
A document's distinct terms are counted in one task, whatever its length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

TOP = 20
BITS = 20
#: Letters of terms are these and every byte above 127; A-Z become a-z.
LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
CUT = bytes(b + 32 if 65 <= b <= 90 else b if b in LETTERS or b > 127 else 32 for b in range(256))
#: Levels of a quarter octave below 2 ** 36; END lies behind the last one.
OCTAVES, STEPS = 36, 4
END = OCTAVES * STEPS + 1
#: A round leaves this share of an item's rest while it has no threshold, and then this
#: share of the threshold, so that few documents stay; after that it reads to the end.
OPEN, CLOSED = 0.75, 0.35
#: Without a threshold at this share of the rest before the first read, too.
LAST = 0.05
#: So many times the asked documents are read ahead for the threshold.
AHEAD = 8
#: Documents of an output batch.
BATCH = 256


def terms(text: bytes) -> list[bytes]:
    return text.translate(CUT).split()


def _counted(batches, bits: bytes | None, key: str):
    """(key, n, terms, tfs) of every text with a term; with ``bits`` only the terms
    whose hash is set there."""
    seen = None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8)).tolist()
    mask = (1 << BITS) - 1
    for batch in batches:
        keys = batch.column(0)
        for at in range(0, batch.num_rows, BATCH):
            rows, sizes, found, tfs = [], [], [], []
            texts = batch.column(1).slice(at, BATCH).cast(pa.binary()).to_pylist()
            for i, text in enumerate(texts):
                words = terms(text or b"")
                if words:
                    count = Counter(words)
                    if seen is not None:
                        count = {w: c for w, c in count.items() if seen[zlib.crc32(w) & mask]}
                    rows.append(at + i)
                    sizes.append(len(words))
                    found.append([w.decode() for w in count])
                    tfs.append(list(count.values()))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(found, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))],
                names=[key, "n", "terms", "tfs"])


def _counts(df: DataFrame, key: str, bits: bytes | None = None) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias(key), "text")
    return rows.mapInArrow(lambda batches: _counted(batches, bits, key),
                           f"{key} long, n long, terms array<string>, tfs array<long>")


def item_terms(items: DataFrame) -> DataFrame:
    """iid (one a row), item_id, term and q, its occurrences in the item."""
    rows = _counts(items, "item_id").withColumn("iid", F.monotonically_increasing_id())
    return rows.select("iid", "item_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(
        "iid", "item_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("q"))


def _bit_map(wanted: DataFrame) -> bytes:
    at = wanted.select(F.crc32("term").bitwiseAND((1 << BITS) - 1).alias("b")).distinct()
    bits = np.zeros(1 << BITS, np.uint8)
    bits[[r.b for r in at.collect()]] = 1  # at most 2 ** BITS rows
    return np.packbits(bits).tobytes()


def _level(impact: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.lit(float(STEPS)) * (F.lit(float(OCTAVES)) - F.log2(impact)))).cast("int")


class Index:
    """Impact-sorted postings of the terms of ``items`` in ``docs``.

    Written tables: ``docs`` (rid, doc_id, ...), ``lists`` (iid, tid, w, the term's weight
    times its occurrences in the item), ``postings`` (level, tid, rid, f, the share that
    w is multiplied by) and ``heads`` (tid, level, n, f, the greatest of the level); rid
    and iid number rows."""

    def __init__(self, docs: DataFrame, items: DataFrame):
        wanted = materialize(item_terms(items), "rank-items")
        counted = _counts(docs, "doc_id", _bit_map(wanted)).withColumn("rid", F.monotonically_increasing_id())
        self.docs = materialize(counted, "rank-docs")
        n_docs, n_terms = self.docs.agg(F.count(F.lit(1)), F.sum("n")).first()
        n_docs, n_terms = n_docs or 0, n_terms or 1
        found = self.docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
        known = wanted.select("term").distinct().join(found, "term").select(
            "term", weight.alias("w"), F.monotonically_increasing_id().alias("tid")).filter("w > 0")
        known = materialize(known, "rank-terms")
        self.items = wanted.select("iid", "item_id").distinct()
        self.lists = materialize(wanted.join(known, "term").select("iid", "tid", (F.col("q") * F.col("w")).alias("w")),
                                 "rank-lists")
        m = F.expr(f"75L + (25L * n * {n_docs}L) div {n_terms}L")
        flat = self.docs.select("rid", m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(
            "rid", "m", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
        share = F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)").cast("int")
        flat = flat.join(known, "term").select("tid", "rid", "w", share.alias("f")).filter("f > 0")
        flat = flat.select(_level(F.col("w") * F.col("f")).alias("level"), "tid", "rid", "f")
        # every part is sorted: a round reads a band of levels of each
        self.postings = materialize(flat.sortWithinPartitions("level", "rid"), "rank-postings")
        self.heads = materialize(self.postings.groupBy("tid", "level").agg(
            F.count(F.lit(1)).alias("n"), F.max("f").alias("f")), "rank-heads")

    def rests(self) -> DataFrame:
        """iid, level and ``rest``: the sum over the item's lists of the greatest
        impact from that level on; no row where nothing is left."""
        before = F.coalesce(F.lag("level").over(Window.partitionBy("tid").orderBy("level")), F.lit(-1))
        tops = self.heads.withColumn("before", before).select(
            "tid", "f", F.explode(F.sequence(F.col("before") + 1, F.col("level"))).alias("level"))
        return tops.join(self.lists, "tid").groupBy("iid", "level").agg(F.sum(F.col("w") * F.col("f")).alias("rest"))


def _next_fronts(plan: DataFrame, rests: DataFrame) -> DataFrame:
    """iid, theta, whole, lo, hi, rest (from hi on) and ``open`` (whether the item takes
    documents it has not met) of the next round, from plan (iid, theta, whole, hi, rest).
    ``whole`` is the rest before the first read."""
    rest, theta, whole = F.col("rest"), F.col("theta"), F.col("whole")
    aim = (F.when(theta > 0, F.when(rest <= theta * CLOSED, -1.0).otherwise(theta * CLOSED))
           .otherwise(F.when(rest <= whole * LAST, -1.0).otherwise(rest * OPEN)))
    asked = plan.select("iid", "theta", "whole", F.col("hi").alias("lo"), aim.alias("aim"), (rest >= theta).alias("open"))
    ahead = (rests.select("iid", "level", F.col("rest").alias("r")).join(asked.select("iid", "lo", "aim"), "iid")
             .filter((F.col("level") > F.col("lo")) & (F.col("r") <= F.col("aim")))
             .groupBy("iid").agg(F.min(F.struct("level", "r")).alias("to")))
    return asked.join(ahead, "iid", "left").select(
        "iid", "theta", "whole", "lo", "open", F.coalesce("to.level", F.lit(END)).alias("hi"),
        F.coalesce("to.r", F.lit(0)).cast("long").alias("rest"))


def _read(index: Index, plan: DataFrame, state: DataFrame | None, first: int, last: int) -> DataFrame:
    """(iid, rid, lower) after the reads of a round, without the documents whose upper
    bound is below the threshold. The round's reads lie in levels ``first`` to ``last``
    - 1. Items that are not open read on over the documents they have met only."""
    level = F.col("level")
    band = index.postings.filter((level >= first) & (level < last)).select("level", "tid", "rid", F.col("f").cast("long").alias("f"))
    lists = index.lists.join(plan.select("iid", "lo", "hi", "open"), "iid").filter("lo < hi")
    if state is not None:
        own, one = -1 - F.col("iid"), F.lit(1).cast("long")
        lists = lists.unionByName(plan.select("iid", own.alias("tid"), one.alias("w"), F.lit(-1).alias("lo"),
                                              F.lit(0).alias("hi"), F.lit(True).alias("open")))
        band = band.unionByName(state.select(F.lit(-1).alias("level"), own.alias("tid"), "rid", F.col("lower").alias("f")))
    # written, so that its size is known before the join is planned: with few items it
    # comes to the postings, and their sums need no other exchange than that by document
    lists = materialize(lists.withColumnRenamed("tid", "list"), "rank-round")
    band = band.repartition("rid")
    takes = F.col("open")
    if state is not None:
        met = state.select("rid").distinct().withColumn("met", F.lit(True))
        band = band.join(met, "rid", "left")
        takes = takes | F.coalesce(F.col("met"), F.lit(False))
    reads = band.join(lists, (F.col("tid") == F.col("list")) & (level >= F.col("lo")) & (level < F.col("hi")) & takes)
    sums = reads.groupBy("rid", "iid").agg(F.sum(F.col("w") * F.col("f")).alias("lower"))
    return (sums.join(plan.select("iid", "theta", "rest"), "iid")
            .filter(F.col("lower") + F.col("rest") >= F.col("theta")).select("iid", "rid", "lower"))


def _thresholds(index: Index, state: DataFrame, top: int) -> DataFrame:
    """iid and ``least``, the ``top``-th score of the ``AHEAD`` * ``top`` documents with
    the greatest lower bounds; items that have met fewer than ``top`` have none."""
    best = F.row_number().over(Window.partitionBy("iid").orderBy(F.col("lower").desc()))
    ahead = state.select("iid", "rid", best.alias("at")).filter(F.col("at") <= AHEAD * top).drop("at")
    scores = (index.postings.join(ahead, "rid").join(index.lists, ["iid", "tid"])
              .groupBy("iid", "rid").agg(F.sum(F.col("w") * F.col("f")).alias("least")))
    order = F.row_number().over(Window.partitionBy("iid").orderBy(F.col("least").desc()))
    return scores.select("iid", "least", order.alias("at")).filter(F.col("at") == top).drop("at")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` documents."""
    index = Index(docs, items)
    rests = materialize(index.rests(), "rank-rests")
    plan = rests.groupBy("iid").agg(F.max("rest").alias("whole")).select(
        "iid", F.lit(0).cast("long").alias("theta"), "whole", F.lit(0).alias("hi"), F.col("whole").alias("rest"))
    state = None
    while True:
        plan = materialize(_next_fronts(plan, rests), "rank-plan")
        first, last, ends = plan.filter("lo < hi").agg(F.min("lo"), F.max("hi"), F.min("hi")).first()
        if first is None:
            break
        state = materialize(_read(index, plan, state, first, last), "rank-state")
        if ends < END:
            least = _thresholds(index, state, top)
            theta = F.greatest("theta", F.coalesce("least", F.lit(0)))
            plan = plan.join(least, "iid", "left").withColumn("theta", theta)
    if state is None:
        return index.docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # every rest is zero: the bounds are the scores
    scored = state.join(index.docs.select("rid", "doc_id"), "rid").join(index.items, "iid")
    order = Window.partitionBy("iid").orderBy(F.col("lower").desc(), F.col("doc_id").asc_nulls_last(), "rid")
    return (scored.filter("lower > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", F.col("lower").alias("score")))
