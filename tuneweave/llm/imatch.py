"""I-Match document fingerprints from DataFrame functions only.

A term is a lower-cased word. The lexicon holds the terms whose document
frequency lies in a band of the corpus, that is an inverse-document-frequency
band. A text's fingerprint has one hash per randomised subset of the lexicon:
its distinct terms in that subset are sorted and hashed. The subsets are of several
sizes, from the whole lexicon down to small shares of it: the smaller a subset, the more
edits pass it by. A subset with fewer than ``LEAST`` terms of the text says nothing and has
no hash, but for the whole lexicon. Two fingerprints are as alike as the share of subsets
in which they agree, of those where either has a hash.

Document frequency is counted per term (its 64-bit hash). The lexicon is a hash
table: the hashes of its terms by bucket, ``BUCKETS`` of them. A text has each of
its terms once, so the band admits at most the mean number of distinct terms of a
text divided by ``LOW``, whatever the number of texts; every task reads that much.

Defined results: a null text is the empty text; a text without a term in the
band is hashed over all its distinct terms; equal texts, repeated rows among
them, have equal fingerprints; an empty table gives no rows. Columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import words

BUCKETS = 1 << 12
#: Subset k = (bits, value) holds the terms whose hash has that value in the bits kept for
#: that rate: one in 2 ** bits terms of the lexicon. Those of one rate are disjoint.
SUBSETS = ((0, 0), (2, 0), (3, 0), (3, 1), (3, 2), (4, 0), (4, 1), (4, 2), (4, 3), (5, 0), (5, 1), (5, 2), (5, 3), (6, 0), (6, 1))
LEAST = 5
#: Band of document frequency as shares of all documents: idf from 1.6 to 6.2.
LOW, HIGH = 0.002, 0.2
#: Documents of one block of consecutive ids, as a power of two.
BLOCK_BITS = 8


def term_hashes(text: Column) -> Column:
    """64-bit hashes of a text's distinct terms."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> Column:
    """Scalar subquery over a written table: for each bucket the hashes of its terms in
    the band, null where it has none."""
    spark = docs.sparkSession
    text = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = text.agg(F.count(F.lit(1))).scalar()
    found = (text.select(F.explode(term_hashes(F.col("text"))).alias("h"))
             .groupBy("h").agg(F.count(F.lit(1)).alias("df"))
             .filter((F.col("df") >= rows * low) & (F.col("df") <= F.greatest(rows * high, F.lit(1.0))))
             .groupBy(_bucket(F.col("h")).alias("b")).agg(F.collect_list("h").alias("terms")))
    every = spark.range(BUCKETS, numPartitions=8).select(F.col("id").cast("int").alias("b"))
    table = every.join(found, "b", "left").select(F.struct("b", "terms").alias("s"))
    table = table.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["terms"]).alias("lexicon"))
    return materialize(table, "imatch-lexicon").select("lexicon").scalar()


def fingerprint(kept: Column) -> Column:
    """Array of hashes, one for each of ``SUBSETS``, from a text's sorted terms that are in
    the lexicon. The subsets are written out one by one: as a lambda over their numbers
    they would have the optimizer compute ``kept`` anew in each."""
    def subset(k: int) -> Column:
        bits, value = SUBSETS[k]
        if bits == 0:
            return F.xxhash64(kept, F.lit(k))
        # above the bits of the bucket, the rates one after the other
        at, mask = 12 + sum(range(2, bits)), F.lit((1 << bits) - 1).cast("long")
        mine = F.filter(kept, lambda h: F.shiftright(h, at).bitwiseAND(mask) == value)
        return F.transform(F.array(mine), lambda m: F.when(F.size(m) >= LEAST, F.xxhash64(m, F.lit(k))))[0]

    return F.array(*[subset(k) for k in range(len(SUBSETS))])


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with a hash on either side that agree; null of an absent
    fingerprint."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    either = F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull())
    return F.when(a.isNotNull() & b.isNotNull(), F.size(F.filter(same, lambda x: x)) / F.size(F.filter(either, lambda x: x)))


def as_text(fp: Column) -> Column:
    """Hashes in hexadecimal, ``x`` for a subset without one, joined by hyphens."""
    return F.array_join(F.transform(fp, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit("x"))), "-")


def imatch(docs: DataFrame, low: float = LOW, high: float = HIGH, table: Column | None = None) -> DataFrame:
    """doc_id, text and ``fp``, the array of subset hashes; ``table`` is a lexicon made
    before, else that of ``docs``."""
    table = lexicon(docs, low, high) if table is None else table
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return _fingerprinted(base, "text", "fp", table)


def _fingerprinted(df: DataFrame, text: str, fp: str, table: Column) -> DataFrame:
    inside = F.filter("terms", lambda h: F.array_contains(F.get(F.col("table"), _bucket(h)), h))
    df = df.withColumn("terms", term_hashes(F.col(text))).withColumn("table", table).withColumn("inside", inside)
    df = df.withColumn("kept", F.sort_array(F.when(F.size("inside") == 0, F.col("terms")).otherwise(F.col("inside"))))
    return df.withColumn(fp, fingerprint(F.col("kept"))).drop("terms", "table", "inside", "kept")


def successors(keys: DataFrame, span: int) -> DataFrame:
    """Distinct long keys ``k`` with ``next``, the next smaller one (null for the
    least). Keys are not negative and below 2 ** ``span``. The keys are
    ordered within blocks, and the blocks in the same way, so that no task orders
    them all."""
    k = F.col("k")
    near = keys.withColumn("g", F.shiftright(k, BLOCK_BITS)).withColumn(
        "next", F.lead("k").over(Window.partitionBy("g").orderBy(k.desc())))
    if span <= BLOCK_BITS:
        return near.select("k", "next")
    tops = near.groupBy("g").agg(F.max("k").alias("top"))
    after = successors(tops.select(F.col("g").alias("k")), span - BLOCK_BITS)
    bridge = after.join(tops.select(F.col("g").alias("next"), "top"), "next").select(F.col("k").alias("g"), "top")
    return near.join(bridge, "g", "left").select("k", F.coalesce("next", "top").alias("next"))


def with_next(docs: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``next``, a struct of ``cols`` of the next row in descending doc_id
    (null ids last; rows of one id by text); after the last row comes the first.
    Rows travel once, to the block of consecutive ids they belong to; only the
    last row of a block is joined to the first row of the block that follows."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if hi is None:
        lo = hi = 0
    # blocks count from 1; null ids form block 0, below all others
    below = (lo >> BLOCK_BITS) - 1
    block = F.coalesce(F.shiftright(F.col("doc_id"), BLOCK_BITS) - F.lit(below), F.lit(0)).cast("long").alias("block")
    dealt = docs.select("*", block).repartition("block")
    order = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    seen = dealt.withColumn("next", F.lead(F.struct(*cols)).over(order)).withColumn("rank", F.row_number().over(order))
    blocks = docs.select(block.alias("k")).distinct()
    after = successors(blocks, ((hi >> BLOCK_BITS) - below).bit_length())
    first = blocks.agg(F.max("k")).scalar()
    after = after.select(F.col("k").alias("block"), F.coalesce(F.col("next"), first).alias("to"))
    heads = seen.filter("rank = 1").select(F.col("block").alias("to"), F.struct(*cols).alias("head"))
    bridge = after.join(heads, "to").select("block", "head")
    inner = seen.filter(F.col("next").isNotNull()).drop("rank", "block")
    last = (seen.filter(F.col("next").isNull()).join(bridge, "block")
            .withColumn("next", F.col("head")).drop("rank", "block", "head"))
    return inner.unionByName(last)


def edited_fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is
    replaced by the beginning of the next document."""
    n = F.col("n_chars")
    half = F.floor(n / 2).cast("int")
    table = lexicon(docs, low, high)
    pairs = with_next(imatch(docs, table=table), ["text", "fp"]).withColumn("n_chars", F.length("text").cast("long"))
    pairs = pairs.withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), (n - half).cast("int")),
        F.substring(F.col("next.text"), F.lit(1), half)))
    edited = _fingerprinted(pairs, "edited", "edited_fp", table)
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next.fp")).alias("near_next"))
