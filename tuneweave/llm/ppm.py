"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes long, pretrained on the
training documents. A byte's probability comes from the longest context in which
it was seen; each longer context is escaped with its distinct followers as the
escape count (method C), and bytes that a longer context would have predicted are
excluded from the shorter one. Below order 0 the bytes never seen share the rest.
A text's score is the sum over its bytes and a closing end byte. A word unigram
model with add-one smoothing gives the base score.

How it runs: tasks gather the distinct (context, byte) strings and words of their
blocks of documents with training counts. Counts are added up by key, probabilities
are worked out for all strings that share their last two context bytes, and
every block gets back the values of its own keys by a join, where its texts are
scored. Nothing but orders 0 and 1 (at most 256 * 256 counts) is broadcast, so the
model may grow with the corpus. A block is a run of rows of one input split, of about
BLOCK_BYTES of text at the mean size of a text; beside its texts a task holds their
distinct words and strings, and the work on PIECE bytes or one text.

Defined results: a null text is empty and has its end only; a null doc_id counts
as the empty text in the split rule; without training rows every byte has
probability 1/256; repeated rows are scored each for itself; an empty table gives
no rows. Words are keyed by 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import LOWER, text_bytes

#: Longest context in bytes, and bytes that are worked on at a time.
ORDER, PIECE = 4, 1_000_000
#: Text of a block.
BLOCK_BYTES = 32 * 1024 * 1024
WORD, GRAM = 0, 1
END_WORD = b"\x00end"
SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")


def grams(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte after the first four of each segment, with the four bytes before
    it, as one number; and where each segment's numbers begin."""
    x = np.frombuffer(b"".join(segments), np.uint8)
    g = x[:-ORDER].astype(np.int64)
    for k in range(1, ORDER + 1):
        g <<= 8
        g |= x[k:len(x) - ORDER + k]
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    own = np.ones(len(x), bool)
    for k in range(ORDER):
        own[ends - sizes + k] = False
    return g[own[ORDER:]], np.concatenate([[0], np.cumsum(sizes - ORDER)[:-1]])


def pieces(texts: list[bytes]):
    """(text numbers, segments) of about PIECE bytes; long texts are cut, and each
    part begins with the four bytes before it."""
    owner, segments, size = [], [], 0
    for k, t in enumerate(texts):
        data = b"\0" * ORDER + t + b"\0"
        for at in range(0, len(data) - ORDER, PIECE):
            part = data[at:at + PIECE + ORDER]
            owner.append(k)
            segments.append(part)
            size += len(part)
            if size >= PIECE:
                yield owner, segments
                owner, segments, size = [], [], 0
    if segments:
        yield owner, segments


def _counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, segments in pieces(texts):
        k, c = np.unique(grams(segments)[0], return_counts=True)
        keys, counts = _merged(np.concatenate([keys, k]), np.concatenate([counts, c]))
    return keys, counts


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")  # two sorted runs: one merge
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.diff(keys, prepend=keys[:1] - 1))[0]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _lowered(texts) -> list[bytes]:
    """Small-letter bytes of an Arrow column of texts."""
    return [text_bytes(t.as_py()).translate(LOWER) for t in texts.cast(pa.binary())]


def _key_rows(batches, schema: pa.Schema):
    """(block, kind, key, training count) of the keys of each block. The rows of a block
    follow each other, in one batch or in several."""
    open_, words, others, keys, counts = None, Counter(), set(), *_counted([])

    def ended():
        rest = others.difference(words)
        wk = np.array([*map(word_key, words), *map(word_key, rest)], np.int64)
        wc = np.array([*words.values(), *([0] * len(rest))], np.int64)
        kind = np.repeat(np.array([WORD, GRAM], np.int8), [len(wk), len(keys)])
        all_keys, all_counts = np.concatenate([wk, keys]), np.concatenate([wc, counts])
        for at in range(0, len(kind), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(kind[part]), open_), pa.int64()), pa.array(kind[part], pa.int8()),
                 pa.array(all_keys[part]), pa.array(all_counts[part])], schema=schema)

    for batch in batches:
        blocks, held = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8())) > 0
        for block in np.unique(blocks):
            if open_ is not None and block != open_:
                yield from ended()
                words, others, keys, counts = Counter(), set(), *_counted([])
            open_ = block
            own = batch.column(2).filter(pa.array(blocks == block))
            texts, out = _lowered(own), held[blocks == block]
            train = [t for t, h in zip(texts, out) if not h]
            rest = [t for t, h in zip(texts, out) if h]
            for t in train:
                words.update(t.split())
            words[END_WORD] += len(train)
            for t in rest:
                others.update(t.split())
            k1, c1 = _counted(train)
            k0, c0 = _counted(rest)
            keys, counts = _merged(np.concatenate([keys, k1]), np.concatenate([counts, c1]))
            keys, counts = _merged(np.concatenate([keys, k0]), np.concatenate([counts, 0 * c0]))
    if open_ is not None:
        yield from ended()


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted keys in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Level:
    """Counts of one order: c(context, byte) by key, and by context the total, the
    number of followers and the total of the same followers one order below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, below: "Level | None"):
        self.width = order + 1  # bytes of a key: the context and the byte
        self.keys, self.counts = _merged(keys & ((1 << 8 * self.width) - 1), counts)
        self.below = below
        contexts = self.keys >> 8
        first = np.nonzero(np.diff(contexts, prepend=contexts[:1] - 1))[0]
        self.contexts = contexts[first]
        self.total = np.add.reduceat(self.counts, first) if len(first) else self.counts
        self.followers = np.diff(np.append(first, len(contexts)))
        if below is not None:
            mask = (1 << 8 * below.width) - 1
            at, _ = _find(below.keys, self.keys & mask)
            lower = below.counts[at] if len(self.keys) else self.counts
            self.covered = np.add.reduceat(lower, first) if len(first) else lower


def log_probabilities(levels: list[Level], wanted: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each string in its context; ``levels``
    from the longest context down to none."""
    out = np.zeros(len(wanted))
    open_ = np.ones(len(wanted), bool)
    covered = np.zeros(len(wanted), np.int64)
    known = np.zeros(len(wanted), np.int64)
    for level in levels:
        key = wanted & ((1 << 8 * level.width) - 1)
        at, there = _find(level.contexts, key >> 8)
        if len(level.contexts) == 0:
            continue
        total = np.where(there, level.total[at] - covered, 0)
        followers = np.where(there, level.followers[at] - known, 0)
        place, seen = _find(level.keys, key)
        use = open_ & (followers > 0)
        hit = use & seen
        out[hit] += np.log10(level.counts[place[hit]] / (total[hit] + followers[hit]))
        open_ &= ~hit
        escape = use & ~hit
        out[escape] += np.log10(followers[escape] / (total[escape] + followers[escape]))
        known = np.where(there, level.followers[at], known)
        if level.below is not None:
            covered = np.where(there, level.covered[at], 0)
    out[open_] -= np.log10(np.maximum(256 - known[open_], 1))
    return out


def low_levels(pair_keys: np.ndarray, pair_counts: np.ndarray) -> tuple[Level, Level]:
    """Orders 1 and 0 from counts of byte pairs."""
    none = Level(pair_keys, pair_counts, 0, None)
    return Level(pair_keys, pair_counts, 1, none), none


def probabilities_of(keys: np.ndarray, counts: np.ndarray, one: Level, none: Level) -> np.ndarray:
    """Of all strings that share their last two context bytes."""
    train = counts > 0
    two = Level(keys[train], counts[train], 2, one)
    three = Level(keys[train], counts[train], 3, two)
    four = Level(keys[train], counts[train], 4, three)
    return log_probabilities([four, three, two, one, none], keys)


def _score_block(docs: pa.Table, values: pa.Table) -> pa.Table:
    kind, key, value = (np.asarray(values[c].combine_chunks()) for c in ("kind", "key", "value"))
    words, strings = kind == WORD, kind == GRAM
    wo, go = np.argsort(key[words]), np.argsort(key[strings])
    wk, wv = key[words][wo], value[words][wo]
    gk, gv = key[strings][go], value[strings][go]
    n = docs.num_rows
    texts = _lowered(docs["text"])
    count: dict[bytes, float] = {}
    n_tokens, n_known, logs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for k, t in enumerate(texts):
        ws = [*t.split(), END_WORD]
        new = list(set(ws).difference(count))
        if new:
            at, there = _find(wk, np.fromiter(map(word_key, new), np.int64, len(new)))
            if not there.all():
                raise ValueError("a word of this block has no count: the input must not change between reads")
            count.update(zip(new, wv[at].tolist()))
        c = np.fromiter(map(count.__getitem__, ws), float, len(ws))
        n_tokens[k], n_known[k], logs[k] = len(ws), np.count_nonzero(c), np.log10(c + 1).sum()
    score = np.zeros(n)
    for owner, segments in pieces(texts):
        g, starts = grams(segments)
        order = np.argsort(g)
        ranked = g[order]
        first = np.nonzero(np.diff(ranked, prepend=ranked[:1] - 1))[0]
        at, there = _find(gk, ranked[first])
        if not there.all():
            raise ValueError("a string of this block has no value: the input must not change between reads")
        each = np.empty(len(g))
        each[order] = np.repeat(gv[at], np.diff(np.append(first, len(g))))
        np.add.at(score, owner, np.add.reduceat(each, starts))
    return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": n_tokens, "n_known": n_known,
                     "logs": logs, "score": score})


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of
    every document. ``docs`` must be a table: its splits are read twice."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    rows_of_block = max(BLOCK_BYTES * size[1] // max(size[0], 1), 1)
    place = F.monotonically_increasing_id()  # the split above bit 33, its row below
    block = place - F.pmod(place.bitwiseAND((1 << 33) - 1), F.lit(rows_of_block))
    rows = docs.select(block.alias("block"), held_out.alias("held_out"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])
    keys = materialize(rows.select("block", "held_out", "text").mapInArrow(
        lambda batches: _key_rows(batches, schema), "block bigint, kind tinyint, key bigint, n bigint"), "ppm-keys")
    sums = materialize(keys.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")
    words = sums.filter(F.col("kind") == WORD)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    pair = F.col("key").bitwiseAND(0xFFFF)
    pairs = (sums.filter((F.col("kind") == GRAM) & (F.col("n") > 0)).groupBy(pair.alias("pair")).agg(F.sum("n").alias("n"))
             .toArrow())  # at most 256 * 256 rows
    low = spark.sparkContext.broadcast((np.asarray(pairs["pair"]), np.asarray(pairs["n"])))

    def values_of(table: pa.Table) -> pa.Table:
        one, none = low_levels(*low.value)
        k, c = np.asarray(table["key"].combine_chunks()), np.asarray(table["n"].combine_chunks())
        return pa.table({"key": k, "value": probabilities_of(k, c, one, none)})

    strings = (sums.filter(F.col("kind") == GRAM)
               .select("key", "n", F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("suffix"))
               .groupBy("suffix").applyInArrow(values_of, "key bigint, value double")
               .select(F.lit(GRAM).cast("tinyint").alias("kind"), "key", "value"))
    values = words.select("kind", "key", F.col("n").cast("double").alias("value")).unionByName(strings)
    given = keys.select("block", "kind", "key").join(values, ["kind", "key"])
    scored = rows.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_score_block, SCORED)
    log_all = F.log10(F.lit(float(total[0] + total[1] + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total[0])).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * log_all).alias("base_score"), "score")
