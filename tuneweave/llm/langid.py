"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary that have
at most ``LONGEST`` letters. A word's probability is the sum over all its segmentations
into such pieces, by the forward algorithm; words of more than ``LONG_WORD`` letters are
cut into stretches of that length, each summed on its own. A text's is the product over
its words. The probabilities are
learnt from the words of each language by expectation maximisation, in which the
same forward sums, and their backward counterparts, give expected piece counts.

Words are runs of letters and the marks that follow them (Unicode categories L and M) in
lower case. Defined results: a text that is null or
has no letter is ``und`` with score 0, as is every text if nothing could be learnt;
repeated rows get the same row; an empty table gives no rows. ``lang`` is read
from training rows only; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ASCII_WORD = re.compile("[a-z]+")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Longest piece tried, rounds of expectation maximisation, pseudo-count of a piece.
LONGEST, ROUNDS, PSEUDO = 12, 2, 0.05
#: Words are cut into stretches of at most so many letters.
LONG_WORD = 24
#: Logarithm of the probability of a letter that is in no piece.
UNKNOWN = -18.0
MEMO = 400_000
UND = "und"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of the vocabulary, found in many words at once: substrings are
    compared by 64-bit polynomial hashes."""

    _loaded: dict = {}
    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = {model.id_to_piece(i): i for i in range(self.size)
                       if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.pieces = {p: i for p, i in self.pieces.items() if len(p) <= LONGEST}
        #: rows of the probabilities beside the pieces: a letter without a piece, nothing
        self.unknown, self.none = self.size, self.size + 1
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array(list(self.pieces.values()), np.int32)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    @classmethod
    def of(cls, path: str) -> "Vocabulary":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self._BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: (start, end) to the piece of each word there,
        where any word has one."""
        n = len(words[0])
        codes = np.array(words, f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        out, h = {}, None
        for length in range(1, min(LONGEST, n) + 1):
            h = codes if h is None else h[:, :-1] * self._BASE + codes[:, length - 1:]
            hit = self.maybe[h >> np.uint64(44)]
            found = np.full(h.shape, self.none if length > 1 else self.unknown, np.int32)
            some = h[hit]
            at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
            found[hit] = np.where(self.hashes[at] == some, self.ids[at], found[hit])
            for start in np.nonzero((found != self.none).any(0))[0]:
                out[int(start), int(start) + length] = found[:, start]
        return out


def text_words(text: str) -> list[str]:
    """Words of a text in lower case."""
    return (ASCII_WORD if text.isascii() else WORD).findall(text.lower())


def stretches(word: str) -> list[str]:
    word = "▁" + word
    return [word[i:i + LONG_WORD] for i in range(0, len(word), LONG_WORD)]


def forward(lattice: dict, n: int, count: int, p: np.ndarray, none: int) -> np.ndarray:
    """Sums over all segmentations of each prefix of ``count`` words of length n;
    p[piece] holds one probability for each language."""
    a = np.zeros((n + 1, count, p.shape[1]))
    a[0] = 1.0
    for (start, end), ids in sorted(lattice.items(), key=lambda x: x[0][1]):
        rows = np.nonzero(ids != none)[0]
        if len(rows) == count:
            a[end] += a[start] * p[ids]
        else:
            a[end, rows] += a[start, rows] * p[ids[rows]]
    return a


def expected(lattice: dict, n: int, weight: np.ndarray, p: np.ndarray, none: int, total: np.ndarray) -> None:
    """Adds the expected piece counts of words of length n, each ``weight`` times,
    to ``total``; p has one column."""
    a = forward(lattice, n, len(weight), p, none)
    b = np.zeros_like(a)
    b[n] = 1.0
    share = weight / a[n, :, 0]
    for (start, end), ids in sorted(lattice.items(), key=lambda x: -x[0][1]):
        rows = np.nonzero(ids != none)[0]
        part = p[ids[rows]] * b[end, rows]
        b[start, rows] += part
        np.add.at(total, ids[rows], a[start, rows, 0] * part[:, 0] * share[rows])


def by_length(parts: list[str], most: int = 20_000):
    """Indexes of strings of one length, in blocks."""
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    at = 0
    while at < len(order):
        n, end = len(parts[order[at]]), at
        while end < len(order) and end - at < most and len(parts[order[end]]) == n:
            end += 1
        yield n, order[at:end]
        at = end


def _word_rows(batches, schema: pa.Schema):
    """(lang, word, n) of a task's texts, counted within each batch."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0), batch.column(1)):
            counts.setdefault(lang.as_py(), Counter()).update(text_words(text.as_py()))
        for lang, words in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()),
                 pa.array(list(words.values()), pa.int64())], schema=schema)


def word_counts(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    rows = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(lambda batches: _word_rows(batches, schema), "lang string, word string, n long").groupBy(
        "lang", "word").agg(F.sum("n").alias("n"))


def _expected_rows(batches, path: str, langs: list[str], p: np.ndarray, schema: pa.Schema):
    v = Vocabulary.of(path)
    total = np.zeros((len(langs), v.size + 2))
    column = {x: i for i, x in enumerate(langs)}
    for batch in batches:
        parts: dict[int, tuple[list, list]] = {}
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            texts, counts = parts.setdefault(column[lang], ([], []))
            for x in stretches(word):
                texts.append(x)
                counts.append(n)
        for k, (texts, counts) in parts.items():
            weight = np.array(counts, float)
            for n, rows in by_length(texts):
                expected(v.lattice([texts[i] for i in rows]), n, weight[rows], p[:, k:k + 1], v.none, total[k])
    k, i = np.nonzero(total[:, :v.size])
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(total[k, i])], schema=schema)


def _probabilities(v: Vocabulary, counts: np.ndarray) -> np.ndarray:
    """Probabilities of all pieces from their counts, of an unknown letter, and 0."""
    p = np.zeros((v.size + 2, counts.shape[1]))
    pieces = sorted(v.pieces.values())
    p[pieces] = counts[pieces] + PSEUDO
    p /= p.sum(0)
    p[v.unknown] = math.exp(UNKNOWN)
    return p


def learn(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities, (pieces + 1) x languages: what is
    collected is bounded by the vocabulary and the number of languages."""
    path = path or vocabulary_path()
    vocabulary = Vocabulary.of(path)
    counts = materialize(word_counts(docs), "langid-words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    length = np.full(vocabulary.size, np.inf)
    for piece, i in vocabulary.pieces.items():
        length[i] = len(piece)
    # before any count: longer pieces are rarer, as in a uniform choice of letters
    p = _probabilities(vocabulary, np.repeat(1e6 * (30.0 ** -length)[:, None], max(1, len(langs)), 1))
    schema = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("x", pa.float64())])
    for _ in range(rounds if langs else 0):
        now = p
        sums = counts.mapInArrow(lambda batches: _expected_rows(batches, path, langs, now, schema),
                                 "lang int, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x"))
        table = sums.toArrow()
        c = np.zeros((vocabulary.size, len(langs)))
        c[np.asarray(table["piece"]), np.asarray(table["lang"])] = np.asarray(table["x"])
        p = _probabilities(vocabulary, c)
    return langs, p


class Scorer:
    """Log probabilities of words for all languages at once, with a memo."""

    def __init__(self, path: str, p: np.ndarray):
        self.vocabulary, self.p = Vocabulary.of(path), p
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((0, p.shape[1]))

    def _learn(self, new: list[str]) -> None:
        v = self.vocabulary
        parts, owner = [], []
        for k, w in enumerate(new):
            for x in stretches(w):
                parts.append(x)
                owner.append(k)
        logs, owner = np.zeros((len(new), self.p.shape[1])), np.array(owner)
        for n, rows in by_length(parts):
            last = forward(v.lattice([parts[i] for i in rows]), n, len(rows), self.p, v.none)[n]
            np.add.at(logs, owner[rows], np.log(np.maximum(last, 1e-300)))
        base = len(self.rows)
        self.rows.update(zip(new, range(base, base + len(new))))
        self.logs = np.concatenate([self.logs, logs])

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log probability of each text by language; None without a letter."""
        if len(self.rows) > MEMO:
            self.rows, self.logs = {}, self.logs[:0]
        words = [text_words(t) if t else [] for t in texts]
        self._learn(list(set().union(*words).difference(self.rows)))
        row = self.rows.__getitem__
        return [self.logs[np.fromiter(map(row, ws), np.int64, len(ws))].sum(0) if ws else None for ws in words]


def _predict_rows(batches, path: str, langs: list[str], model, schema: pa.Schema):
    scorer = Scorer(path, model.value)
    for batch in batches:
        names, scores = [], []
        texts = batch.column(2)
        blocks = (scorer.texts(texts.slice(at, 2000).to_pylist()) for at in range(0, batch.num_rows, 2000))
        for x in itertools.chain.from_iterable(blocks):
            if x is None or not langs:
                names.append(UND)
                scores.append(0.0)
            else:
                k = int(x.argmax())
                names.append(langs[k])
                scores.append(float(1.0 / np.exp(x - x[k]).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores)], schema=schema)


def identify(docs: DataFrame, held_out, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (probability of that language among
    the learnt ones) of every document."""
    path = path or vocabulary_path()
    langs, p = learn(docs.withColumn("lang_held_out", held_out).filter("not lang_held_out"), path)
    model = docs.sparkSession.sparkContext.broadcast(p)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(lambda batches: _predict_rows(batches, path, langs, model, schema),
                           "doc_id long, held_out boolean, lang_pred string, score double")
