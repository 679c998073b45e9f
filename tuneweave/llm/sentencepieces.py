"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a batch that are not known yet lie in one flat numpy array of symbols.
A round takes the best (least) pair rank of every segment, merges all its leftmost
non-overlapping occurrences at once, and compacts the arrays; segments without a pair
leave them. A segment is a run of letters in which each two neighbours stand side by
side in some piece of the vocabulary: no merge can cross its borders.

Merging several occurrences in one round is exact as long as no merge makes a pair
that is better than the one being merged, or as good and further left (this happens
where a piece is older than its part). Occurrences after the first such merge wait
for a later round.

Only models of the kind BPE without a normalisation table, user-defined or unused
pieces are accepted; others raise ``ValueError``.

Defined results: a null text is the empty text, whose only id is the end id; equal
and repeated rows are encoded each for itself; an empty table gives no rows;
``doc_id`` may be null; other columns are ignored. Texts are never cut: memory is
bounded by the longest text and by ``SLICE`` letters of new words at a time.
"""

from __future__ import annotations

import codecs
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Letters of new words in one flat array, letters of texts in one output batch.
SLICE, OUT_LETTERS = 1 << 19, 1 << 21
#: Words a worker remembers, and their greatest length; the memo starts anew beyond it.
WORDS, WORD_LENGTH = 500_000, 40
NONE = np.iinfo(np.int64).max
ENCODED = "doc_id long, ids array<int>"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def message_fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message; numbers of fixed
    size come as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


codecs.register_error("byte_by_byte", lambda e: ("�", e.start + 1))


class Memo(dict):
    """Words to their ids; words it does not have are noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> None:
        self.new.append(word)


class Pieces:
    """The tables of a model, and the words a worker has encoded so far."""

    _loaded: dict = {}

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        #: Settings of the message TrainerSpec (field 2) and NormalizerSpec (field 3).
        spec = dict(message_fields(sp.serialized_model_proto()))
        trainer, normal = dict(message_fields(spec[2])), dict(message_fields(spec[3]))
        if trainer.get(3, 1) != 2 or normal.get(2) or trainer.get(24, 0):
            raise ValueError(f"{path}: not a BPE model without normalisation table")
        if trainer.get(31) or any(sp.is_unused(i) for i in range(size)):
            raise ValueError(f"{path}: user-defined or unused pieces")
        self.prefix, self.trim = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        if not normal.get(5, 1) or self.trim:
            raise ValueError(f"{path}: spaces are not kept as {SPACE}")
        self.end = sp.eos_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        plain = {names[i]: i for i in range(size) if not special[i]}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(sp.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError(f"{path}: no byte pieces")

        # symbols: ids of pieces, then letters that are no piece themselves
        letters = sorted(set("".join(plain)))
        symbol = dict(plain)
        for c in letters:
            symbol.setdefault(c, size + len(symbol))
        self.size = size
        self.letters = np.array([ord(c) for c in letters], np.int64)
        self.letter_symbols = np.array([symbol[c] for c in letters], np.int64)
        self.bigrams = np.unique(np.array([ord(a) << 21 | ord(b) for p in plain for a, b in zip(p, p[1:])], np.int64))
        scores = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.width = size + len(symbol) + 1
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    pairs[symbol[p[:k]] * self.width + symbol[p[k:]]] = (rank[sp.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)

        # places where every text can be cut, whatever its letters
        inner = any(b == SPACE != a for p in plain for a, b in zip(p, p[1:]))
        lines = any("\n" in p and len(p) > 1 for p in plain)
        stop = SPACE if lines else SPACE + "\n"
        self.words = None if inner else re.compile(f"{SPACE}+[^{stop}]*|\n|[^{stop}]+")
        self.known = Memo()

        # decoding
        self.bytes_of = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i)
                         else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i)
                         else names[i].replace(SPACE, " ").encode() for i in range(size)]
        self.control = np.array([sp.is_control(i) for i in range(size)])
        self.spaced = np.array([n in plain and n.startswith(SPACE) for n in names])

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    # ------------------------------------------------------------ merge rounds
    def _lookup(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        """Rank of each pair (NONE where it is none) and its place in the table."""
        key = np.where(joined & (left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def _before_a_better_pair(self, c, sym, seg, best, where):
        """The occurrences ``c`` that can merge in one round: in each segment those up
        to the first whose merge makes a pair that comes before the others."""
        more = np.append(seg[c][1:] == seg[c][:-1], False)
        if not more.any():
            return c
        new = self.merged[where[c]]
        beside = np.append(False, np.diff(c) == 2)  # the left neighbour is merged already
        before, after = np.maximum(c - 1, 0), np.minimum(c + 2, len(sym) - 1)
        left = np.where(beside, np.append(0, new[:-1]), sym[before])
        made_left, _ = self._lookup(left, new, more & (c > 0) & (seg[before] == seg[c]))
        made_right, _ = self._lookup(new, sym[after], more & (c + 2 < len(sym)) & (seg[after] == seg[c]))
        better = (np.minimum(made_left, made_right) <= best[c]).astype(np.int64)
        total = np.cumsum(better) - better
        opening = np.append(True, seg[c][1:] != seg[c][:-1])
        return c[total == np.maximum.accumulate(np.where(opening, total, 0))]

    def merge(self, words: list[str]) -> list[bytes]:
        """32-bit ids of each word, by merge rounds over one flat array."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        starts = np.zeros(len(code) + 1, bool)
        ends = np.cumsum([len(w) for w in words])
        starts[0] = True
        starts[ends] = True
        at = np.minimum(np.searchsorted(self.letters, code), len(self.letters) - 1)
        first = np.where(self.letters[at] == code, self.letter_symbols[at], -1)
        two = code[:-1] << 21 | code[1:]
        near = np.minimum(np.searchsorted(self.bigrams, two), len(self.bigrams) - 1)
        starts[1:-1] |= self.bigrams[near] != two
        sym, seg, place = first, np.cumsum(starts[:-1]) - 1, np.arange(len(code))
        done_sym, done_place = [], []
        rank, where = self._lookup(sym, np.append(sym[1:], -1), np.append(seg[1:] == seg[:-1], False))
        while len(sym):
            head = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(sym))))
            finished = best == NONE
            if finished.any():
                done_sym.append(sym[finished])
                done_place.append(place[finished])
                live = ~finished
                sym, seg, place, rank, where, best = (x[live] for x in (sym, seg, place, rank, where, best))
                if not len(sym):
                    break
            c = np.flatnonzero(rank == best)
            # every other one of a run of overlapping occurrences, from its left end
            run = np.append(True, np.diff(c) != 1)
            order = np.arange(len(c))
            c = c[(order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0]
            c = self._before_a_better_pair(c, sym, seg, best, where)
            sym[c] = self.merged[where[c]]
            stay = np.ones(len(sym), bool)
            stay[c + 1] = False
            at = c - np.arange(len(c))  # where the merged symbols come to lie
            sym, seg, place, rank, where = sym[stay], seg[stay], place[stay], rank[stay], where[stay]
            changed = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(changed + 1, len(sym) - 1)
            joined = (seg[after] == seg[changed]) & (after > changed)
            rank[changed], where[changed] = self._lookup(sym[changed], sym[after], joined)
        place = np.concatenate(done_place) if done_place else np.zeros(0, np.int64)
        sym = np.concatenate(done_sym) if done_sym else place
        order = np.argsort(place, kind="stable")
        place, sym = place[order], sym[order]
        ids = sym.astype(np.int32)
        unknown = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(unknown):  # letters that are no piece, by their bytes
            letters, which = np.unique(code[place[unknown]], return_inverse=True)
            spelt = [self.byte_ids[list(chr(x).encode())] for x in letters.tolist()]
            count = np.ones(len(ids), np.int64)
            count[unknown] = np.array([len(s) for s in spelt])[which]
            to = np.cumsum(count) - count
            wide = np.repeat(ids, count)
            for k, s in enumerate(spelt):
                for j, b in enumerate(s):
                    wide[to[unknown[which == k]] + j] = b
            ids, place = wide, np.repeat(place, count)
        data = ids.tobytes()
        cuts = [0, *(4 * np.searchsorted(place, ends)).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    # ------------------------------------------------------------ texts
    def _learn(self, new: list[str]) -> None:
        at = 0
        while at < len(new):
            some, letters = [], 0
            while at < len(new) and (not some or letters + len(new[at]) <= SLICE):
                some.append(new[at])
                letters += len(new[at])
                at += 1
            self.known.update(zip(some, self.merge(some)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """32-bit ids of whole texts, without the end id."""
        lead = SPACE if self.prefix else ""
        split = []
        for t in texts:
            t = lead + t.replace(" ", SPACE) if t else ""
            split.append(self.words.findall(t) if self.words else [t] if t else [])
        known = self.known
        if len(known) > WORDS:
            known.clear()
        found, open_ = [], []
        for i, ws in enumerate(split):
            before = len(known.new)
            found.append(list(map(known.__getitem__, ws)))
            if len(known.new) > before:
                open_.append(i)
        self._learn(list(set(known.new)))
        for i in open_:
            found[i] = list(map(known.__getitem__, split[i]))
        for w in known.new:
            if len(w) > WORD_LENGTH:
                known.pop(w, None)
        known.new.clear()
        return list(map(b"".join, found))

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int32)
        cuts = np.flatnonzero(self.control[ids])  # no letter is spelt in bytes across a control id
        table = self.bytes_of.__getitem__
        text = "".join(b"".join(map(table, run.tolist())).decode("utf-8", "byte_by_byte")
                       for run in (np.split(ids, cuts) if len(cuts) else [ids]) if len(run))
        if self.prefix:  # the space that encoding puts before a text
            visible = np.flatnonzero(~self.control[ids[:len(cuts) + 1]])
            if len(visible) and self.spaced[ids[visible[0]]]:
                text = text[1:]
        return text


def _slices(lengths: list[int]):
    """(start, end) of runs of rows of about OUT_LETTERS letters."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > OUT_LETTERS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def _encoded(batches, path: str, decoded: bool):
    pieces = Pieces.of(path)
    end = np.array([pieces.end], np.int32).tobytes()
    for batch in batches:
        docs, texts = batch.column(0), batch.column(1)
        for a, b in _slices([n or 0 for n in pc.utf8_length(texts).to_pylist()]):
            flat = [data + end for data in pieces.encode(texts.slice(a, b - a).to_pylist())]
            offsets = np.append(0, np.cumsum([len(d) // 4 for d in flat])).astype(np.int32)
            values = np.frombuffer(b"".join(flat), np.int32)
            out = [docs.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
            names = ["doc_id", "ids"]
            if decoded:
                out.append(pa.array([pieces.decode(np.frombuffer(d, np.int32)) for d in flat], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(out, names=names)


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id and the ids of the whole text, end id included; with ``decoded`` also
    the text that these ids decode to."""
    path = path or model_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: _encoded(batches, path, decoded),
                           ENCODED + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of an array of ids (null ids: null text)."""
    path = path or model_path()

    def texts(batches):
        pieces = Pieces.of(path)
        for batch in batches:
            out = [None if ids is None else pieces.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(texts, "doc_id long, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of :func:`encode` with ``decoded``."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
