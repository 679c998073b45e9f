"""Power-of-two packing of documents into training sequences.

A document's token ids, closed by an end id, are cut into pieces whose lengths
are powers of two: as many of ``MAX_LEN`` as fit, then the binary digits of the
rest, largest first. Pieces of one length form a bucket, and each piece is a
sequence of its bucket, so no sequence crosses documents and none is padded. No
row leaves its task: there is no shuffle and no state besides a word memo.

Defined results: a null or empty text is the single end id; repeated rows are
packed each for itself; an empty table gives no rows; ``doc_id`` may be null.
Other columns are ignored.
"""

from __future__ import annotations

import gc
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEN = 2048
END_ID = 1
#: Documents that are encoded together.
BATCH = 512
#: Words, and parts of words, whose ids a worker remembers (about 0.4 GB at most);
#: a memo starts anew beyond it.
WORDS, KNOWN_PARTS = 600_000, 1_000_000
#: Parts of words that the tokenizer gets at a time.
JOINED = 20_000
SEPARATORS = re.compile("[\x1c-\x1f]")
#: How the tokenizer cuts a word (fixed values of its file).
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WHOLE = re.compile("[^\x00-\xff]|[\x1c-\x1f]|<\\|")
PIECE = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memo(dict):
    """Words to ids; words it does not have are noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> None:
        self.new.append(word)


def _lowered(text: str) -> str:
    """The text in small letters, if it has Latin-1 letters only; letters beyond are left
    to the tokenizer's own rules."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordIds:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and
    cuts words by ``PARTS``, as little-endian 32-bit bytes. No token of such a
    tokenizer spans two parts, so a text's ids are those of its parts in turn, and
    each distinct part is encoded once. Words with letters beyond Latin-1, where
    the tokenizer may also recompose or fold letters, go to it whole."""

    _loaded: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closing = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words = Memo()
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "WordIds":
        if path not in cls._loaded:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _learn_each(self, parts: list[str]) -> None:
        for at in range(0, len(parts), JOINED):
            some = parts[at:at + JOINED]
            for part, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.parts[part] = np.array(e.ids, "<u4").tobytes()

    def _learn_parts(self, parts: list[str]) -> None:
        """Ids of parts that the tokenizer does not cut further, all in one text: each
        ends with a token that closes a word. Where that does not hold, one by one."""
        ids = np.array(self.tokenizer.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(parts) or len(ids) != ends[-1]:
            return self._learn_each(parts)
        data, cuts = ids.tobytes(), (4 * ends).tolist()
        self.parts.update(zip(parts, (data[a:b] for a, b in zip([0, *cuts], cuts))))

    def _learn(self, new: set[str]) -> None:
        whole = [w for w in new if WHOLE.search(w)]
        rest = new.difference(whole)
        plain = [w for w in rest if w.isalpha()]
        mixed = {w: PARTS.findall(w.lower()) for w in rest.difference(plain)}
        lower = [w.lower() for w in plain]
        missing = list(set(lower).union(*mixed.values()).difference(self.parts))
        for at in range(0, len(missing), JOINED):
            self._learn_parts(missing[at:at + JOINED])
        self._learn_each([w for w in whole if w not in self.parts])
        mixed |= {w: [w] for w in whole}
        known = self.parts.__getitem__
        self.words.update(zip(plain, map(known, lower)))
        for w, parts in mixed.items():
            self.words[w] = b"".join(map(known, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        # words that differ in case have the same ids: one entry of the memo for all
        texts = [_lowered(t) for t in texts]
        # U+001C to U+001F are white space to split(), but not to the tokenizer
        split = [re.split("[ \t\n\x0b\x0c\r]+", t) if SEPARATORS.search(t) else t.split() for t in texts]
        for memo, most in ((self.words, WORDS), (self.parts, KNOWN_PARTS)):
            if len(memo) > most:
                memo.clear()
        known, new = self.words.__getitem__, self.words.new
        found, open_ = [], []
        for i, ws in enumerate(split):
            before = len(new)
            found.append(list(map(known, ws)))
            if len(new) > before:
                open_.append(i)
        self._learn(set(new))
        new.clear()
        for i in open_:
            found[i] = list(map(known, split[i]))
        return [b"".join(ids) for ids in found]


def lengths(n: int, most: int = MAX_LEN) -> list[int]:
    """Binary piece lengths of a document of n tokens, largest first."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def _rows(batches, path: str, with_ids: bool, keep_memo: bool, schema: pa.Schema):
    words = WordIds.of(path)
    end = np.array([END_ID], "<u4").tobytes()
    gc.disable()  # the memos hold millions of strings and no cycles
    try:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, BATCH):
                part = ids.slice(at, BATCH).to_pylist()
                out: list[list] = [[] for _ in schema]
                docs, starts, sizes, pieces, sums, totals = out
                for doc, data in zip(part, words.encode(texts.slice(at, BATCH).to_pylist())):
                    data += end
                    total = len(data) // 4
                    cut = lengths(total)
                    bounds = [0, *itertools.accumulate(cut)]
                    found = [data[4 * a:4 * b] for a, b in zip(bounds, bounds[1:])]
                    docs += [doc] * len(cut)
                    starts += bounds[:-1]
                    sizes += cut
                    pieces += found if with_ids else [None] * len(cut)
                    sums += map(zlib.crc32, found)
                    totals += [total] * len(cut)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
    finally:
        gc.enable()
        if not keep_memo:
            WordIds._loaded.pop(path, None)


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = True, keep_memo: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit, null
    unless ``with_ids``), ids_crc32, doc_tokens, sequence_id, offset and bucket.
    Workers hand their word memo on from task to task with ``keep_memo``."""
    path = path or tokenizer_path()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        lambda batches: _rows(batches, path, with_ids, keep_memo, schema), PIECE)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                         F.col("length").alias("bucket"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
