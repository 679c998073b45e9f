"""Text to token ids (T1, T5, T6) and the plug-in tokenizer surface.

Two tokenizers are offered:

* the **vocabulary job** (default): words are whitespace pieces, counted over
  the corpus with map-side partial aggregation and numbered most frequent first
  with the distributed dense index. Ids come back by a **block-local dictionary
  join**, the same plan for a vocabulary of any size: rows are dealt to blocks of
  about ``BLOCK_BYTES`` of text, each block lists its distinct words once, the
  (block, word) pairs are joined to the vocabulary table, and rows and dictionary
  meet again by a cogroup on the block. A word travels once per block, not once per
  occurrence, so the most frequent word is no hot key, no vocabulary is ever
  collected or broadcast by hand, and nothing is regrouped per row;
* a **plug-in** (E1): any tokenizer object built once per Python worker by a
  picklable factory and applied in an Arrow-batched iterator ``pandas_udf``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import pad_clip, real_token_mask
from ..functions.specials import (ENDOFTEXT, FIRST_WORD_ID, INLINE_SPECIALS, PAD_ID,
                                  SPECIAL_IDS, UNK_ID, WORD_SPLIT)
from ..session import shuffle_partitions
from .order import dense_index

#: Text of one dictionary block; a longer text is a block's text by itself.
BLOCK_BYTES = 32 * 1024 * 1024
#: Distinct words that a task counts before it hands them on, and rows of an Arrow batch.
COUNTED_WORDS, BATCH_ROWS = 500_000, 100_000
_PY_SPLIT = re.compile(WORD_SPLIT)
_BYTE_SPLIT = re.compile(WORD_SPLIT.encode())


def isolate_specials(text: Column) -> Column:
    """Surround inline special tokens with spaces so they split as words."""
    for s in INLINE_SPECIALS:
        text = F.replace(text, F.lit(s), F.lit(f" {s} "))
    return text


def words(text: Column) -> Column:
    """Whitespace words of a text column (empty pieces removed)."""
    return F.filter(F.split(isolate_specials(text), WORD_SPLIT), lambda w: w != F.lit(""))


def py_words(text: str) -> list[str]:
    """The same split in Python, for literals (templates, system messages)."""
    for s in INLINE_SPECIALS:
        text = text.replace(s, f" {s} ")
    return [w for w in _PY_SPLIT.split(text) if w]


def byte_words(text: bytes) -> list[bytes]:
    """The same split of a UTF-8 text."""
    if b"<|" in text:
        for s in INLINE_SPECIALS:
            text = text.replace(s.encode(), f" {s} ".encode())
    # split() of bytes cuts at a vertical tab too, and at nothing else beside WORD_SPLIT
    return [w for w in _BYTE_SPLIT.split(text) if w] if b"\v" in text else text.split()


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, number) of the texts in all columns; a word may come several times."""
    counts: Counter = Counter()

    def counted():
        words, numbers = list(counts), list(counts.values())
        for at in range(0, len(words), BATCH_ROWS):
            part = slice(at, at + BATCH_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(words[part], pa.binary()).cast(pa.string()),
                                              pa.array(numbers[part], pa.int64())], names=["word", "n"])

    for batch in batches:
        for column in batch.columns:
            for text in column.cast(pa.binary()):
                if text.is_valid:
                    counts.update(byte_words(text.as_py()))
                    if len(counts) >= COUNTED_WORDS:
                        yield from counted()
                        counts.clear()
    yield from counted()


@dataclass
class Vocabulary:
    """Materialised vocabulary table ``(word, n, token_id)``."""

    table: DataFrame
    size: int

    def ids_for(self, text: str) -> list[int]:
        """Ids of a short literal text (template pieces, system messages).
        Only the literal's own words are fetched: bounded by its length."""
        ws = py_words(text)
        plain = sorted({w for w in ws if w not in SPECIAL_IDS})
        found = {}
        if plain:
            found = {r["word"]: r["token_id"] for r in
                     self.table.filter(F.col("word").isin(plain)).select("word", "token_id").collect()}
        return [SPECIAL_IDS.get(w, found.get(w, UNK_ID)) for w in ws]


def build_vocabulary(texts: Sequence[Column] | Column, df: DataFrame) -> Vocabulary:
    """T1 vocabulary job: count whitespace words of the given text columns and
    number them ``FIRST_WORD_ID + rank`` by (count desc, word asc)."""
    cols = [texts] if isinstance(texts, Column) else list(texts)
    # tasks count the words of their texts first: what is shuffled and added up is a word a
    # task, not a word an occurrence
    pieces = df.select(*[c.cast("string").alias(f"__t{i}") for i, c in enumerate(cols)]).mapInArrow(
        _word_counts, "word string, n long")
    counts = pieces.filter(~F.col("word").isin(list(SPECIAL_IDS))).groupBy("word").agg(F.sum("n").alias("n"))
    ranked, size = dense_index(counts, [F.col("n").desc(), F.col("word").asc()], "__rank",
                               return_count=True)
    return Vocabulary(ranked.select("word", "n", (F.col("__rank") + FIRST_WORD_ID).alias("token_id")), size)


def dictionary_blocks(df: DataFrame, texts: Sequence[str], key_cols: Sequence[str],
                      block_bytes: int | None = None) -> DataFrame:
    """``df`` with ``__block``: rows dealt by a hash of their key to blocks of about
    ``block_bytes`` of text, and to at least as many blocks as there are shuffle
    partitions. The total size is a scalar subquery over the text lengths."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in texts])
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).scalar()
    most = F.greatest(F.ceil(total / F.lit(block_bytes or BLOCK_BYTES)), F.lit(shuffle_partitions(df.sparkSession)))
    return df.withColumn("__block", F.pmod(F.xxhash64(*key_cols), most.cast("long")))


def block_dictionaries(blocks: DataFrame, texts: Sequence[str], vocab: Vocabulary) -> DataFrame:
    """``(__dict, word, token_id)``: the known words of every block, each once."""
    listed = reduce(F.concat, [F.coalesce(words(F.col(c)), F.array().cast("array<string>")) for c in texts])
    pairs = blocks.select(F.col("__block").alias("__dict"), F.explode(F.array_distinct(listed)).alias("word")).distinct()
    return pairs.join(vocab.table.select("word", "token_id"), "word").select("__dict", "word", "token_id")


def with_ids(df: DataFrame, texts: dict[str, str], vocab: Vocabulary, key_cols: Sequence[str],
             block_bytes: int | None = None) -> DataFrame:
    """Replace each text column by its id array (``{ids column: text column}``) by the
    block-local dictionary join; all other columns are carried. Texts without words
    give an empty array, null texts a null one. ``key_cols`` only deal rows to blocks."""
    names = list(texts.values())
    blocks = dictionary_blocks(df, names, key_cols, block_bytes)
    carried = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(carried + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in texts])
    kept = [f.name for f in carried]

    def encode(rows: pa.Table, dictionary: pa.Table) -> pa.Table:
        tokenizer = _tokenizer_of(dictionary)
        ids = [pa.array(tokenizer.encode_batch(rows.column(c).to_pylist()), pa.list_(pa.int32())) for c in names]
        return pa.Table.from_arrays([rows.column(c) for c in kept] + ids, names=kept + list(texts))

    return (blocks.groupBy("__block").cogroup(block_dictionaries(blocks, names, vocab).groupBy("__dict"))
            .applyInArrow(encode, schema))


def _tokenizer_of(dictionary: pa.Table) -> "WhitespaceTokenizer":
    found = zip(dictionary.column("word").to_pylist(), dictionary.column("token_id").to_pylist())
    return WhitespaceTokenizer({w: i for w, i in found if w is not None})


def tokenize(df: DataFrame, text: str | Column, vocab: Vocabulary, key_cols: Sequence[str],
             ids_col: str = "input_ids") -> DataFrame:
    """T1/T6 by the vocabulary job: ``key_cols`` and the id array of the text, raw
    columns dropped."""
    tcol = F.col(text) if isinstance(text, str) else text
    return with_ids(df.select(*key_cols, tcol.alias("__t")), {ids_col: "__t"}, vocab, key_cols)


def first_words(text: Column, n: Column | int) -> Column:
    """A text whose ids are the first ``n`` ids of ``text`` under the vocabulary job."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def eot_features(df: DataFrame, text_col: str, vocab: Vocabulary | None, key_cols: Sequence[str],
                 max_seq_len: int, end_of_conversation_token: str = ENDOFTEXT,
                 pad_id: int = PAD_ID, prefix: str = "", factory=None) -> DataFrame:
    """T5 of one text column, see :func:`eot_pair_features`."""
    return eot_pair_features(df, {prefix: text_col}, vocab, key_cols, max_seq_len,
                             end_of_conversation_token, pad_id, factory)


def eot_pair_features(df: DataFrame, text_cols: dict[str, str], vocab: Vocabulary | None,
                      key_cols: Sequence[str], max_seq_len: int,
                      end_of_conversation_token: str = ENDOFTEXT, pad_id: int = PAD_ID,
                      factory=None) -> DataFrame:
    """T5: append the end-of-conversation token, tokenize, truncate to
    ``max_seq_len`` and pad to it, for one text column or several of the same rows
    (phase 2: chosen and rejected), ``{prefix: column}``. The attention mask marks real
    tokens (not equality with pad), as a tokenizer's padding mask does. Rows where any
    text is null are dropped (F1/F2 semantics).

    Texts are cut to what can fill ``max_seq_len`` before they are tokenized: to their
    first words for the vocabulary job, by the token budget of :func:`tokenize_with` for
    plug-ins."""
    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in text_cols.values()])
    texts = {f"__i{i}": f"__t{i}" for i in range(len(text_cols))}
    ended = [F.concat(F.col(c), F.lit(end_of_conversation_token)) for c in text_cols.values()]
    if factory is None:
        ended = [first_words(t, max_seq_len) for t in ended]
    out = df.filter(cond).select(*key_cols, *[t.alias(c) for t, c in zip(ended, texts.values())])
    if factory is None:
        out = with_ids(out, texts, vocab, key_cols)
    else:
        for ids, text in texts.items():
            out = tokenize_with(out, text, factory, ids, max_tokens=max_seq_len)
    cols = list(key_cols)
    for ids_col, prefix in zip(texts, text_cols):
        ids = F.slice(F.col(ids_col), 1, max_seq_len)
        cols += [pad_clip(ids, max_seq_len, pad_id, "right").alias(f"{prefix}input_ids"),
                 real_token_mask(F.size(ids), max_seq_len).alias(f"{prefix}attention_mask")]
    return out.select(*cols)


# ---------------------------------------------------------------- E1 plug-in

class WhitespaceTokenizer:
    """Plain-Python tokenizer with the same rules as the vocabulary job; the
    reference plug-in for tests and small vocabularies."""

    word_local = True

    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab
        self._ids = {**vocab, **SPECIAL_IDS}  # specials win, as in the job

    def encode(self, text: str | None) -> list[int] | None:
        if text is None:
            return None
        if "<|" in text:
            for sp in INLINE_SPECIALS:
                text = text.replace(sp, f" {sp} ")
        get = self._ids.get
        return [get(w, UNK_ID) for w in _PY_SPLIT.split(text) if w]

    def encode_batch(self, texts: list[str | None]) -> list[list[int] | None]:
        return [self.encode(t) for t in texts]


class CodePointTokenizer:
    """Vocabulary-free plug-in: one id per Unicode code point,
    ``ord(ch) + FIRST_WORD_ID`` (ids below stay reserved for specials)."""

    word_local = True

    def encode_batch(self, texts: list[str | None]) -> list[list[int] | None]:
        return [None if t is None else [ord(c) + FIRST_WORD_ID for c in t] for t in texts]


class HFTokenizerFile:
    """Factory for a tokenizer saved as a ``tokenizers`` JSON file on shared
    storage; loaded once per Python worker."""

    def __init__(self, path: str, add_special_tokens: bool = False):
        self.path = path
        self.add_special_tokens = add_special_tokens

    def __call__(self):
        from tokenizers import Tokenizer  # imported on the worker

        tok = Tokenizer.from_file(self.path)
        add = self.add_special_tokens

        class _Enc:
            def encode_batch(self, texts):
                safe = [t if t is not None else "" for t in texts]
                out = [e.ids for e in tok.encode_batch(safe, add_special_tokens=add)]
                return [o if t is not None else None for o, t in zip(out, texts)]

        return _Enc()


#: Letters of a budgeted tokenizer's first prefix, for each token asked for.
PREFIX_LETTERS = 8
_BORDER = re.compile(r"[ \t\n\r\f][^ \t\n\r\f]")


def budgeted_ids(tokenizer, texts: list[str | None], max_tokens: int) -> list[list[int] | None]:
    """The first ``max_tokens`` ids of each text, from growing prefixes.

    A tokenizer that sets ``word_local`` promises that the ids of a text are those of its
    parts wherever it is cut in front of a word; it sees prefixes that are cut there and
    double until they fill the budget. Any other sees whole texts."""
    if not getattr(tokenizer, "word_local", False):
        return [None if ids is None else ids[:max_tokens] for ids in tokenizer.encode_batch(texts)]
    out: list[list[int] | None] = [None] * len(texts)
    open_ = [(i, PREFIX_LETTERS * max(max_tokens, 1)) for i, t in enumerate(texts) if t is not None]
    while open_:
        cuts = []
        for i, letters in open_:
            border = _BORDER.search(texts[i], letters) if letters < len(texts[i]) else None
            cuts.append(border.start() + 1 if border else len(texts[i]))
        found = tokenizer.encode_batch([texts[i][:cut] for (i, _), cut in zip(open_, cuts)])
        again = []
        for (i, letters), cut, ids in zip(open_, cuts, found):
            if cut < len(texts[i]) and len(ids) < max_tokens:
                again.append((i, 2 * cut))
            else:
                out[i] = ids[:max_tokens]
        open_ = again
    return out


def tokenize_with(df: DataFrame, text_col: str, factory: Callable[[], object],
                  ids_col: str = "input_ids", max_tokens: int | None = None) -> DataFrame:
    """Apply a plug-in tokenizer (``factory()`` returns an object with
    ``encode_batch(list[str]) -> list[list[int]]``) in Arrow batches. The
    factory runs once per worker iterator, not per row. With ``max_tokens`` only the
    first ids are kept, and texts are read no further than needed for them
    (:func:`budgeted_ids`)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = factory()
        for s in batches:
            vals = [None if v is None else str(v) for v in s.tolist()]
            yield pd.Series(tok.encode_batch(vals) if max_tokens is None else budgeted_ids(tok, vals, max_tokens))

    return df.withColumn(ids_col, _encode(F.col(text_col)))
