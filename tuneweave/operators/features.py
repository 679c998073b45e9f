"""Sample features beyond padding: phase tuples (X4), reversed prompts (X5),
corpus packing (X6) and phase lengths (X7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.specials import FIRST_WORD_ID, SPECIAL_IDS, UNK_ID
from ..session import materialize
from .order import dense_index
from .tokens import BATCH_ROWS, BLOCK_BYTES, byte_words


def phase2_tuple(chosen_ids: Column, chosen_mask: Column, rejected_ids: Column,
                 rejected_mask: Column) -> Column:
    """X4, phase 2: (chosen ids, chosen mask, rejected ids, rejected mask)."""
    return F.struct(chosen_ids.alias("chosen_input_ids"), chosen_mask.alias("chosen_attention_mask"),
                    rejected_ids.alias("rejected_input_ids"),
                    rejected_mask.alias("rejected_attention_mask"))


def phase3_tuple(prompt_ids: Column, prompt_mask: Column, pad_id: int) -> Column:
    """X4 + X5, phase 3: reversed prompt ids and mask, plus the pad id."""
    return F.struct(F.reverse(prompt_ids).alias("prompt_input_ids"),
                    F.reverse(prompt_mask).alias("prompt_attention_mask"),
                    F.lit(pad_id).alias("pad_token_id"))


def phase_length(df: DataFrame) -> int:
    """A phase dataset's length is its row count."""
    return df.count()


def pack_blocks(tokens: DataFrame, block_size: int, rows_per_group: int = 1000,
                order_by: list[str] | None = None, ids_col: str = "input_ids",
                indexed: bool = False, index_col: str = "idx") -> DataFrame:
    """Concatenate the ids of each group of ``rows_per_group`` consecutive
    rows (D10: explicit grouping), cut into ``block_size`` blocks, drop the
    remainder unless the group is shorter than one block (then it is one
    short block); labels are a copy of the ids.

    No group is ever collected whole: per-row offsets inside the group come
    from a window over row lengths (at most ``rows_per_group`` rows), every row
    is cut into the block slices it overlaps, and one shuffle on
    ``(group, block)`` assembles each block from at most ``block_size`` ids.
    """
    if not indexed:
        tokens = dense_index(tokens, order_by or [], index_col)
    g = tokens.select(
        F.expr(f"{index_col} div {int(rows_per_group)}").alias("group_id"),
        F.col(index_col), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("__ids"))
    g = g.withColumn("__len", F.size("__ids"))
    w_prev = Window.partitionBy("group_id").orderBy(index_col).rowsBetween(
        Window.unboundedPreceding, -1)
    w_all = Window.partitionBy("group_id")
    g = (g.withColumn("__off", F.coalesce(F.sum("__len").over(w_prev), F.lit(0)).cast("long"))
         .withColumn("__tot", F.sum("__len").over(w_all).cast("long")))
    b = F.lit(block_size).cast("long")
    keep = F.when(F.col("__tot") >= b, F.floor(F.col("__tot") / b) * b).otherwise(F.col("__tot"))
    g = g.withColumn("__keep", keep.cast("long"))
    end = F.least(F.col("__off") + F.col("__len"), F.col("__keep"))
    g = g.filter((F.col("__len") > 0) & (F.col("__off") < F.col("__keep")))
    g = g.withColumn("__end", end)
    first_blk = F.floor(F.col("__off") / b).cast("long")
    last_blk = F.floor((F.col("__end") - 1) / b).cast("long")

    def cut(k):
        lo = F.greatest(F.col("__off"), k * b)
        hi = F.least(F.col("__end"), (k + 1) * b)
        return F.struct(k.alias("block_id"), lo.alias("__start"),
                        F.slice("__ids", F.greatest(lo - F.col("__off") + 1, F.lit(1)).cast("int"),
                                F.greatest(hi - lo, F.lit(0)).cast("int")).alias("__s"))

    # cut every row into its block slices first, then explode the slices (an
    # exploded row never carries the whole id array). The expressions are safe
    # on any row: the planner may evaluate them next to the filter above.
    blocks_of = F.when(last_blk >= first_blk, F.sequence(first_blk, last_blk)).otherwise(
        F.array().cast("array<bigint>"))
    cuts = g.select("group_id", F.transform(blocks_of, cut).alias("__cuts"))
    # explode_outer: no size() filter is inferred (it would run the cut twice)
    pieces = cuts.select("group_id", F.explode_outer("__cuts").alias("__c")).filter(
        F.col("__c").isNotNull()).select(
        "group_id", "__c.block_id", "__c.__start", "__c.__s")
    blocks = pieces.groupBy("group_id", "block_id").agg(
        F.sort_array(F.collect_list(F.struct("__start", "__s"))).alias("__parts"))
    ids = F.flatten(F.transform("__parts", lambda x: x["__s"]))
    return blocks.select("group_id", "block_id", ids.alias("input_ids")).withColumn(
        "labels", F.col("input_ids"))


def pack_text_blocks(texts: DataFrame, text_col: str, vocab, block_size: int,
                     rows_per_group: int = 1000, index_col: str = "idx", key_col: str | None = None,
                     index: DataFrame | None = None) -> DataFrame:
    """T6 + X6 fused for raw text: the same blocks as tokenizing every row and
    calling :func:`pack_blocks`, without a row's id array in any exchange.

    Texts are read and cut into words once: a task numbers the distinct words of its block,
    about ``BLOCK_BYTES`` of text, and stores each text as those numbers beside the block's
    words. The (block, word) pairs get their ids by one join to the vocabulary. Only
    ``(key, index, length)`` goes through the window on the group, at most
    ``rows_per_group`` rows of numbers. Ids, offsets and numbered texts meet by a cogroup on
    the block, and what leaves it are the slices of each block, assembled by one shuffle
    on ``(group, block)`` from at most ``block_size`` ids. A very long row is spread over
    many blocks instead of becoming one hot group.

    ``index``: table of ``key_col`` and ``index_col``; without it ``texts`` has the index
    itself, which is then its key. Keys are unique.
    """
    import numpy as np
    import pyarrow as pa

    key = key_col or index_col
    base = texts.select(F.spark_partition_id().alias("__part"), F.col(key).alias("__key"), F.col(text_col).cast("string").alias("__t"))
    key_type = base.schema["__key"].dataType
    coded = materialize(base.mapInArrow(_numbered, T.StructType([
        T.StructField("__block", T.LongType()), T.StructField("__key", key_type), T.StructField("__len", T.IntegerType()),
        T.StructField("__codes", T.ArrayType(T.IntegerType())), T.StructField("word", T.StringType()), T.StructField("code", T.IntegerType())])),
        "pack-codes")
    rows = coded.filter(F.col("__len") > 0)
    lens = coded.filter(F.col("__len").isNotNull()).select("__block", "__key", "__len")
    if index is None:
        lens = lens.withColumn("__idx", F.col("__key"))
    else:
        lens = lens.join(index.select(F.col(key).alias("__key"), F.col(index_col).alias("__idx")), "__key")
    b = F.lit(block_size).cast("long")
    group = Window.partitionBy("group_id")
    before = group.orderBy("__idx").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("__len").over(group)
    placed = lens.withColumn("group_id", F.expr(f"__idx div {int(rows_per_group)}")).select(
        "__block", "__key", "group_id", "__len", F.coalesce(F.sum("__len").over(before), F.lit(0)).cast("long").alias("__off"),
        F.when(total >= b, F.floor(total / b) * b).otherwise(total).cast("long").alias("__keep"))
    placed = placed.filter((F.col("__len") > 0) & (F.col("__off") < F.col("__keep"))).drop("__len")
    none = F.lit(None)
    beside = coded.filter(F.col("word").isNotNull()).select("__block", "word", "code").join(
        vocab.table.select("word", "token_id"), "word").select(
        F.col("__block").alias("__dict"), "code", F.col("token_id").cast("int").alias("token_id"), none.cast(key_type).alias("__key"),
        *[none.cast("long").alias(c) for c in ("group_id", "__off", "__keep")])
    beside = beside.unionByName(placed.select(F.col("__block").alias("__dict"), none.cast("int").alias("code"), none.cast("int").alias("token_id"),
                                              "__key", F.col("group_id").cast("long").alias("group_id"), "__off", "__keep"))
    schema = pa.schema([("group_id", pa.int64()), ("block_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def cut(rows: pa.Table, other: pa.Table) -> pa.Table:
        words = other.filter(other.column("code").is_valid())
        codes, found = (words.column(c).to_numpy() for c in ("code", "token_id"))
        values = [np.asarray(c.flatten()) for c in rows.column("__codes").chunks]
        values = np.concatenate(values) if values else np.zeros(0, np.int32)
        id_of = np.full(max(int(values.max(initial=0)), int(codes.max(initial=0)), FIRST_WORD_ID) + 1, UNK_ID, np.int32)
        id_of[:FIRST_WORD_ID] = np.arange(FIRST_WORD_ID)
        id_of[codes] = found
        ids, at = id_of[values], 0
        offsets = other.filter(other.column("group_id").is_valid())
        offsets = {k: place for k, *place in zip(*(offsets.column(c).to_pylist() for c in ("__key", "group_id", "__off", "__keep")))}
        out: list[tuple[int, int, int]] = []
        parts: list[np.ndarray] = []
        for k, n in zip(rows.column("__key").to_pylist(), rows.column("__len").to_pylist()):
            if k in offsets:
                g, off, keep = offsets[k]
                end = min(off + n, keep)
                for start in [off, *range((off // block_size + 1) * block_size, end, block_size)]:
                    stop = min((start // block_size + 1) * block_size, end)
                    out.append((g, start // block_size, start))
                    parts.append(ids[at + start - off:at + stop - off])
            at += n
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else ids[:0]))
        columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)]
        return pa.Table.from_arrays([*columns, lists], schema=schema)

    pieces = rows.select("__block", "__key", "__len", "__codes").groupBy("__block").cogroup(beside.groupBy("__dict")).applyInArrow(
        cut, "group_id long, block_id long, start long, ids array<int>")
    found = pieces.groupBy("group_id", "block_id").agg(F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("__parts"))
    ids = F.flatten(F.transform("__parts", lambda x: x["ids"]))
    return found.select("group_id", "block_id", ids.alias("input_ids")).withColumn("labels", F.col("input_ids"))


class _Numbers(dict):
    """Words of a block with their numbers in order of appearance, special tokens first."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _numbered(batches):
    """Texts as the numbers of their words in their block, and the words of each block.
    A block ends after ``BLOCK_BYTES`` of text and with its task."""
    import numpy as np
    import pyarrow as pa

    special = {w.encode(): i for w, i in SPECIAL_IDS.items()}
    numbers, size, block = _Numbers(special), 0, None
    names = ["__block", "__key", "__len", "__codes", "word", "code"]
    codes_type, key_type = pa.list_(pa.int32()), None

    def listed():
        words = list(numbers)[FIRST_WORD_ID:]
        for at in range(0, len(words), BATCH_ROWS):
            part = pa.array(words[at:at + BATCH_ROWS], pa.binary()).cast(pa.string())
            n, first = len(part), FIRST_WORD_ID + at
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.nulls(n, key_type), pa.nulls(n, pa.int32()), pa.nulls(n, codes_type), part,
                 pa.array(np.arange(first, first + n, dtype=np.int32))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        part, keys, texts = batch.columns
        key_type = keys.type
        block = part[0].as_py() << 32 if block is None else block
        texts = texts.cast(pa.binary())
        done = 0
        while done < len(texts):
            found = []
            for text in texts[done:]:
                data = text.as_py() or b""
                ws = byte_words(data)
                found.append(np.fromiter(map(numbers.__getitem__, ws), np.int32, len(ws)))
                size += len(data)
                if size >= BLOCK_BYTES:
                    break
            n = len(found)
            lens = np.array([len(f) for f in found], np.int32)
            codes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lens], dtype=np.int32)), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), keys[done:done + n], pa.array(lens), codes,
                                              pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())], names=names)
            done += n
            if size >= BLOCK_BYTES:
                yield from listed()
                numbers, size, block = _Numbers(special), 0, block + 1
    if block is not None:
        yield from listed()
