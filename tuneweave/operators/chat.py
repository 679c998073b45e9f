"""Chat turns to ids and labels (T2, T3) and instruction records to
conversations (A17).

Every turn becomes the ids of ``<|im_start|> role-words \\n content-words
<|im_end|> \\n``; role, newline and content are encoded separately (never the
rendered string at once), by the vocabulary job or a plug-in. One shuffle by
conversation collects ``(turn, ids, labels)`` structs that are sorted, so the
order never depends on ``collect_list``.

Roles besides user and assistant raise, or their turns are left out and counted
(``n_dropped``); in the system form a conversation's first system turn takes the
place of the default message.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import pad_clip, value_mask
from ..session import materialize
from ..functions.specials import (DEFAULT_SYSTEM_MESSAGE, IGNORE_INDEX, IM_END, IM_START,
                                  NEWLINE, PAD_ID, SFT_ROLES, SPECIAL_IDS)
from .scans import running_sums, sequence_positions
from .tokens import Vocabulary, first_words, tokenize_with, with_ids, words

SYSTEM_ROLE = "system"
Encoder = Callable[[DataFrame, dict[str, str]], DataFrame]


def _used_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str,
                on_unknown_role: str, form: str) -> DataFrame:
    """Adds ``__use``, whether the turn has a place in the output. Roles other than
    user/assistant raise (default) or are left out; in the system form the first system
    turn of a conversation is used too."""
    known = F.coalesce(F.col(role_col).isin(*SFT_ROLES), F.lit(False))
    if form == "system":
        is_system = F.coalesce(F.col(role_col) == SYSTEM_ROLE, F.lit(False))
        first = turns.filter(is_system).groupBy(conv_col).agg(F.min(turn_col).alias(turn_col))
        turns = turns.join(first.withColumn("__own", F.lit(True)), [conv_col, turn_col], "left")
        own = F.coalesce(F.col("__own"), F.lit(False)) & is_system
        turns = turns.withColumn("__use", known | own).drop("__own")
        fine = known | is_system
    else:
        turns, fine = turns.withColumn("__use", known), known
    if on_unknown_role == "drop_turn":
        return turns
    if on_unknown_role == "error":
        return turns.withColumn(role_col, F.when(fine, F.col(role_col)).otherwise(
            F.raise_error(F.concat(F.lit("unsupported chat role: "),
                                   F.coalesce(F.col(role_col), F.lit("null"))))))
    raise ValueError("on_unknown_role must be 'error' or 'drop_turn'")


def turn_offsets(per_turn: DataFrame, len_col: str, conv_col: str = "conv_id",
                 turn_col: str = "turn") -> DataFrame:
    """Token offset of every turn inside its conversation: an exclusive prefix
    sum of turn lengths in turn order, computed with the chunked scan (no
    window over a whole conversation)."""
    narrow = per_turn.select(conv_col, turn_col, F.col(len_col).alias("__len"))
    pos = sequence_positions(narrow, [conv_col], [turn_col], "__tp")
    offs = running_sums(pos, [conv_col], "__tp", {"__off": F.col("__len")}, exclusive=True)
    return offs.select(conv_col, turn_col, F.col("__off").cast("long").alias("__off"))


def _whitespace_turn_length(role_col: str, text_col: str) -> Column:
    """Turn length under the whitespace vocabulary: marker, role words,
    newline, content words, end marker, newline."""
    return (F.size(words(F.col(role_col))) + F.size(words(F.coalesce(F.col(text_col), F.lit(""))))
            + F.lit(4))


def _chat_ids(turns: DataFrame, vocab: Vocabulary, form: str, conv_col: str, turn_col: str,
              role_col: str, text_col: str, on_unknown_role: str, max_tokens: int | None) -> DataFrame:
    """The chat form with the vocabulary job's ids."""
    return _assemble(turns, lambda df, texts: with_ids(df, texts, vocab, [conv_col, turn_col]),
                     SPECIAL_IDS[IM_END], [SPECIAL_IDS[NEWLINE]], form, conv_col, turn_col, role_col, text_col,
                     on_unknown_role, max_tokens, _whitespace_turn_length(role_col, text_col), first_words)


def sft_tokens(turns: DataFrame, vocab: Vocabulary, conv_col: str = "conv_id",
               turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
               on_unknown_role: str = "error", max_tokens: int | None = None) -> DataFrame:
    """``(conv_id, input_ids, labels)``, unpadded, no system turn; with
    ``on_unknown_role='drop_turn'`` also ``n_dropped``, the turns left out. With
    ``max_tokens`` only the first ``max_tokens`` tokens are gathered (turns
    are clipped by their offset before they are tokenized)."""
    out = _chat_ids(turns, vocab, "sft", conv_col, turn_col, role_col, text_col, on_unknown_role, max_tokens)
    return _counted(out, on_unknown_role, conv_col, "input_ids", "labels")


def _counted(df: DataFrame, on_unknown_role: str, *cols: str) -> DataFrame:
    return df.select(*cols, *(["n_dropped"] if on_unknown_role == "drop_turn" else []))


def system_turn(vocab: Vocabulary, system_message: str) -> tuple[list[int], list[int]]:
    """Ids and labels of the system turn (a literal, tokenized once)."""
    ids = ([SPECIAL_IDS[IM_START]] + vocab.ids_for("system") + [SPECIAL_IDS[NEWLINE]]
           + vocab.ids_for(system_message) + [SPECIAL_IDS[IM_END], SPECIAL_IDS[NEWLINE]])
    labels = [ids[0]] + [IGNORE_INDEX] * (len(ids) - 3) + ids[-2:]
    return ids, labels


def system_tokens(turns: DataFrame, vocab: Vocabulary, max_len: int,
                  system_message: str = DEFAULT_SYSTEM_MESSAGE, pad_id: int = PAD_ID,
                  conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", on_unknown_role: str = "error") -> DataFrame:
    """System turn first, marker tokens kept in labels, right-padded and
    clipped to ``max_len``; mask by value (X2). The system turn is the conversation's
    first one, or ``system_message`` where it has none; with
    ``on_unknown_role='drop_turn'`` the turns left out are counted in ``n_dropped``."""
    sys_ids, sys_labels = system_turn(vocab, system_message)
    # only the first max_len tokens survive the clip: gather no more than that
    conv = _chat_ids(turns, vocab, "system", conv_col, turn_col, role_col, text_col, on_unknown_role, max_len)

    def prefixed(own: str, default: list[int], rest: str) -> Column:
        return F.concat(F.coalesce(own, F.array(*[F.lit(i) for i in default])), F.col(rest))

    ids, labels = prefixed("own_ids", sys_ids, "input_ids"), prefixed("own_labels", sys_labels, "labels")
    out = conv.select(conv_col, "n_dropped", pad_clip(ids, max_len, pad_id, "right").alias("input_ids"),
                      pad_clip(labels, max_len, IGNORE_INDEX, "right").alias("labels"))
    out = _counted(out, on_unknown_role, conv_col, "input_ids", "labels")
    return out.withColumn("attention_mask", value_mask(F.col("input_ids"), pad_id))


def instruct_to_conversation(df: DataFrame, instruction: str = "instruction",
                             input_col: str = "input", output: str = "output") -> DataFrame:
    """``{instruction, input, output}`` -> two turns; the user content is
    ``instruction + input`` with no separator, the assistant content is
    ``output``."""
    conv = F.array(
        F.struct(F.lit("user").alias("role"),
                 F.concat(F.col(instruction), F.col(input_col)).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col(output).alias("content")))
    return df.withColumn("conversations", conv)


def conversations_to_turns(df: DataFrame, id_col: str, conv_col: str = "conversations"
                           ) -> DataFrame:
    """Nested conversation arrays to the long turn table (conv_id, turn, role,
    text)."""
    return df.select(F.col(id_col).alias("conv_id"),
                     F.posexplode(conv_col).alias("turn", "__t")).select(
        "conv_id", F.col("turn").cast("long"), F.col("__t.role").alias("role"),
        F.col("__t.content").alias("text"))


def sft_tokens_with(turns: DataFrame, factory, im_end_id: int, newline: str = NEWLINE,
                    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text", on_unknown_role: str = "error",
                    newline_ids: list[int] | None = None, max_tokens: int | None = None) -> DataFrame:
    """T2 with a plug-in tokenizer (E1): per turn ``enc("<|im_start|>" + role)
    + enc("\\n") + enc(content) + [im_end] + enc("\\n")``, each piece encoded
    separately in Arrow batches; user turns unsupervised, assistant turns
    supervised after role and newline. One shuffle by conversation assembles
    the sorted turns. Columns as :func:`sft_tokens`."""
    nl_ids = newline_ids if newline_ids is not None else factory().encode_batch([newline])[0]

    def encode(df: DataFrame, texts: dict[str, str]) -> DataFrame:
        return reduce(lambda d, c: tokenize_with(d, texts[c], factory, c), texts, df).drop(*texts.values())

    out = _assemble(turns, encode, im_end_id, nl_ids, "sft", conv_col, turn_col, role_col, text_col,
                    on_unknown_role, max_tokens)
    return _counted(out, on_unknown_role, conv_col, "input_ids", "labels")


def _assemble(turns: DataFrame, encode: Encoder, im_end_id: int, nl_ids: list[int], form: str,
              conv_col: str, turn_col: str, role_col: str, text_col: str, on_unknown_role: str,
              max_tokens: int | None, turn_length: Column | None = None, cut=None) -> DataFrame:
    """Conversations with ``input_ids``, ``labels``, ``n_dropped`` and, in the system
    form, ``own_ids`` and ``own_labels`` of the own system turn (null without one), which
    the former leave out.

    ``turn_length``: the number of ids of a turn where it is known without
    tokenizing; ``cut(text, n)``: a text whose first ``n`` ids are those of
    ``text``. Both only save work under ``max_tokens``."""
    if form not in ("sft", "system"):
        raise ValueError("form must be 'sft' or 'system'")
    turns = _used_turns(turns.select(conv_col, turn_col, role_col, text_col), conv_col, turn_col, role_col,
                        on_unknown_role, form)
    spoken = F.col("__use") & F.col(role_col).isin(*SFT_ROLES)
    if max_tokens and turn_length is not None:
        # lengths are known without tokenizing: turns past the budget go, and the
        # others keep the words that can be inside it, before any is tokenized
        lens = turns.select(conv_col, turn_col, F.when(spoken, turn_length).otherwise(0).alias("__tl"))
        left = F.greatest(F.lit(max_tokens) - F.col("__off"), F.lit(0))
        offs = turn_offsets(lens, "__tl", conv_col, turn_col)
        turns = turns.join(offs.select(conv_col, turn_col, left.alias("__left")), [conv_col, turn_col])
        turns = turns.withColumn("__left", F.when(spoken, F.col("__left")).otherwise(max_tokens).cast("int"))
        # a turn that is left out still counts; one past the budget does not
        turns = turns.filter(F.col("__left") > 0)
        if cut is not None:
            turns = turns.withColumn(text_col, cut(F.col(text_col), F.col("__left")))
    # turns that are left out keep their row, without text, to be counted
    use = F.col("__use")
    t = turns.withColumn("__role_text", F.when(use, F.concat(F.lit(IM_START), F.col(role_col))))
    t = encode(t.withColumn("__content", F.when(use, F.coalesce(F.col(text_col), F.lit("")))).drop(text_col),
               {"__rids": "__role_text", "__cids": "__content"})
    nl = F.array(*[F.lit(i) for i in nl_ids]) if nl_ids else F.array().cast("array<int>")
    t = t.withColumn("__ids", F.concat("__rids", nl, "__cids", F.array(F.lit(im_end_id)), nl))
    ids, is_asst = F.col("__ids"), F.col(role_col) == "assistant"
    if form == "sft":
        first = F.size("__rids") + F.lit(len(nl_ids))
        supervised = lambda i: is_asst & (i >= first)
    else:
        # first token kept; assistant: role pieces masked; others: all but the
        # closing im_end + newline masked
        supervised = lambda i: (i == 0) | F.when(is_asst, i > F.size("__rids")).otherwise(i >= F.size(ids) - 2)
    t = t.withColumn("__lab", F.transform(ids, lambda x, i: F.when(supervised(i), x).otherwise(F.lit(IGNORE_INDEX))))
    columns = [conv_col, turn_col, role_col, "__use", "__ids", "__lab"]
    if max_tokens and turn_length is None:
        # lengths are not known: the per-turn arrays are stored once and measured;
        # turns past the budget are dropped and the rest sliced before the
        # per-conversation collect
        t = materialize(t.select(*columns), "chat-turns")
        lens = t.select(conv_col, turn_col, F.when(spoken, F.size("__ids")).otherwise(0).alias("__tl"))
        offs = turn_offsets(lens, "__tl", conv_col, turn_col)
        t = t.join(offs, [conv_col, turn_col]).withColumn("__left", F.when(spoken, F.greatest(
            F.lit(max_tokens) - F.col("__off"), F.lit(0))).otherwise(max_tokens).cast("int"))
        t = t.filter(F.col("__left") > 0)
    if max_tokens:
        t = t.withColumn("__ids", F.slice("__ids", 1, F.col("__left"))).withColumn(
            "__lab", F.slice("__lab", 1, F.col("__left")))
    item = F.struct(F.col(turn_col).alias("turn"), F.col("__ids").alias("ids"), F.col("__lab").alias("labels"))
    own = F.col("__use") & (F.col(role_col) == SYSTEM_ROLE)
    conv = t.groupBy(conv_col).agg(
        F.sort_array(F.collect_list(F.when(spoken, item))).alias("__ts"),
        F.first(F.when(own, item), ignorenulls=True).alias("__own"),
        F.sum(F.when(F.col("__use"), 0).otherwise(1)).cast("long").alias("n_dropped"))
    out = conv.select(conv_col, F.flatten(F.transform("__ts", lambda x: x["ids"])).alias("input_ids"),
                      F.flatten(F.transform("__ts", lambda x: x["labels"])).alias("labels"), "n_dropped",
                      F.col("__own.ids").alias("own_ids"), F.col("__own.labels").alias("own_labels"))
    return out if form == "system" else out.drop("own_ids", "own_labels")
