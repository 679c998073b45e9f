"""Registered queries: vocabulary, chat tokens, padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_to

from ..functions.arrays import join_ints, pad_clip, value_mask
from ..functions.specials import DEFAULT_SYSTEM_MESSAGE, IGNORE_INDEX, PAD_ID
from ..operators.chat import sft_tokens, system_tokens
from ..operators.tokens import CodePointTokenizer, build_vocabulary, tokenize_with
from . import sqlkit as q
from .tables import table

MAX_SEQ_LEN = 256  # reference default sample length


def conversation_vocab(conv: DataFrame):
    return build_vocabulary([F.col("text"), F.col("role")], conv)


def _sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return sft_tokens(conv, conversation_vocab(conv), on_unknown_role="drop_turn")


def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return conversation_vocab(conv).table


def sft_tokens_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _sft(spark, sf_dir)
    return t.select(
        "conv_id", join_ints(F.col("input_ids")).alias("input_ids"),
        join_ints(F.col("labels")).alias("labels"),
        F.size("input_ids").cast("long").alias("n_tokens"),
        F.size(F.filter("labels", lambda x: x != IGNORE_INDEX)).cast("long").alias("n_supervised"),
        "n_dropped")


def sft_system_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    t = system_tokens(conv, conversation_vocab(conv), MAX_SEQ_LEN, DEFAULT_SYSTEM_MESSAGE,
                      on_unknown_role="drop_turn")
    return t.select("conv_id", join_ints(F.col("input_ids")).alias("input_ids"),
                    join_ints(F.col("labels")).alias("labels"),
                    F.aggregate("attention_mask", F.lit(0).cast("long"),
                                lambda a, m: a + m).alias("n_attended"), "n_dropped")


def _sft_first(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """T2 gathering only the first ``n`` tokens of each conversation (all X1
    needs: either padding side keeps the first ``n``)."""
    conv = table(spark, sf_dir, "conversations")
    return sft_tokens(conv, conversation_vocab(conv), on_unknown_role="drop_turn", max_tokens=n)


def _padded(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    t = _sft_first(spark, sf_dir, MAX_SEQ_LEN)
    ids = pad_clip(F.col("input_ids"), MAX_SEQ_LEN, PAD_ID, side)
    labels = pad_clip(F.col("labels"), MAX_SEQ_LEN, IGNORE_INDEX, side)
    return t.select("conv_id", ids.alias("ids"), labels.alias("lab")).select(
        "conv_id", join_ints(F.col("ids")).alias("input_ids"),
        join_ints(F.col("lab")).alias("labels"),
        join_ints(value_mask(F.col("ids"), PAD_ID)).alias("attention_mask"))


def pad_clip_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir, "right")


def pad_clip_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir, "left")


def attention_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _sft_first(spark, sf_dir, MAX_SEQ_LEN)
    mask = value_mask(pad_clip(F.col("input_ids"), MAX_SEQ_LEN, PAD_ID, "right"), PAD_ID)
    n_real = F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + m)
    return t.select("conv_id", n_real.alias("n_real")).select(
        "conv_id", "n_real", round_to(F.col("n_real") / F.lit(float(MAX_SEQ_LEN)), 6).alias("density"))


def plugin_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plug-in tokenizer applied in Arrow batches (built once per worker)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    t = tokenize_with(conv, "text", CodePointTokenizer, "ids")
    return t.select("conv_id", "turn", F.size("ids").cast("long").alias("n_ids"),
                    join_ints(F.col("ids")).alias("ids"))


# ------------------------------------------------------------------ oracle SQL

CONV_VOCAB = q.vocab_cte([("conversations", "text"), ("conversations", "role")])


#: conversations with the number of their turns of other roles
_SQL_DROPPED = """convs AS (SELECT conv_id, count(*) FILTER (WHERE role IS NULL OR role NOT IN ({roles})) AS n_other,
                 min(turn) FILTER (WHERE role = 'system') AS own_turn FROM conversations GROUP BY conv_id)"""


def _sql_items(form: str) -> str:
    """CTE chain ending in ``items(conv_id, turn, role, pos, nr, nt, id)``; the system
    form has the first system turn too."""
    own = " OR (role = 'system' AND turn = own_turn)" if form == "system" else ""
    return f"""{CONV_VOCAB},
{_SQL_DROPPED.format(roles="'user', 'assistant'")},
t AS (SELECT conv_id, turn, role, len({q.words('role')}) AS nr,
             len({q.words("coalesce(text, '')")}) AS nt,
             list_concat(['<|im_start|>'], {q.words('role')}, [chr(10)],
                         {q.words("coalesce(text, '')")}, ['<|im_end|>', chr(10)]) AS ws
      FROM conversations JOIN convs USING (conv_id) WHERE role IN ('user', 'assistant'){own}),
p AS (SELECT conv_id, turn, role, nr, nt, unnest(ws) AS w,
             generate_subscripts(ws, 1) - 1 AS pos FROM t),
items AS (SELECT p.conv_id, p.turn, p.role, p.pos, p.nr, p.nt, {q.id_of('p.w')} AS id
          FROM p LEFT JOIN vocab v ON v.word = p.w)"""


SUP_SFT = "(role = 'assistant' AND pos >= nr + 2)"
SUP_SYS = "(pos = 0 OR (role = 'assistant' AND pos >= nr + 2) OR (role <> 'assistant' AND pos >= nr + nt + 2))"

SQL_VOCAB_IDS = f"WITH {CONV_VOCAB} SELECT word, n, token_id FROM vocab"

SQL_SFT_TOKENS = f"""WITH {_sql_items('sft')}
SELECT conv_id,
       {q.ints('id', 'turn, pos')} AS input_ids,
       {q.ints(f'CASE WHEN {SUP_SFT} THEN id ELSE -100 END', 'turn, pos')} AS labels,
       count(id) AS n_tokens,
       count(id) FILTER (WHERE {SUP_SFT}) AS n_supervised, n_other AS n_dropped
FROM convs LEFT JOIN items USING (conv_id) GROUP BY conv_id, n_other"""

_LISTS = f"""{_sql_items('sft')},
lists AS (SELECT conv_id, coalesce(list(id ORDER BY turn, pos) FILTER (WHERE id IS NOT NULL), []) AS ids,
                 coalesce(list(CASE WHEN {SUP_SFT} THEN id ELSE -100 END ORDER BY turn, pos)
                          FILTER (WHERE id IS NOT NULL), []) AS lab
          FROM convs LEFT JOIN items USING (conv_id) GROUP BY conv_id)"""


def _sql_pad(side: str) -> str:
    n = MAX_SEQ_LEN
    if side == "right":
        ids = f"list_resize(ids, {n}, {PAD_ID})"
        lab = f"list_resize(lab, {n}, -100)"
    else:
        ids = (f"CASE WHEN len(ids) >= {n} THEN ids[1:{n}] ELSE list_concat("
               f"list_resize([]::INTEGER[], {n} - len(ids), {PAD_ID}), ids) END")
        lab = (f"CASE WHEN len(lab) >= {n} THEN lab[1:{n}] ELSE list_concat("
               f"list_resize([]::INTEGER[], {n} - len(lab), -100), lab) END")
    return f"""WITH {_LISTS},
padded AS (SELECT conv_id, {ids} AS ids, {lab} AS lab FROM lists)
SELECT conv_id, array_to_string(ids, ',') AS input_ids, array_to_string(lab, ',') AS labels,
       array_to_string(list_transform(ids, lambda x: CASE WHEN x <> {PAD_ID} THEN 1 ELSE 0 END), ',')
         AS attention_mask
FROM padded"""


SQL_ATTENTION_DENSITY = f"""WITH {_LISTS},
m AS (SELECT conv_id, CAST(len(list_filter(list_resize(ids, {MAX_SEQ_LEN}, {PAD_ID}),
                                          lambda x: x <> {PAD_ID})) AS BIGINT) AS n_real FROM lists)
SELECT conv_id, n_real, round(n_real / {float(MAX_SEQ_LEN)}, 6) AS density FROM m"""


def _sql_system() -> str:
    # system turn words: <|im_start|> system \n <message words> <|im_end|> \n
    sys_words = (f"list_concat(['<|im_start|>'], {q.words(repr('system'))}, [chr(10)], "
                 f"{q.words(repr(DEFAULT_SYSTEM_MESSAGE))}, ['<|im_end|>', chr(10)])")
    n = MAX_SEQ_LEN
    return f"""WITH {_sql_items('system')},
sw AS (SELECT unnest({sys_words}) AS w, generate_subscripts({sys_words}, 1) - 1 AS pos),
sys AS (SELECT list({q.id_of('sw.w')} ORDER BY sw.pos) AS ids FROM sw LEFT JOIN vocab v ON v.word = sw.w),
syslab AS (SELECT ids, list_concat([ids[1]], list_resize([]::INTEGER[], len(ids) - 3, -100),
                                   ids[len(ids) - 1:]) AS lab FROM sys),
lists AS (SELECT conv_id, role = 'system' AS own, list(id ORDER BY turn, pos) AS ids,
                 list(CASE WHEN {SUP_SYS} THEN id ELSE -100 END ORDER BY turn, pos) AS lab
          FROM items GROUP BY ALL),
full_ AS (SELECT c.conv_id, n_other - (o.conv_id IS NOT NULL)::BIGINT AS n_dropped,
                 list_resize(list_concat(coalesce(o.ids, syslab.ids), coalesce(r.ids, [])), {n}, {PAD_ID}) AS ids,
                 list_resize(list_concat(coalesce(o.lab, syslab.lab), coalesce(r.lab, [])), {n}, -100) AS lab
          FROM syslab, convs c LEFT JOIN lists o ON o.conv_id = c.conv_id AND o.own
          LEFT JOIN lists r ON r.conv_id = c.conv_id AND NOT r.own)
SELECT conv_id, array_to_string(ids, ',') AS input_ids, array_to_string(lab, ',') AS labels,
       CAST(len(list_filter(ids, lambda x: x <> {PAD_ID})) AS BIGINT) AS n_attended, n_dropped FROM full_"""


SQL_PLUGIN = """SELECT conv_id, turn, CAST(len(cp) AS BIGINT) AS n_ids, array_to_string(cp, ',') AS ids
FROM (SELECT conv_id, turn, CASE WHEN text = '' THEN []::INTEGER[]
             ELSE list_transform(string_split(text, ''), lambda c: unicode(c) + 5) END AS cp
      FROM conversations)"""

QUERIES = {
    "vocab_ids": (vocab_ids, SQL_VOCAB_IDS),
    "plugin_tokens": (plugin_tokens, SQL_PLUGIN),
    "sft_tokens": (sft_tokens_q, SQL_SFT_TOKENS),
    "sft_system_tokens": (sft_system_tokens, _sql_system()),
    "pad_clip_right": (pad_clip_right, _sql_pad("right")),
    "pad_clip_left": (pad_clip_left, _sql_pad("left")),
    "attention_density": (attention_density, SQL_ATTENTION_DENSITY),
}
