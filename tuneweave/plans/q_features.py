"""Registered queries: phase features, packing, token caches, sampling and
batching (T5, T6, X3-X6, F3, B1-B4, V4, K1, S6-S8, M11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import join_ints, labels_from_mask
from ..functions.specials import ENDOFTEXT, IGNORE_INDEX, PAD_ID
from ..operators.batches import batch_ids, mini_batches, prompt_collate, reward_collate
from ..operators.chat import sft_tokens
from ..operators.features import pack_text_blocks, phase2_tuple, phase3_tuple
from ..operators.order import dense_index, rank_shards, seeded_rank
from ..operators.tokens import build_vocabulary, eot_features, eot_pair_features, tokenize, words
from ..sinks.token_cache import cache_rows
from ..sources.files import unsupervised_text_column
from ..sources.token_cache import union_caches
from . import sqlkit as q
from ..operators.adapters import apply_adapter, spec
from .q_adapters import SHAPES, SQL_CONV_BASE, adapted, conv_pairs, doc_pairs
from .q_order import SEED, sql_rank
from .q_tokens import _LISTS, conversation_vocab
from .tables import table

MAX_PROMPT_LEN = 32
MAX_TOKEN_LEN = 16
MAX_SEQ_LEN = 64
PROMPT_BATCH = 8
REWARD_BATCH = 4
BLOCK_SIZE = 512  # max_prompt_seq_len + max_answer_seq_len (256 + 256)
ROWS_PER_GROUP = 1000
WORLD = 3
TRAIN_BATCH = 8
MAX_BUFFER = 2
SMALL_BATCH = 3
GPTJ = "Dahoas/synthetic-instruct-gptj-pairwise"


# ------------------------------------------------------------------- phase 3

def _phase3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase-3 prompts: null prompts dropped, tokenized, longer than
    MAX_PROMPT_LEN dropped (F3), reversed (X5)."""
    prompts = adapted(spark, sf_dir, GPTJ, 3).select("conv_id", "turn", "prompt")
    vocab = build_vocabulary(F.col("prompt"), prompts)
    tok = tokenize(prompts, "prompt", vocab, ["conv_id", "turn"], "ids")
    kept = tok.filter(F.size("ids") <= MAX_PROMPT_LEN)
    ones = F.transform("ids", lambda x: F.lit(1))
    return kept.select("conv_id", "turn", F.size("ids").cast("long").alias("n_tokens"),
                       phase3_tuple(F.col("ids"), ones, PAD_ID).alias("t")).select(
        "conv_id", "turn", "n_tokens", "t.*")


def prompt_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _phase3(spark, sf_dir)
    return p.select("conv_id", "turn", "n_tokens",
                    join_ints(F.col("prompt_input_ids")).alias("prompt_ids"),
                    join_ints(F.col("prompt_attention_mask")).alias("prompt_mask"))


def prompt_left_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = seeded_rank(_phase3(spark, sf_dir), SEED, ["conv_id", "turn"])
    p = batch_ids(p, PROMPT_BATCH, "rank")
    c = prompt_collate(p, MAX_TOKEN_LEN, PAD_ID)
    return c.select("conv_id", "turn", "batch_id", join_ints(F.col("prompt")).alias("prompt"),
                    join_ints(F.col("prompt_att_mask")).alias("prompt_att_mask"))


# --------------------------------------------------------------- phase 1 / 2

def phase1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir, "local/jsonfile", 1).select(
        "conv_id", "turn", F.concat("prompt_and_chosen", F.lit(ENDOFTEXT)).alias("t"))
    vocab = build_vocabulary(F.col("t"), rows)
    feats = eot_features(rows, "t", vocab, ["conv_id", "turn"],
                         MAX_SEQ_LEN, end_of_conversation_token="")
    return feats.select(
        "conv_id", "turn", join_ints(F.col("input_ids")).alias("input_ids"),
        join_ints(F.col("attention_mask")).alias("attention_mask"),
        join_ints(labels_from_mask(F.col("input_ids"), F.col("attention_mask"))).alias("labels"))


def reward_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen and rejected features of the pairs."""
    keys = ["conv_id", "turn"]
    pairs = adapted(spark, sf_dir, "Dahoas/rm-static", 2).select(
        *keys, F.concat("prompt_and_chosen", F.lit(ENDOFTEXT)).alias("c"),
        F.concat("prompt_and_rejected", F.lit(ENDOFTEXT)).alias("r"))
    vocab = build_vocabulary([F.col("c"), F.col("r")], pairs)
    feats = eot_pair_features(pairs, {"c_": "c", "r_": "r"}, vocab, keys, MAX_SEQ_LEN, "")
    return feats.select(*keys, phase2_tuple(
        F.col("c_input_ids"), F.col("c_attention_mask"), F.col("r_input_ids"),
        F.col("r_attention_mask")).alias("t")).select(*keys, "t.*")


def reward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["conv_id", "turn"]
    ranked = batch_ids(seeded_rank(reward_features(spark, sf_dir), SEED, keys), REWARD_BATCH, "rank")
    out = reward_collate(ranked, keys=keys)
    return out.select(*keys, "batch_id", "side", F.col("row_in_collated").cast("long"),
                      join_ints(F.col("input_ids")).alias("input_ids"),
                      join_ints(F.col("attention_mask")).alias("attention_mask"))


# ------------------------------------------------------------------ packing

def pack_blocks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text_col = unsupervised_text_column(docs)
    vocab = build_vocabulary(F.col(text_col), docs)
    # number the ids alone, then go from texts straight to blocks: neither a text nor a
    # document's id array goes through the index
    index = dense_index(docs.select("doc_id"), ["doc_id"], "idx")
    blocks = pack_text_blocks(docs, text_col, vocab, BLOCK_SIZE, ROWS_PER_GROUP, key_col="doc_id", index=index)
    return blocks.select("group_id", "block_id", join_ints(F.col("input_ids")).alias("input_ids"),
                         F.size("input_ids").cast("long").alias("n_tokens"))


# -------------------------------------------------------------- token cache

def _sft_store(spark: SparkSession, sf_dir: str, vocab=None):
    conv = table(spark, sf_dir, "conversations")
    vocab = vocab or conversation_vocab(conv)
    t = sft_tokens(conv, vocab, on_unknown_role="drop_turn").drop("n_dropped")
    return cache_rows(t, "sft", ["conv_id"]), vocab


def token_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _sft_store(spark, sf_dir)
    return rows.select("key", "key_tag", "idx", "conv_id",
                       F.size("input_ids").cast("long").alias("n_tokens"))


def token_cache_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    store0, vocab = _sft_store(spark, sf_dir)
    pairs = adapted(spark, sf_dir, "local/jsonfile", 1).select(
        "conv_id", "turn", "prompt_and_chosen")
    tok = tokenize(pairs, "prompt_and_chosen", vocab, ["conv_id", "turn"], "input_ids")
    store1 = cache_rows(tok.withColumn("labels", F.col("input_ids")), "sft", ["conv_id", "turn"])
    cols = ["key", "key_tag", "idx", "input_ids", "labels"]
    merged = union_caches([store0.select(*cols), store1.select(*cols)], on_conflict="last")
    return merged.select(
        "key", "store", F.size("input_ids").cast("long").alias("n_tokens"),
        F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


# ------------------------------------------------------------ sampling, B1-4

def _shards(spark: SparkSession, sf_dir: str, with_count: bool = False):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    ranked, n = seeded_rank(docs, SEED, ["doc_id"], return_count=True)
    out = rank_shards(ranked, WORLD, n=n)
    return (out, n) if with_count else out


def rank_shards_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shards(spark, sf_dir).select("doc_id", "padded_pos", "shard", "shard_pos")


def batch_ids_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_ids(_shards(spark, sf_dir), TRAIN_BATCH).select(
        "doc_id", "padded_pos", "shard", "batch_id", "row_in_batch")


def mini_batches_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = _shards(spark, sf_dir, with_count=True)
    per_shard = -(-n // WORLD)
    b = batch_ids(s, TRAIN_BATCH)
    return mini_batches(b, TRAIN_BATCH, MAX_BUFFER, SMALL_BATCH, per_shard).select(
        "doc_id", "padded_pos", "shard", "buffer_id", "mini_id")


# ------------------------------------------------------------------- M11

PREP_COUNTS = ("n_raw", "phase1_kept", "phase1_dropped", "phase2_kept", "phase2_dropped",
               "phase3_kept", "phase3_filtered")


def _counts_of(base: DataFrame, names: list[str]) -> DataFrame:
    """One row per dataset layout in ``names``, all counted in one pass over
    ``base``: each layout is projected in turn beside the base columns, and only
    its seven conditions are kept for the one aggregate."""
    df = base.select(F.struct("*").alias("base"))
    flags: list[str] = []
    for i, name in enumerate(names):
        df = df.select("base", *flags, "base.*").select("base", *flags, *SHAPES[name][1]())
        df = apply_adapter(df, spec(name), ["base", *flags])
        pc = F.col("prompt_and_chosen").isNotNull()
        both = pc & F.col("prompt_and_rejected").isNotNull()
        prompt = F.col("prompt").isNotNull()
        short = F.size(words(F.col("prompt"))) <= MAX_PROMPT_LEN
        tests = [F.lit(True), pc, ~pc, both, ~both, prompt & short, prompt & ~short]
        df = df.select("base", *flags, F.array(*tests).alias(f"is_{i}"))
        flags.append(f"is_{i}")
    sums = df.agg(*[F.coalesce(F.sum(F.col(f)[k].cast("long")), F.lit(0)).alias(f"{f}_{k}")
                    for f in flags for k in range(len(PREP_COUNTS))])
    rows = F.array(*[F.struct(F.lit(name).alias("dataset"),
                              *[F.col(f"is_{i}_{k}").alias(c) for k, c in enumerate(PREP_COUNTS)])
                     for i, name in enumerate(names)])
    return sums.select(F.explode(rows).alias("row")).select("row.*")


def prep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared and dropped rows per dataset and phase, for all layouts; the
    phase-3 length is the whitespace token count (ids are not needed to count)."""
    conv = [n for n, (kind, _) in SHAPES.items() if kind == "conv"]
    docs = [n for n, (kind, _) in SHAPES.items() if kind == "doc"]
    return _counts_of(conv_pairs(spark, sf_dir), conv).unionByName(
        _counts_of(doc_pairs(spark, sf_dir), docs))


# ------------------------------------------------------------------ oracle SQL

def _sql_tok_cte(src: str, text: str, keys: str, name: str = "tok") -> str:
    """``{name}(keys..., ids)`` from text column ``text`` of CTE ``src``,
    vocabulary over the same texts."""
    return f"""{q.vocab_cte([(src, text)])},
{name}_w AS (SELECT {keys}, unnest({q.words(text)}) AS w,
                    generate_subscripts({q.words(text)}, 1) AS pos FROM {src}),
{name} AS (SELECT {keys}, list({q.id_of(f'{name}_w.w')} ORDER BY pos) AS ids
           FROM {name}_w LEFT JOIN vocab v ON v.word = {name}_w.w GROUP BY {keys})"""


_P3 = f"""{SQL_CONV_BASE},
pr AS (SELECT conv_id, turn, ' Human: ' || prompt || ' Assistant:' AS prompt FROM base
       WHERE prompt IS NOT NULL),
{_sql_tok_cte('pr', 'prompt', 'conv_id, turn')},
kept AS (SELECT conv_id, turn, ids FROM tok WHERE len(ids) <= {MAX_PROMPT_LEN})"""

SQL_PROMPT_LENGTH = f"""WITH {_P3}
SELECT conv_id, turn, CAST(len(ids) AS BIGINT) AS n_tokens,
       array_to_string(list_reverse(ids), ',') AS prompt_ids,
       array_to_string(list_transform(ids, lambda x: 1), ',') AS prompt_mask FROM kept"""

SQL_PROMPT_LEFT_PAD = f"""WITH {_P3},
rk AS (SELECT conv_id, turn, ids, {sql_rank('conv_id, turn')} AS rank FROM kept),
bt AS (SELECT *, rank // {PROMPT_BATCH} AS batch_id FROM rk),
ln AS (SELECT *, greatest(max(len(ids)) OVER (PARTITION BY batch_id), {MAX_TOKEN_LEN}) AS L FROM bt)
SELECT conv_id, turn, batch_id,
       array_to_string(list_concat(list_resize([]::INTEGER[], L - len(ids), {PAD_ID}), ids), ',') AS prompt,
       array_to_string(list_concat(list_resize([]::INTEGER[], L - len(ids), 0),
                                   list_transform(ids, lambda x: 1)), ',') AS prompt_att_mask
FROM ln"""


def _sql_eot_lists(name: str) -> str:
    n = MAX_SEQ_LEN
    return (f"array_to_string(list_resize({name}[1:{n}], {n}, {PAD_ID}), ',') AS input_ids, "
            f"array_to_string(list_transform(range(1, {n} + 1), lambda i: CASE WHEN i <= "
            f"len({name}[1:{n}]) THEN 1 ELSE 0 END), ',') AS attention_mask")


SQL_PHASE1 = f"""WITH {SQL_CONV_BASE},
t AS (SELECT conv_id, turn, ' ' || prompt || ' ' || chosen || '{ENDOFTEXT}' AS t FROM base
      WHERE (' ' || prompt || ' ' || chosen) IS NOT NULL),
{_sql_tok_cte('t', 't', 'conv_id, turn')}
SELECT conv_id, turn, {_sql_eot_lists('ids')},
       array_to_string(list_transform(range(1, {MAX_SEQ_LEN} + 1), lambda i: CASE WHEN i <= len(ids)
         THEN ids[i] ELSE {IGNORE_INDEX} END), ',') AS labels
FROM tok"""

SQL_REWARD = f"""WITH {SQL_CONV_BASE},
pairs AS (SELECT conv_id, turn, prompt || chosen || '{ENDOFTEXT}' AS c,
                 prompt || rejected || '{ENDOFTEXT}' AS r FROM base
          WHERE prompt || chosen IS NOT NULL AND prompt || rejected IS NOT NULL),
long AS (SELECT conv_id, turn, 0 AS side, c AS t FROM pairs UNION ALL
         SELECT conv_id, turn, 1 AS side, r AS t FROM pairs),
{_sql_tok_cte('long', 't', 'conv_id, turn, side')},
rk AS (SELECT conv_id, turn, {sql_rank('conv_id, turn')} AS rank FROM pairs),
bt AS (SELECT *, rank // {REWARD_BATCH} AS batch_id, CAST(rank % {REWARD_BATCH} AS INTEGER) AS rib,
              count(*) OVER (PARTITION BY rank // {REWARD_BATCH}) AS blen FROM rk)
SELECT tok.conv_id, tok.turn, bt.batch_id, tok.side, CAST(tok.side * bt.blen + bt.rib AS BIGINT) AS row_in_collated,
       {_sql_eot_lists('tok.ids')}
FROM tok JOIN bt ON tok.conv_id = bt.conv_id AND tok.turn = bt.turn"""

SQL_PACK = f"""WITH {q.vocab_cte([('documents', 'text')])},
d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, {q.words('text')} AS ws FROM documents),
l AS (SELECT idx, idx // {ROWS_PER_GROUP} AS grp, len(ws) AS n, ws FROM d),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY grp ORDER BY idx
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
             sum(n) OVER (PARTITION BY grp) AS tot FROM l),
k AS (SELECT grp, off, ws, CASE WHEN tot >= {BLOCK_SIZE} THEN (tot // {BLOCK_SIZE}) * {BLOCK_SIZE}
                            ELSE tot END AS keep FROM o),
p AS (SELECT grp, off, keep, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM k),
ids AS (SELECT p.grp, p.off + p.i - 1 AS gpos, {q.id_of('p.w')} AS id
        FROM p LEFT JOIN vocab v ON v.word = p.w WHERE p.off + p.i - 1 < p.keep)
SELECT CAST(grp AS BIGINT) AS group_id, CAST(gpos // {BLOCK_SIZE} AS BIGINT) AS block_id,
       {q.ints('id', 'gpos')} AS input_ids, count(*) AS n_tokens
FROM ids GROUP BY grp, gpos // {BLOCK_SIZE}"""

_SFT_STORE = f"""{_LISTS},
s0 AS (SELECT conv_id, len(ids) AS n_tokens, CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS id_sum,
              row_number() OVER (ORDER BY conv_id) - 1 AS idx FROM lists)"""

SQL_CACHE_KEYS = f"""WITH {_SFT_STORE}
SELECT 'sft_idx_' || CAST(idx AS VARCHAR) AS key, 'sft' AS key_tag, idx, conv_id, n_tokens FROM s0"""

SQL_CACHE_LAST = f"""WITH {_SFT_STORE}, {SQL_CONV_BASE},
pw AS (SELECT conv_id, turn, unnest({q.words("' ' || prompt || ' ' || chosen")}) AS w FROM base),
s1 AS (SELECT conv_id, turn, count(*) AS n_tokens, CAST(sum({q.id_of('pw.w')}) AS BIGINT) AS id_sum,
              row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx
       FROM pw LEFT JOIN vocab v ON v.word = pw.w GROUP BY conv_id, turn),
u AS (SELECT 'sft_idx_' || CAST(idx AS VARCHAR) AS key, 0 AS store, n_tokens, id_sum FROM s0 UNION ALL
      SELECT 'sft_idx_' || CAST(idx AS VARCHAR) AS key, 1 AS store, n_tokens, id_sum FROM s1),
win AS (SELECT key, arg_max(n_tokens, store) AS n_tokens, arg_max(id_sum, store) AS id_sum FROM u GROUP BY key)
SELECT u.key, u.store, win.n_tokens, win.id_sum FROM u JOIN win ON u.key = win.key"""

_SHARDS = f"""r AS (SELECT doc_id, {sql_rank('doc_id')} AS rank FROM documents),
cnt AS (SELECT count(*) AS n, CAST(ceil(count(*) / {WORLD}.0) * {WORLD} AS BIGINT) AS total FROM documents),
pp AS (SELECT doc_id, rank AS padded_pos FROM r UNION ALL
       SELECT r.doc_id, r.rank + k * cnt.n FROM r, cnt, range(1, 1 + {WORLD}) t(k)
       WHERE r.rank + k * cnt.n < cnt.total),
sh AS (SELECT doc_id, padded_pos, CAST(padded_pos % {WORLD} AS INTEGER) AS shard,
              padded_pos // {WORLD} AS shard_pos FROM pp)"""

SQL_RANK_SHARDS = f"WITH {_SHARDS} SELECT doc_id, padded_pos, shard, shard_pos FROM sh"
SQL_BATCH_IDS = (f"WITH {_SHARDS} SELECT doc_id, padded_pos, shard, shard_pos // {TRAIN_BATCH} AS batch_id, "
                 f"CAST(shard_pos % {TRAIN_BATCH} AS INTEGER) AS row_in_batch FROM sh")
SQL_MINI = f"""WITH {_SHARDS},
bb AS (SELECT *, shard_pos // {TRAIN_BATCH} AS batch_id, shard_pos % {TRAIN_BATCH} AS rib FROM sh),
lim AS (SELECT (CAST(ceil(ceil(n / {WORLD}.0) / {TRAIN_BATCH}) AS BIGINT)) // {MAX_BUFFER} AS complete FROM cnt)
SELECT doc_id, padded_pos, shard, batch_id // {MAX_BUFFER} AS buffer_id,
       CAST((batch_id % {MAX_BUFFER}) * {-(-TRAIN_BATCH // SMALL_BATCH)} + rib // {SMALL_BATCH} AS BIGINT) AS mini_id
FROM bb, lim WHERE batch_id // {MAX_BUFFER} < lim.complete"""


def _sql_prep() -> str:
    from .q_adapters import SQL_CONV_BASE as CB, SQL_DOC_BASE as DB, SQL_OUTPUTS, SQL_SHAPES, KEYS
    parts = []
    for name in SHAPES:
        kind = SHAPES[name][0]
        base = CB if kind == "conv" else DB
        outs = SQL_OUTPUTS[name]
        sel = ", ".join(f"{e} AS {n}" for e, n in zip(outs, ("prompt", "chosen", "rejected",
                                                              "prompt_and_chosen", "prompt_and_rejected")))
        keys = ", ".join(KEYS[kind])
        short = f"len({q.words('prompt')}) <= {MAX_PROMPT_LEN}"
        parts.append(f"""(WITH {base}, shaped AS (SELECT {keys}, {SQL_SHAPES[name]} FROM base),
 a AS (SELECT {sel} FROM shaped)
 SELECT '{name}' AS dataset, count(*) AS n_raw,
   count(*) FILTER (WHERE prompt_and_chosen IS NOT NULL) AS phase1_kept,
   count(*) FILTER (WHERE prompt_and_chosen IS NULL) AS phase1_dropped,
   count(*) FILTER (WHERE prompt_and_chosen IS NOT NULL AND prompt_and_rejected IS NOT NULL) AS phase2_kept,
   count(*) FILTER (WHERE NOT (prompt_and_chosen IS NOT NULL AND prompt_and_rejected IS NOT NULL)) AS phase2_dropped,
   count(*) FILTER (WHERE prompt IS NOT NULL AND {short}) AS phase3_kept,
   count(*) FILTER (WHERE prompt IS NOT NULL AND NOT ({short})) AS phase3_filtered
 FROM a)""")
    return " UNION ALL ".join(parts)


QUERIES = {
    "prompt_length_filter": (prompt_length_filter, SQL_PROMPT_LENGTH),
    "prompt_left_pad": (prompt_left_pad, SQL_PROMPT_LEFT_PAD),
    "phase1_labels": (phase1_labels, SQL_PHASE1),
    "reward_rows": (reward_rows, SQL_REWARD),
    "pack_blocks": (pack_blocks_q, SQL_PACK),
    "token_cache_keys": (token_cache_keys, SQL_CACHE_KEYS),
    "token_cache_last_wins": (token_cache_last_wins, SQL_CACHE_LAST),
    "rank_shards": (rank_shards_q, SQL_RANK_SHARDS),
    "batch_ids": (batch_ids_q, SQL_BATCH_IDS),
    "mini_batches": (mini_batches_q, SQL_MINI),
    "prep_counts": (prep_counts, _sql_prep()),
}
