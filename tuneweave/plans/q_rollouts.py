"""Registered queries: rollout analytics (R1-R9, F5) over the ``embeddings``
table read as logged per-token arrays.

Rollout view of one embedding row ``e`` (64 values, label 0-9): sequence
length 16, prompt length ``P = 4 + label % 4``, ``label`` answer tokens, then
pads (id 0); token ids from ``e``; log-probs ``-|e[16..30]|``, reference
log-probs ``-|e[31..45]|``, values ``e[46..60]``, reward score
``20 * (e[61] + e[62] + e[63])``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..operators.rollouts import (action_mask, advantages_returns, end_score, kl_rewards,
                                  log_softmax_at, pairwise_loss, policy_loss_terms, reward_end,
                                  valid_answer_len, value_loss_terms, zero_from)
from .tables import table

L = 16
PAD = 0
SEQ_BATCH = 8
NLL_SEQ = 8


def rollout_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    e = F.col("embedding").cast("array<double>")
    P = F.lit(4) + F.col("label") % 4
    real = P + F.col("label")
    pos = F.sequence(F.lit(0), F.lit(L - 1))
    raw = lambda i: (F.floor(F.abs(F.get(e, i)) * 1000).cast("int") % 100)
    ids = F.transform(pos, lambda i: F.when(i < real, F.lit(1) + raw(i)).otherwise(F.lit(PAD)))
    mask = F.transform(pos, lambda i: F.when(i < real, F.lit(1)).otherwise(F.lit(0)))
    v = emb.select(
        "vec_id", "label", e.alias("e"), P.alias("P"), ids.alias("input_ids"),
        mask.alias("attention_mask"),
        F.transform(F.slice(e, 17, L - 1), lambda x: -F.abs(x)).alias("logprobs"),
        F.transform(F.slice(e, 32, L - 1), lambda x: -F.abs(x)).alias("ref_logprobs"),
        F.slice(e, 47, L - 1).alias("values"),
        ((F.get(e, 61) + F.get(e, 62) + F.get(e, 63)) * 20.0).alias("reward"))
    v = v.withColumn("mask", action_mask(F.col("attention_mask"))).withColumn("start", F.col("P") - 1)
    v = v.withColumn("end", reward_end(F.col("mask"), F.col("start")))
    v = v.withColumn("rewards", kl_rewards(F.col("logprobs"), F.col("ref_logprobs"), F.col("mask"),
                                           F.col("start"), F.col("reward")))
    v = v.withColumn("rewards_z", zero_from(F.col("rewards"), F.col("end"))).withColumn(
        "values_z", zero_from(F.col("values"), F.col("end")))
    return v


def _with_gae(v: DataFrame) -> DataFrame:
    g = advantages_returns(F.col("values_z"), F.col("rewards_z"), F.col("start"))
    return v.withColumn("gae", g)


def label_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", round_to(log_softmax_at(F.col("embedding"), F.col("label")), 6)
                      .alias("logprob"))


def token_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: positions are rows ``(seq, pos)``; the label of the next position
    is scored under the current logits (window bounded by a sequence)."""
    emb = table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {NLL_SEQ}").alias("seq_id"), (F.col("vec_id") % NLL_SEQ).alias("pos"),
        "embedding", "label")
    w = Window.partitionBy("seq_id").orderBy("pos")
    nxt = emb.withColumn("next_label", F.lead("label").over(w)).filter(
        F.col("next_label").isNotNull() & (F.col("next_label") != -100))
    lp = nxt.withColumn("lp", log_softmax_at(F.col("embedding"), F.col("next_label")))
    return lp.groupBy("seq_id").agg(round_to(-F.avg("lp"), 6).alias("loss"),
                                    F.count(F.lit(1)).alias("n_tokens"))


def kl_rewards_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rollout_view(spark, sf_dir)
    return v.select("vec_id", F.posexplode("rewards").alias("pos", "r")).select(
        "vec_id", "pos", round_to("r", 6).alias("reward"))


def zero_after_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rollout_view(spark, sf_dir)
    z = v.select("vec_id", F.posexplode(F.arrays_zip("rewards_z", "values_z")).alias("pos", "z"))
    return z.select("vec_id", "pos", round_to(F.col("z.rewards_z"), 6).alias("reward"),
                    round_to(F.col("z.values_z"), 6).alias("value"))


def gae(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _with_gae(rollout_view(spark, sf_dir))
    z = v.select("vec_id", "start",
                 F.posexplode(F.arrays_zip("gae.advantages", "gae.returns")).alias("k", "z"))
    return z.select("vec_id", (F.col("start") + F.col("k")).alias("pos"),
                    round_to(F.col("z.advantages"), 6).alias("advantage"),
                    round_to(F.col("z.returns"), 6).alias("return_"))


def _tail(col: str, start: str = "start") -> F.Column:
    return F.slice(F.col(col), F.col(start) + 1, F.size(F.col(col)))


def policy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _with_gae(rollout_view(spark, sf_dir))
    new_lp = F.transform(F.slice("e", 1, L - 1), lambda x: -F.abs(x))
    t = v.withColumn("new_lp", new_lp).select(
        F.expr(f"vec_id div {SEQ_BATCH}").alias("batch_id"),
        policy_loss_terms(F.slice("new_lp", F.col("start") + 1, L - 1), _tail("logprobs"),
                          F.col("gae.advantages"), _tail("mask")).alias("t"))
    return t.groupBy("batch_id").agg(
        round_to(F.sum("t.num") / F.sum("t.den"), 6).alias("policy_loss"))


def value_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _with_gae(rollout_view(spark, sf_dir))
    t = v.withColumn("new_v", F.slice("e", 1, L - 1)).select(
        F.expr(f"vec_id div {SEQ_BATCH}").alias("batch_id"),
        value_loss_terms(F.slice("new_v", F.col("start") + 1, L - 1), _tail("values_z"),
                         F.col("gae.returns"), _tail("mask")).alias("t"))
    return t.groupBy("batch_id").agg(
        round_to(F.lit(0.5) * F.sum("t.num") / F.sum("t.den"), 6).alias("value_loss"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rollout_view(spark, sf_dir)
    d = F.lit(1) + F.col("label") % 5
    a2 = (F.col("label") * 3) % 10
    pos = F.sequence(F.lit(0), F.lit(L - 1))
    raw = lambda i: (F.floor(F.abs(F.get(F.col("e"), i)) * 1000).cast("int") % 100)
    rej = F.transform(pos, lambda i: F.when(i < d, F.get(F.col("input_ids"), i))
                      .when(i < F.col("P") + a2, F.lit(1) + (raw(i) + 7) % 100).otherwise(F.lit(PAD)))
    rej = F.when(F.col("label") == 9, F.col("input_ids")).otherwise(rej)
    return v.select("vec_id", F.expr(f"vec_id div {SEQ_BATCH}").alias("batch_id"),
                    F.col("input_ids").alias("chosen_ids"), rej.alias("rejected_ids"),
                    F.slice("e", 17, L).alias("chosen_reward"), F.slice("e", 33, L).alias("rejected_reward"))


def pair_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    r = p.select("vec_id", "batch_id", pairwise_loss(
        F.col("chosen_ids"), F.col("rejected_ids"), F.col("chosen_reward"),
        F.col("rejected_reward"), PAD).alias("r"))
    return r.select("vec_id", "batch_id", "r.divergence", "r.end_ind",
                    round_to("r.loss", 6).alias("loss"),
                    round_to("r.chosen_end_score", 6).alias("chosen_end_score"),
                    round_to("r.rejected_end_score", 6).alias("rejected_end_score"))


def pair_loss_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    r = p.select("batch_id", pairwise_loss(
        F.col("chosen_ids"), F.col("rejected_ids"), F.col("chosen_reward"),
        F.col("rejected_reward"), PAD)["loss"].alias("loss"))
    return r.groupBy("batch_id").agg(round_to(F.avg("loss"), 6).alias("loss"),
                                     F.count(F.lit(1)).alias("n_pairs"))


def end_score_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rollout_view(spark, sf_dir)
    return v.select("vec_id", round_to(end_score(F.col("input_ids"), F.slice("e", 1, L), F.col("P"),
                                                 PAD), 6).alias("end_score"))


def short_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequences with more than one non-pad answer token are kept."""
    v = rollout_view(spark, sf_dir)
    n = valid_answer_len(F.col("input_ids"), F.col("P"), PAD)
    return v.select("vec_id", n.alias("valid_ans_len")).filter(F.col("valid_ans_len") > 1)


# ------------------------------------------------------------------ oracle SQL

_RAW = "(CAST(floor(abs(e[i + 1]) * 1000) AS INTEGER) % 100)"
SQL_VIEW = f"""r0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, 4 + label % 4 AS P FROM embeddings),
v0 AS (SELECT *, list_transform(range({L}), lambda i: CASE WHEN i < P + label THEN 1 + {_RAW} ELSE {PAD} END) AS ids,
              list_transform(range({L}), lambda i: CASE WHEN i < P + label THEN 1 ELSE 0 END) AS am,
              list_transform(e[17:31], lambda x: -abs(x)) AS lp,
              list_transform(e[32:46], lambda x: -abs(x)) AS ref,
              e[47:61] AS val,
              (e[62] + e[63] + e[64]) * 20.0 AS score FROM r0),
v1 AS (SELECT *, am[2:] AS mask, P - 1 AS st FROM v0),
v2 AS (SELECT *, st + CAST(list_sum(mask[st + 1:]) AS INTEGER) + 1 AS en FROM v1),
v3 AS (SELECT *, list_transform(range({L - 1}), lambda j: CASE WHEN j = least(en, {L - 1}) - 1
                   THEN -0.1 * (lp[j + 1] - ref[j + 1]) + greatest(least(score, 5.0), -5.0)
                   ELSE -0.1 * (lp[j + 1] - ref[j + 1]) END) AS rw FROM v2),
v AS (SELECT *, list_transform(range({L - 1}), lambda j: CASE WHEN j >= en THEN 0.0 ELSE rw[j + 1] END) AS rz,
             list_transform(range({L - 1}), lambda j: CASE WHEN j >= en THEN 0.0 ELSE val[j + 1] END) AS vz
      FROM v3)"""

_DELTA = f"(rz[k + 1] + 1.0 * (CASE WHEN k < {L - 2} THEN vz[k + 2] ELSE 0.0 END) - vz[k + 1])"
SQL_GAE_CTE = f"""{SQL_VIEW},
g AS (SELECT *, list_transform(range(st, {L - 1}), lambda t: list_sum(list_transform(range(t, {L - 1}),
        lambda k: pow(0.95, k - t) * {_DELTA}))) AS adv FROM v)"""

SQL_LABEL_LOGPROB = """WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, round(e[label + 1] - list_max(e) - ln(list_sum(list_transform(e, lambda v: exp(v - list_max(e))))), 6)
       AS logprob FROM x"""

SQL_TOKEN_NLL = f"""WITH x AS (SELECT vec_id // {NLL_SEQ} AS seq_id, vec_id % {NLL_SEQ} AS pos,
                       CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
n AS (SELECT *, lead(label) OVER (PARTITION BY seq_id ORDER BY pos) AS nl FROM x),
lp AS (SELECT seq_id, e[nl + 1] - list_max(e) - ln(list_sum(list_transform(e, lambda v: exp(v - list_max(e))))) AS lp
       FROM n WHERE nl IS NOT NULL AND nl <> -100)
SELECT seq_id, round(-avg(lp), 6) AS loss, count(*) AS n_tokens FROM lp GROUP BY seq_id"""

SQL_KL = f"""WITH {SQL_VIEW}
SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos, round(rw[p], 6) AS reward
FROM (SELECT vec_id, rw, unnest(range(1, {L})) AS p FROM v)"""

SQL_ZERO = f"""WITH {SQL_VIEW}
SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos, round(rz[p], 6) AS reward, round(vz[p], 6) AS value
FROM (SELECT vec_id, rz, vz, unnest(range(1, {L})) AS p FROM v)"""

SQL_GAE = f"""WITH {SQL_GAE_CTE}
SELECT vec_id, CAST(st + k - 1 AS INTEGER) AS pos, round(adv[k], 6) AS advantage,
       round(adv[k] + vz[st + k], 6) AS return_
FROM (SELECT vec_id, st, adv, vz, unnest(range(1, len(adv) + 1)) AS k FROM g)"""

SQL_POLICY = f"""WITH {SQL_GAE_CTE},
t AS (SELECT vec_id // {SEQ_BATCH} AS batch_id, st, adv, lp, mask,
             list_transform(e[1:{L - 1}], lambda x: -abs(x)) AS nl FROM g),
u AS (SELECT batch_id, list_transform(range(st, {L - 1}), lambda k:
        CAST(mask[k + 1] AS DOUBLE) * greatest(-adv[k - st + 1] * exp((nl[k + 1] - lp[k + 1]) * CAST(mask[k + 1] AS DOUBLE)),
                 -adv[k - st + 1] * least(greatest(exp((nl[k + 1] - lp[k + 1]) * CAST(mask[k + 1] AS DOUBLE)), 0.8), 1.2))) AS terms,
        mask[st + 1:] AS m FROM t)
SELECT batch_id, round(sum(list_sum(terms)) / sum(list_sum(m)), 6) AS policy_loss FROM u GROUP BY batch_id"""

SQL_VALUE = f"""WITH {SQL_GAE_CTE},
t AS (SELECT vec_id // {SEQ_BATCH} AS batch_id, st, adv, vz, mask, e[1:{L - 1}] AS nv FROM g),
u AS (SELECT batch_id, list_transform(range(st, {L - 1}), lambda k:
        CAST(mask[k + 1] AS DOUBLE) * greatest((nv[k + 1] - (adv[k - st + 1] + vz[k + 1])) * (nv[k + 1] - (adv[k - st + 1] + vz[k + 1])),
          (least(greatest(nv[k + 1], vz[k + 1] - 0.2), vz[k + 1] + 0.2) - (adv[k - st + 1] + vz[k + 1]))
          * (least(greatest(nv[k + 1], vz[k + 1] - 0.2), vz[k + 1] + 0.2) - (adv[k - st + 1] + vz[k + 1])))) AS terms,
        mask[st + 1:] AS m FROM t)
SELECT batch_id, round(0.5 * sum(list_sum(terms)) / sum(list_sum(m)), 6) AS value_loss FROM u GROUP BY batch_id"""

SQL_PAIRS_CTE = f"""{SQL_VIEW},
pp AS (SELECT vec_id, vec_id // {SEQ_BATCH} AS batch_id, ids AS c,
        CASE WHEN label = 9 THEN ids ELSE list_transform(range({L}), lambda i:
          CASE WHEN i < 1 + label % 5 THEN ids[i + 1] WHEN i < P + (label * 3) % 10 THEN 1 + ({_RAW} + 7) % 100
               ELSE {PAD} END) END AS rj,
        e[17:{16 + L}] AS cr, e[33:{32 + L}] AS rr FROM v),
pq AS (SELECT *, coalesce(list_position(c, {PAD}) - 1, {L}) AS c_ind,
              coalesce(list_position(rj, {PAD}) - 1, {L}) AS r_pad,
              list_filter(range({L}), lambda i: c[i + 1] <> rj[i + 1]) AS diff FROM pp),
pr AS (SELECT *, CASE WHEN len(diff) = 0 THEN {L} ELSE greatest(c_ind, r_pad) END AS end_ind,
              CASE WHEN len(diff) = 0 THEN {L} - 1 ELSE diff[1] END AS divergence,
              CASE WHEN len(diff) = 0 THEN c_ind ELSE r_pad END AS r_ind FROM pq),
ps AS (SELECT *, list_transform(range(divergence, end_ind), lambda i:
          least(cr[i + 1] - rr[i + 1], 0.0) - ln(1.0 + exp(-abs(cr[i + 1] - rr[i + 1])))) AS ls FROM pr)"""

SQL_PAIR = f"""WITH {SQL_PAIRS_CTE}
SELECT vec_id, batch_id, CAST(divergence AS INTEGER) AS divergence, CAST(end_ind AS INTEGER) AS end_ind,
       round(-list_sum(ls) / len(ls), 6) AS loss, round(cr[c_ind], 6) AS chosen_end_score,
       round(rr[r_ind], 6) AS rejected_end_score FROM ps"""

SQL_PAIR_BATCH = f"""WITH {SQL_PAIRS_CTE}
SELECT batch_id, round(avg(-list_sum(ls) / len(ls)), 6) AS loss, count(*) AS n_pairs FROM ps GROUP BY batch_id"""

SQL_END_SCORE = f"""WITH {SQL_VIEW},
x AS (SELECT vec_id, e[1:{L}] AS vals, P, list_position(ids[P + 1:], {PAD}) AS fp FROM v)
SELECT vec_id, round(vals[CASE WHEN fp IS NULL THEN {L} ELSE fp - 1 + P END], 6) AS end_score FROM x"""

SQL_SHORT = f"""WITH {SQL_VIEW},
x AS (SELECT vec_id, CAST(len(list_filter(ids[P + 1:], lambda t: t <> {PAD})) AS INTEGER) AS valid_ans_len FROM v)
SELECT vec_id, valid_ans_len FROM x WHERE valid_ans_len > 1"""

QUERIES = {
    "label_logprob": (label_logprob, SQL_LABEL_LOGPROB),
    "token_nll": (token_nll, SQL_TOKEN_NLL),
    "kl_rewards": (kl_rewards_q, SQL_KL),
    "zero_after_end": (zero_after_end, SQL_ZERO),
    "gae": (gae, SQL_GAE),
    "policy_loss": (policy_loss, SQL_POLICY),
    "value_loss": (value_loss, SQL_VALUE),
    "pair_loss": (pair_loss, SQL_PAIR),
    "pair_loss_batch": (pair_loss_batch, SQL_PAIR_BATCH),
    "end_score": (end_score_q, SQL_END_SCORE),
    "short_answers": (short_answers, SQL_SHORT),
}
