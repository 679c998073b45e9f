"""Registered queries: training-log metrics (M1-M10) and scalar series (K4)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_to

from ..functions.perf import checkpoint_factor, scheduled_lr, tflops, train_flops
from ..operators.trainlog import (cumulative_mean, dice_by_class, ema, eval_perplexity,
                                  report_buckets, throughput)
from ..sinks.metrics import scalar_series
from .tables import eval_log, step_log, table

REPORT_EVERY = 100
THROUGHPUT_EVERY = 1000
MAX_SEQ_LEN = 256
EMA_ALPHA = 0.9

# run configuration per event type (the run a step belongs to):
# layers, hidden, vocab, gpus, lora_dim, gradient checkpointing
RUN_CONFIGS = [
    ("click", 24, 1024, 50272, 8, 0, False),
    ("view", 32, 4096, 151936, 8, 128, True),
    ("error", 24, 2048, 32000, 4, 0, True),
    ("purchase", 40, 5120, 32000, 16, 64, False),
    ("signup", 28, 3584, 152064, 8, 0, False),
]
CONFIG_COLS = ["event_type", "num_layers", "hidden_size", "vocab_size", "gpus", "lora_dim",
               "checkpointing"]

# step-3 run parameters (actor, critic, generation)
ACTOR = dict(layers=32, hidden=4096, vocab=32000, lora=128, ckpt=True, params=6.7e9, num_bytes=2)
CRITIC = dict(layers=24, hidden=1024, vocab=50272, lora=0, ckpt=True)
GPUS = 8
MAX_PROMPT, MAX_ANSWER = 256, 256
GENERATION_BATCHES, PPO_EPOCHS = 1, 1
GEN_SHARE = 0.6  # share of a step's wall time spent generating

LR_CFG = dict(init_lr=1e-4, base_lr=1e-2, min_lr=1e-4, warmup_iters=10, lr_decay_iters=50)
LR_EVERY = 100  # one scheduler iteration per 100 logged steps
DICE_BATCH = 32


def loss_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = step_log(spark, sf_dir)
    return report_buckets(log, F.col("step") % REPORT_EVERY == 0)


def loss_cumavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cumulative_mean(step_log(spark, sf_dir)).select(
        "rank", "step", round_to("cum_mean", 6).alias("cum_mean"))


def loss_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ema(step_log(spark, sf_dir), alpha=EMA_ALPHA).select(
        "rank", "step", round_to("ema", 6).alias("ema"))


def eval_perplexity_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_perplexity(eval_log(spark, sf_dir)).select(
        round_to("eval_loss", 6).alias("eval_loss"), round_to("perplexity", 6).alias("perplexity"))


def throughput_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = step_log(spark, sf_dir)
    rep = (F.col("rank") == 0) & (F.col("step") % THROUGHPUT_EVERY == 0)
    return throughput(log, MAX_SEQ_LEN, report=rep).select(
        "step", "rank", "tokens_per_sec", "samples_per_sec", "reported")


def tflops_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = step_log(spark, sf_dir)
    cfg = spark.createDataFrame(RUN_CONFIGS, CONFIG_COLS)
    # a literal table of len(RUN_CONFIGS) rows: broadcasting it is bounded
    # and a step of an unknown run type stays, with a null rate
    j = log.join(F.broadcast(cfg), "event_type", "left")
    f = checkpoint_factor(F.col("checkpointing"), F.col("lora_dim"), F.col("hidden_size"))
    flops = train_flops(f, F.col("n"), F.lit(MAX_SEQ_LEN), F.col("num_layers"),
                        F.col("hidden_size"), F.col("vocab_size"))
    return j.select(
        "step", "event_type",
        round_to(tflops(flops, F.col("seconds"), F.col("gpus")), 6).alias("tflops"),
        round_to(F.try_divide(F.col("n").cast("double"), F.col("seconds")), 6).alias("samples_per_sec"),
        round_to(F.try_divide(F.col("seconds"), F.col("n").cast("double")), 6).alias("time_per_seq"))


def rlhf_tflops(spark: SparkSession, sf_dir: str, unsupervised: bool = False,
                as_reference: bool = False) -> DataFrame:
    """M8 per logged step. D8: with unsupervised data the batch is doubled
    (``as_reference=True`` reproduces the reference's parse, batch = 2)."""
    log = step_log(spark, sf_dir)
    seq = MAX_PROMPT + MAX_ANSWER
    n = F.col("n").cast("double")
    batch = n * GENERATION_BATCHES * PPO_EPOCHS * GPUS
    if unsupervised:
        batch = F.lit(2.0) if as_reference else batch * 2
    e2e = F.col("seconds")
    gen_t = e2e * GEN_SHARE
    train_t = e2e * (1.0 - GEN_SHARE)
    fa = checkpoint_factor(F.lit(ACTOR["ckpt"]), F.lit(ACTOR["lora"]), F.lit(ACTOR["hidden"]))
    fc = checkpoint_factor(F.lit(CRITIC["ckpt"]), F.lit(CRITIC["lora"]), F.lit(CRITIC["hidden"]))
    a_fl = train_flops(fa, batch, F.lit(seq), F.lit(ACTOR["layers"]), F.lit(ACTOR["hidden"]),
                       F.lit(ACTOR["vocab"]))
    c_fl = train_flops(fc, batch, F.lit(seq), F.lit(CRITIC["layers"]), F.lit(CRITIC["hidden"]),
                       F.lit(CRITIC["vocab"]))
    total_train = a_fl + c_fl
    gen_bs = n * GPUS
    gen_fl = train_flops(F.lit(1.0), gen_bs, F.lit(seq), F.lit(ACTOR["layers"]),
                         F.lit(ACTOR["hidden"]), F.lit(ACTOR["vocab"]))
    pertok = gen_t / MAX_ANSWER
    gen_bw = F.try_divide(F.lit(1.0), pertok) * F.lit(ACTOR["params"]) * ACTOR["num_bytes"] / 1e9
    total = total_train + gen_fl * GENERATION_BATCHES
    g = F.lit(float(GPUS))
    return log.select(
        "step",
        round_to(tflops(total, e2e, g), 6).alias("e2e_tflops"),
        round_to(tflops(gen_fl, gen_t, g), 6).alias("gen_tflops"),
        round_to(tflops(total_train, train_t, g), 6).alias("train_tflops"),
        round_to(pertok * 1000, 6).alias("pertok_latency_ms"),
        round_to(gen_bw, 6).alias("gen_bw"),
        round_to(F.try_divide(batch, e2e), 6).alias("samples_per_sec"))


def lr_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = step_log(spark, sf_dir)
    it = F.expr(f"step div {LR_EVERY}")
    lr = scheduled_lr(it, **LR_CFG)
    phase = (F.when(it < LR_CFG["warmup_iters"], "warmup")
             .when(it > LR_CFG["lr_decay_iters"], "floor").otherwise("cosine"))
    return log.select("step", it.alias("it"), round_to(lr, 12).alias("lr"), phase.alias("phase"))


def dice_by_class_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    long = emb.select(F.expr(f"vec_id div {DICE_BATCH}").alias("batch_id"), "label",
                      F.posexplode("embedding").alias("class", "e"))
    long = long.select(
        "batch_id", "class",
        F.least(F.abs(F.col("e").cast("double")) * 5.0, F.lit(1.0)).alias("p"),
        F.when(F.col("label") == F.col("class"), 1.0).otherwise(0.0).alias("t"))
    return dice_by_class(long)


def scalar_series_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = loss_buckets(spark, sf_dir)
    it = F.expr(f"report_step div {LR_EVERY}")
    wide = b.select("rank", F.col("report_step").alias("global_step"), "avg_loss",
                    F.when(F.col("rank") == 0, scheduled_lr(it, **LR_CFG)).alias("lr"))
    s = scalar_series(wide, {"loss": "avg_loss", "lr": "lr"}, keys=["rank"])
    tag = F.when(F.col("tag") == "loss", F.concat(F.lit("0_Train/rank-"), F.col("rank").cast("string"),
                                                  F.lit("_loss"))).otherwise(F.lit("0_Train/lr"))
    return s.select(tag.alias("tag"), round_to("value", 9).alias("value"), "global_step")


# ------------------------------------------------------------------ oracle SQL

def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


SQL_LOG = ("log AS (SELECT 0 AS epoch, event_id AS step, CAST(user_id % 4 AS INTEGER) AS rank, "
           "value AS loss, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n, "
           "value / 100.0 AS seconds, event_type FROM events)")

SQL_BUCKETS = f"""WITH {SQL_LOG},
b AS (SELECT *, CAST(step % {REPORT_EVERY} = 0 AS INTEGER) AS r,
             CAST(coalesce(sum(CAST(step % {REPORT_EVERY} = 0 AS INTEGER)) OVER (PARTITION BY rank
               ORDER BY epoch, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bucket
      FROM log)
SELECT rank, bucket, max(epoch) FILTER (WHERE r = 1) AS report_epoch,
       max(step) FILTER (WHERE r = 1) AS report_step, count(*) AS n_rows,
       round(sum(loss * n) / nullif(sum(n), 0), 5) AS avg_loss
FROM b GROUP BY rank, bucket HAVING sum(r) > 0"""

SQL_CUMAVG = f"""WITH RECURSIVE {SQL_LOG},
s AS (SELECT rank, step, loss, row_number() OVER (PARTITION BY rank ORDER BY epoch, step) - 1 AS t FROM log),
r AS (SELECT rank, t, step, loss AS total FROM s WHERE t = 0
      UNION ALL
      SELECT s.rank, s.t, s.step, r.total + s.loss FROM r JOIN s ON s.rank = r.rank AND s.t = r.t + 1)
SELECT rank, step, round(total / (t + 1), 6) AS cum_mean FROM r"""

SQL_EMA = f"""WITH RECURSIVE {SQL_LOG},
s AS (SELECT rank, step, loss, row_number() OVER (PARTITION BY rank ORDER BY epoch, step) - 1 AS t FROM log),
r AS (SELECT rank, t, step, {dbl(EMA_ALPHA)} * loss + {dbl(1.0 - EMA_ALPHA)} * loss AS ema FROM s WHERE t = 0
      UNION ALL
      SELECT s.rank, s.t, s.step, {dbl(EMA_ALPHA)} * r.ema + {dbl(1.0 - EMA_ALPHA)} * s.loss
      FROM r JOIN s ON s.rank = r.rank AND s.t = r.t + 1)
SELECT rank, step, round(ema, 6) AS ema FROM r"""

SQL_EVAL = """WITH pr AS (SELECT CAST(user_id % 4 AS INTEGER) AS rank, avg(value / 10.0) AS l FROM events GROUP BY 1)
SELECT round(avg(l), 6) AS eval_loss, round(exp(avg(l)), 6) AS perplexity FROM pr"""

SQL_THROUGHPUT = f"""WITH {SQL_LOG}
SELECT step, rank, round((n * {dbl(float(MAX_SEQ_LEN))}) / nullif(seconds, 0), 4) AS tokens_per_sec,
       round(CAST(n AS DOUBLE) / nullif(seconds, 0), 4) AS samples_per_sec,
       (rank = 0 AND step % {THROUGHPUT_EVERY} = 0) AS reported FROM log"""


def _sql_factor(ckpt: str, lora: str, hidden: str) -> str:
    base = f"(CASE WHEN {ckpt} THEN {dbl(4.0)} ELSE {dbl(3.0)} END)"
    return f"(CASE WHEN {lora} > 0 THEN {base} - ({dbl(1.0)} - {lora} * 2 / {hidden}) ELSE {base} END)"


def _sql_flops(f: str, b: str, s: str, L: str, h: str, V: str) -> str:
    return (f"(({dbl(24.0)} * {f} * {b} * {s} * {L} * {h} * {h}) * ({dbl(1.0)} + {s} / ({dbl(6.0)} * {h})"
            f" + {V} / ({dbl(16.0)} * {L} * {h})))")


_CFG_VALUES = ", ".join(f"('{e}', {l}, {h}, {v}, {g}, {lo}, {str(c).lower()})"
                        for e, l, h, v, g, lo, c in RUN_CONFIGS)
SQL_TFLOPS = f"""WITH {SQL_LOG},
cfg({', '.join(CONFIG_COLS)}) AS (VALUES {_CFG_VALUES}),
j AS (SELECT log.*, cfg.num_layers, cfg.hidden_size, cfg.vocab_size, cfg.gpus, cfg.lora_dim, cfg.checkpointing
      FROM log LEFT JOIN cfg ON log.event_type = cfg.event_type)
SELECT step, event_type,
  round({_sql_flops(_sql_factor('checkpointing', 'lora_dim', 'hidden_size'), 'n', str(MAX_SEQ_LEN),
                    'num_layers', 'hidden_size', 'vocab_size')} / nullif(seconds * gpus * {dbl(1e12)}, 0), 6) AS tflops,
  round(CAST(n AS DOUBLE) / nullif(seconds, 0), 6) AS samples_per_sec,
  round(seconds / nullif(CAST(n AS DOUBLE), 0), 6) AS time_per_seq
FROM j"""


def _sql_rlhf() -> str:
    seq = MAX_PROMPT + MAX_ANSWER
    batch = f"(CAST(n AS DOUBLE) * {GENERATION_BATCHES} * {PPO_EPOCHS} * {GPUS})"
    fa = _sql_factor(str(ACTOR["ckpt"]).lower(), str(ACTOR["lora"]), str(ACTOR["hidden"]))
    fc = _sql_factor(str(CRITIC["ckpt"]).lower(), str(CRITIC["lora"]), str(CRITIC["hidden"]))
    a_fl = _sql_flops(fa, batch, str(seq), str(ACTOR["layers"]), str(ACTOR["hidden"]), str(ACTOR["vocab"]))
    c_fl = _sql_flops(fc, batch, str(seq), str(CRITIC["layers"]), str(CRITIC["hidden"]), str(CRITIC["vocab"]))
    gen_fl = _sql_flops(dbl(1.0), f"(CAST(n AS DOUBLE) * {GPUS})", str(seq), str(ACTOR["layers"]),
                        str(ACTOR["hidden"]), str(ACTOR["vocab"]))
    g = dbl(float(GPUS))
    gen_t = f"(seconds * {dbl(GEN_SHARE)})"
    train_t = f"(seconds * {dbl(1.0 - GEN_SHARE)})"
    pertok = f"({gen_t} / {MAX_ANSWER})"
    return f"""WITH {SQL_LOG},
x AS (SELECT step, seconds, {a_fl} + {c_fl} AS train_fl, {gen_fl} AS gen_fl, {batch} AS batch FROM log)
SELECT step,
  round((train_fl + gen_fl * {GENERATION_BATCHES}) / nullif(seconds * {g} * {dbl(1e12)}, 0), 6) AS e2e_tflops,
  round(gen_fl / nullif({gen_t} * {g} * {dbl(1e12)}, 0), 6) AS gen_tflops,
  round(train_fl / nullif({train_t} * {g} * {dbl(1e12)}, 0), 6) AS train_tflops,
  round({pertok} * 1000, 6) AS pertok_latency_ms,
  round({dbl(1.0)} / nullif({pertok}, 0) * {dbl(ACTOR['params'])} * {ACTOR['num_bytes']} / {dbl(1e9)}, 6) AS gen_bw,
  round(batch / nullif(seconds, 0), 6) AS samples_per_sec
FROM x"""


def _sql_lr(it: str) -> str:
    c = LR_CFG
    ratio = f"(({it} - {c['warmup_iters']}) / {dbl(float(c['lr_decay_iters'] - c['warmup_iters']))})"
    coeff = f"({dbl(0.5)} * ({dbl(1.0)} + cos({dbl(math.pi)} * {ratio})))"
    return (f"(CASE WHEN {it} < {c['warmup_iters']} THEN {dbl(c['init_lr'])} + "
            f"{dbl(c['base_lr'] - c['init_lr'])} * {it} / {dbl(float(c['warmup_iters']))} "
            f"WHEN {it} > {c['lr_decay_iters']} THEN {dbl(c['min_lr'])} "
            f"ELSE {dbl(c['min_lr'])} + {coeff} * {dbl(c['base_lr'] - c['min_lr'])} END)")


SQL_LR = f"""WITH {SQL_LOG}, i AS (SELECT step, step // {LR_EVERY} AS it FROM log)
SELECT step, it, round({_sql_lr('it')}, 12) AS lr,
  CASE WHEN it < {LR_CFG['warmup_iters']} THEN 'warmup' WHEN it > {LR_CFG['lr_decay_iters']} THEN 'floor'
       ELSE 'cosine' END AS phase FROM i"""

SQL_DICE = f"""WITH l AS (SELECT vec_id // {DICE_BATCH} AS batch_id, label, c AS class,
       least(abs(CAST(embedding[c + 1] AS DOUBLE)) * 5.0, 1.0) AS p,
       CASE WHEN label = c THEN 1.0 ELSE 0.0 END AS t
  FROM (SELECT vec_id, embedding, label, unnest(range(0, len(embedding))) AS c FROM embeddings)),
per AS (SELECT batch_id, class, ({dbl(2.0)} * sum(p * t) + 1) / (sum(p) + sum(t) + 1) AS d FROM l GROUP BY 1, 2)
SELECT CAST(class AS INTEGER) AS class, round(avg(d), 4) AS dice FROM per GROUP BY class"""

SQL_SERIES = f"""WITH b AS ({SQL_BUCKETS}),
lr AS (SELECT rank, report_step, avg_loss, CASE WHEN rank = 0 THEN {_sql_lr(f'(report_step // {LR_EVERY})')} END AS lr FROM b)
SELECT '0_Train/rank-' || CAST(rank AS VARCHAR) || '_loss' AS tag, round(avg_loss, 9) AS value,
       report_step AS global_step FROM lr WHERE avg_loss IS NOT NULL
UNION ALL
SELECT '0_Train/lr' AS tag, round(lr, 9) AS value, report_step AS global_step FROM lr WHERE lr IS NOT NULL"""

QUERIES = {
    "loss_buckets": (loss_buckets, SQL_BUCKETS),
    "loss_cumavg": (loss_cumavg, SQL_CUMAVG),
    "loss_ema": (loss_ema, SQL_EMA),
    "eval_perplexity": (eval_perplexity_q, SQL_EVAL),
    "throughput": (throughput_q, SQL_THROUGHPUT),
    "tflops": (tflops_q, SQL_TFLOPS),
    "rlhf_tflops": (rlhf_tflops, _sql_rlhf()),
    "lr_audit": (lr_audit, SQL_LR),
    "dice_by_class": (dice_by_class_q, SQL_DICE),
    "scalar_series": (scalar_series_q, SQL_SERIES),
}
