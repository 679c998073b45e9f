import math
import random

from pyspark.sql import functions as F

from tuneweave.functions.perf import checkpoint_factor, scheduled_lr, train_flops
from tuneweave.operators.scans import exponential_mean, running_sums, sequence_positions
from tuneweave.operators.trainlog import (cumulative_mean, dice_by_class, ema, eval_perplexity,
                                          report_buckets)


def _log(spark, epochs=2, steps=250, ranks=(0, 1)):
    rng = random.Random(3)
    rows = [(e, s, r, round(rng.uniform(0, 5), 3), rng.randint(1, 8))
            for r in ranks for e in range(epochs) for s in range(steps)]
    return rows, spark.createDataFrame(rows, "epoch int, step int, rank int, loss double, n int")


def test_report_buckets_sizes_and_means(spark):
    rows, df = _log(spark)
    out = report_buckets(df, F.col("step") % 100 == 0).filter("rank = 0").orderBy("bucket").collect()
    assert [r.n_rows for r in out] == [1, 100, 100, 50, 100, 100]
    # plain restatement of the reference loop
    want, s, c = [], 0.0, 0
    for e, st, r, loss, n in sorted(x for x in rows if x[2] == 0):
        s += loss * n
        c += n
        if st % 100 == 0:
            want.append(round(s / c, 5))
            s, c = 0.0, 0
    assert [r.avg_loss for r in out] == want


def test_running_sums_multi_level_chunks(spark):
    rows = [(k, i, float(i % 7)) for k in range(2) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, t long, v double")
    out = running_sums(df, ["k"], "t", {"s": F.col("v")}, chunk=4)
    got = {(r.k, r.t): r.s for r in out.collect()}
    for k in range(2):
        acc = 0.0
        for i in range(150):
            acc += float(i % 7)
            assert got[(k, i)] == acc
    ex = running_sums(df, ["k"], "t", {"s": F.col("v")}, chunk=5, exclusive=True).collect()
    assert {(r.k, r.t): r.s for r in ex}[(1, 0)] == 0.0


def test_cumulative_mean_and_ema_match_sequential(spark):
    rows, df = _log(spark, epochs=1, steps=2500, ranks=(0,))
    cm = {r.step: r.cum_mean for r in cumulative_mean(df).collect()}
    em = {r.step: r.ema for r in ema(df, alpha=0.9).collect()}
    total, prev = 0.0, None
    for i, (_, st, _, loss, _) in enumerate(sorted(rows, key=lambda x: x[1])):
        total += loss
        assert math.isclose(cm[st], total / (i + 1), rel_tol=1e-12)
        p = loss if prev is None else prev
        prev = 0.9 * p + (1.0 - 0.9) * loss
        assert math.isclose(em[st], prev, rel_tol=1e-12)


def test_eval_perplexity_two_level_mean(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 1.0)], "rank int, loss double")
    r = eval_perplexity(df).first()
    assert r.eval_loss == 1.5 and math.isclose(r.perplexity, math.exp(1.5))
    big = spark.createDataFrame([(0, 1000.0)], "rank int, loss double")
    assert eval_perplexity(big).first().perplexity == float("inf")


def test_flops_formula_and_lr_schedule(spark):
    df = spark.createDataFrame([(True, 128, 4096), (False, 0, 1024)], "ck boolean, lora int, h int")
    out = df.select(train_flops(checkpoint_factor(F.col("ck"), F.col("lora"), F.col("h")), F.lit(8),
                                F.lit(256), F.lit(32), F.col("h"), F.lit(32000)).alias("f")).collect()
    assert math.isclose(out[0].f, 82889043607552.0, rel_tol=1e-12)
    assert math.isclose(out[1].f, 5455950643200.0, rel_tol=1e-12)

    its = spark.range(60).select(F.col("id").alias("it"))
    got = {r.it: r.lr for r in its.select("it", scheduled_lr(F.col("it"), 1e-4, 1e-2, 1e-4, 10, 50)
                                             .alias("lr")).collect()}
    # warm-up by equal steps, cosine half way down at 30, the floor from 50 on
    for it, lr in ((0, 0.0001), (5, 0.00505), (10, 0.01), (30, 0.00505), (50, 0.0001), (59, 0.0001)):
        assert math.isclose(got[it], lr, rel_tol=1e-9)
    assert all(a >= b for a, b in zip([got[i] for i in range(10, 59)], [got[i] for i in range(11, 60)]))


def test_dice_mean_over_batches(spark):
    rows = [(0, 0, 1.0, 1.0), (0, 0, 0.0, 1.0), (1, 0, 0.5, 0.0), (0, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "batch_id int, class int, p double, t double")
    got = {r["class"]: r.dice for r in dice_by_class(df).collect()}
    d0 = (2 * 1 + 1) / (1 + 2 + 1)
    d1 = (0 + 1) / (0.5 + 0 + 1)
    assert got[0] == round((d0 + d1) / 2, 4)
    assert got[1] == 1.0


def test_exponential_mean_several_keys(spark):
    rows = [(k, t, float((t * 7 + k) % 11)) for k in range(3) for t in range(400)]
    df = spark.createDataFrame(rows, "k int, t long, x double")
    out = {(r.k, r.t): r.ema for r in exponential_mean(df, ["k"], "t", F.col("x"), 0.5).collect()}
    for k in range(3):
        prev = None
        for t in range(400):
            x = float((t * 7 + k) % 11)
            p = x if prev is None else prev
            prev = 0.5 * p + 0.5 * x
            assert math.isclose(out[(k, t)], prev, rel_tol=1e-12)


def test_sequence_positions_dense(spark):
    df = spark.createDataFrame([(k, v) for k in range(3) for v in range(0, 30, 3)], "k int, v int")
    out = sequence_positions(df, ["k"], ["v"]).collect()
    assert all(r.t == r.v // 3 for r in out)


def test_rlhf_batch_size_divergence_flag(spark):
    from tuneweave.plans.q_trainlog import rlhf_tflops

    sf = "/root/testdata/sf0.001"
    base = {r.step: r.samples_per_sec for r in rlhf_tflops(spark, sf).limit(5).collect()}
    doubled = {r.step: r.samples_per_sec for r in rlhf_tflops(spark, sf, unsupervised=True).collect()
               if r.step in base}
    ref = {r.step: r.samples_per_sec for r in rlhf_tflops(spark, sf, unsupervised=True,
                                                          as_reference=True).collect() if r.step in base}
    for s, v in base.items():
        assert math.isclose(doubled[s], 2 * v, rel_tol=1e-6, abs_tol=1e-6)
    secs = {r.event_id: r.value / 100.0 for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    for s in base:
        assert math.isclose(ref[s], round(2.0 / secs[s], 6), rel_tol=1e-9)


def test_running_sums_do_not_depend_on_chunks(spark):
    from fractions import Fraction

    rng = random.Random(9)
    xs = [rng.choice([rng.uniform(-1, 1) * 10.0 ** rng.randint(-16, 18), 0.1, -0.1, 1e16, -1e16, 2.0 ** -60]) for _ in range(700)]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)] + [(1, 0, None), (1, 1, 0.5)], "k int, t long, v double")
    runs = []
    for chunk in (16, 100, 1024):
        for parts in (1, 5):
            out = running_sums(df.repartition(parts), ["k"], "t", {"s": F.col("v")}, chunk=chunk, exact=True)
            runs.append({(r.k, r.t): r.s for r in out.collect()})
    assert all(r == runs[0] for r in runs)  # bit for bit
    exact = Fraction(0)
    for i, x in enumerate(xs):
        exact += Fraction(x)
        assert abs(Fraction(runs[0][(0, i)]) - exact) <= abs(exact) * Fraction(1, 2 ** 51) + Fraction(1, 2 ** 100)
    assert runs[0][(1, 0)] == 0.0 and runs[0][(1, 1)] == 0.5
    odd = spark.createDataFrame([(0, 0, 1.0), (0, 1, float("inf")), (0, 2, -1e300), (0, 3, float("-inf"))],
                                "k int, t long, v double")
    got = [r.s for r in running_sums(odd, ["k"], "t", {"s": F.col("v")}, chunk=2, exact=True).orderBy("t").collect()]
    assert got[:3] == [1.0, math.inf, math.inf] and math.isnan(got[3])


def test_exponential_mean_for_slow_alphas_and_any_chunk(spark):
    rng = random.Random(4)
    xs = {k: [rng.uniform(0, 5) for _ in range(n)] for k, n in ((0, 5000), (1, 1), (2, 1024), (3, 1025))}
    df = spark.createDataFrame([(k, i, x) for k, v in xs.items() for i, x in enumerate(v)], "k int, t long, x double")
    for alpha in (0.5, 0.9, 0.999999):
        for chunk in (16, 1024):
            got = {(r.k, r.t): r.ema for r in exponential_mean(df, ["k"], "t", F.col("x"), alpha, chunk=chunk).collect()}
            assert len(got) == df.count()
            for k, v in xs.items():
                y = v[0]
                for i, x in enumerate(v):
                    y = alpha * y + (1 - alpha) * x
                    assert math.isclose(got[(k, i)], y, rel_tol=1e-12)
    went_on = exponential_mean(df.filter("k = 1"), ["k"], "t", F.col("x"), 0.9, initial=F.lit(2.0)).first().ema
    assert math.isclose(went_on, 0.9 * 2.0 + 0.1 * xs[1][0], rel_tol=1e-12)


def test_exponential_mean_sends_every_row_once(spark):
    """No halo: the one exchange of the rows before the recurrence has each row once."""
    df = spark.range(4000).selectExpr("0 as k", "id as t", "double(id) as x")
    plan = exponential_mean(df, ["k"], "t", F.col("x"), 0.99, chunk=8192)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") == 1
