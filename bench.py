"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query seconds (full evaluation through the
no-op sink, nothing collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tuneweave.plans.catalog import registry  # noqa: E402
from tuneweave.session import get_spark  # noqa: E402

HEADLINE = [
    "vocab_ids", "sft_tokens", "sft_system_tokens", "pad_clip_right", "pack_blocks",
    "exact_split", "blend_shuffle", "rank_shards", "adapter_openai_webgpt_comparisons",
    "adapter_dahoas_rm_static", "phase1_labels", "reward_rows", "prompt_left_pad",
    "token_cache_last_wins", "loss_buckets", "loss_cumavg", "loss_ema", "tflops",
    "label_logprob", "gae", "pair_loss", "stream_ema",
    # end-to-end flows of the reference: JSON -> token cache, cache -> batches,
    # preference data -> phase features
    "sft_cache_from_json", "training_batches", "prompt_dataset_phase2_train",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app_name="tuneweave-bench",
                      shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2)),
                      driver_memory="16g")
    reg = registry()
    # warm the JVM (class loading, code generation) and the Python workers on
    # the smallest tables so the first timed query is not charged with start-up
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("sft_tokens", "loss_ema"):
            reg[name][0](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        reg[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    rates = {}
    if not sys.argv[1:]:
        # rates of our own (the reference publishes none), from untimed counts
        from pyspark.sql import functions as F
        conv = reg["sft_tokens"][0](spark, sf_dir).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens")).first()
        blocks = reg["pack_blocks"][0](spark, sf_dir).agg(F.sum("n_tokens")).first()[0] or 0
        docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).count()
        rates = {
            "sft_conversations_per_sec": round(conv["rows"] / times["sft_tokens"], 1),
            "sft_tokens_per_sec": round((conv["tokens"] or 0) / times["sft_tokens"], 1),
            "pack_tokens_per_sec": round(blocks / times["pack_blocks"], 1),
            "split_rows_per_sec": round(docs / times["exact_split"], 1),
        }
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rates": rates, "sf": sf,
                      "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
