import json
import os

import pytest
from pyspark.sql import functions as F

from tuneweave.operators.chat import conversations_to_turns, instruct_to_conversation
from tuneweave.sinks.metrics import scalar_series
from tuneweave.sinks.token_cache import cache_rows, content_key, persist_or_reuse, write_token_cache
from tuneweave.sources.files import (read_json_arrays, read_json_lines, read_local_pair,
                                     unsupervised_text_column)
from tuneweave.sources.token_cache import lookup, read_token_caches
from tuneweave.streaming.metrics_stream import read_sink, run_metrics


def test_json_array_and_lines_sources(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "a.json")
    b = os.path.join(tmpdir_path, "b.json")
    with open(a, "w") as f:
        json.dump([{"instruction": "Say", "input": " hi", "output": "hi"},
                   {"instruction": "é", "input": "", "output": "ü"}], f)
    with open(b, "w") as f:
        json.dump([{"instruction": "x", "input": "y", "output": "z"}], f)
    df = read_json_arrays(spark, [a, b])
    rows = sorted(df.collect(), key=lambda r: (r.file_ordinal, r.source_file, r.row_in_file))
    assert [r.instruction for r in rows] == ["Say", "é", "x"]
    # path order, not name order
    rev = sorted(read_json_arrays(spark, [b, a]).collect(),
                 key=lambda r: (r.file_ordinal, r.source_file, r.row_in_file))
    assert [r.instruction for r in rev] == ["x", "Say", "é"]
    conv = instruct_to_conversation(df)
    turns = conversations_to_turns(conv.withColumn("cid", F.monotonically_increasing_id()), "cid")
    assert {r.text for r in turns.filter("role = 'user'").collect()} == {"Say hi", "é", "xy"}
    jl = os.path.join(tmpdir_path, "c.jsonl")
    with open(jl, "w") as f:
        f.write('{"instruction": "a", "input": "b", "output": "c"}\n{"instruction": "d"}\n')
    assert read_json_lines(spark, jl).count() == 2


def test_local_pair_requires_both_files(spark, tmpdir_path):
    tr = os.path.join(tmpdir_path, "train.json")
    with open(tr, "w") as f:
        f.write('{"prompt": "p", "chosen": "c", "rejected": "r"}\n')
    with pytest.raises(RuntimeError):
        read_local_pair(spark, tr, os.path.join(tmpdir_path, "eval.json"))
    ev = os.path.join(tmpdir_path, "eval.json")
    with open(ev, "w") as f:
        f.write('{"prompt": "p2", "chosen": "c2", "rejected": null}\n')
    assert sorted(r.split for r in read_local_pair(spark, tr, ev).collect()) == ["eval", "train"]


def test_unsupervised_text_column(spark):
    assert unsupervised_text_column(spark.createDataFrame([("a", "b")], "x string, text string")) == "text"
    assert unsupervised_text_column(spark.createDataFrame([("a", "b")], "x string, y string")) == "x"


def test_token_cache_roundtrip_and_last_wins(spark, tmpdir_path):
    s0 = spark.createDataFrame([(i, [i, i], [-100, i]) for i in range(3)],
                               "conv_id long, input_ids array<int>, labels array<int>")
    s1 = spark.createDataFrame([(i, [9], [9]) for i in range(2)],
                               "conv_id long, input_ids array<int>, labels array<int>")
    p0, p1 = os.path.join(tmpdir_path, "c0"), os.path.join(tmpdir_path, "c1")
    write_token_cache(cache_rows(s0, "t", ["conv_id"]), p0)
    write_token_cache(cache_rows(s1, "t", ["conv_id"]), p1)
    keep = read_token_caches(spark, [p0, p1])
    assert keep.count() == 5
    assert lookup(keep, "t_idx_2").first().input_ids == [2, 2]
    last = read_token_caches(spark, [p0, p1], on_conflict="last")
    vals = sorted((r.key, r.store, r.input_ids) for r in last.collect())
    assert vals == [("t_idx_0", 0, [9]), ("t_idx_0", 1, [9]), ("t_idx_1", 0, [9]),
                    ("t_idx_1", 1, [9]), ("t_idx_2", 0, [2, 2])]


def test_content_key_reuse(spark, tmpdir_path):
    key = content_key(["a/b"], "2,4,4", 1, 1234, "tok", 512)
    assert len(key) == 64 and key != content_key(["a/b"], "2,4,4", 2, 1234, "tok", 512)
    calls = []

    def build():
        calls.append(1)
        return {"train": spark.range(3), "eval": spark.range(len(calls))}

    persist_or_reuse(spark, build, tmpdir_path, key)
    again = persist_or_reuse(spark, build, tmpdir_path, key)
    assert again["train"].count() == 3 and again["eval"].count() == 1 and len(calls) == 1
    # a build that ended before its marker is made anew, both results of it
    os.rename(os.path.join(tmpdir_path, key, "complete"), os.path.join(tmpdir_path, key, "lost"))
    assert persist_or_reuse(spark, build, tmpdir_path, key)["eval"].count() == 2
    assert persist_or_reuse(spark, build, tmpdir_path, key, reload=True)["eval"].count() == 3


def test_rewriting_a_tag_replaces_its_rows_only(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "cache")
    rows = spark.createDataFrame([(i, [i], [i]) for i in range(4)],
                                 "conv_id long, input_ids array<int>, labels array<int>")
    for tag in ("a", "b", "a"):
        write_token_cache(cache_rows(rows, tag, ["conv_id"]), path)
    got = spark.read.parquet(path).groupBy("key_tag").count().collect()
    assert sorted((r.key_tag, r["count"]) for r in got) == [("a", 4), ("b", 4)]


def test_missing_path_raises(spark, tmpdir_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_json_lines(spark, [os.path.join(tmpdir_path, "none.json")], ordered=True)


def test_scalar_series_unpivot(spark):
    df = spark.createDataFrame([(0, 5, 1.5, None), (0, 6, 2.5, 0.1)],
                               "epoch int, step int, loss double, lr double")
    s = scalar_series(df.withColumn("global_step", F.col("step")), {"loss": "loss", "lr": "lr"})
    assert sorted((r.tag, r.global_step) for r in s.collect()) == [("loss", 5), ("loss", 6), ("lr", 6)]


def test_stream_metrics_equal_batch_and_drop_late_rows(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    schema = "epoch int, step long, rank int, loss double, n int"
    batch1 = [(0, s, s % 2, float(s % 13), 1 + s % 3) for s in range(0, 300)]
    batch2 = [(0, 5, 1, 99.0, 1)] + [(0, s, s % 2, float(s % 13), 1 + s % 3) for s in range(300, 450)]
    import time

    spark.createDataFrame(batch1, schema).coalesce(1).write.parquet(os.path.join(src, "f1"))
    time.sleep(1.1)  # the file source takes files in modification order
    spark.createDataFrame(batch2, schema).coalesce(1).write.parquet(os.path.join(src, "f2"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(src, "*")))
    out = read_sink(spark, run_metrics(stream, alpha=0.9, report_every=100))
    late = out.filter("late").collect()
    assert [(r.rank, r.step) for r in late] == [(1, 5)]
    ok = {(r.rank, r.step): r for r in out.filter("not late").collect()}
    for rank in (0, 1):
        prev, total, cnt = None, 0.0, 0
        for s in [x for x in range(450) if x % 2 == rank]:
            x = float(s % 13)
            p = x if prev is None else prev
            prev = 0.9 * p + (1.0 - 0.9) * x
            total += x
            cnt += 1
            assert abs(ok[(rank, s)].ema - prev) <= 1e-12 * prev
            assert abs(ok[(rank, s)].cum_mean - total / cnt) <= 1e-12 * max(1.0, total)


def test_stream_does_not_depend_on_the_file_layout(spark, tmpdir_path):
    from tuneweave.operators.trainlog import cumulative_mean, ema, report_buckets
    from tuneweave.plans.tables import step_log, table
    from tuneweave.streaming.metrics_stream import step_log_stream

    sf = "/root/testdata/sf0.001"
    events, src = table(spark, sf, "events"), os.path.join(tmpdir_path, "unordered")
    # each file holds every fourth row, in descending order of steps
    for i in (3, 0, 2, 1):
        events.filter(F.col("event_id") % 4 == i).coalesce(1).sortWithinPartitions(
            F.desc("event_id")).write.parquet(os.path.join(src, f"part{i}"))
    log = step_log_stream(spark, os.path.join(src, "*"), events.schema)
    out = read_sink(spark, run_metrics(log, alpha=0.9, report_every=100))
    rows = {(r.rank, r.step): r for r in out.collect()}
    batch = step_log(spark, sf)
    assert out.count() == events.count() == len(rows) and not any(r.late for r in rows.values())
    for r in ema(batch).collect():
        assert abs(rows[(r["rank"], r.step)].ema - r.ema) <= 1e-12 * max(1.0, abs(r.ema))
    for r in cumulative_mean(batch).collect():
        assert abs(rows[(r["rank"], r.step)].cum_mean - r.cum_mean) <= 1e-12 * max(1.0, abs(r.cum_mean))
    s_b = sorted((r["rank"], r.bucket, r.step, r.bucket_rows) for r in rows.values() if r.report)
    assert s_b == sorted((r["rank"], r.bucket, r.report_step, r.n_rows)
                         for r in report_buckets(batch, F.col("step") % 100 == 0).collect())


def test_stream_equals_batch_operators(spark, tmpdir_path):
    from tuneweave.operators.trainlog import cumulative_mean, ema, report_buckets

    rows = [(0, s, s % 3, float((s * 7) % 19) / 3.0, 1 + s % 4) for s in range(0, 900)]
    schema = "epoch int, step long, rank int, loss double, n int"
    import time

    src = os.path.join(tmpdir_path, "log")
    df = spark.createDataFrame(rows, schema)
    # logs arrive in step order: three files of consecutive steps, written one
    # after the other (the file source takes them in modification order)
    for i, (lo, hi) in enumerate([(0, 300), (300, 650), (650, 900)]):
        df.filter((F.col("step") >= lo) & (F.col("step") < hi)).coalesce(1).write.parquet(
            os.path.join(src, f"part{i}"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        os.path.join(src, "*"))
    out = read_sink(spark, run_metrics(stream, alpha=0.9, report_every=100)).filter("not late")
    s_ema = {(r.rank, r.step): r.ema for r in out.collect()}
    s_cum = {(r.rank, r.step): r.cum_mean for r in out.collect()}
    b_ema = {(r.rank, r.step): r.ema for r in ema(df).collect()}
    b_cum = {(r.rank, r.step): r.cum_mean for r in cumulative_mean(df).collect()}
    assert s_ema.keys() == b_ema.keys()
    assert all(abs(s_ema[k] - b_ema[k]) <= 1e-12 * max(1.0, abs(b_ema[k])) for k in s_ema)
    assert s_cum.keys() == b_cum.keys()
    assert all(abs(s_cum[k] - b_cum[k]) <= 1e-12 * max(1.0, abs(b_cum[k])) for k in s_cum)
    s_b = sorted((r.rank, r.step, r.bucket_rows, r.bucket_avg) for r in out.filter("report").collect())
    b_b = sorted((r.rank, r.report_step, r.n_rows, r.avg_loss)
                 for r in report_buckets(df, F.col("step") % 100 == 0).collect())
    assert s_b == b_b


def test_stream_layouts_and_carry(spark, tmpdir_path):
    """One trigger or many, 1, 4 or 40 files in any order of writing: the same rows; late
    and repeated rows are counted, and a second run goes on from the first one's carry."""
    import random

    from tuneweave.streaming.metrics_stream import CARRY_SCHEMA, batch_metrics

    rng = random.Random(8)
    schema = "epoch int, step long, rank int, loss double, n int"
    rows = [(s // 300, s, s % 3, rng.uniform(-1, 1) * 10 ** rng.randint(-6, 6), rng.choice([1, 2, 3, None])) for s in range(700)]
    rows.append((9, 5, 7, 1.5, 2))
    results = {}
    for files in (1, 4, 40):
        src = os.path.join(tmpdir_path, f"log{files}")
        dealt = [rows[i::files] for i in range(files)]
        rng.shuffle(dealt)
        for i, part in enumerate(dealt):
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
        stream = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
        out = read_sink(spark, run_metrics(stream, alpha=0.99, report_every=50))
        results[files] = sorted(map(tuple, out.collect()), key=str)
    assert len(results[1]) == 701 and results[1] == results[4] == results[40]

    # micro-batches in step order, cut anywhere, chunks of any length
    carry = spark.createDataFrame([], CARRY_SCHEMA)
    got = []
    for lo, hi in ((0, 1), (1, 137), (137, 500), (500, 701)):
        out, carry = batch_metrics(spark.createDataFrame(rows[lo:hi], schema), carry, 0.99, 50, chunk=16)
        carry = spark.createDataFrame(carry.collect(), CARRY_SCHEMA)
        got += map(tuple, out.collect())
    got.sort(key=str)
    assert [r[:4] + r[6:9] for r in got] == [r[:4] + r[6:9] for r in results[1]]
    for a, b in zip(got, results[1]):
        assert a[5] == b[5] and a[9] == b[9]  # exact sums: the same bits
        assert abs(a[4] - b[4]) <= 1e-12 * max(1.0, abs(b[4]))
    # a late row, a repeated step and a rank without new rows
    out, carry = batch_metrics(spark.createDataFrame([(0, 3, 0, 1.0, 1), (2, 700, 0, 1.0, 1), (2, 700, 0, 2.0, 1)], schema),
                               carry, 0.99, 50)
    assert sorted((r.step, r.late) for r in out.collect()) == [(3, True), (700, False), (700, True)]
    assert {r["rank"]: (r.late_rows, r["last"].step) for r in carry.collect()} == {
        0: (2, 700), 1: (0, 697 + 1 if 698 % 3 == 1 else 697), 2: (0, 698), 7: (0, 5)}


def test_stream_restart_counts_each_row_once(spark, tmpdir_path):
    schema = "epoch int, step long, rank int, loss double, n int"
    src, out = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "out")
    for i in range(2):
        spark.createDataFrame([(0, 10 * i + s, 0, float(s), 1) for s in range(10)], schema).coalesce(1).write.parquet(
            os.path.join(src, f"f{i}"))
        stream = spark.readStream.schema(schema).parquet(os.path.join(src, "*"))
        run_metrics(stream, out, report_every=5)
    rows = {r.step: r for r in read_sink(spark, out).collect()}
    assert len(rows) == 20 and rows[19].cum_mean == 4.5 and [r.bucket for s, r in sorted(rows.items()) if r.report] == [0, 1, 2, 3]


def test_large_json_array_is_read_by_many_tasks(spark, tmpdir_path):
    import json

    from tuneweave.sources.files import CONVERSATION_SCHEMA, INSTRUCT_SCHEMA, read_json_arrays, read_large_json_arrays

    odd = ['}', '{', '"', '\\', '\\"}', '{"a": [1, {"b": "}"}]}', 'line\nbreak\t}', '\u00e9\U0001F600}{', '', '\\\\', ']', '[,]']
    records = [{"instruction": odd[i % len(odd)] + str(i), "input": odd[(i * 7) % len(odd)] * (i % 5),
                "output": "x}" * (i % 40), "extra": {"deep": [{"er": odd[i % 3]}, {}]}} for i in range(900)]
    records[5] = {"instruction": None, "output": "no input"}
    names = []
    for k, (indent, part) in enumerate(((None, records[:500]), (2, records[500:]), (None, []), (None, records[:1]))):
        names.append(os.path.join(tmpdir_path, f"{'zxya'[k]}.json"))
        with open(names[-1], "w") as f:
            json.dump(part, f, indent=indent, ensure_ascii=k == 0)
    order = ["file_ordinal", "source_file", "row_in_file"]
    fields = INSTRUCT_SCHEMA.fieldNames()
    want = [tuple(r) for r in read_json_arrays(spark, names).orderBy(*order).select(*fields).collect()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        whole, cut = read_json_arrays(spark, names[0]), spark.read.option("lineSep", "}").text(names[0])
        assert whole.rdd.getNumPartitions() == 1 < 5 < cut.rdd.getNumPartitions()
        got = [tuple(r) for r in read_large_json_arrays(spark, names).orderBy(*order).select(*fields).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(want) == 901 and got == want
    chats = [{"conversations": [{"role": "user", "content": f"q}}{i}"}, {"role": "assistant", "content": '"'}]} for i in range(40)]
    path = os.path.join(tmpdir_path, "chats.json")
    with open(path, "w") as f:
        json.dump(chats, f)
    got = read_large_json_arrays(spark, path, CONVERSATION_SCHEMA).orderBy(*order).collect()
    assert [[t.content for t in r.conversations] for r in got] == [[f"q}}{i}", '"'] for i in range(40)]
