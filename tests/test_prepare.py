import json
import os

from tuneweave.functions.specials import IGNORE_INDEX, SPECIAL_IDS
from tuneweave.plans.prepare import (create_prompt_dataset, prepare_sft_cache, training_batches,
                                     unsupervised_blocks)


def _write(path, records):
    with open(path, "w") as f:
        json.dump(records, f)
    return path


def test_sft_cache_then_training_batches(spark, tmpdir_path):
    a = _write(os.path.join(tmpdir_path, "a.json"),
               [{"instruction": f"q{i} please", "input": "" if i % 2 else " ctx", "output": f"answer {i}"}
                for i in range(7)])
    b = _write(os.path.join(tmpdir_path, "b.json"),
               [{"instruction": "last one", "input": "", "output": "done"}])
    out = os.path.join(tmpdir_path, "cache")
    rows = prepare_sft_cache(spark, [a, b], out, key_tag="instruct", max_samples=6)
    got = sorted(rows.select("key", "idx", "input_ids", "labels").collect(), key=lambda r: r.idx)
    assert [r.key for r in got] == [f"instruct_idx_{i}" for i in range(6)]
    for r in got:
        assert len(r.input_ids) == len(r.labels)
        assert r.input_ids[0] == SPECIAL_IDS["<|im_start|>"]
        assert any(x != IGNORE_INDEX for x in r.labels)
    batches = training_batches(spark, out, max_seq_len=8, batch_size=2, sampler="distributed",
                               world_size=4, padding_side="left").collect()
    assert len(batches) == 8  # 6 padded to a multiple of 4
    assert {r.shard for r in batches} == {0, 1, 2, 3}
    assert all(len(r.input_ids) == 8 and len(r.attention_mask) == 8 for r in batches)
    seq = training_batches(spark, out, max_seq_len=8, batch_size=4, sampler="sequential").collect()
    assert sorted((r.pos, r.key) for r in seq) == [(i, f"instruct_idx_{i}") for i in range(6)]


def _pairs(spark, n, prefix):
    rows = [(f"{prefix} prompt {i}", f"good {i}", None if i % 4 == 0 else f"bad {i}") for i in range(n)]
    return spark.createDataFrame(rows, "prompt string, chosen string, rejected string")


def test_create_prompt_dataset_phases(spark, tmpdir_path):
    d1, d2 = _pairs(spark, 40, "a"), _pairs(spark, 30, "b")
    sft = spark.createDataFrame([(f"z{i}", f"y{i}") for i in range(10)], "INSTRUCTION string, RESPONSE string")
    tr, ev = create_prompt_dataset(spark, [("local/jsonfile", d1), ("Dahoas/rm-static", d2)], "2,4,4", 1,
                                   max_seq_len=16, sft_only=[("wangrui6/Zhihu-KOL", sft)])
    trr, evr = tr.collect(), ev.collect()
    assert sorted(r.order for r in trr) == list(range(len(trr)))
    assert {r.source for r in trr} == {"local/jsonfile", "Dahoas/rm-static", "wangrui6/Zhihu-KOL"}
    assert sum(1 for r in trr if r.source == "wangrui6/Zhihu-KOL") == 9  # 9:1 derived, all of train
    for r in trr:
        assert len(r.input_ids) == 16
        assert r.labels == [x if m else IGNORE_INDEX for x, m in zip(r.input_ids, r.attention_mask)]
    tr2, _ = create_prompt_dataset(spark, [("local/jsonfile", d1)], "2,4,4", 2, max_seq_len=16)
    r2 = tr2.collect()
    assert r2 and all(len(r.chosen_input_ids) == 16 and len(r.rejected_input_ids) == 16 for r in r2)
    tr3, _ = create_prompt_dataset(spark, [("Dahoas/synthetic-instruct-gptj-pairwise", d1)], "2,4,4", 3,
                                   max_seq_len=5)
    r3 = tr3.collect()
    assert all(len(r.prompt_input_ids) <= 5 and r.pad_token_id == 0 for r in r3)
    out_root = os.path.join(tmpdir_path, "prompt")
    a, _ = create_prompt_dataset(spark, [("local/jsonfile", d1)], "2,4,4", 1, max_seq_len=16,
                                 output_root=out_root)
    plain, _ = create_prompt_dataset(spark, [("local/jsonfile", d1)], "2,4,4", 1, max_seq_len=16)
    assert sorted(r.row_id for r in a.collect()) == sorted(r.row_id for r in plain.collect())
    (key,) = os.listdir(out_root)
    assert {"train", "eval", "complete"} <= set(os.listdir(os.path.join(out_root, key)))
    again, _ = create_prompt_dataset(spark, [("local/jsonfile", d1)], "2,4,4", 1, max_seq_len=16,
                                     output_root=out_root)
    assert again.count() == a.count()


def test_unsupervised_blocks(spark):
    corpus = spark.createDataFrame([(f"{' '.join(['w'] * (i + 1))} end",) for i in range(20)], "text string")
    blocks = unsupervised_blocks(spark, corpus, 4, 4, rows_per_group=5).collect()
    assert blocks and all(len(r.input_ids) == 8 for r in blocks)
    assert all(r.labels == r.input_ids for r in blocks)


def test_unsupervised_blocks_with_plugin(spark):
    from tuneweave.operators.tokens import CodePointTokenizer

    corpus = spark.createDataFrame([(i, "ab" * (i + 1)) for i in range(10)], "k long, text string")
    blocks = unsupervised_blocks(spark, corpus, 3, 3, rows_per_group=4, order_by=["k"],
                                 tokenizer_factory=CodePointTokenizer).collect()
    # groups of 4 rows: 2+4+6+8=20 -> 3 blocks, 10+12+14+16=52 -> 8 blocks, 18+20=38 -> 6 blocks
    assert sorted((r.group_id, len(r.input_ids)) for r in blocks) == \
        [(0, 6)] * 3 + [(1, 6)] * 8 + [(2, 6)] * 6
    assert blocks[0].input_ids[:2] == [ord("a") + 5, ord("b") + 5]


def test_prompt_dataset_ranks_ids_and_keeps_equal_records(spark, monkeypatch):
    import tuneweave.operators.order as order

    seen, real = [], order.materialize

    def spy(df, name="stage"):
        seen.append(set(df.columns))
        return real(df, name)

    monkeypatch.setattr(order, "materialize", spy)
    pairs = _pairs(spark, 30, "a")
    twice = pairs.unionByName(pairs).unionByName(pairs.limit(1))
    tr, ev = create_prompt_dataset(spark, [("Dahoas/rm-static", twice)], "10,0,0", 1, max_seq_len=8)
    rows = tr.collect() + ev.collect()
    assert len(rows) == 61 and len({r.row_id for r in rows}) == 61
    # the vocabulary's own index aside, ids and ranks only
    assert all(c <= {"row_id", "source", "__h", "__order", "__pid", "__mid"} for c in seen if "word" not in c)


def test_changed_inputs_are_no_hit(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from tuneweave.operators.tokens import build_vocabulary
    from tuneweave.plans import prepare

    d = _pairs(spark, 40, "a")
    root = os.path.join(tmpdir_path, "reuse")

    def build(df=d, **more):
        args = dict(max_seq_len=16, output_root=root) | more
        return create_prompt_dataset(spark, [("local/jsonfile", df)], "2,4,4", 1, **args)[0]

    first = sorted(build().select("row_id", "input_ids").collect())
    assert len(os.listdir(root)) == 1
    work, real = [], prepare._features
    prepare._features = lambda *a: work.append(1) or real(*a)
    try:
        assert sorted(build().select("row_id", "input_ids").collect()) == first and not work  # a hit does nothing
        assert sorted(build(d.repartition(5)).select("row_id", "input_ids").collect()) == first and not work
        other = build_vocabulary(F.col("chosen"), d)
        assert sorted(build(vocabulary=other).select("row_id", "input_ids").collect()) != first
        assert sorted(build(end_of_conversation_token=" end").select("row_id", "input_ids").collect()) != first
        changed = d.withColumn("chosen", F.when(F.col("prompt") == "a prompt 3", "other").otherwise(F.col("chosen")))
        build(changed)
        build(d.limit(39))
        assert len(work) == 4 and len(os.listdir(root)) == 5
    finally:
        prepare._features = real


def test_prompt_dataset_counts(spark):
    from tuneweave.plans.prepare import prompt_dataset_counts

    d = _pairs(spark, 40, "a")
    for phase in (1, 2, 3):
        counts = prompt_dataset_counts([("Dahoas/rm-static", d)], "10,0,0" if phase == 1 else "2,4,4", phase, max_seq_len=3)
        made = dict(zip(("train", "eval"), create_prompt_dataset(spark, [("Dahoas/rm-static", d)],
                                                                 "10,0,0" if phase == 1 else "2,4,4", phase, max_seq_len=3)))
        rows = {r.which: r for r in counts.collect()}
        for which, df in made.items():
            assert df.count() == (rows[which].kept if which in rows else 0)
        if phase == 2:
            assert sum(r.dropped for r in rows.values()) > 0
