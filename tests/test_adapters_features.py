from collections import Counter

import pytest
from pyspark.sql import functions as F

from tuneweave.operators.adapters import apply_adapter, phase_filter, resolve_adapter, spec
from tuneweave.operators.batches import batch_ids, mini_batches, prompt_collate, reward_collate
from tuneweave.operators.features import pack_blocks


def test_registry_substring_dispatch_and_unknown():
    assert resolve_adapter("/data/openai/webgpt_comparisons").name == "openai/webgpt_comparisons"
    assert resolve_adapter("mkqa-Japanese").name == "mkqa-Japanese"
    with pytest.raises(RuntimeError):
        resolve_adapter("nobody/knows")


def test_webgpt_choice_tie_and_citations(spark):
    rows = [({"full_text": "Q"}, "A [1] x (see) y [2", "B (c]", "1.0", "1.0"),
            ({"full_text": "Q"}, "A", "B [3]", "0", "2")]
    df = spark.createDataFrame(rows, "question struct<full_text:string>, answer_0 string, "
                                     "answer_1 string, score_0 string, score_1 string")
    out = apply_adapter(df, spec("openai/webgpt_comparisons")).collect()
    # tie: chosen answer_0, rejected answer_1; bracket pairs removed, unclosed kept
    assert out[0].chosen == " A x y [2"
    assert out[0].rejected == " B"
    assert out[0].prompt == " Human: Q Assistant:"
    assert out[0].prompt_and_chosen == " Human: Q Assistant: A x y [2"
    assert out[1].chosen == " B" and out[1].rejected == " A"


def test_sharegpt_null_empty_and_replace(spark):
    df = spark.createDataFrame([("USER: a ASSISTANT:", "b"), ("", "b"), (None, None)],
                               "prompt string, label string")
    out = apply_adapter(df, spec("pvduy/sharegpt_alpaca_oa_vicuna_format")).collect()
    assert out[0].prompt == "Human: a Assistant:" and out[0].prompt_and_chosen == "Human: a Assistant: b"
    assert out[1].prompt is None and out[1].prompt_and_chosen is None
    assert out[2].chosen is None and out[0].rejected is None


def test_miracl_empty_negatives_are_null_and_filtered(spark):
    df = spark.createDataFrame(
        [("q", [{"text": "p"}], []), ("q2", [{"text": "p2"}], [{"text": "n2"}])],
        "query string, positive_passages array<struct<text:string>>, "
        "negative_passages array<struct<text:string>>")
    a = apply_adapter(df, spec("Cohere/miracl-zh-queries-22-12"))
    assert phase_filter(a, 1).count() == 2
    assert phase_filter(a, 2).count() == 1
    assert a.first().rejected is None


def test_rlhf_reward_after_last_marker(spark):
    df = spark.createDataFrame([("P ", "x Assistant: y Assistant: z", "no marker")],
                               "prompt string, chosen string, rejected string")
    r = apply_adapter(df, spec("yitingxie/rlhf-reward-datasets")).first()
    assert r.chosen == " z" and r.rejected == "no marker" and r.prompt == "P Assistant:"


def test_pack_blocks_by_hand(spark):
    # groups of three rows, blocks of four; a group's rest is dropped once it has a block
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5]), (2, [6]), (3, [7]), (4, []), (5, [8, 9])],
                               "idx long, input_ids array<int>")
    got = pack_blocks(df, 4, 3, indexed=True).collect()
    assert sorted((r.group_id, r.input_ids) for r in got) == [(0, [1, 2, 3, 4]), (1, [7, 8, 9])]
    assert all(r.labels == r.input_ids for r in got)


def test_collation_keeps_shards_apart(spark):
    df = spark.createDataFrame([(s, 0, r, [s], [1], [s], [1]) for s in (0, 1) for r in (0, 1)],
                               "shard int, batch_id long, row_in_batch int, chosen_input_ids array<int>, chosen_attention_mask array<int>, "
                               "rejected_input_ids array<int>, rejected_attention_mask array<int>")
    got = sorted((r.shard, r.row_in_collated) for r in reward_collate(df).collect())
    assert got == [(s, r) for s in (0, 1) for r in range(4)]
    p = spark.createDataFrame([(0, 0, [3], [1]), (1, 0, [4, 3, 2, 1], [1, 1, 1, 1])],
                              "shard int, batch_id long, prompt_input_ids array<int>, prompt_attention_mask array<int>")
    assert {r.shard: r.prompt for r in prompt_collate(p, 2, 0).collect()} == {0: [0, 3], 1: [1, 2, 3, 4]}


def test_batches_reward_and_prompt_collation(spark):
    df = spark.createDataFrame([(i, [i, i], [1, 1], [i + 50], [1]) for i in range(5)],
                               "pos long, chosen_input_ids array<int>, chosen_attention_mask array<int>, "
                               "rejected_input_ids array<int>, rejected_attention_mask array<int>")
    b = batch_ids(df, 2, "pos")
    col = reward_collate(b, keys=["pos"]).collect()
    last = sorted((r.row_in_collated, r.side, r.pos) for r in col if r.batch_id == 2)
    assert last == [(0, 0, 4), (1, 1, 4)]
    first = sorted((r.row_in_collated, r.side, r.pos) for r in col if r.batch_id == 0)
    assert first == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)]
    p = spark.createDataFrame([(0, [3, 2, 1], [1, 1, 1]), (0, [9], [1])],
                              "batch_id long, prompt_input_ids array<int>, prompt_attention_mask array<int>")
    out = sorted(prompt_collate(p, 2, 0).collect(), key=lambda r: len(r.prompt_input_ids))
    assert out[0].prompt == [0, 0, 9] and out[0].prompt_att_mask == [0, 0, 1]
    assert out[1].prompt == [1, 2, 3]


def test_mini_batches_keep_complete_buffers(spark):
    df = spark.createDataFrame([(i,) for i in range(13)], "pos long")
    b = batch_ids(df, 4, "pos")  # batches of 4,4,4,1
    out = mini_batches(b, 4, 2, 3, 13).collect()
    assert sorted({r.buffer_id for r in out}) == [0, 1]
    minis = {}
    for r in out:
        minis.setdefault((r.buffer_id, r.mini_id), []).append(r.pos)
    assert sorted(len(v) for v in minis.values()) == [1, 1, 1, 1, 3, 3, 3]


def test_pack_text_blocks_equals_tokenize_then_pack(spark):
    from tuneweave.operators.features import pack_text_blocks
    from tuneweave.operators.order import dense_index
    from tuneweave.operators.tokens import build_vocabulary, tokenize

    texts = [(i, " ".join(f"w{(i * 7 + j) % 13}" for j in range(n)))
             for i, n in enumerate([5, 0, 17, 3, 40, 1, 9, 2, 33])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    v = build_vocabulary(F.col("text"), df)
    idx = dense_index(df, ["doc_id"], "idx")
    fused = pack_text_blocks(idx, "text", v, 8, 4).collect()
    tok = tokenize(idx, "text", v, ["doc_id", "idx"], "input_ids")
    two_step = pack_blocks(tok, 8, 4, indexed=True).collect()
    assert sorted((r.group_id, r.block_id, r.input_ids) for r in fused) == \
        sorted((r.group_id, r.block_id, r.input_ids) for r in two_step)
    keyed = pack_text_blocks(df, "text", v, 8, 4, key_col="doc_id", index=idx.select("doc_id", "idx"))
    assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, fused))
    # no exchange carries words: arrays leave the cogroup as slices of ids
    for line in _exchange_outputs(keyed):
        assert "array<string>" not in line


def _exchange_outputs(df):
    """The row type of everything that goes through an exchange of a plan."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
            continue
        if node.nodeName() == "Exchange":
            out.append(node.schema().simpleString())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert out
    return out


def test_custom_collator_per_batch(spark):
    from tuneweave.operators.batches import collate_with

    df = spark.createDataFrame([(0, i // 3, i) for i in range(7)], "shard int, batch_id long, v long")

    def total(pdf):
        return pdf.groupby(["shard", "batch_id"], as_index=False)["v"].sum()

    out = sorted((r.batch_id, r.v) for r in collate_with(df, total, "shard int, batch_id long, v long").collect())
    assert out == [(0, 3), (1, 12), (2, 6)]


def test_register_adapter_takes_precedence():
    from tuneweave.operators.adapters import AdapterSpec, _USER_SPECS, register_adapter

    mine = AdapterSpec("my/rm-static", "mine", None, prompt=lambda: F.col("p"), chosen=lambda: F.col("c"),
                       rejected=None, prompt_and_chosen=lambda: F.concat("p", "c"),
                       prompt_and_rejected=None)
    register_adapter("Dahoas/rm-static", mine)
    try:
        assert resolve_adapter("Dahoas/rm-static").clean_name == "mine"
    finally:
        _USER_SPECS.clear()
    assert resolve_adapter("Dahoas/rm-static").clean_name == "Dahoas_rm_static"


def test_words_are_counted_by_tasks(monkeypatch):
    import pyarrow as pa

    from tuneweave.operators import tokens

    batch = pa.RecordBatch.from_arrays(
        [pa.array(["a b a", None, "a b\x0bc  b", "", "x<|im_end|>y\tx"]), pa.array(["b"] * 5)], ["s", "t"])
    want = {"a": 2, "b": 7, "a b\x0bc": 1, "x": 2, "y": 1, "<|im_end|>": 1}
    got = [(r["word"], r["n"]) for b in tokens._word_counts([batch]) for r in b.to_pylist()]
    assert len(got) == len(want) and dict(got) == want  # a row a word, not an occurrence
    monkeypatch.setattr(tokens, "COUNTED_WORDS", 2)
    some = Counter()
    for b in tokens._word_counts([batch, batch]):
        some.update({r["word"]: r["n"] for r in b.to_pylist()})
    assert some == {w: 2 * n for w, n in want.items()}


def test_numbered_texts_of_several_blocks(monkeypatch):
    import pyarrow as pa

    from tuneweave.functions.specials import SPECIAL_IDS
    from tuneweave.operators import features
    from tuneweave.operators.tokens import py_words

    monkeypatch.setattr(features, "BLOCK_BYTES", 12)
    texts = ["b a b", None, "a c<|endoftext|>", "", "b\x0ba b", "d d d d d d d d", "a"]
    batches = [pa.RecordBatch.from_arrays([pa.array([3] * len(t), pa.int32()), pa.array(k, pa.int64()), pa.array(t, pa.string())], ["p", "k", "t"])
               for k, t in (([0, 1, 2, 3], texts[:4]), ([], []), ([4, 5, 6], texts[4:]))]
    rows = [r for b in features._numbered(batches) for r in b.to_pylist()]
    of = {}
    for r in rows:
        if r["word"] is not None:
            assert of.setdefault((r["__block"], r["code"]), r["word"]) == r["word"]
    special = {i: w for w, i in SPECIAL_IDS.items()}
    found = {r["__key"]: [special.get(c) or of[r["__block"], c] for c in r["__codes"]] for r in rows if r["word"] is None}
    assert found == {k: py_words(t or "") for k, t in enumerate(texts)}
    assert all(r["__len"] == len(r["__codes"]) for r in rows if r["word"] is None)
    assert len({r["__block"] for r in rows}) > 2


def test_pack_text_blocks_reads_and_cuts_texts_once(spark):
    from tuneweave.operators.features import pack_text_blocks
    from tuneweave.operators.order import dense_index
    from tuneweave.operators.tokens import build_vocabulary

    df = spark.createDataFrame([(i, f"a b{i % 3} <|endoftext|> c{i}") for i in range(30)], "doc_id long, text string")
    index = dense_index(df.select("doc_id"), ["doc_id"], "idx")
    out = pack_text_blocks(df, "text", build_vocabulary(F.col("text"), df), 8, 4, key_col="doc_id", index=index)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "text#" not in plan
    assert sum(len(r.input_ids) for r in out.collect()) == 7 * 16 + 8
