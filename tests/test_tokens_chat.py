import pytest
from pyspark.sql import functions as F

from tuneweave.functions.arrays import labels_from_mask, pad_clip, value_mask
from tuneweave.functions.specials import IGNORE_INDEX, SPECIAL_IDS
from tuneweave.operators.chat import sft_tokens, system_tokens
from tuneweave.operators.tokens import (WhitespaceTokenizer, build_vocabulary, eot_features, py_words,
                                        tokenize, tokenize_with)

TURNS = [
    (1, 0, "user", "hello  world"), (1, 1, "assistant", "hi there\nfriend"),
    (1, 2, "user", "bye"), (1, 3, "assistant", ""),
    (2, 0, "system", "be nice"), (2, 1, "user", "é ü 中文"), (2, 2, "assistant", "ok <|im_end|> ok"),
]


@pytest.fixture()
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")


def _vocab_dict(v):
    return {r.word: r.token_id for r in v.table.collect()}


def _py_sft(turns, vocab):
    tok = WhitespaceTokenizer(vocab)
    out = {}
    for cid in sorted({t[0] for t in turns}):
        ids, labels = [], []
        for _, _, role, text in sorted(t for t in turns if t[0] == cid):
            if role not in ("user", "assistant"):
                continue
            role_ids = [SPECIAL_IDS["<|im_start|>"]] + tok.encode(role)
            nl = [SPECIAL_IDS["\n"]]
            piece = role_ids + nl + tok.encode(text) + [SPECIAL_IDS["<|im_end|>"]] + nl
            if role == "user":
                lab = [IGNORE_INDEX] * len(piece)
            else:
                lab = [IGNORE_INDEX] * (len(role_ids) + 1) + piece[len(role_ids) + 1:]
            ids += piece
            labels += lab
        out[cid] = (ids, labels)
    return out


def test_vocabulary_ranks_by_count_then_word(spark, turns):
    v = build_vocabulary([F.col("text"), F.col("role")], turns)
    rows = sorted(v.table.collect(), key=lambda r: r.token_id)
    assert rows[0].token_id == 5
    keys = [(-r.n, r.word) for r in rows]
    assert keys == sorted(keys)
    assert "<|im_end|>" not in {r.word for r in rows}


def test_sft_tokens_match_plain_python(spark, turns):
    v = build_vocabulary([F.col("text"), F.col("role")], turns)
    want = _py_sft(TURNS, _vocab_dict(v))
    rows = sft_tokens(turns, v, on_unknown_role="drop_turn").collect()
    got = {r.conv_id: (r.input_ids, r.labels) for r in rows}
    assert got == want
    assert {r.conv_id: r.n_dropped for r in rows} == {1: 0, 2: 1}
    for ids, labels in got.values():
        assert len(ids) == len(labels)


def test_unknown_role_raises_by_default(spark, turns):
    v = build_vocabulary([F.col("text"), F.col("role")], turns)
    with pytest.raises(Exception, match="unsupported chat role"):
        sft_tokens(turns, v).collect()


def test_system_form_labels_and_padding(spark, turns):
    v = build_vocabulary([F.col("text"), F.col("role")], turns)
    out = {r.conv_id: r for r in system_tokens(turns, v, 24, "be nice", on_unknown_role="drop_turn").collect()}
    r = out[1]
    assert len(r.input_ids) == 24 and len(r.labels) == 24
    assert r.labels[0] == SPECIAL_IDS["<|im_start|>"]
    # system turn: im_start kept, body masked, im_end + newline kept
    sys_len = 1 + 1 + 1 + 2 + 2
    assert r.labels[1:sys_len - 2] == [IGNORE_INDEX] * (sys_len - 3)
    assert r.labels[sys_len - 2:sys_len] == [SPECIAL_IDS["<|im_end|>"], SPECIAL_IDS["\n"]]
    assert r.attention_mask == [int(x != 0) for x in r.input_ids]


def test_plugin_tokenizer_equals_vocabulary_job(spark, turns):
    v = build_vocabulary(F.col("text"), turns)
    vocab = _vocab_dict(v)
    job = {r.turn: r.ids for r in tokenize(turns.filter("conv_id = 1"), "text", v, ["turn"], "ids").collect()}
    plug = {r.turn: r.ids for r in tokenize_with(turns.filter("conv_id = 1"), "text",
                                                 lambda: WhitespaceTokenizer(vocab), "ids").collect()}
    assert job == plug


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a a b")], "k int, t string")
    v = build_vocabulary(F.col("t"), df)
    got = {r.k: r.ids for r in tokenize(df, "t", v, ["k"], "ids").collect()}
    assert got[1] is None and got[2] == [] and got[3] == [5, 5, 6]


def test_eot_features_truncate_pad_and_mask(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a"), (3, None)], "k int, t string")
    v = build_vocabulary(F.col("t"), df)
    out = {r.k: r for r in eot_features(df, "t", v, ["k"], 4).collect()}
    assert 3 not in out
    assert out[1].input_ids[:4] == out[1].input_ids and out[1].attention_mask == [1, 1, 1, 1]
    assert out[2].input_ids[1] == SPECIAL_IDS["<|endoftext|>"]
    assert out[2].attention_mask == [1, 1, 0, 0]


def test_pad_clip_both_sides_keeps_first(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6],)], "a array<int>")
    r = df.select(pad_clip(F.col("a"), 5, 0, "right").alias("r"),
                  pad_clip(F.col("a"), 5, 0, "left").alias("l")).collect()
    assert r[0].r == [1, 2, 3, 0, 0] and r[0].l == [0, 0, 1, 2, 3]
    assert r[1].r == [1, 2, 3, 4, 5] and r[1].l == [1, 2, 3, 4, 5]


def test_masks_and_labels(spark):
    df = spark.createDataFrame([([7, 0, 9],)], "a array<int>")
    r = df.select(value_mask(F.col("a"), 0).alias("m")).select(
        "m", labels_from_mask(F.array(F.lit(7), F.lit(0), F.lit(9)), F.col("m")).alias("l")).first()
    assert r.m == [1, 0, 1] and r.l == [7, -100, 9]


def test_py_words_matches_split_rules():
    assert py_words(" a\tb\n\nc<|im_end|>d ") == ["a", "b", "c", "<|im_end|>", "d"]


def test_plugin_chat_template_equals_vocabulary_job(spark, turns):
    from tuneweave.operators.chat import sft_tokens_with

    v = build_vocabulary([F.col("text"), F.col("role")], turns)
    vocab = _vocab_dict(v)
    job = {r.conv_id: (r.input_ids, r.labels)
           for r in sft_tokens(turns, v, on_unknown_role="drop_turn").collect()}
    plug = {r.conv_id: (r.input_ids, r.labels)
            for r in sft_tokens_with(turns, lambda: WhitespaceTokenizer(vocab),
                                     SPECIAL_IDS["<|im_end|>"], on_unknown_role="drop_turn",
                                     newline_ids=[SPECIAL_IDS["\n"]]).collect()}
    assert job == plug


def test_hf_tokenizer_file_plugin(spark, tmpdir_path):
    import os

    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import WhitespaceSplit

    from tuneweave.operators.tokens import HFTokenizerFile

    tok = Tokenizer(WordLevel({"[UNK]": 0, "hello": 1, "world": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = WhitespaceSplit()
    path = os.path.join(tmpdir_path, "tok.json")
    tok.save(path)
    df = spark.createDataFrame([(1, "hello world"), (2, "world zzz"), (3, None)], "k int, t string")
    out = {r.k: r.ids for r in tokenize_with(df, "t", HFTokenizerFile(path), "ids").collect()}
    assert out == {1: [1, 2], 2: [2, 0], 3: None}


def test_eot_pair_features_drop_rows_with_a_null(spark):
    from tuneweave.operators.tokens import eot_pair_features

    df = spark.createDataFrame([(1, "a b", "b"), (2, "c", None), (3, "a a a a a", "c")],
                               "k int, c string, r string")
    v = build_vocabulary([F.col("c"), F.col("r")], df)
    got = {r.k: tuple(r)[1:] for r in eot_pair_features(df, {"c_": "c", "r_": "r"}, v, ["k"], 4).collect()}
    a, b, c = (_vocab_dict(v)[w] for w in "abc")
    assert got == {1: ([a, b, 0, 0], [1, 1, 1, 0], [b, 0, 0, 0], [1, 1, 0, 0]),
                   3: ([a, a, a, a], [1, 1, 1, 1], [c, 0, 0, 0], [1, 1, 0, 0])}


def test_sft_tokens_max_tokens_is_a_prefix(spark, turns):
    from tuneweave.operators.chat import sft_tokens_with

    v = build_vocabulary([F.col("text"), F.col("role")], turns)
    vocab = _vocab_dict(v)
    full = {r.conv_id: (r.input_ids, r.labels, r.n_dropped)
            for r in sft_tokens(turns, v, on_unknown_role="drop_turn").collect()}
    for k in (1, 6, 7, 12, 100):
        want = {c: (i[:k], lab[:k], n) for c, (i, lab, n) in full.items()}
        out = sft_tokens(turns, v, on_unknown_role="drop_turn", max_tokens=k)
        assert {r.conv_id: (r.input_ids, r.labels, r.n_dropped) for r in out.collect()} == want
        out = sft_tokens_with(turns, lambda: WhitespaceTokenizer(vocab), SPECIAL_IDS["<|im_end|>"],
                              on_unknown_role="drop_turn", newline_ids=[SPECIAL_IDS["\n"]], max_tokens=k)
        assert {r.conv_id: (r.input_ids, r.labels, r.n_dropped) for r in out.collect()} == want


def test_own_system_turn_takes_the_place_of_the_message(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 5, "system", "be brief"), (1, 7, "system", "again"),
            (2, 0, "user", "a"), (3, 0, "tool", "x"), (3, 1, None, "y"), (4, 0, "system", "long " * 50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    v = build_vocabulary([F.col("text"), F.col("role")], df)
    word = {**_vocab_dict(v), **SPECIAL_IDS}
    out = {r.conv_id: r for r in system_tokens(df, v, 16, "be nice", on_unknown_role="drop_turn").collect()}
    own = [word[w] for w in ("<|im_start|>", "system", "\n", "be", "brief", "<|im_end|>", "\n")]
    assert out[1].input_ids[:7] == own and out[1].input_ids[7:11] == [word[w] for w in ("<|im_start|>", "user", "\n", "a")]
    assert out[1].labels[:7] == [own[0]] + [IGNORE_INDEX] * 4 + own[-2:]
    assert out[2].input_ids[3:5] == [word["be"], SPECIAL_IDS["<|unk|>"]]
    assert {c: r.n_dropped for c, r in out.items()} == {1: 1, 2: 0, 3: 2, 4: 0}
    assert out[4].input_ids == [word["<|im_start|>"], word["system"], word["\n"]] + [word["long"]] * 13
    with pytest.raises(Exception, match="unsupported chat role"):
        system_tokens(df.filter("conv_id = 3"), v, 16).collect()


def test_dictionary_blocks_of_any_size_give_the_same_ids(spark):
    """The vocabulary is larger than a block, and a block smaller than a text."""
    from tuneweave.operators.tokens import block_dictionaries, dictionary_blocks, with_ids

    texts = [" ".join(f"w{(i * 37 + j * j) % 5000}" for j in range(i % 90)) for i in range(400)] + [None, "", "zz <|im_end|>"]
    texts += [" ".join(f"w{j}" for j in range(6000))]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("u", F.upper("t")).repartition(3)
    v = build_vocabulary(F.col("t"), df)
    tok = WhitespaceTokenizer(_vocab_dict(v))
    for size in (1, 2_000, None):
        got = {r.k: (r.a, r.b) for r in with_ids(df, {"a": "t", "b": "u"}, v, ["k"], size).collect()}
        assert got == {i: (tok.encode(t), tok.encode(t and t.upper())) for i, t in enumerate(texts)}
    # a word is listed once a block, and blocks are many where they are small
    blocks = dictionary_blocks(df, ["t"], ["k"], 2_000)
    listed = block_dictionaries(blocks, ["t"], v)
    assert blocks.select("__block").distinct().count() > 10
    assert listed.count() == listed.select("__dict", "word").distinct().count()


def test_budgeted_plugin_reads_a_bounded_prefix(spark):
    from tuneweave.operators.tokens import budgeted_ids

    class Watched(WhitespaceTokenizer):
        read = 0

        def encode_batch(self, texts):
            Watched.read += sum(len(t) for t in texts)
            return super().encode_batch(texts)

    vocab = {f"w{i}": 5 + i for i in range(1000)}
    tok = Watched(vocab)
    long = " ".join(f"w{i % 1000}" for i in range(2_000_000))
    wide = " " * 50_000 + "w1" + " " * 90_000 + "w2 w3 w4"
    texts = [long, wide, None, "", "w1 w2", "x" * 10_000]
    whole = [None if t is None else tok.encode(t)[:64] for t in texts]
    Watched.read = 0
    assert budgeted_ids(tok, texts, 64) == whole
    assert Watched.read < 600_000 < len(long)

    class Whole:  # makes no promise: sees whole texts
        def encode_batch(self, texts):
            return [None if t is None else [len(t)] * 100 for t in texts]

    assert budgeted_ids(Whole(), [long, None], 3) == [[len(long)] * 3, None]
    df = spark.createDataFrame([(1, "w1 w2 w3"), (2, None)], "k int, t string")
    got = {r.k: r.ids for r in tokenize_with(df, "t", lambda: WhitespaceTokenizer(vocab), "ids", max_tokens=2).collect()}
    assert got == {1: [6, 7], 2: None}
