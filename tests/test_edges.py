from pyspark.sql import functions as F

from tuneweave.operators.features import pack_text_blocks
from tuneweave.operators.order import dense_index, exact_split, rank_shards, seeded_rank
from tuneweave.operators.scans import exponential_mean, running_sums
from tuneweave.operators.tokens import build_vocabulary, tokenize


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    idx, n = dense_index(empty, ["doc_id"], "idx", return_count=True)
    assert n == 0 and idx.count() == 0
    assert exact_split(empty, "2,4,4", 1, ["doc_id"]).count() == 0
    assert rank_shards(seeded_rank(empty, 1, ["doc_id"]), 4).count() == 0
    v = build_vocabulary(F.col("text"), empty)
    assert v.size == 0
    assert tokenize(empty, "text", v, ["doc_id"], "ids").count() == 0
    assert pack_text_blocks(idx, "text", v, 8, 4).count() == 0
    log = spark.createDataFrame([], "k int, t long, x double")
    assert running_sums(log, ["k"], "t", {"s": F.col("x")}).count() == 0
    assert exponential_mean(log, ["k"], "t", F.col("x")).count() == 0


def test_unknown_words_map_to_unk(spark):
    train = spark.createDataFrame([(1, "a b")], "k int, t string")
    other = spark.createDataFrame([(1, "a zz <|endoftext|>")], "k int, t string")
    v = build_vocabulary(F.col("t"), train)
    assert tokenize(other, "t", v, ["k"], "ids").first().ids == [5, 4, 0]
