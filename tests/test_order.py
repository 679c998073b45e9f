import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tuneweave.operators.order import (blend, dense_index, exact_split, rank_shards, seeded_rank,
                                       split_bounds, first_n)


@pytest.mark.parametrize("spec,n,expected", [
    ("2,4,4", 10, [0, 2, 6, 10]), ("1,1,1", 10, [0, 4, 7, 10]), ("1,1", 5, [0, 3, 5]),
    ("1,1", 3, [0, 1, 3]), ("9,1", 5, [0, 5, 5]), ("10,0,0", 7, [0, 7, 7, 7]),
])
def test_split_bounds_worked_examples(spec, n, expected):
    assert split_bounds(spec, n) == expected


def test_split_bounds_negative_raises():
    with pytest.raises(ValueError):
        split_bounds(",".join(["1"] * 8), 12)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_dense_index_equals_row_number(spark, parts):
    rows = [(i % 5, random.Random(i).random()) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(parts)
    got = dense_index(df, ["x"], "idx", num_partitions=parts)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("x")) - 1)
    j = got.join(ref, ["g", "x"])
    assert j.filter(F.col("idx") != F.col("rn")).count() == 0
    assert got.count() == 300


def test_dense_index_per_group_and_hot_key(spark):
    # one group holds most rows: the per-group index must still be dense
    rows = [(0 if i % 10 else i % 3 + 1, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v int")
    got = dense_index(df, ["v"], "t", partition_by=["g"], num_partitions=5)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1)
    assert got.join(ref, ["g", "v"]).filter(F.col("t") != F.col("rn")).count() == 0


def test_dense_index_ties_are_distinct(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "k int")
    got = dense_index(df, ["k"], "idx", num_partitions=4)
    idx = sorted(r.idx for r in got.collect())
    assert idx == list(range(100))
    assert max(r.idx for r in got.filter("k = 1").collect()) == 49


def test_seeded_rank_is_a_deterministic_permutation(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r.rank for r in seeded_rank(df, 7, ["doc_id"]).collect()}
    b = {r.doc_id: r.rank for r in seeded_rank(df.repartition(3), 7, ["doc_id"]).collect()}
    c = {r.doc_id: r.rank for r in seeded_rank(df, 8, ["doc_id"]).collect()}
    assert a == b
    assert sorted(a.values()) == list(range(200))
    assert a != c


def test_exact_split_parts_cover_and_match_bounds(spark):
    df = spark.range(103).withColumnRenamed("id", "doc_id")
    out = exact_split(df, "2,4,4", 1234, ["doc_id"]).collect()
    bounds = split_bounds("2,4,4", 103)
    sizes = [sum(1 for r in out if r.part == p) for p in range(3)]
    assert sizes == [bounds[i + 1] - bounds[i] for i in range(3)]
    assert len({r.doc_id for r in out}) == 103
    for r in out:
        assert bounds[r.part] <= r.rank < bounds[r.part + 1]


def _torch_like_shards(n, world):
    order = list(range(n))
    total = -(-n // world) * world
    pad = total - n
    order += (order * (-(-pad // n) if pad else 0))[:pad]
    return {r: order[r:total:world] for r in range(world)}


@pytest.mark.parametrize("n,world", [(10, 3), (7, 8), (12, 4), (1, 5)])
def test_rank_shards_match_distributed_sampler(spark, n, world):
    df = spark.createDataFrame([(i, i) for i in range(n)], "doc_id long, rank long")
    out = rank_shards(df, world).collect()
    want = _torch_like_shards(n, world)
    for r in range(world):
        got = [x.doc_id for x in sorted((x for x in out if x.shard == r), key=lambda x: x.shard_pos)]
        assert got == want[r]


def test_blend_and_first_n(spark):
    a = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    b = spark.createDataFrame([(str(i),) for i in range(3)], "id string")
    out = blend({"a": a, "b": b}, 1).collect()
    assert sorted(r.rank for r in out) == list(range(8))
    idx = dense_index(a, ["id"], "idx")
    assert first_n(idx, 2).count() == 2
    assert first_n(idx, 0).count() == 5


def test_dense_index_spreads_a_hot_key_over_partitions(spark, monkeypatch):
    import tuneweave.operators.order as order

    seen = []
    real = order.materialize

    def spy(df, name="stage"):
        out = real(df, name)
        seen.append(out)
        return out

    monkeypatch.setattr(order, "materialize", spy)
    rows = [(0 if i % 10 else i, i) for i in range(4000)]  # one key holds 90% of rows
    df = spark.createDataFrame(rows, "k long, v long").repartition(4)
    out = dense_index(df, ["k"], "idx", num_partitions=8)
    assert sorted(r.idx for r in out.collect()) == list(range(4000))
    sizes = [r["count"] for r in seen[0].groupBy("__pid").count().collect()]
    assert max(sizes) < 0.3 * 4000  # the hot key is split, not one task


def _written_columns(monkeypatch):
    import tuneweave.operators.order as order

    seen = []
    real = order.materialize

    def spy(df, name="stage"):
        seen.append(set(c for c in df.columns if not c.startswith("__p") and not c.startswith("__m")))
        return real(df, name)

    monkeypatch.setattr(order, "materialize", spy)
    return seen


def test_only_keys_go_through_the_index(spark, monkeypatch):
    from tuneweave.operators.order import phase_part, sft_only_append, train_eval_split

    df = spark.createDataFrame([(i if i else None, f"text {i}", i % 3) for i in range(200)], "doc_id long, text string, v int")
    plain = {(r.doc_id, r.text): r.rank for r in phase_part(df, "2,4,4", 2, 7, ["doc_id"]).collect()}
    a = df.select(F.col("doc_id").cast("string").alias("id"), "text")
    mixed = {(r.source, r.id): r.rank for r in blend({"a": a, "b": a.limit(50)}, 3).collect()}
    seen = _written_columns(monkeypatch)
    out = phase_part(df, "2,4,4", 2, 7, ["doc_id"], unique_ids=True)
    assert {(r.doc_id, r.text): r.rank for r in out.collect()} == plain and len(plain) == 80
    got = {(r.source, r.id): r.rank for r in blend({"a": a, "b": a.limit(50)}, 3, unique_ids=True).collect()}
    assert got == mixed
    both = train_eval_split(df, 7, ["doc_id"], unique_ids=True)
    assert both.count() == 200 and both.filter("split = 'eval'").count() == 20 and "text" in both.columns
    assert sft_only_append(got and a.withColumn("source", F.lit("a")), {"s": a}, 5, unique_ids=True).count() == 400
    assert seen and all(not c & {"text", "v"} for c in seen)
