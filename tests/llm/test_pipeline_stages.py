"""Near-duplicate stage of the corpus pipeline on repeated rows, nulls and clashes."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, row long, id long, content string"


def test_one_of_each_group_stays(spark, tmp_path):
    long = " ".join(f"w{i % 97}x{i}" for i in range(400))
    texts = [(1, long), (1, long), (2, long + " end"), (3, "other words that stand alone here today"), (None, "no id at all in this one"),
             (None, "no id at all in this one"), (4, None), (4, None), (5, ""), (6, "short one"), (7, "short one"), (3, "a second text of id three is kept")]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, "en", "s", 1, "r", 2, 3, "c") for i, t in texts], SCHEMA).repartition(2).write.parquet(path)
    out = corpus_pipeline.near_duplicates(spark, spark.read.parquet(path), "")
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(1, long), (3, "other words that stand alone here today"), (None, "no id at all in this one"), (4, None), (4, None), (5, ""),
            (6, "short one"), (3, "a second text of id three is kept")]
    assert got == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert corpus_pipeline.near_duplicates(spark, spark.read.parquet(path), "").count() == 0
