"""Corpus pipeline: quality filter, near duplicates, personal data, mixing, packing.

Each stage works on all its predecessor kept and is written as Parquet before the
next one reads it. All but the last return the columns of ``documents``.

Defined results: a null text is an empty document and goes through every stage
(the classifier judges it, it has no near duplicates and no personal data, and it
packs to the end id alone); an empty table gives an empty result; extra columns of
``documents`` are carried up to the last stage. Of rows equal in doc_id and text one stays
behind the near-duplicate stage; the quality stage decides by doc_id, so rows of one id stay
together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneweave.llm import mixing, ngram_join, packing, pii, quality
from tuneweave.llm.common import GAP_CHARS, remainder, table
from tuneweave.session import materialize


def _by_row(docs: DataFrame, verdict: DataFrame, keep) -> DataFrame:
    """Rows of ``docs`` whose doc_id's verdict says keep."""
    wanted = verdict.filter(keep).select(F.col("doc_id").alias("kept_id"))
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(wanted, F.col("row.doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) == 1)
    return _by_row(docs, scored, F.col("predicted") == 1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, and one of
    the rows that are equal in doc_id and text."""
    joined = ngram_join.jaccard_classes(docs)
    first = F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))
    stays = joined.filter(first).select(F.col("doc_id").alias("kept_id")).distinct()
    # rows are numbered as the written table is read; a blank text has no copies
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"))
    blank = F.coalesce(F.btrim("row.text", F.lit(GAP_CHARS)), F.lit("")) == ""
    content = F.when(blank, F.col("rid").cast("string")).otherwise(F.sha2("row.text", 256))
    one = rows.groupBy(F.col("row.doc_id").alias("id"), content.alias("content")).agg(F.min("rid").alias("rid"))
    one = one.join(stays, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("rid")
    return rows.join(one, "rid", "left_semi").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.masked_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers of copies that bring the sources to their targets."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids."""
    return packing.pack(docs, keep_memo=False)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the sampling and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
