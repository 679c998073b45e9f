"""Registered queries: seeded order, exact splits, blends, subsets
(V1-V3, P1-P3, U1-U2, F4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import (blend, dense_index, exact_split, first_n, phase_part,
                               seeded_rank, sft_only_append, subset, train_eval_split)
from .tables import table

SEED = 1234  # reference default seed
DATA_SPLIT = "2,4,4"  # reference default phase split
FIRST_N = 100


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars")


def shuffle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_rank(_docs(spark, sf_dir), SEED, ["doc_id"]).select("doc_id", "rank")


def exact_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_split(_docs(spark, sf_dir), DATA_SPLIT, SEED, ["doc_id"]).select(
        "doc_id", "rank", "part")


def phase_part_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phase_part(_docs(spark, sf_dir), DATA_SPLIT, 2, SEED, ["doc_id"], unique_ids=True).select(
        "doc_id", "rank")


def derived_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_eval_split(_docs(spark, sf_dir), SEED, ["doc_id"]).select(
        "doc_id", "rank", "split")


def eval_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    idx = train_eval_split(docs.select("doc_id"), SEED, ["doc_id"]).filter(
        F.col("split") == "eval").select("doc_id")
    return subset(docs, idx, "doc_id")


def first_n_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = dense_index(_docs(spark, sf_dir), ["doc_id"], "idx")
    return first_n(indexed, FIRST_N).select("doc_id", "idx")


def _blend_inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    conv = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"))
    return docs, conv


def blend_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, conv = _blend_inputs(spark, sf_dir)
    return blend({"documents": docs, "conversations": conv}, SEED, unique_ids=True).select("source", "id", "rank")


def sft_only_append_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, conv = _blend_inputs(spark, sf_dir)
    train = exact_split(docs, DATA_SPLIT, SEED, ["id"]).filter(F.col("part") == 0).select(
        "id", F.lit("documents").alias("source"))
    return sft_only_append(train, {"conversations": conv}, SEED).select("source", "id", "rank")


# ------------------------------------------------------------------ oracle SQL

def sql_rank(ids: str, seed: int = SEED) -> str:
    return f"row_number() OVER (ORDER BY md5(concat_ws('-', '{seed}', {ids})), {ids}) - 1"


def sql_bounds(data_split: str, n_expr: str) -> tuple[str, list[str]]:
    """SQL for the P1 bounds; returns (CTE body columns, bound names)."""
    ws = [float(x) for x in data_split.split(",")]
    tot = sum(ws)
    cum = []
    parts = []
    for i, w in enumerate(ws):
        parts.append(f"CAST(round_even(CAST({w / tot!r} AS DOUBLE) * {n_expr}, 0) AS BIGINT)")
        cum.append(" + ".join(parts))
    diff = f"(({cum[-1]}) - {n_expr})"
    cols = [f"({c}) - {diff} AS b{i + 1}" for i, c in enumerate(cum)]
    return ", ".join(cols), [f"b{i + 1}" for i in range(len(ws))]


def sql_part(rank: str, names: list[str]) -> str:
    arms = " ".join(f"WHEN {rank} < {b} THEN {i}" for i, b in enumerate(names))
    return f"CAST(CASE {arms} END AS INTEGER)"


def _split_sql(tbl: str, ids: str, data_split: str) -> str:
    cols, names = sql_bounds(data_split, "n")
    return (f"r AS (SELECT *, {sql_rank(ids)} AS rank FROM {tbl}), "
            f"cnt AS (SELECT count(*) AS n FROM {tbl}), bounds AS (SELECT {cols} FROM cnt), "
            f"sp AS (SELECT r.*, {sql_part('r.rank', names)} AS part FROM r, bounds)")


SQL_SHUFFLE_RANK = f"SELECT doc_id, {sql_rank('doc_id')} AS rank FROM documents"
SQL_EXACT_SPLIT = f"WITH {_split_sql('documents', 'doc_id', DATA_SPLIT)} SELECT doc_id, rank, part FROM sp"
SQL_PHASE_PART = f"WITH {_split_sql('documents', 'doc_id', DATA_SPLIT)} SELECT doc_id, rank FROM sp WHERE part = 1"
SQL_DERIVED = (f"WITH {_split_sql('documents', 'doc_id', '9,1')} SELECT doc_id, rank, "
               "CASE WHEN part = 0 THEN 'train' ELSE 'eval' END AS split FROM sp")
SQL_EVAL_SUBSET = (f"WITH {_split_sql('documents', 'doc_id', '9,1')} SELECT doc_id, n_chars "
                   "FROM documents WHERE doc_id IN (SELECT doc_id FROM sp WHERE part = 1)")
SQL_FIRST_N = (f"SELECT doc_id, idx FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 "
               f"AS idx FROM documents) WHERE idx < {FIRST_N}")

_SQL_BLEND_IN = ("src AS (SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS id FROM documents "
                 "UNION ALL SELECT 'conversations' AS source, concat_ws(':', conv_id, turn) AS id "
                 "FROM conversations)")
SQL_BLEND = (f"WITH {_SQL_BLEND_IN} SELECT source, id, {sql_rank('source, id')} AS rank FROM src")

_docs_ids = "dids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents)"
SQL_SFT_ONLY = (f"WITH {_docs_ids}, {_split_sql('dids', 'id', DATA_SPLIT)}, "
                "u AS (SELECT 'documents' AS source, id FROM sp WHERE part = 0 UNION ALL "
                "SELECT 'conversations' AS source, concat_ws(':', conv_id, turn) AS id FROM conversations) "
                f"SELECT source, id, {sql_rank('source, id')} AS rank FROM u")

QUERIES = {
    "shuffle_rank": (shuffle_rank, SQL_SHUFFLE_RANK),
    "exact_split": (exact_split_q, SQL_EXACT_SPLIT),
    "phase_part": (phase_part_q, SQL_PHASE_PART),
    "derived_split": (derived_split, SQL_DERIVED),
    "eval_subset": (eval_subset, SQL_EVAL_SUBSET),
    "first_n": (first_n_q, SQL_FIRST_N),
    "blend_shuffle": (blend_shuffle, SQL_BLEND),
    "sft_only_append": (sft_only_append_q, SQL_SFT_ONLY),
}
