"""Registered queries for the dataset adapters.

The driver tables stand in for the hub datasets: prompt/answer pairs come from
adjacent conversation turns, labelled documents give scored answer pairs. Each
adapter's raw layout is shaped from them (in Spark and in the oracle SQL), then
the adapter spec produces the five strings and phase 1 keeps rows with a
prompt_and_chosen (F1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adapters import apply_adapter, phase_filter, spec
from ..operators.chat import instruct_to_conversation
from .tables import table

def _null() -> Column:
    return F.lit(None).cast("string")


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns directly followed by an assistant turn. ``rejected`` is the
    next assistant answer of the same conversation (turn + 3) if any; ``sys``
    is a system turn directly before the user turn, if any.

    Neighbours are found by equi-joins on ``(conv_id, turn)``, a unique key, so
    even one enormous conversation is spread over many tasks (a window by
    conversation would put it in one)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    answer = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("chosen"))
    later = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("rejected"))
    system = conv.filter(F.col("role") == "system").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("sys"))
    keys = ["conv_id", "turn"]
    return (user.join(answer, keys).join(later, keys, "left").join(system, keys, "left")
            .select("conv_id", "turn", "prompt", "chosen", "rejected", "sys"))


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: first line as question, text and a language-tagged variant as
    the two answers, quality/toxic as scores (null where there is no label: layouts
    that need a score then have no chosen answer and F1 drops the row). The join is
    left to the planner (AQE broadcasts the label table only when it is small)."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("question"),
        F.col("text").alias("answer"), F.concat("lang", F.lit(": "), "text").alias("alt"),
        "quality", "toxic")


def _st(**kv: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in kv.items()])


def _text_list(x: Column) -> Column:
    return F.when(x.isNull(), F.array().cast("array<struct<text:string>>")).otherwise(
        F.array(_st(text=x)))


SHAPES = {
    "Dahoas/rm-static": ("conv", lambda: ["prompt", "chosen", "rejected"]),
    "Dahoas/full-hh-rlhf": ("conv", lambda: ["prompt", "chosen", "rejected"]),
    "Dahoas/synthetic-instruct-gptj-pairwise": ("conv", lambda: ["prompt", "chosen", "rejected"]),
    "yitingxie/rlhf-reward-datasets": ("conv", lambda: [
        F.concat(F.lit(" Human: "), "prompt").alias("prompt"),
        F.concat(F.lit(" Human: "), "prompt", F.lit(" Assistant: "), "chosen").alias("chosen"),
        F.concat(F.lit(" Human: "), "prompt", F.lit(" Assistant: "), "rejected").alias("rejected")]),
    "openai/webgpt_comparisons": ("doc", lambda: [
        _st(full_text=F.col("question")).alias("question"), F.col("answer").alias("answer_0"),
        F.col("alt").alias("answer_1"), F.col("quality").cast("string").alias("score_0"),
        F.col("toxic").cast("string").alias("score_1")]),
    "stanfordnlp/SHP": ("doc", lambda: [
        F.col("question").alias("history"), F.col("answer").alias("human_ref_A"),
        F.col("alt").alias("human_ref_B"), F.col("quality").alias("labels")]),
    "pvduy/sharegpt_alpaca_oa_vicuna_format": ("conv", lambda: [
        F.concat(F.lit("USER: "), "prompt", F.lit(" ASSISTANT:")).alias("prompt"),
        F.col("chosen").alias("label")]),
    "local/jsonfile": ("conv", lambda: ["prompt", "chosen", "rejected"]),
    "wangrui6/Zhihu-KOL": ("conv", lambda: [F.col("prompt").alias("INSTRUCTION"),
                                            F.col("chosen").alias("RESPONSE")]),
    "Cohere/miracl-zh-queries-22-12": ("doc", lambda: [
        F.col("question").alias("query"), F.array(_st(text=F.col("answer"))).alias("positive_passages"),
        _text_list(F.when(F.col("toxic") == 1, F.col("alt"))).alias("negative_passages")]),
    "Hello-SimpleAI/HC3-Chinese": ("conv", lambda: [
        F.col("prompt").alias("question"), F.array("chosen", "rejected").alias("human_answers")]),
    "mkqa-Chinese": ("conv", lambda: [
        _st(zh_cn=F.col("prompt"), ja=F.col("prompt")).alias("queries"),
        _st(zh_cn=F.array(_st(text=F.col("chosen"))), ja=_text_list(F.col("rejected"))).alias("answers")]),
    "mkqa-Japanese": ("conv", lambda: [
        _st(zh_cn=F.col("prompt"), ja=F.col("prompt")).alias("queries"),
        _st(zh_cn=F.array(_st(text=F.col("chosen"))), ja=_text_list(F.col("rejected"))).alias("answers")]),
    "Cohere/miracl-ja-queries-22-12": ("doc", lambda: [
        F.col("question").alias("query"), F.array(_st(text=F.col("answer"))).alias("positive_passages"),
        _text_list(F.when(F.col("quality") == 0, F.col("alt"))).alias("negative_passages")]),
    "lmqg/qg_jaquad": ("conv", lambda: [F.col("prompt").alias("question"),
                                        F.col("chosen").alias("sentence")]),
    "lmqg/qag_jaquad": ("conv", lambda: [F.array("prompt", "sys").alias("questions"),
                                         F.col("chosen").alias("paragraph")]),
}

KEYS = {"conv": ["conv_id", "turn"], "doc": ["doc_id"]}


def shaped(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, list[str]]:
    kind, cols = SHAPES[name]
    base = conv_pairs(spark, sf_dir) if kind == "conv" else doc_pairs(spark, sf_dir)
    keys = KEYS[kind]
    return base.select(*keys, *cols()), keys


def adapted(spark: SparkSession, sf_dir: str, name: str, train_phase: int = 1) -> DataFrame:
    df, keys = shaped(spark, sf_dir, name)
    return phase_filter(apply_adapter(df, spec(name), keys), train_phase)


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return adapted(spark, sf_dir, name, 1)
    run.__name__ = "adapter_" + spec(name).clean_name
    return run


def pairs_from_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + F1 on adjacent user/assistant turns."""
    return adapted(spark, sf_dir, "local/jsonfile", 1).drop("rejected", "prompt_and_rejected")


def instruct_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instruction = user turn, input = the system turn right before it
    (empty if none), output = the assistant answer."""
    p = conv_pairs(spark, sf_dir).select(
        "conv_id", "turn", F.col("prompt").alias("instruction"),
        F.coalesce("sys", F.lit("")).alias("input"), F.col("chosen").alias("output"))
    c = instruct_to_conversation(p)
    return c.select("conv_id", "turn", F.col("conversations")[0]["role"].alias("role_0"),
                    F.col("conversations")[0]["content"].alias("content_0"),
                    F.col("conversations")[1]["role"].alias("role_1"),
                    F.col("conversations")[1]["content"].alias("content_1"))


# ------------------------------------------------------------------ oracle SQL

SQL_CONV_BASE = """base AS (
  SELECT conv_id, turn, text AS prompt, nx AS chosen,
         CASE WHEN r3 = 'assistant' AND t3 = turn + 3 THEN x3 END AS rejected,
         CASE WHEN pr = 'system' AND pt = turn - 1 THEN px END AS sys
  FROM (SELECT conv_id, turn, role, text,
               lead(role) OVER w AS nr, lead(turn) OVER w AS nt, lead(text) OVER w AS nx,
               lead(role, 3) OVER w AS r3, lead(turn, 3) OVER w AS t3, lead(text, 3) OVER w AS x3,
               lag(role) OVER w AS pr, lag(turn) OVER w AS pt, lag(text) OVER w AS px
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nr = 'assistant' AND nt = turn + 1)"""

SQL_DOC_BASE = """base AS (
  SELECT d.doc_id, split_part(d.text, chr(10), 1) AS question, d.text AS answer,
         d.lang || ': ' || d.text AS alt, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

_TL = "CASE WHEN {x} IS NULL THEN [] ELSE [{{'text': {x}}}] END"

SQL_SHAPES = {
    "Dahoas/rm-static": "prompt, chosen, rejected",
    "Dahoas/full-hh-rlhf": "prompt, chosen, rejected",
    "Dahoas/synthetic-instruct-gptj-pairwise": "prompt, chosen, rejected",
    "yitingxie/rlhf-reward-datasets": ("' Human: ' || prompt AS prompt, "
                                       "' Human: ' || prompt || ' Assistant: ' || chosen AS chosen, "
                                       "' Human: ' || prompt || ' Assistant: ' || rejected AS rejected"),
    "openai/webgpt_comparisons": ("{'full_text': question} AS question, answer AS answer_0, "
                                  "alt AS answer_1, CAST(quality AS VARCHAR) AS score_0, "
                                  "CAST(toxic AS VARCHAR) AS score_1"),
    "stanfordnlp/SHP": ("question AS history, answer AS human_ref_A, alt AS human_ref_B, "
                        "quality AS labels"),
    "pvduy/sharegpt_alpaca_oa_vicuna_format": ("'USER: ' || prompt || ' ASSISTANT:' AS prompt, "
                                               "chosen AS label"),
    "local/jsonfile": "prompt, chosen, rejected",
    "wangrui6/Zhihu-KOL": "prompt AS INSTRUCTION, chosen AS RESPONSE",
    "Cohere/miracl-zh-queries-22-12": (
        "question AS query, [{'text': answer}] AS positive_passages, "
        + _TL.format(x="CASE WHEN toxic = 1 THEN alt END") + " AS negative_passages"),
    "Hello-SimpleAI/HC3-Chinese": "prompt AS question, [chosen, rejected] AS human_answers",
    "mkqa-Chinese": ("{'zh_cn': prompt, 'ja': prompt} AS queries, "
                     "{'zh_cn': [{'text': chosen}], 'ja': " + _TL.format(x="rejected")
                     + "} AS answers"),
    "mkqa-Japanese": ("{'zh_cn': prompt, 'ja': prompt} AS queries, "
                      "{'zh_cn': [{'text': chosen}], 'ja': " + _TL.format(x="rejected")
                      + "} AS answers"),
    "Cohere/miracl-ja-queries-22-12": (
        "question AS query, [{'text': answer}] AS positive_passages, "
        + _TL.format(x="CASE WHEN quality = 0 THEN alt END") + " AS negative_passages"),
    "lmqg/qg_jaquad": "prompt AS question, chosen AS sentence",
    "lmqg/qag_jaquad": "[prompt, sys] AS questions, chosen AS paragraph",
}


def _h(p: str) -> str:
    return f"' Human: ' || {p} || ' Assistant:'"


def _hj(p: str, r: str) -> str:
    return f"' Human: ' || {p} || ' Assistant: ' || {r}"


def _strip(x: str) -> str:
    return (r"regexp_replace(regexp_replace(" + x + r", ' [\(\[][^\n]*?[\)\]]', '', 'g'), "
            r"'[\(\[][^\n]*?[\)\]]', '', 'g')")


def _human_sql(p: str, c: str, r: str | None) -> tuple[str, ...]:
    return (_h(p), f"' ' || {c}", f"' ' || {r}" if r else "CAST(NULL AS VARCHAR)", _hj(p, c),
            _hj(p, r) if r else "CAST(NULL AS VARCHAR)")


_W0 = ("CASE WHEN TRY_CAST(score_0 AS DOUBLE) IS NULL OR TRY_CAST(score_1 AS DOUBLE) IS NULL "
       "THEN NULL WHEN TRY_CAST(score_0 AS DOUBLE) {op} TRY_CAST(score_1 AS DOUBLE) "
       "THEN answer_0 ELSE answer_1 END")
_SHP = ("CASE WHEN TRY_CAST(labels AS INTEGER) IS NULL THEN NULL "
        "WHEN TRY_CAST(labels AS INTEGER) = 1 THEN {a} ELSE {b} END")
_SG_P = ("CASE WHEN prompt IS NOT NULL AND length(prompt) > 0 THEN "
         "replace(replace(prompt, 'USER', 'Human'), 'ASSISTANT', 'Assistant') END")
_SG_OK = "({c} IS NOT NULL AND length({c}) > 0)"

SQL_OUTPUTS = {
    "Dahoas/rm-static": ("prompt", "chosen", "rejected", "prompt || chosen", "prompt || rejected"),
    "Dahoas/full-hh-rlhf": ("prompt", "chosen", "rejected", "prompt || chosen", "prompt || rejected"),
    "Dahoas/synthetic-instruct-gptj-pairwise": _human_sql("prompt", "chosen", "rejected"),
    "yitingxie/rlhf-reward-datasets": (
        "prompt || 'Assistant:'", "string_split(chosen, 'Assistant:')[-1]",
        "string_split(rejected, 'Assistant:')[-1]", "prompt || chosen", "prompt || rejected"),
    "openai/webgpt_comparisons": _human_sql("question.full_text", _strip(_W0.format(op=">=")),
                                            _strip(_W0.format(op="<"))),
    "stanfordnlp/SHP": _human_sql("history", _SHP.format(a="human_ref_A", b="human_ref_B"),
                                  _SHP.format(a="human_ref_B", b="human_ref_A")),
    "pvduy/sharegpt_alpaca_oa_vicuna_format": (
        _SG_P, f"CASE WHEN {_SG_OK.format(c='label')} THEN ' ' || label END", "CAST(NULL AS VARCHAR)",
        f"CASE WHEN {_SG_OK.format(c='prompt')} AND {_SG_OK.format(c='label')} THEN "
        f"{_SG_P} || ' ' || label END", "CAST(NULL AS VARCHAR)"),
    "local/jsonfile": ("' ' || prompt", "' ' || chosen", "' ' || rejected",
                       "' ' || prompt || ' ' || chosen", "' ' || prompt || ' ' || rejected"),
    "wangrui6/Zhihu-KOL": _human_sql("INSTRUCTION", "RESPONSE", None),
    "Cohere/miracl-zh-queries-22-12": _human_sql("query", "positive_passages[1].text",
                                                 "negative_passages[1].text"),
    "Hello-SimpleAI/HC3-Chinese": _human_sql("question", "human_answers[1]", None),
    "mkqa-Chinese": _human_sql("queries.zh_cn", "answers.zh_cn[1].text", None),
    "mkqa-Japanese": _human_sql("queries.ja", "answers.ja[1].text", None),
    "Cohere/miracl-ja-queries-22-12": _human_sql("query", "positive_passages[1].text",
                                                 "negative_passages[1].text"),
    "lmqg/qg_jaquad": _human_sql("question", "sentence", None),
    "lmqg/qag_jaquad": _human_sql("questions[1]", "paragraph", None),
}


def adapter_sql(name: str, phase: int = 1) -> str:
    kind = SHAPES[name][0]
    keys = ", ".join(KEYS[kind])
    base = SQL_CONV_BASE if kind == "conv" else SQL_DOC_BASE
    outs = SQL_OUTPUTS[name]
    sel = ", ".join(f"{e} AS {n}" for e, n in zip(outs, ("prompt", "chosen", "rejected",
                                                          "prompt_and_chosen",
                                                          "prompt_and_rejected")))
    cond = "prompt_and_chosen IS NOT NULL"
    if phase == 2:
        cond += " AND prompt_and_rejected IS NOT NULL"
    return (f"WITH {base}, shaped AS (SELECT {keys}, {SQL_SHAPES[name]} FROM base), "
            f"adapted AS (SELECT {keys}, {sel} FROM shaped) "
            f"SELECT * FROM adapted WHERE {cond}")


SQL_PAIRS = (f"WITH {SQL_CONV_BASE} SELECT conv_id, turn, ' ' || prompt AS prompt, "
             "' ' || chosen AS chosen, ' ' || prompt || ' ' || chosen AS prompt_and_chosen "
             "FROM base WHERE (' ' || prompt || ' ' || chosen) IS NOT NULL")

SQL_INSTRUCT = (f"WITH {SQL_CONV_BASE} SELECT conv_id, turn, 'user' AS role_0, "
                "prompt || coalesce(sys, '') AS content_0, 'assistant' AS role_1, "
                "chosen AS content_1 FROM base")

QUERIES = {
    "pairs_from_turns": (pairs_from_turns, SQL_PAIRS),
    "instruct_conversation": (instruct_conversation, SQL_INSTRUCT),
}
for _name in SHAPES:
    QUERIES["adapter_" + spec(_name).clean_name.lower()
            + ("_ja" if _name == "mkqa-Japanese" else "_zh" if _name == "mkqa-Chinese" else "")] = (
        _query(_name), adapter_sql(_name))
