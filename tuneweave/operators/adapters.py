"""Dataset adapters (A1-A16), the name registry (S5), and phase filters
(F1-F3 counted by M11).

An adapter is a frozen spec of Column builders over the raw record columns: no
UDF, no Python per row. Every adapter yields the same five strings: prompt,
chosen, rejected, prompt_and_chosen, prompt_and_rejected. Where the reference
raises on a null or an empty list (D5) the result is null, and the row is
dropped by the phase filters.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.specials import ASSISTANT_JOIN, ASSISTANT_SUFFIX, HUMAN_PREFIX
from ..functions.text import after_last, human_prompt, human_join, space, strip_citations

OUTPUTS = ("prompt", "chosen", "rejected", "prompt_and_chosen", "prompt_and_rejected")

def _null() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class AdapterSpec:
    """Column builders for one dataset layout; ``None`` = no rejected
    response (the column is null and a warning is issued once)."""

    name: str
    clean_name: str
    natural_splits: tuple[str, str] | None  # (train, eval) split names; None = derived 9:1
    prompt: Callable[[], Column]
    chosen: Callable[[], Column]
    rejected: Callable[[], Column] | None
    prompt_and_chosen: Callable[[], Column]
    prompt_and_rejected: Callable[[], Column] | None

    def columns(self) -> dict[str, Column]:
        if self.rejected is None or self.prompt_and_rejected is None:
            warnings.warn(f"dataset {self.name} does not include rejected response", stacklevel=3)
        return {
            "prompt": self.prompt(),
            "chosen": self.chosen(),
            "rejected": self.rejected() if self.rejected else _null(),
            "prompt_and_chosen": self.prompt_and_chosen(),
            "prompt_and_rejected": self.prompt_and_rejected() if self.prompt_and_rejected else _null(),
        }


def apply_adapter(df: DataFrame, spec: AdapterSpec, keep: list[str] | None = None) -> DataFrame:
    cols = spec.columns()
    return df.select(*(keep or []), *[c.alias(n) for n, c in cols.items()])


def _c(name: str) -> Column:
    return F.col(name)


def _plain(p, c, r):
    return dict(prompt=lambda: _c(p), chosen=lambda: _c(c), rejected=lambda: _c(r),
                prompt_and_chosen=lambda: F.concat(_c(p), _c(c)),
                prompt_and_rejected=lambda: F.concat(_c(p), _c(r)))


def _webgpt_choice(chosen: bool) -> Column:
    s0, s1 = F.col("score_0").try_cast("double"), F.col("score_1").try_cast("double")
    pick0 = (s0 >= s1) if chosen else (s0 < s1)
    resp = F.when(s0.isNull() | s1.isNull(), _null()).when(pick0, _c("answer_0")).otherwise(
        _c("answer_1"))
    return strip_citations(resp)


def _shp_choice(chosen: bool) -> Column:
    lab = F.col("labels").try_cast("int")
    a, b = _c("human_ref_A"), _c("human_ref_B")
    first, second = (a, b) if chosen else (b, a)
    return F.when(lab.isNull(), _null()).when(lab == 1, first).otherwise(second)


def _sharegpt_prompt() -> Column:
    p = _c("prompt")
    return F.when(p.isNotNull() & (F.length(p) > 0),
                  F.replace(F.replace(p, F.lit("USER"), F.lit("Human")), F.lit("ASSISTANT"),
                            F.lit("Assistant")))


def _sharegpt_ok(col: str) -> Column:
    return _c(col).isNotNull() & (F.length(_c(col)) > 0)


def _first_text(arr: str) -> Column:
    return F.get(F.col(arr), 0)["text"]


def _human(p: Callable[[], Column], c: Callable[[], Column], r: Callable[[], Column] | None):
    return dict(prompt=lambda: human_prompt(p()), chosen=lambda: space(c()),
                rejected=(lambda: space(r())) if r else None,
                prompt_and_chosen=lambda: human_join(p(), c()),
                prompt_and_rejected=(lambda: human_join(p(), r())) if r else None)


SPECS: list[AdapterSpec] = [
    AdapterSpec("Dahoas/rm-static", "Dahoas_rm_static", ("train", "test"),
                **_plain("prompt", "chosen", "rejected")),
    AdapterSpec("Dahoas/full-hh-rlhf", "Dahoas_full_hh_rlhf", ("train", "test"),
                **_plain("prompt", "chosen", "rejected")),
    AdapterSpec("Dahoas/synthetic-instruct-gptj-pairwise",
                "Dahoas_synthetic_instruct_gptj_pairwise", None,
                **_human(lambda: _c("prompt"), lambda: _c("chosen"), lambda: _c("rejected"))),
    AdapterSpec("yitingxie/rlhf-reward-datasets", "yitingxie_rlhf_reward_datasets",
                ("train", "test"),
                prompt=lambda: F.concat(_c("prompt"), F.lit("Assistant:")),
                chosen=lambda: after_last(_c("chosen"), "Assistant:"),
                rejected=lambda: after_last(_c("rejected"), "Assistant:"),
                prompt_and_chosen=lambda: F.concat(_c("prompt"), _c("chosen")),
                prompt_and_rejected=lambda: F.concat(_c("prompt"), _c("rejected"))),
    AdapterSpec("openai/webgpt_comparisons", "openai_webgpt_comparisons", None,
                **_human(lambda: F.col("question")["full_text"], lambda: _webgpt_choice(True),
                         lambda: _webgpt_choice(False))),
    AdapterSpec("stanfordnlp/SHP", "stanfordnlp_SHP", ("train", "validation"),
                **_human(lambda: _c("history"), lambda: _shp_choice(True),
                         lambda: _shp_choice(False))),
    AdapterSpec("pvduy/sharegpt_alpaca_oa_vicuna_format",
                "pvduy_sharegpt_alpaca_oa_vicuna_format", ("train", "test"),
                prompt=_sharegpt_prompt,
                chosen=lambda: F.when(_sharegpt_ok("label"), space(_c("label"))),
                rejected=None,
                prompt_and_chosen=lambda: F.when(
                    _sharegpt_ok("prompt") & _sharegpt_ok("label"),
                    F.concat(_sharegpt_prompt(), F.lit(" "), _c("label"))),
                prompt_and_rejected=None),
    AdapterSpec("local/jsonfile", "local_jsonfile", ("train", "eval"),
                prompt=lambda: space(_c("prompt")), chosen=lambda: space(_c("chosen")),
                rejected=lambda: space(_c("rejected")),
                prompt_and_chosen=lambda: F.concat(F.lit(" "), _c("prompt"), F.lit(" "),
                                                   _c("chosen")),
                prompt_and_rejected=lambda: F.concat(F.lit(" "), _c("prompt"), F.lit(" "),
                                                     _c("rejected"))),
    AdapterSpec("wangrui6/Zhihu-KOL", "wangrui6_Zhihu_KOL", None,
                **_human(lambda: _c("INSTRUCTION"), lambda: _c("RESPONSE"), None)),
    AdapterSpec("Cohere/miracl-zh-queries-22-12", "Cohere_miracl_zh_queries_22_12",
                ("train", "dev"),
                **_human(lambda: _c("query"), lambda: _first_text("positive_passages"),
                         lambda: _first_text("negative_passages"))),
    AdapterSpec("Hello-SimpleAI/HC3-Chinese", "Hello_SimpleAI_HC3_Chinese", None,
                **_human(lambda: _c("question"), lambda: F.get(_c("human_answers"), 0), None)),
    AdapterSpec("mkqa-Chinese", "mkqa", None,
                **_human(lambda: F.col("queries")["zh_cn"],
                         lambda: F.get(F.col("answers")["zh_cn"], 0)["text"], None)),
    AdapterSpec("mkqa-Japanese", "mkqa", None,
                **_human(lambda: F.col("queries")["ja"],
                         lambda: F.get(F.col("answers")["ja"], 0)["text"], None)),
    AdapterSpec("Cohere/miracl-ja-queries-22-12", "Cohere_miracl_ja_queries_22_12",
                ("train", "dev"),
                **_human(lambda: _c("query"), lambda: _first_text("positive_passages"),
                         lambda: _first_text("negative_passages"))),
    AdapterSpec("lmqg/qg_jaquad", "lmqg_qg_jaquad", ("train", "validation"),
                **_human(lambda: _c("question"), lambda: _c("sentence"), None)),
    AdapterSpec("lmqg/qag_jaquad", "lmqg_qag_jaquad", ("train", "validation"),
                **_human(lambda: F.get(_c("questions"), 0), lambda: _c("paragraph"), None)),
]

_BY_NAME = {s.name: s for s in SPECS}
_USER_SPECS: list[tuple[str, AdapterSpec]] = []


def register_adapter(match: str, spec: AdapterSpec) -> None:
    """Add an adapter; user registrations are matched before built-ins. Registering
    the same one again changes nothing."""
    if (match, spec) not in _USER_SPECS:
        _USER_SPECS.append((match, spec))


def resolve_adapter(dataset_name: str) -> AdapterSpec:
    """Ordered **substring** dispatch on the dataset name; unknown names
    raise."""
    for match, spec in _USER_SPECS:
        if match in dataset_name:
            return spec
    for spec in SPECS:
        if spec.name in dataset_name:
            return spec
    raise RuntimeError(f"no adapter for dataset {dataset_name!r}; register one with "
                       "register_adapter()")


def spec(name: str) -> AdapterSpec:
    return _BY_NAME[name]


# ------------------------------------------------------------- phase filters

def phase_filter(adapted: DataFrame, train_phase: int) -> DataFrame:
    """F1 (phase 1): prompt_and_chosen present. F2 (phase 2): both joined
    forms present. Phase 3 filters on the tokenized prompt (F3, see
    ``prompt_length_filter``)."""
    if train_phase == 1:
        return adapted.filter(F.col("prompt_and_chosen").isNotNull())
    if train_phase == 2:
        return adapted.filter(F.col("prompt_and_chosen").isNotNull()
                              & F.col("prompt_and_rejected").isNotNull())
    if train_phase == 3:
        return adapted.filter(F.col("prompt").isNotNull())
    raise ValueError("train_phase must be 1, 2 or 3")


__all__ = ["AdapterSpec", "SPECS", "apply_adapter", "resolve_adapter", "register_adapter",
           "phase_filter", "OUTPUTS", "HUMAN_PREFIX", "ASSISTANT_SUFFIX", "ASSISTANT_JOIN"]
