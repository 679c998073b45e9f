"""String expressions of the prompt templates (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .specials import ASSISTANT_JOIN, ASSISTANT_SUFFIX, HUMAN_PREFIX

# Citation brackets: "(...)" or "[...]" on one line, removed first with the
# leading space, then without. ``[^\n]`` keeps Python's meaning of "." (D11).
CITATION_WITH_SPACE = r" [\(\[][^\n]*?[\)\]]"
CITATION = r"[\(\[][^\n]*?[\)\]]"


def human_prompt(p: Column) -> Column:
    """``" Human: " + p + " Assistant:"``"""
    return F.concat(F.lit(HUMAN_PREFIX), p, F.lit(ASSISTANT_SUFFIX))


def human_join(p: Column, r: Column) -> Column:
    """``" Human: " + p + " Assistant: " + r`` (note the trailing space)."""
    return F.concat(F.lit(HUMAN_PREFIX), p, F.lit(ASSISTANT_JOIN), r)


def space(x: Column) -> Column:
    return F.concat(F.lit(" "), x)


def after_last(x: Column, marker: str) -> Column:
    """Text after the last ``marker`` (the whole text when absent)."""
    return F.substring_index(x, marker, -1)


def strip_citations(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, CITATION_WITH_SPACE, ""), CITATION, "")
