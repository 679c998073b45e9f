"""Snippets for the DuckDB oracle SQL (the same rules as the Spark code,
written as SQL text)."""

from __future__ import annotations

from ..functions.specials import INLINE_SPECIALS, SPECIAL_IDS

SPLIT = r"'[ \t\n\r\f]+'"


def isolate(expr: str) -> str:
    for s in INLINE_SPECIALS:
        expr = f"replace({expr}, '{s}', ' {s} ')"
    return expr


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({isolate(expr)}, {SPLIT}), lambda w: w <> '')"


def special_case(expr: str) -> str:
    parts = []
    for tok, i in SPECIAL_IDS.items():
        lit = "chr(10)" if tok == "\n" else f"'{tok}'"
        parts.append(f"WHEN {expr} = {lit} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


def specials_list() -> str:
    return ", ".join("chr(10)" if t == "\n" else f"'{t}'" for t in SPECIAL_IDS)


def vocab_cte(sources: list[tuple[str, str]]) -> str:
    """``vocab(word, n, token_id)`` over (table, text expression) pairs."""
    union = " UNION ALL ".join(
        f"SELECT unnest({words(expr)}) AS word FROM {tbl}" for tbl, expr in sources)
    return (f"vocab AS (SELECT word, n, CAST(4 + row_number() OVER (ORDER BY n DESC, word) "
            f"AS BIGINT) AS token_id FROM (SELECT word, count(*) AS n FROM ({union}) "
            f"WHERE word NOT IN ({specials_list()}) GROUP BY word))")


def id_of(word_expr: str, vocab_alias: str = "v") -> str:
    return f"coalesce({special_case(word_expr)}, {vocab_alias}.token_id, 4)"


def ints(expr: str, order: str) -> str:
    return f"coalesce(string_agg(CAST({expr} AS VARCHAR), ',' ORDER BY {order}), '')"
